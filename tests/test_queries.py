"""Every query with a SQL twin against DuckDB on the smallest tables, and the shape of a few plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from genlex.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    c.execute("set timezone = 'UTC'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_twin(spark, db, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(core.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = core.QUERIES["scan_filter_aggregate"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan.split("PushedFilters")[1] and "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_text_operators_stay_in_the_jvm(spark):
    for name in ("m_score_by_source", "marker_rates", "dedup_sequential", "seed_cosine"):
        assert "Python" not in core.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_every_spelling_of_a_language_counts(spark, tmp_path):
    docs = [(1, "Il faut lire.", "fr", "forum"), (2, "Il faut lire.", "FR", " forum"), (3, "Il faut lire.", "fr-FR", "FORUM"), (4, "Il faut lire.", " fr_CA ", None), (5, "Il faut lire.", None, "forum"), (6, "A person.", "EN", "Forum "), (7, "A person.", "en-EN", "forum"), (8, "A person.", "en", " ")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r[0] for r in core.QUERIES["whole_phrase_marker_counts"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    assert [tuple(r)[:2] for r in core.QUERIES["whole_definition_scores"](spark, str(tmp_path)).collect()] == [("forum", 1.0)]
    assert {tuple(r) for r in core._all_french(spark, str(tmp_path)).select("dataset", "text_id").collect()} == {("forum", 1), ("forum", 2), ("forum", 3), ("none", 4)}


def test_whole_lexicon_is_counted(spark, tmp_path):
    docs = [(1, "Le glarbier parle au maître de Prun. Le maître dort.", "FR", "forum"), (2, "Le boulanger dort.", "fr", "Forum")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lex = [(1, " Glarbier", "?", "model"), (2, "glar​bier", "N de Rang", "dmnt"), (3, "glarbier", "Divers", None), (4, "Maître de  prun", "Divers", "dmnt"), (5, None, "Divers", "dmnt")]
    spark.createDataFrame([(*x, None, None) for x in lex], "entry_id bigint, noun string, class string, origin string, subclass string, updated_at timestamp").write.parquet(f"{tmp_path}/lexicon_entries.parquet")
    spark.createDataFrame([("model", 1), ("dmnt", 2)], "origin string, trust_rank int").write.parquet(f"{tmp_path}/lexicon_origins.parquet")
    q = lambda name: sorted(tuple(r) for r in core.QUERIES[f"whole_{name}"](spark, str(tmp_path)).collect())
    assert q("masculine_generic_logs") == [(1, 1, "glarbier", 0), (1, 4, "maître de prun", 0), (2, 1, "boulanger", 0)]
    assert q("class_counts") == [("forum", "Divers", 1), ("forum", "N de Rang", 1), ("forum", "profession", 1)]
    assert [r[:5] for r in q("m_score_by_source")] == [("forum", 2, 2, 3, 3)]


def test_command_line(spark, tmp_path, capsys):
    from genlex.__main__ import main

    assert main([]) == 0 and "m_score_by_source" in capsys.readouterr().out.split()
    assert main(["none", DATA, str(tmp_path / "x")]) == 2 and main(["kappa"]) == 2
    assert main(["scan_filter_aggregate", DATA, str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == core.QUERIES["scan_filter_aggregate"](spark, DATA).count()
