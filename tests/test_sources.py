import json
import sqlite3
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from genlex.sources import html, readers, writers
from genlex.streaming import scores


def test_pickle_and_sqlite(spark, tmp_path):
    pd.DataFrame({"noun": ["a", "b"]}).to_pickle(tmp_path / "x.pkl")
    assert readers.read_pickle(spark, str(tmp_path / "x.pkl")).count() == 2
    with pytest.raises(ValueError):
        readers.read_pickle(spark, "x.csv")
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table wikt (id integer, word text)")
        db.executemany("insert into wikt values (?, ?)", [(1, "a"), (2, None)])
    t = readers.read_sqlite(spark, str(tmp_path / "d.db"), "wikt", batch=1)
    assert [tuple(r) for r in t.orderBy("id").collect()] == [(1, "a"), (2, None)] and spark.table("wikt").count() == 2
    assert readers.read_values(t, "none") is None and readers.read_values(t.withColumn("alt", F.lit("z")), "word", "alt").collect()[1][0] == "z"


def test_text_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Prenoms\nZoé\nLéon\n", encoding="utf8")
    assert [r[0] for r in readers.first_names(spark, str(tmp_path / "n.csv")).collect()] == ["Zoé", "Léon"]
    (tmp_path / "l.txt").write_text("a\n\nb\n")
    assert readers.read_lines(spark, str(tmp_path / "l.txt")).count() == 2
    (tmp_path / "a.json").write_text(json.dumps([{"instruction": "i", "output": "o", "x": 1}]))
    (tmp_path / "bad.json").write_text("{[")
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), "instruction string, output string", "output").first()[0] == "o"
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        m = readers.merge_json(spark, [str(tmp_path / f) for f in ("a.json", "none.json", "l.txt")], "instruction string")
        assert m.count() == 1 and len(w) == 2
    assert readers.merge_json(spark, [], "instruction string").count() == 0
    for k, cols in enumerate(({"a": [1]}, {"a": [2], "b": [3]})):
        pd.DataFrame(cols).to_parquet(tmp_path / f"{k}.parquet")
    assert sorted(tuple(r) for r in readers.union_splits(spark, [str(tmp_path / f"{k}.parquet") for k in (0, 1)]).fillna(0).collect()) == [(1, 0), (2, 3)]
    (tmp_path / "w.csv").write_text("id,index,word,sum_prob\n0,1,ami,0.5\n")
    assert readers.read_words(spark, str(tmp_path / "w.csv")).first()[0] == "ami"
    with pytest.raises(ValueError):
        readers.read_words(spark, "x.txt")


def test_annotations(spark, tmp_path):
    head = "dataset\ttext_index\ttext_index_dataset\ttext\toriginal_annotation\tannotator_annotation\n"
    (tmp_path / "a.tsv").write_text(head + "d\t1\td_1\tx\t{'a': 1}\t{'a': 0}\n")
    assert readers.read_annotations(spark, str(tmp_path / "a.tsv")).first()["annotator_annotation_map"] == {"a": 0}
    (tmp_path / "b.tsv").write_text(head + "d\t7\td_1\tx\t{'a': 1}\t{'a': 2}\n")
    with pytest.raises(Exception, match="row 7"):
        readers.read_annotations(spark, str(tmp_path / "b.tsv")).collect()


def test_pages(spark):
    page = "<table><tr><td>h</td></tr><tr><td>1</td><td>2</td><td>Belge, Wallon (x)</td></tr></table>"
    one = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r["demonym"] for r in html.demonyms(one, "html", "page_id").collect()] == ["Belge", "Wallon"]
    nouns = "<h2>Corps</h2><p><b>Noms</b> <a>main</a> <a>ami</a> <a>main</a></p><h2>Autre</h2><p><b>Noms</b><a>roi</a></p>"
    two = spark.createDataFrame([(1, nouns)], "page_id long, html string")
    found = html.pages_to_rows(two, "html", html.section_nouns(("Corps",)), "pos int, noun string", "page_id")
    kept = html.without_words(found, "noun", spark.createDataFrame([("ami",)], "w string"))
    assert [r["noun"] for r in kept.collect()] == ["main"]
    zoo = "<table class='wikitable'><tr><th>x</th></tr>" + "".join(f"<tr><td>{a}</td></tr>" for a in ("<a>zèbre</a>", "humain", "âne gris", "chat", "aboiement", "cri")) + "</table>"
    three = spark.createDataFrame([(1, zoo)], "page_id long, html string")
    animals = html.animal_names(html.pages_to_rows(three, "html", html.animals, "pos int, animal string", "page_id"))
    assert [r[0] for r in animals.collect()] == ["âne", "chat", "zèbre"]


def test_definitions():
    root = html.parse("<div><span class='tlf_cdomaine'>DROIT</span><p><span class='tlf_ccrochet'>[pers.]</span><b><span class='tlf_cdefinition'>Celui qui juge :</span></b></p><span class='tlf_cdefinition'>Celui qui juge</span></div>")
    assert html.definitions(root) == [(0, "Celui qui juge", "[pers.]", "", "DROIT", "")]


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([("real", "g", "d", 1)], "validated string, dataset_group string, dataset string, x int")
    writers.write_results(rec, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["x"] == 1
    ins = spark.createDataFrame([(0, "q", "alpaca", 1)], "i int, instruction string, source string, neutral int")
    line = json.loads(writers.batch_requests(ins, "m").first()[0])
    assert line["custom_id"] == "alpaca_0_1" and line["body"]["messages"][0]["content"] == "q"
    arrays = writers.column_arrays(spark.createDataFrame([(2, "b"), (1, "a")], "i int, v string"), "i", ["v"])
    assert arrays.first()["v"] == ["a", "b"]
    writers.write_csv(ins, str(tmp_path / "c"), "\t")
    writers.write_lines(ins, "source", str(tmp_path / "t"))
    writers.write_table(ins, str(tmp_path / "p"), "source")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "alpaca" and spark.read.parquet(str(tmp_path / "p")).count() == 1
    entry = spark.createDataFrame([("A, B", "a", "s", [("d",)], "e", ["x"], "u", "p")], "completeWordForm string, wordForm string, wordType string, wordDefinitionFeatures array<struct<definition:string>>, etyhist string, derives array<string>, url string, parentWord string")
    row = writers.entry_rows(entry).first()
    assert row["derives"] == '["x"]' and row["parentWord"] == "p" and row["parentCompleteWord"] is None
    sheet = writers.annotator_sheet(spark.createDataFrame([("d", 1, "d_1", "t", {"a": 1})], "dataset string, text_index int, text_index_dataset string, text string, real_human_nouns map<string,int>"))
    assert tuple(sheet.first()) == ("d", 1, "d_1", "t", '{"a":1}', "")


def test_batch_output(spark, tmp_path):
    rows = [{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": '{"x": 1}'}}]}}}, {"error": 1}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert readers.read_batch_output(spark, str(tmp_path / "o.jsonl")).first()["verdicts"] == {"x": 1}


def test_streams(spark, tmp_path):
    schema = "dataset string, text_id string, text string, ts timestamp"
    spark.createDataFrame([("d", "1", "Tous et toutes."), ("d", "1", "Tous et toutes."), ("d", "2", "iel dort")], "dataset string, text_id string, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = scores.running_rates(scores.marker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("rates").first()) == ("d", 2, 1, 0, 1)
