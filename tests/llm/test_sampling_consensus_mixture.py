import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from genlex.llm import balanced as B
from genlex.llm import consensus as C
from genlex.llm import mixture as M


def test_flight_keeps_category_sums():
    rng = np.random.default_rng(0)
    p, cat = rng.random(5000), rng.integers(0, 7, 5000)
    q = B.flight(p, cat.astype(object), np.arange(5000), 1)
    for k in range(7):
        assert abs(q[cat == k].sum() - p[cat == k].sum()) < 1e-6
        assert ((q[cat == k] > 1e-9) & (q[cat == k] < 1 - 1e-9)).sum() <= 1


def test_flight_is_fair():
    """Every record is drawn about as often as its probability says."""
    hits = np.zeros(40)
    for seed in range(400):
        hits += B.flight(np.full(40, 0.25), np.array(["a"] * 40, dtype=object), np.arange(40), seed) == 1
    assert abs(hits.mean() / 400 - 0.25) < 0.01 and hits.min() > 55 and hits.max() < 150


def sample_inputs(spark, n=(900, 90, 9)):
    rows = [(k * 10_000 + i, s) for k, (s, m) in enumerate(zip(("Big-one", " mid", "tiny"), n, strict=True)) for i in range(m)]
    targets = spark.createDataFrame([("big_one", 0.5, 10), ("MID", 0.3, 10), ("tiny", 0.1, 20), ("none", 0.1, 5), (None, 0.5, 1)], "category string, target_share double, min_rows long")
    return spark.createDataFrame([*rows, (1_000_000, None), (1_000_001, "other"), (None, "tiny")], "id long, category string"), targets


def test_balanced_sample(spark):
    records, targets = sample_inputs(spark)
    drawn = B.balanced_sample(records.repartition(9), targets, 201)
    counts = {r["category"]: r["count"] for r in drawn.groupBy("category").count().collect()}
    assert counts["tiny"] == 9 and counts["big_one"] == 101 and counts["mid"] == 61 and "other" not in counts
    assert drawn.select("id").distinct().count() == drawn.count()
    cand = records.select(B.category_key(records["category"]).alias("category"), "id")
    rep = {r["category"]: r for r in B.imbalance(drawn, cand, targets, 201).collect()}
    assert rep["tiny"]["met"] is False and rep["none"]["met"] is False and rep["none"]["drawn"] == 0 and rep["mid"]["met"] and abs(rep["big_one"]["residual"]) <= 0.5
    assert len(rep) == 4


def test_sums_are_exact_and_targets_are_judged_by_the_draw(spark):
    rows = [(k, "abc"[k % 3]) for k in range(3_000)]
    records = spark.createDataFrame(rows, "id long, category string").repartition(13)
    targets = spark.createDataFrame([("a", 1 / 3, 1), ("b", 1 / 7, 1), ("b", 1 / 7, 1), ("c", 0.0, 1_001)], "category string, target_share double, min_rows long")
    drawn = B.balanced_sample(records, targets, 1_001)
    rep = {r["category"]: r for r in B.imbalance(drawn, records, targets, 1_001).collect()}
    assert {k: (r["drawn"], r["residual"], r["met"]) for k, r in rep.items()} == {"a": (334, 0.0, True), "b": (143, 0.0, True), "c": (1_000, 0.0, False)}
    short = B.imbalance(drawn.where("category <> 'b'"), records, targets, 1_001)
    assert [r["category"] for r in short.where("not met").orderBy("category").collect()] == ["b", "c"]  # there are enough, but they were not drawn


def test_whole_flight_is_exact():
    rng = np.random.default_rng(3)
    whole = np.full(999, 999, dtype=np.int64)
    q = B.flight(np.full(999, 334, dtype=np.int64), np.array(["a"] * 999, dtype=object), rng.permutation(999), 5, whole)
    assert sorted(set(q.tolist())) == [0, 999] and int((q == 999).sum()) == 334


def test_sample_of_nothing(spark):
    records, targets = sample_inputs(spark, (0, 0, 0))
    assert B.balanced_sample(records, targets, 10).count() == 0
    assert B.balanced_sample(records, targets.limit(0), 10).count() == 0


def test_instructions_count_once(spark):
    rows = [(5, "a", " x "), (3, "A ", "x"), (4, "a", None), (6, "a", " "), (7, None, "x"), (8, "a-b", "y"), (9, "A_B", "y"), (None, "a", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "pair_id long, source string, instruction string, text string")
    assert sorted(tuple(r) for r in B.instruction_records(df).collect()) == [(3, "a"), (8, "a_b")]


ANN = "dataset string, text_index long, text_index_dataset string, text string, original_annotation string, annotator_annotation string, annotator string, annotated_at timestamp, noun string, label int"


def annotations(spark, rows):
    """rows: (text, original, given, annotator, hour)"""
    return spark.createDataFrame([("d", t, "x", "t", o, g, a, None if h is None else datetime(2024, 1, 1, h), "clash", 9) for t, o, g, a, h in rows], ANN)


def test_usable_literals(spark):
    good = ["{'a': 1}", '{"a":0 , "b" : 1}', "{}", "{'a': 1, }", "{\"l'ami\": 1}", " {'a': 1.0} "]
    bad = [None, "", "  ", "{'a': 2}", "{'a': oui}", "{'a': -1}", '{"a": 1, "b', "{'a': '1'}", "{'a' 1}", "{'a': 11}"]
    df = spark.createDataFrame([(x,) for x in good + bad], "v string")
    assert [r[0] for r in df.select(C.usable(df["v"])).collect()] == [True] * len(good) + [False] * len(bad)
    one = spark.createDataFrame([("{'a': 1, \"l'b\": 0, 'a': 0}",)], "v string")
    assert [tuple(x) for x in one.select(C.entries(one["v"])).first()[0]] == [("l'b", 0), ("a", 0)]


def test_long_literals_need_no_stack(spark):
    many = "{" + ", ".join(f"'noun {k}': {k % 2}" for k in range(10_000)) + "}"
    wide = "{'" + "x" * 100_000 + "\\'" * 5_000 + "': 1}"
    broken = "{" + "'a': 1, " * 20_000 + "'b"
    df = spark.createDataFrame([(1, many), (2, wide), (3, broken), (4, "{'a': 1" + " " * 50_000 + "!")], "k int, v string")
    assert [r[0] for r in df.orderBy("k").select(C.usable(df["v"])).collect()] == [True, True, False, False]
    sizes = {r["k"]: r["n"] for r in df.where("k < 3").select("k", F.size(C.entries(df["v"])).alias("n")).collect()}
    assert sizes == {1: 10_000, 2: 1}
    again = spark.createDataFrame([("{" + "'a': 1, 'b': 0, " * 5_000 + "'a': 0}",)], "v string")
    assert [tuple(x) for x in again.select(C.entries(again["v"])).first()[0]] == [("b", 0), ("a", 0)]


def test_latest_usable_annotation_counts(spark):
    o = "{'a': 1, 'b': 0}"
    df = annotations(spark, [(1, o, "{'a': 0}", "X", 1), (1, o, "{'a': 1, 'zz': 1}", " x ", 2), (1, None, "{'a': 1", "x", 3), (1, o, "{'b': 1}", "y", None), (1, o, "{'b': 0}", "y", 0), (None, o, "{'a': 1}", "x", 1), (2, "broken", "{'a': 1}", "x", 1), (1, o, "{'a': 1}", None, 1)])
    got = sorted(tuple(r) for r in C.judgements(df).select("noun", "annotator", "original", "label").collect())
    assert got == [("a", "x", 1, 1), ("b", "y", 0, 0)]
    assert C.judgements(df.limit(0)).count() == 0


def votes(spark, rows):
    return spark.createDataFrame(rows, "item long, annotator string, label int")


def test_reliability_finds_the_careless(spark):
    rng = np.random.default_rng(1)
    rows = []
    for item in range(300):
        truth = int(rng.integers(0, 2))
        rows += [(item, a, truth if rng.random() < q else 1 - truth) for a, q in (("good", 0.96), ("fine", 0.9), ("fair", 0.75), ("coin", 0.5), ("bad", 0.15))]
    v = votes(spark, rows)
    w = {r["annotator"]: r for r in C.reliability(v, ["item"]).collect()}
    assert w["good"]["accuracy"] > w["fair"]["accuracy"] > w["coin"]["accuracy"] > w["bad"]["accuracy"] and w["bad"]["weight"] == 0 and w["good"]["n_items"] == 300


def test_agreement_and_ties(spark):
    v = votes(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 0), (2, "b", 0), (3, "a", 1), (4, "a", 1), (4, "b", 0), (4, None, 1), (4, "c", None)])
    items = C.consensus(v, C.reliability(v, ["item"]), ["item"])
    got = {r["item"]: r for r in items.collect()}
    assert (got[1]["consensus"], got[1]["observed"], got[3]["observed"], got[4]["n_ones"]) == (1, 1.0, None, 1)
    # Krippendorff's alpha by hand: pairable items 1, 2, 4; observed disagreement 2/6, expected 2*3*3/(6*5)
    assert C.krippendorff_alpha(items).first()["alpha"] == pytest.approx(1 - (2 / 6) / (18 / 30), abs=1e-6)
    none = v.limit(0)
    assert C.reliability(none, ["item"]).count() == 0 and C.krippendorff_alpha(C.consensus(none, C.reliability(none, ["item"]), ["item"])).first()["alpha"] is None


def shortest_paths(patterns, repeats, quota):
    """(total flow, cost) by successive shortest paths, one unit of use at a time: the definition."""
    cost = 0
    supply = {(k, u): t for k, (m, t) in enumerate(patterns) for u in range(1, sum(repeats[s] for s in m if s in quota) + 1)}
    names = list(quota)
    cap = {(k, s): t * repeats[s] for k, (m, t) in enumerate(patterns) for s in m if s in quota}
    arcs = []
    node = {("p", k): 1 + k for k in range(len(patterns))} | {("s", s): 1 + len(patterns) + j for j, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    for (k, u), t in supply.items():
        arcs.append([0, node["p", k], t, u - 1])
    for (k, s), c in cap.items():
        arcs.append([node["p", k], node["s", s], c, 0])
    for s in names:
        arcs.append([node["s", s], sink, quota[s], 0])
    edges = [e for a, b, c, w in arcs for e in ([a, b, c, w], [b, a, 0, -w])]
    flow = 0
    while True:
        dist, via = {0: 0}, {}
        for _ in range(sink + 1):
            for j, (a, b, c, w) in enumerate(edges):
                if c > 0 and a in dist and dist[a] + w < dist.get(b, 1e18):
                    dist[b], via[b] = dist[a] + w, j
        if sink not in dist:
            return flow, cost
        path, v = [], sink
        while v:
            path.append(via[v])
            v = edges[via[v]][0]
        push = min(edges[j][2] for j in path)
        for j in path:
            edges[j][2] -= push
            edges[j ^ 1][2] += push
        flow, cost = flow + push, cost + push * dist[sink]


def spread_cost(patterns, flow):
    out = 0
    for k, (_, t) in enumerate(patterns):
        used, n = sum(f for (p, _), f in flow.items() if p == k), 0
        while used > 0:
            out += min(used, t) * n
            used, n = used - t, n + 1
    return out


def test_flow_is_cheapest_and_maximal():
    import random

    rng = random.Random(11)
    for _ in range(150):
        names = "abcd"[: rng.randint(1, 4)]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        repeats, quota = {s: rng.randint(0, 3) for s in names}, {s: rng.randint(0, 60) for s in names}
        flow = M.shared_flow(patterns, repeats, quota)
        assert all(s in patterns[k][0] and f <= patterns[k][1] * repeats[s] for (k, s), f in flow.items())
        assert all(sum(f for (_, q), f in flow.items() if q == s) <= quota[s] for s in names)
        assert (sum(flow.values()), spread_cost(patterns, flow)) == shortest_paths(patterns, repeats, quota)


def test_greedy_by_source_would_repeat_needlessly():
    """Whoever chooses first must leave the shared text to the source that has nothing else."""
    flow = M.shared_flow([(("a", "b"), 100), (("a",), 100)], {"a": 1, "b": 1}, {"a": 100, "b": 100})
    assert flow == {(0, "b"): 100, (1, "a"): 100}


def test_many_patterns_and_repeats_end():
    import time

    patterns = [((f"s{k % 50}", f"s{(k * 7 + 1) % 50}"), 10 + k % 13) for k in range(20_000)]
    began = time.time()
    flow = M.shared_flow(patterns, {f"s{k}": 1_000_000 for k in range(50)}, {f"s{k}": 40_000 * (k + 1) for k in range(50)})
    assert sum(flow.values()) == 40_000 * 50 * 51 // 2 and time.time() - began < 60


def test_too_many_targets_raise(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 3)
    sized = spark.createDataFrame([(1, ["a"], 5)], "id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([(f"s{k}", 0.1, 1) for k in range(4)], "source string, target_weight double, max_repeats int")
    with pytest.raises(ValueError, match="targets"):
        M.plan_mixture(sized, targets)


def test_overlapping_sources_share():
    patterns = [(("a",), 100), (("a", "b"), 100), (("c",), 10)]
    flow, quota = M.route(patterns, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3)], 200)
    got = {s: sum(v for (_, q), v in flow.items() if q == s) for s in "abc"}
    assert got == {"a": 100, "b": 60, "c": 30} and quota["c"] == 40
    assert flow[(1, "b")] == 60 and flow.get((0, "a"), 0) >= 60  # nothing is used twice while unused text is left


def test_selection_follows_the_plan(spark):
    sized = spark.createDataFrame([(k, ["a"], 10) for k in range(200)] + [(1000 + k, ["b"], 7) for k in range(10)] + [(5000, ["a"], 0)], "id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([(" A", 0.4, 1, "clash"), ("b", 0.5, 3, "clash"), (None, 0.1, 1, "clash"), ("zz", 0.1, 2, "clash")], "source string, target_weight double, max_repeats int, tokens string")
    intervals, report = M.plan_mixture(sized, targets)
    rep = {r["key"]: r for r in report}
    assert rep["b"]["met"] is False and rep["b"]["routed"] == 210 and rep["a"]["met"] and rep["zz"]["available"] == 0
    chosen = M.select_documents(sized, intervals, buckets=16).toPandas()
    a, b = chosen[chosen.source == "a"], chosen[chosen.source == "b"]
    assert set(b.repeats) == {3} and len(b) == 10
    assert abs((a.tokens * a.repeats).sum() - rep["a"]["quota"]) <= 10 and set(a.repeats) == {1}
    again = M.select_documents(sized.repartition(7), intervals, buckets=16).toPandas()
    assert sorted(again.id) == sorted(chosen.id)


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer files")
def test_whole_mixture(spark):
    docs = spark.createDataFrame([(1, "un deux trois", " A ", "x"), (2, "quatre", "a", "x"), (3, None, "a", "x"), (4, " ", "a", "x"), (5, "cinq", None, "x"), (6, "<|endoftext|>", "b", "x")], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "source string, target_weight double, max_repeats int")
    chosen, report = M.mixture(docs, targets)
    assert {r["doc_id"] for r in chosen.collect()} <= {1, 2, 6}
    rep = {r["source"]: r for r in report.collect()}
    assert rep["b"]["available"] > 1  # the special token's spelling is ordinary text
    chosen, report = M.mixture(docs.limit(0), targets)
    assert chosen.count() == 0 and {r["taken"] for r in report.collect()} == {0}


def test_alternating_accuracies_settle(spark):
    rows = [(0, "a", 0), (0, "b", 1), (1, "b", 0), (1, "c", 1), (2, "c", 0)]
    votes = spark.createDataFrame(rows, "item int, annotator string, label int")
    got = C.reliability(votes, ["item"]).collect()
    assert max(r["moved"] for r in got) <= 1e-4
    early = C.reliability(votes, ["item"], max_rounds=2).collect()
    assert min(r["moved"] for r in early) > 1e-4


def test_a_text_of_two_sources_is_shared(spark):
    docs = spark.createDataFrame([(1, "Le pain.", "a"), (2, "Le pain.", "B "), (3, "Le pain.", "b"), (4, "Le vin.", "b")], "doc_id int, text string, source string")
    got = {r["id"]: (r["sources"], r["copies"]) for r in M.shared_documents(docs).collect()}
    assert got == {1: (["a", "b"], 2), 3: (["b"], 1), 4: (["b"], 1)}
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 1)], "source string, target_weight double, max_repeats int")
    plain, shared = (M.mixture(docs, targets, shared=x)[1].orderBy("source").collect() for x in (False, True))
    assert [(r["quota"], r["available"], r["met"]) for r in shared] == [(r["quota"], r["available"], r["met"]) for r in plain]
