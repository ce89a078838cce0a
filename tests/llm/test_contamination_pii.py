import random

import pytest
from pyspark.sql import functions as F

from genlex.llm import contamination as K
from genlex.llm import pii as P
from genlex.llm import pii_model as PM
from genlex.llm.pii_training import labelled_texts

WORDS = [f"mot{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
ITEM = " ".join(WORDS[:50])


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, toks string, n int")


def items(spark, *texts):
    return spark.createDataFrame([(100 + k, t, "clash", 1) for k, t in enumerate(texts)], "item_id long, text string, toks string, n int")


def pairs(df):
    return sorted((r["doc_id"], r["item_id"]) for r in df.collect())


def swapped(words, *at):
    return " ".join("autre" if k in at else w for k, w in enumerate(words))


def test_cases(spark):
    w = WORDS[:50]
    texts = [
        ITEM, ITEM.upper().replace(" ", " — "), "Avant. " + " ".join(w[10:30]) + " après.", " ".join(w[10:28]) + ".", swapped(w[5:25], 6, 13) + " fin du texte ici",
        swapped(w, *range(0, 50, 4)), "<p>" + ITEM.replace("motla", "<i>mo</i>tla") + "</p>", "> " + "\n> ".join(" ".join(w[k : k + 6]) for k in range(0, 50, 6)), ITEM.replace(" ", "[3] "), None, "", "rien ici",
        " ".join(w[:10]) + " " + " ".join(w[30:40]),
    ]
    assert pairs(K.leaks(docs(spark, *texts), items(spark, ITEM, None, ""))) == [(k, 100) for k in (0, 1, 2, 4, 6, 7, 8)]


def test_nineteen_words_are_no_case(spark):
    assert pairs(K.leaks(docs(spark, " ".join(WORDS[10:27])), items(spark, ITEM))) == []


def test_short_items_count_whole(spark):
    short = " ".join(WORDS[:9])
    got = K.leaks(docs(spark, "x " + short + " y", "x " + " ".join(WORDS[:8]) + " y", swapped(WORDS[:9], 4)), items(spark, short))
    assert pairs(got) == [(0, 100), (1, 100), (2, 100)]  # 8 of 9 words and one changed are within one in eight


def test_accents_and_composition(spark):
    item = " ".join(f"é{w}" for w in WORDS[:25])
    assert pairs(K.leaks(docs(spark, item.replace("é", "é"), item.replace("é", "e")), items(spark, item))) == [(0, 100)]


def test_empty_tables_and_repeats(spark):
    assert K.leaks(docs(spark, ITEM).limit(0), items(spark, ITEM)).count() == 0
    assert K.leaks(docs(spark, ITEM), items(spark, ITEM).limit(0)).count() == 0
    twice = docs(spark, ITEM).union(docs(spark, ITEM))
    assert pairs(K.leaks(twice, items(spark, ITEM, ITEM))) == [(0, 100), (0, 101)]


def test_long_document_is_aligned_only_near_seeds(spark):
    filler = " ".join(random.Random(0).choice(["le", "la", "un", "du", "vent", "soir"]) for _ in range(60_000))
    got = K.leaks(docs(spark, filler + " " + ITEM + " " + filler), items(spark, ITEM)).first()
    assert got["n_words"] == 50 and got["n_changed"] == 0


def test_against_brute_force(spark):
    """Random edits: a document is a case exactly if some 20 item words lie in it in a row with at most one in eight changed."""
    rng = random.Random(3)
    texts, want = [], []
    for k in range(60):
        n, a = rng.randint(12, 30), rng.randint(0, 20)
        part = WORDS[a : a + n]
        at = set(rng.sample(range(n), rng.randint(0, n // 6)))
        flags = [1 if j in at else 0 for j in range(n)]
        texts.append("bruit " * 5 + swapped(part, *at) + " bruit" * 5)
        # words of noise before and after the part count as changed ones of a longer stretch
        lo, hi = min(5, a), min(5, 50 - a - n)
        padded = [1] * lo + flags + [1] * hi
        ok = any(sum(padded[i:j]) * 8 <= j - i for i in range(len(padded)) for j in range(i + 20, len(padded) + 1))
        if ok:
            want.append((k, 100))
    assert pairs(K.leaks(docs(spark, *texts), items(spark, ITEM))) == want


def test_seed_length():
    assert K.seed_length(50, 20, 8) <= 6 and K.seed_length(9, 20, 8) == 4 and K.seed_length(3, 20, 8) == 3


def test_seed_lengths_of_a_column(spark):
    df = spark.range(1, 200).select(F.col("id").cast("int").alias("k"))
    for least, one_in in ((20, 8), (12, 5)):
        for r in df.select("k", K.seed_lengths(F.col("k"), least, one_in).alias("n")).collect():
            assert r["n"] <= K.seed_length(r["k"], least, one_in) and (r["n"] == K.seed_length(r["k"], least, one_in) or r["k"] >= least)
    assert K.context_length(20, 8) == 3


def test_rows_of_one_id_are_all_searched(spark):
    d = spark.createDataFrame([(1, ITEM), (1, "zzz tout autre chose"), (2, " ".join(WORDS[:25])), (2, ITEM)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_words"]) for r in K.leaks(d, items(spark, ITEM)).orderBy("doc_id").collect()] == [(1, 50), (2, 50)]


@pytest.mark.parametrize("share", [0.0, 0.001, 2.0])
def test_a_stock_phrase_is_no_evidence_alone(spark, share, monkeypatch):
    """A phrase of eight words in every document and every item: the same rows whatever counts as common, and few candidates if it does."""
    stock = "selon la coutume du pays tous les voisins"
    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS, k=30)) + f" {stock} " + " ".join(rng.choices(WORDS, k=30)) for _ in range(200)]
    bench = [" ".join(rng.choices(WORDS, k=14)) + f" {stock} " + " ".join(rng.choices(WORDS, k=14)) for _ in range(20)]
    texts += ["x " + b for b in bench[:5]] + [" ".join(b.split()[8:30]) for b in bench[5:10]]
    edited = bench[10].split()
    edited[13], edited[23] = "autre", "autre"
    texts.append(" ".join(edited[3:33]))
    counted = []
    monkeypatch.setattr(K, "PAIRS_PER_TASK", 10**9)
    inner = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df: counted.append(df.columns) or (counted.append(inner(df)) or counted[-1]))
    got = pairs(K.leaks(docs(spark, *texts), items(spark, *bench), common_share=share))
    assert got == [(200 + k, 100 + k) for k in range(10)] + [(210, 110)]
    tried = [c for c in counted if not isinstance(c, list)][-1].count()
    assert tried >= 4000 if share > 1 else tried < 60


def test_stretches_are_bounded_and_whole():
    import numpy as np

    item = np.arange(40)
    doc = np.concatenate([np.tile(np.r_[item[:6], [-1] * 6], 900), item, [-1] * 50])
    cut = K.stretches(doc, item, 6, 8, 500)
    assert max(b - a for a, b in cut) <= 500 and any(a <= 10_800 and 10_840 <= b for a, b in cut)
    assert K.stretches(doc[:3], item, 6, 8) == [] and K.stretches(np.full(30, -1), item, 6, 8) == []


GIVEN = ["Zoé", "Léon", "Rose"]


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "prenoms string")


def test_held_out_accuracy():
    given = PM.normal_given(GIVEN)
    weights = PM.trained_weights(given)
    hit = miss = extra = 0
    for text, gold in labelled_texts(500, 4242, sorted(given)):
        got, gold = set(PM.decode(text, weights, given)), set(gold)
        hit, miss, extra = hit + len(got & gold), miss + len(gold - got), extra + len(got - gold)
    assert hit / (hit + miss) > 0.96 and hit / (hit + extra) > 0.98


def test_found_values(spark):
    text = (
        "Selon Mme Zoé MARBOIS, rien. Tél. 01 99 00 94 64 ou zoe.marbois [arobase] atelier point test. Son passeport 99ZZ64404 est là. J'habite au 12 bis, rue des Lilas, 99163 Montclair depuis hier. "
        "La commande n° 2021004085 est partie. L'ISBN 978-0-00-108832-0. Rose est une fleur. Il reste 61 rues."
    )
    d = spark.createDataFrame([(1, text, "clash"), (2, None, "x"), (3, "", "x"), (4, "Rien.", "x")], "doc_id long, text string, kind string")
    got = {(r["kind"], r["found_text"]) for r in P.spans(d, names(spark, *GIVEN)).collect()}
    assert got == {("name", "Zoé MARBOIS"), ("phone", "01 99 00 94 64"), ("email", "zoe.marbois [arobase] atelier point test"), ("id_number", "99ZZ64404"), ("address", "12 bis, rue des Lilas, 99163 Montclair")}
    out = {r["doc_id"]: r for r in P.redact(d, names(spark, *GIVEN)).collect()}
    assert out[1]["text"].startswith("Selon Mme [NAME], rien. Tél. [PHONE] ou [EMAIL]. Son passeport [ID] est là. J'habite au [ADDRESS] depuis hier. La commande n° 2021004085")
    assert (out[2]["text"], out[2]["n_replaced"], out[3]["text"], out[4]["text"], out[1]["n_replaced"]) == (None, 0, "", "Rien.", 5)


def test_long_values_are_found_whole(spark):
    """No bound on the length of a value may lose it: it would be printed in clear."""
    email = ".".join(["jean", "paul", "de", "la", "tour"] * 12) + "@mail.service.ville.exemple.fr"
    d = spark.createDataFrame([(1, f"Écrire à {email} sans tarder."), (2, f"<{email}>")], "doc_id long, text string")
    assert {(r["doc_id"], r["found_text"]) for r in P.spans(d, names(spark, *GIVEN)).collect()} == {(1, email), (2, email)}
    assert P.redact(d, names(spark, *GIVEN)).where("doc_id = 1").first()["text"] == "Écrire à [EMAIL] sans tarder."


def test_forward_backward_is_the_sum_over_all_segmentations():
    import itertools
    import math

    rng = random.Random(4)
    for _ in range(60):
        segments = []
        for _ in range(rng.randint(1, 7)):
            a = rng.randint(0, 8)
            segments.append((a, a + rng.randint(1, 4), a, 0, rng.choice(PM.KINDS), [f"f{rng.randint(0, 5)}"]))
        weights = {f"f{k}": rng.uniform(-2, 2) for k in range(6)} | {f"{p}>{k}": rng.uniform(-1, 1) for p in ("O", *PM.KINDS) for k in PM.KINDS}
        for stretch in PM.chains(segments):
            total, mass, best = 0.0, dict.fromkeys(stretch, 0.0), (-1e9, None)
            for size in range(len(stretch) + 1):
                for chosen in itertools.combinations(sorted(stretch, key=lambda k: segments[k][0]), size):
                    if any(segments[i][1] > segments[j][0] for i, j in itertools.pairwise(chosen)):
                        continue
                    s, end, last = 0.0, None, "O"
                    for k in chosen:
                        s += weights[segments[k][5][0]] + weights[f"{last if end == segments[k][0] else 'O'}>{segments[k][4]}"]
                        end, last = segments[k][1], segments[k][4]
                    total += math.exp(s)
                    best = max(best, (s, chosen))
                    for k in chosen:
                        mass[k] += math.exp(s)
            probs, log_total = PM.marginals(segments, stretch, weights)
            assert log_total == pytest.approx(math.log(total))
            assert [sum(p.values()) for p in probs] == pytest.approx([mass[k] / total for k in stretch])
            path, s, end, last = PM._best_path(segments, stretch, weights), 0.0, None, "O"
            for k in path:
                s += weights[segments[k][5][0]] + weights[f"{last if end == segments[k][0] else 'O'}>{segments[k][4]}"]
                end, last = segments[k][1], segments[k][4]
            assert s == pytest.approx(best[0])


def test_transitions_are_trained():
    weights = PM.trained_weights(PM.normal_given(GIVEN))
    assert all(f"O>{k}" in weights for k in PM.KINDS) and any(f"{p}>{k}" in weights for p in PM.KINDS for k in PM.KINDS)


def test_positions_cut_the_text(spark):
    d = spark.createDataFrame([(1, "Écrire à a.b@c.fr ou au 06 12 34 56 78, merci.")], "doc_id long, text string")
    for r in P.spans(d, names(spark, *GIVEN)).collect():
        assert d.first()["text"][r["start"] : r["end"]] == r["found_text"]


def test_no_names_no_rows_long_text(spark):
    assert P.spans(spark.createDataFrame([], "doc_id long, text string"), names(spark)).count() == 0
    long = "Le vent souffle. " * 20_000 + "Écrire à a.b@c.fr sans tarder. " + "A" * 20_000 + " " + "1" * 20_000
    d = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert [r["found_text"] for r in P.spans(d, names(spark).limit(0)).collect()] == ["a.b@c.fr"] * 2


@pytest.mark.parametrize("kind", PM.KINDS)
def test_every_kind_has_a_placeholder(kind):
    assert kind in P.PLACEHOLDERS
