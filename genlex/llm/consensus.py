"""Problem 6: a consensus label per item from several annotators, an agreement measure and a reliability per annotator.

Method: iteratively reweighted voting. Annotators start with equal weight; a weighted vote gives each item a consensus; each
annotator's accuracy is measured against the consensus of the others (leave-one-out) with smoothing; accuracies become the
next weights until they no longer move. Chance-corrected agreement is Krippendorff's alpha, which allows missing ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.session import materialize

from .lookalikes import BLANKS

# possessive throughout: what one part has read is never given back, so matching takes linear time and no stack however long a literal is
_QUOTED = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+")"""
_NUMBER = r"[01](?:\.0*+)?+"
DICT = rf"(?s)^\s*+\{{\s*+(?:{_QUOTED}\s*+:\s*+{_NUMBER}\s*+(?:,\s*+{_QUOTED}\s*+:\s*+{_NUMBER}\s*+)*+,?+\s*+)?+\}}\s*+$"
PAIR = rf"(?s)({_QUOTED})\s*+:\s*+([01])"


def usable(literal: Column) -> Column:
    """A complete dict literal, in either quoting style, whose values are all the number 0 or 1."""
    return F.coalesce(literal.rlike(DICT), F.lit(False))


def entries(literal: Column) -> Column:
    """``array<struct<noun, label>>`` of a usable literal; of a repeated key the last value counts, as in the literal itself."""
    keys = F.regexp_extract_all(literal, F.lit(PAIR), F.lit(1))
    values = F.regexp_extract_all(literal, F.lit(PAIR), F.lit(2))
    plain = F.transform(keys, lambda k: F.regexp_replace(F.substring(k, F.lit(2), F.length(k) - 2), r"(?s)\\(.)", "$1"))
    numbered = F.transform(F.arrays_zip(plain.alias("noun"), values.alias("label")), lambda x, i: F.struct(x["noun"].alias("noun"), i.alias("at"), x["label"].cast("int").alias("label")))
    in_order = F.array_sort(numbered)  # the entries of one key lie side by side, the last one behind
    shifted = F.concat(F.slice(in_order, F.lit(2), F.greatest(F.size(in_order), F.lit(1))), F.array(F.lit(None).cast("struct<noun:string,at:int,label:int>")))
    kept = F.filter(F.zip_with(in_order, shifted, lambda x, y: F.struct(x.alias("x"), (x["noun"].eqNullSafe(y["noun"])).alias("again"))), lambda p: p["x"].isNotNull() & ~p["again"])
    as_written = F.array_sort(F.transform(kept, lambda p: F.struct(p["x"]["at"].alias("at"), p["x"]["noun"].alias("noun"), p["x"]["label"].alias("label"))))
    return F.transform(as_written, lambda x: F.struct(x["noun"].alias("noun"), x["label"].alias("label")))


def judgements(annotations: DataFrame) -> DataFrame:
    """``(text_index, noun, original, annotator, label)``: the judged nouns that ``original_annotation`` has.

    Per annotator and text the latest usable annotation counts (null times are the earliest, ties go to the larger literal);
    annotator codes compare without case and blanks; rows without text or annotator are left out.
    """
    code = F.lower(F.regexp_replace(F.col("annotator"), f"^{BLANKS}|{BLANKS}$", ""))
    src = annotations.select("text_index", code.alias("annotator"), F.col("annotator_annotation").alias("given"), F.col("original_annotation").alias("original"), F.col("annotated_at").cast("timestamp").alias("at"))
    originals = src.where(usable(F.col("original")) & F.col("text_index").isNotNull()).groupBy("text_index").agg(F.max("original").alias("original"))
    items = originals.select("text_index", F.explode(entries(F.col("original"))).alias("e")).select("text_index", "e.noun", F.col("e.label").alias("original"))
    good = src.where(usable(F.col("given")) & F.col("text_index").isNotNull() & (F.col("annotator") != ""))
    newest = good.groupBy("text_index", "annotator").agg(F.max(F.struct(F.coalesce(F.unix_micros("at"), F.lit(-(2**62))).alias("at"), F.col("given"))).alias("v"))
    votes = newest.select("text_index", "annotator", F.explode(entries(F.col("v.given"))).alias("e")).select("text_index", "annotator", "e.noun", "e.label")
    return votes.join(items, ["text_index", "noun"]).select("text_index", "noun", "original", "annotator", "label")


def reliability(votes: DataFrame, item: list[str], smoothing: float = 2.0, tolerance: float = 1e-4, max_rounds: int = 30) -> DataFrame:
    """``(annotator, n_items, accuracy, weight, moved)``. ``votes``: item columns, annotator, label (0/1); one row per item and annotator.

    Per round: signed weighted vote per item, then for each vote the sign of what the others say, then the smoothed share of
    votes that agree (items that the others leave undecided count half; an annotator alone on an item gets no information
    from it). Weight = log odds of the accuracy, at least 0: who is no better than chance has no say. Ends when no accuracy
    moves by more than ``tolerance``, or after ``max_rounds``; once the largest movement no longer shrinks (weighted voting may
    alternate between two states), successive accuracies are averaged. ``moved`` is the last round's largest movement: above ``tolerance`` it is not stable.
    Votes without annotator or label are left out. Each round is two partially combined aggregates and one join over the written votes, an item or annotator may hold a
    third of all rows; one number per round comes to the driver.
    """
    rated = votes.where("annotator is not null and label is not null")
    v = materialize(rated.select(*item, "annotator", (F.col("label") * 2 - 1).alias("sign")))
    prior = F.lit(0.7)
    weights = materialize(v.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_items")).select("annotator", "n_items", F.lit(0.5).cast("double").alias("accuracy"), F.lit(1.0).alias("weight")))
    moved, last, damped = None, None, False
    for _ in range(max_rounds):
        w = v.join(weights.select("annotator", "weight"), "annotator").select(*item, "annotator", "sign", (F.col("sign") * F.col("weight")).alias("say"), "weight")
        total = w.groupBy(*item).agg(F.sum("say").alias("total"), F.count(F.lit(1)).alias("n"))
        seen = w.join(total, item).where("n > 1")
        others = F.round((F.col("total") - F.col("say")) * F.col("sign"), 9)
        agree = F.when(others > 0, 1.0).when(others < 0, 0.0).otherwise(0.5)
        acc = seen.groupBy("annotator").agg(F.sum(agree).alias("hits"), F.count(F.lit(1)).alias("tried"))
        fresh = weights.select("annotator", "n_items", F.col("accuracy").alias("before")).join(acc, "annotator", "left")
        smoothed = (F.coalesce("hits", F.lit(0.0)) + prior * smoothing) / (F.coalesce("tried", F.lit(0)) + smoothing)
        accuracy = (smoothed + F.col("before")) / 2 if damped else smoothed
        fresh = fresh.select("annotator", "n_items", "before", accuracy.alias("accuracy"))
        capped = F.least(F.greatest(F.col("accuracy"), F.lit(0.5)), F.lit(0.99))
        fresh = materialize(fresh.withColumn("weight", F.log(capped / (1 - capped))))
        moved = fresh.agg(F.max(F.abs(F.col("accuracy") - F.col("before")))).first()[0]
        weights = fresh.select("annotator", "n_items", "accuracy", "weight")
        if moved is None or moved <= tolerance:
            break
        damped = damped or (last is not None and moved >= last)
        last = moved
    return weights.withColumn("moved", F.lit(moved).cast("double"))


def consensus(votes: DataFrame, weights: DataFrame, item: list[str]) -> DataFrame:
    """Per item: number of votes, of votes for 1, the weighted consensus (ties go to the plain majority, then to 0), its margin and the plain agreement.

    ``observed`` is the share of annotator pairs that agree, null for an item with one vote.
    """
    w = votes.where("label is not null").join(weights.select("annotator", "weight"), "annotator")
    sums = w.groupBy(*item).agg(F.count(F.lit(1)).alias("n_votes"), F.sum(F.col("label").cast("bigint")).alias("n_ones"), F.sum((F.col("label") * 2 - 1) * F.col("weight")).alias("say"), F.sum("weight").alias("all"))
    say = F.round("say", 9)
    label = F.when(say > 0, 1).when(say < 0, 0).when(F.col("n_ones") * 2 > F.col("n_votes"), 1).otherwise(0)
    zeros = F.col("n_votes") - F.col("n_ones")
    pairs = F.col("n_votes") * (F.col("n_votes") - 1)
    observed = F.when(pairs > 0, (F.col("n_ones") * (F.col("n_ones") - 1) + zeros * (zeros - 1)) / pairs)
    margin = F.when(F.col("all") > 0, F.abs("say") / F.col("all")).otherwise(F.lit(0.0))
    return sums.select(*item, "n_votes", "n_ones", label.alias("consensus"), F.round(margin, 6).alias("margin"), F.round(observed, 6).alias("observed"))


def krippendorff_alpha(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(n_items, n_votes, observed_disagreement, expected_disagreement, alpha)`` over all items, or one row per value of ``by``.

    ``items``: n_votes and n_ones per item; items with fewer than two votes carry no information and are left out. alpha is
    null where only one label was ever given.
    """
    n, one = F.col("n_votes").cast("double"), F.col("n_ones").cast("double")
    pairable = items.where("n_votes > 1")
    s = pairable.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_votes").alias("n_votes"), F.sum(one).alias("ones"), F.sum(2 * one * (n - one) / (n - 1)).alias("d"))
    total, ones = F.col("n_votes").cast("double"), F.col("ones")
    observed = F.when(total > 0, F.col("d") / total)
    expected = F.when(total > 1, 2 * ones * (total - ones) / (total * (total - 1)))
    alpha = F.when(expected > 0, 1 - observed / expected)
    return s.select(*(by or []), "n_items", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.round(observed, 6).alias("observed_disagreement"), F.round(expected, 6).alias("expected_disagreement"), F.round(alpha, 6).alias("alpha"))
