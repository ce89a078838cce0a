"""Agreement of annotators and of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohen_kappa(pairs: DataFrame, a: str, b: str, canonical: bool = False) -> DataFrame:
    """Unweighted kappa of two label columns: ``(n, po, pe, kappa)``; kappa is null if pe = 1 or nothing is rated.

    Labels are whole strings, so key order counts; ``canonical=True`` compares the sorted parts of a dict literal. Rows with a
    null label are left out. Marginals come from the confusion matrix: one row per pair of labels, however many rows.
    """
    def label(c: str):
        x = F.col(c).cast("string")
        return F.array_join(F.array_sort(F.split(F.regexp_replace(F.translate(x, "'{}", '"'), r"\s+", ""), ",")), ",") if canonical else x

    m = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(label(a).alias("x"), label(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = m.groupBy("x").agg(F.sum("n").alias("nx")), m.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, "x").agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("c"))
    j = total.join(F.broadcast(chance))  # one row each
    po, pe = F.try_divide("same", "n"), F.try_divide(F.coalesce("c", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))
    return j.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def vote_table(*predictions: DataFrame) -> DataFrame:
    """Predictions of several models joined on word: p1.., q1.., ``votes`` and ``probability_sum``. Each: (word, prediction, probability)."""
    out = None
    for k, p in enumerate(predictions, 1):
        part = p.select("word", F.col("prediction").cast("int").alias(f"p{k}"), F.col("probability").alias(f"q{k}"))
        out = part if out is None else out.join(part, "word")
    n = range(1, len(predictions) + 1)
    return out.withColumn("votes", sum((F.col(f"p{k}") for k in n), F.lit(0))).withColumn("probability_sum", sum((F.col(f"q{k}") for k in n), F.lit(0.0)))


def disagreements(votes: DataFrame, positives: int = 2) -> DataFrame:
    """V5: words with exactly ``positives`` positive votes."""
    return votes.where(F.col("votes") == positives)


def unanimous(votes: DataFrame, models: int = 3, threshold: float = 0) -> DataFrame:
    """V6: words that all models call positive with a sum of probabilities of at least ``threshold``."""
    return votes.where((F.col("votes") == models) & (F.col("probability_sum") >= threshold))
