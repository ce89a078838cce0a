"""The tables behind the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genlex.functions import values as V

from .threads import split_classes


def class_counts(nouns: DataFrame, dictionary: DataFrame, top: int = 5) -> DataFrame:
    """R2, A2: each dataset's ``top`` classes by number of *distinct dictionary nouns* that occur in it; ties by class name.

    ``nouns``: (dataset, noun), ``dictionary``: (noun, merged_classes). The window runs over counts, one row per class.
    """
    used = nouns.select("dataset", "noun").distinct()
    classes = split_classes(dictionary.select("noun", F.col("merged_classes").alias("class")).distinct(), "class")
    counts = used.join(classes, "noun").groupBy("dataset", "class").agg(F.count(F.lit(1)).alias("freq"))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("freq"), "class"))
    return counts.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r")


def top_classes(counts: DataFrame, top: int = 5) -> DataFrame:
    """A3: the ``top`` classes by the sum of each dataset's already truncated counts, for every dataset, missing ones 0."""
    best = counts.groupBy("class").agg(F.sum("freq").alias("total")).orderBy(F.desc("total"), "class").limit(top).select("class")
    grid = counts.select("dataset").distinct().join(F.broadcast(best))  # best has `top` rows
    return grid.join(counts, ["dataset", "class"], "left").select("dataset", "class", F.coalesce("freq", F.lit(0)).alias("freq"))


def use_rate(scores: DataFrame) -> DataFrame:
    """Bias rate of scored texts, coverage before validation (share of rows with a log), rank by coverage.

    ``scores``: dataset, hn, mg and masc_gen_logs.
    """
    agg = scores.groupBy("dataset").agg(
        F.round(100 * F.avg(F.when(F.col("hn") > 0, (F.col("mg") > 0).cast("int"))), 6).alias("bias_rate_pct"), F.round(100 * F.count_if(F.size("masc_gen_logs") > 0) / F.count(F.lit(1)), 6).alias("coverage_pct")
    )
    return agg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("coverage_pct"), "dataset")))  # one row per dataset


def marker_rates(records: DataFrame) -> DataFrame:
    """Texts with each marker per dataset. Known false positives are left out of the counts, not of the denominator.

    ``records``: dataset, text_index, text_index_dataset and the log columns.
    """
    counted = F.coalesce(~F.col("text_index_dataset").isin(*V.FALSE_POSITIVES), F.lit(True))
    marks = {
        "incl_greetings": F.size("incl_greetings_logs") > 0, "neutral_prons": F.size("neutral_prons_logs") > 0, "incl_pairs": F.size("incl_pairs_logs") > 0, "neutral_words": F.size("neutral_logs") > 0,
        "fem_endings": (F.size("separator_logs") > 0) | (F.size("upper_logs") > 0),
    }
    agg = records.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.when(counted & c, F.col("text_index"))).alias(m) for m, c in marks.items()])
    long = agg.unpivot(["dataset", "n"], list(marks), "marker", "count")
    return long.select("dataset", "marker", "count", F.round(100 * F.col("count") / F.col("n"), 6).alias("pct"))
