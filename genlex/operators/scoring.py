"""Scores of texts and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_scores(records: DataFrame, real: bool = False) -> DataFrame:
    """``hn``, clamped ``mg``, ``m_score`` (null where hn = 0) and ``biased`` of every record.

    ``real=True`` reads the validated fields; records without verdict then count as 0 and are unscored.
    """
    hn_col, log_col = ("real_human_nouns_count", "real_masc_gen_logs") if real else ("human_noun_count", "masc_gen_logs")
    hn = F.coalesce(F.col(hn_col).cast("bigint"), F.lit(0))
    raw = F.coalesce(F.when(F.col(log_col).isNotNull(), F.size(log_col)), F.lit(0)).cast("bigint")
    out = records.withColumn("hn", hn).withColumn("mg", F.least(raw, F.col("hn")))
    return out.withColumn("m_score", F.when(F.col("hn") > 0, F.col("mg") / F.col("hn"))).withColumn("biased", F.when(F.col("hn") > 0, (F.col("mg") > 0).cast("int")))


def dataset_scores(scores: DataFrame, by: str = "dataset") -> DataFrame:
    """Totals, overall (micro) and mean (macro) score and bias rate of each dataset; null where nothing is scored."""
    agg = scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("hn") > 0).alias("n_scored"), F.sum("hn").alias("total_hn"), F.sum("mg").alias("total_mg"),
        F.avg("m_score").alias("mean_m_score"), F.avg("biased").alias("bias_rate"),
    )
    return agg.select(by, "n_texts", "n_scored", "total_hn", "total_mg", F.round(F.try_divide("total_mg", "total_hn"), 6).alias("overall_m_score"), F.round("mean_m_score", 6).alias("mean_m_score"), F.round("bias_rate", 6).alias("bias_rate"))


def histogram(scores: DataFrame, by: str = "dataset") -> DataFrame:
    """Scored texts per bin of width 0.1 (0 to 10; rounding keeps 0.3 in bin 3)."""
    bin_ = F.floor(F.round(F.col("m_score") * 10, 9)).cast("int")
    return scores.where("m_score is not null").groupBy(by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
