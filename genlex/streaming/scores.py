"""Streaming forms of the per-text operators: they keep no state per text, dataset totals are a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genlex.operators.markers import phrase_markers


def marker_stream(texts: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """T12-T14 on a stream of (dataset, text_id, text, time): the phrase logs, each text once within the watermark."""
    fresh = texts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["text_id"])
    return fresh.withColumns(phrase_markers(F.col("text")))


def running_rates(marked: DataFrame) -> DataFrame:
    """Texts and texts with each marker per dataset so far (complete or update mode)."""
    size = lambda c: F.sum((F.size(c) > 0).cast("bigint"))
    return marked.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_texts"), *[size(f"{m}_logs").alias(m) for m in ("incl_greetings", "incl_pairs", "neutral_prons")])


def windowed_scores(scores: DataFrame, time_col: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """V4 per dataset and event-time window. ``scores``: dataset, hn, mg, time; late rows beyond the watermark are dropped."""
    w = scores.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "dataset")
    agg = w.agg(F.sum("hn").alias("total_hn"), F.sum("mg").alias("total_mg"))
    return agg.select(F.col("window.start").alias("start"), "dataset", "total_hn", "total_mg", F.try_divide("total_mg", "total_hn").alias("overall_m_score"))
