"""Sequential deduplication, first-seen values and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.functions import text as T


def dedup_sequential(rows: DataFrame, text_col: str, pos_col: str, cleaned: Column | None = None) -> DataFrame:
    """U8: drop a text that equals the *cleaned* form of an earlier kept text. Adds ``cleaned``.

    In relational form: a row stays if cleaning changes it, or if it is the first of its cleaned form. Repeated texts that
    cleaning changes therefore all stay. Cleaning must be idempotent; texts with doubly escaped markup may not be, see
    ``not_idempotent``. The first row comes from a partially combined minimum, so a text that fills a third of all rows is no
    hot task. Null texts stay.
    """
    c = T.clean_if_marked(F.col(text_col)) if cleaned is None else cleaned
    marked = rows.withColumn("cleaned", c)
    first = marked.where("cleaned is not null").groupBy(F.col("cleaned").alias("__c")).agg(F.min(pos_col).alias("__first"))
    joined = marked.join(first, F.col("cleaned") == F.col("__c"), "left")
    keep = F.col(text_col).isNull() | (F.col(text_col) != F.col("cleaned")) | (F.col(pos_col) == F.col("__first"))
    return joined.where(keep).drop("__c", "__first")


def not_idempotent(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows on which cleaning twice differs from cleaning once."""
    once = T.clean_if_marked(F.col(text_col))
    return rows.withColumn("__once", once).where(T.clean_if_marked(F.col("__once")) != F.col("__once")).drop("__once")


def first_seen(rows: DataFrame, value_col: str, pos_col: str) -> DataFrame:
    """Distinct values with the position where each was seen first."""
    return rows.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.min(pos_col).alias(pos_col))


def expand_one_hop(known: DataFrame, entries: DataFrame) -> DataFrame:
    """Dictionary entries whose definition starts with a known word, tagged with it as parent.

    ``known``: (word), ``entries``: (word, definition).
    """
    first = F.lower(F.regexp_extract("definition", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}\p{M}_-]+)", 1))
    parents = known.select(F.lower("word").alias("parent_word")).distinct()
    return entries.withColumn("parent_word", first).join(parents, "parent_word").select("word", "parent_word", "definition")
