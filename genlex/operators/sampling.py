"""Proportional quotas and deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def proportional_quotas(rows: DataFrame, source_col: str, sample_size: int) -> DataFrame:
    """``(source, n, quota)``. Quota = truncated share x sample size in doubles; the rest goes one each to the largest shares.

    Ties of share go by source name; no quota exceeds its source. The windows run over one row per source.
    """
    counts = rows.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    q = counts.withColumn("share", F.col("n") / F.sum("n").over(every))
    q = q.withColumn("base", (F.col("share") * sample_size).cast("bigint"))
    q = q.withColumn("rest", F.lit(sample_size) - F.sum("base").over(every))
    q = q.withColumn("place", F.row_number().over(Window.orderBy(F.desc("share"), "source")))
    return q.select("source", "n", F.least(F.col("base") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0), F.col("n")).alias("quota"))


def _threshold(rows: DataFrame, key: str, order: str, quota: DataFrame) -> DataFrame:
    """The first ``quota`` rows per key in hash order. Counts per hash bucket find the bucket where the quota ends; only that bucket is ranked."""
    buckets = 4096
    b = rows.withColumn("__b", F.pmod(F.shiftright(F.col(order), 20), F.lit(buckets)))
    sums = b.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    cum = sums.select(key, "__b", F.sum("__n").over(Window.partitionBy(key).orderBy("__b")).alias("__upto"), "__n")
    marked = b.join(cum, [key, "__b"]).join(quota, key)
    whole = marked.where("__upto <= quota")
    edge = marked.where("__upto > quota and __upto - __n < quota")
    rank = F.row_number().over(Window.partitionBy(key, "__b").orderBy(order, *[c for c in rows.columns if c not in (key, order)]))
    edge = edge.withColumn("__r", rank).where(F.col("__r") <= F.col("quota") - (F.col("__upto") - F.col("__n"))).drop("__r")
    return whole.unionByName(edge).select(*rows.columns)


def stratified_sample(rows: DataFrame, source_col: str, text_col: str, sample_size: int = 10_000, seed: int = 42) -> DataFrame:
    """G1: a proportional sample by source in a seeded hash order; rows with any null or empty value are left out first."""
    clean = rows.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]).dropna("any")
    quota = proportional_quotas(clean, source_col, sample_size).select(F.col("source").alias(source_col), "quota")
    hashed = clean.withColumn("__h", F.xxhash64(F.col(text_col), F.lit(seed)))
    return _threshold(hashed, source_col, "__h", quota).drop("__h")


def fraction_sample(words: DataFrame, word_col: str, percent: int = 20) -> DataFrame:
    """About ``percent`` per cent of the capitalised words, and all the others."""
    capital = F.substring(word_col, 1, 1).rlike(r"^\p{Lu}")
    return words.where(~capital | (F.pmod(F.xxhash64(word_col), F.lit(100)) < percent))


def hash_sample(rows: DataFrame, column: str, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded hash order (a top-n, which Spark keeps distributed)."""
    return rows.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column).limit(n)


def train_split(words: DataFrame, word_col: str, seed: int = 42) -> DataFrame:
    """Adds ``is_train`` for about 80 per cent of the words, the same whatever the partitioning."""
    return words.withColumn("is_train", F.pmod(F.xxhash64(F.col(word_col), F.lit(seed)), F.lit(10)) < 8)


def capped_per_group(rows: DataFrame, group_col: str, order_col: str, required_col: str, groups: list[str], cap: int = 250) -> DataFrame:
    """At most ``cap`` rows of each named group in input order, other groups whole; rows without ``required_col`` never count."""
    usable = rows.where(F.col(required_col).isNotNull())
    w = Window.partitionBy(group_col).orderBy(order_col)
    named = usable.where(F.col(group_col).isin(*groups)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")
    return named.unionByName(usable.where(~F.col(group_col).isin(*groups)))


def shuffled(rows: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """The rows in a seeded hash order, sorted by range partitions; a relation has no order, so this matters for what is written next only."""
    return rows.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns)
