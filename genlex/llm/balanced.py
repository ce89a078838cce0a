"""Problem 5: a sample whose categories match target shares.

Method: the cube method. Every record carries an inclusion probability; flight phases move the probabilities of a partition's
records to 0 or 1 while the expected count of every category in that partition stays the same; at most one record per category
stays unresolved and moves up to a merged partition, level by level. Landing resolves what is left at the top, and the report
gives the residual imbalance. Probabilities are whole numbers over the size of their category, so sums are exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.session import materialize

from .lookalikes import BLANKS

EPS = 1e-9
SCALE = 2.0**53


def category_key(c: Column) -> Column:
    """Category names compare without case, blanks around them, and the choice of ``-`` or ``_``; blank is null."""
    bare = F.translate(F.lower(F.regexp_replace(c.cast("string"), f"^{BLANKS}|{BLANKS}$", "")), "-", "_")
    return F.when(bare != "", bare)


def _uniform(seed: int, ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each id, the same on every machine and in every run (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / SCALE


def flight(prob: np.ndarray, category: np.ndarray, ids: np.ndarray, seed: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Flight phase on category indicators: afterwards at most one probability per category lies strictly between 0 and ``whole``.

    ``whole`` is what a probability of 1 is written as (default 1.0; integers make all sums exact; equal within a category). The
    kernel of the balancing matrix is spanned by vectors that move two records of one category in opposite directions, so
    each step takes two open records of a category and moves them until one reaches 0 or 1, in the direction that keeps both
    expectations. Sums per category do not change.
    """
    if whole is None:
        whole = np.ones(len(prob))
        prob = np.where(prob >= 1 - EPS, 1.0, np.where(prob <= EPS, 0.0, prob))
    near = EPS if prob.dtype.kind == "f" else 0
    draws = _uniform(seed, ids)
    open_ = np.flatnonzero((prob > 0) & (prob < whole))
    order = open_[np.lexsort((ids[open_], draws[open_], pd.factorize(category[open_])[0]))].tolist()
    p, full, draw = prob.tolist(), whole.tolist(), draws.tolist()
    held = -1
    for i in order:
        if held < 0 or category[held] != category[i]:
            held = i
            continue
        a, b, one = p[held], p[i], full[i]
        up, down = min(one - a, b), min(a, one - b)  # held goes up by `up`, or down by `down`
        move = up if draw[i] * (up + down) < down else -down
        p[held], p[i] = a + move, b - move
        for j in (held, i):
            if p[j] <= near:
                p[j] = 0
            elif p[j] >= one - near:
                p[j] = one
        if p[held] in (0, one):
            held = i if 0 < p[i] < one else -1
    return np.array(p, dtype=prob.dtype)


def _fly(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: pd.DataFrame | None = None
        for pdf in batches:  # batch by batch: only the open records of earlier batches, one per category, are held
            if waiting is not None and len(waiting):
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            if not len(pdf):
                continue
            whole = pdf["whole"].to_numpy(dtype=np.int64)
            p = flight(pdf["p"].to_numpy(dtype=np.int64), pdf["category"].to_numpy(dtype=object), pdf["id"].to_numpy(dtype=np.int64), seed, whole)
            pdf = pdf.assign(p=p)
            waiting = pdf[(p > 0) & (p < whole)]
            yield pdf[p == whole]
        if waiting is not None and len(waiting):
            yield waiting

    return run


def quotas(candidates: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """``(category, target_share, min_rows, available, wanted, quota)`` for every target category, whether it has records or not.

    wanted = the larger of ``min_rows`` and ``target_share`` x size, quota = the least whole number of records that is no less,
    or all there are. A category given twice has the larger share and minimum. One row per category: small by the number of
    categories, not of records.
    """
    t = targets.select(
        category_key(F.col("category")).alias("category"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0)).alias("min_rows")
    ).where("category is not null")
    t = t.groupBy("category").agg(F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    have = candidates.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    wanted = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.lit(float(size)))
    q = t.join(have, "category", "left").select("category", "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"), wanted.alias("wanted"))
    return q.withColumn("quota", F.least(F.ceil(F.col("wanted") - EPS), F.col("available")))


def balanced_sample(records: DataFrame, targets: DataFrame, size: int, fan_in: int = 16, seed: int = 42) -> DataFrame:
    """``(id, category)`` of the drawn records. ``records``: (id bigint unique, category), ``targets``: (category, target_share, min_rows).

    Inclusion probability of a record = quota of its category / records of its category, so a category that cannot fill its
    quota is taken whole. Quotas are absolute, as targets are: what one category lacks is not drawn from the others. Records
    without id and records of null or unlisted categories are never drawn. Level 0 flies inside the partitions the scan
    gives, whatever their categories: a category with a third of all records needs no shuffle. Each level then merges
    ``fan_in`` partitions' open records (at most one per category and partition) until one partition is left; whole quotas leave
    nothing open there, and landing draws what would be left with the probability it has. The draw depends on the ids, the
    seed and the partitioning only. Empty tables: no rows.
    """
    records = records.select("id", "category").where("id is not null")
    q = quotas(records.select(category_key(F.col("category")).alias("category")), targets, size)
    rate = materialize(q.where("quota > 0").select(F.col("category").alias("key"), F.col("quota").alias("p"), F.col("available").alias("whole")))
    base = records.select(F.col("id").cast("bigint").alias("id"), category_key(F.col("category")).alias("category"))
    base = base.join(rate, F.col("category") == F.col("key")).select("id", "category", "p", "whole")  # one row per target category: Spark's own size check decides
    schema = "id bigint, category string, p bigint, whole bigint"
    flown = materialize(base.mapInPandas(_fly(seed), schema))
    taken, open_, level, parts = [flown.where("p = whole")], flown.where("p < whole"), 1, 0
    categories = max(1, rate.count())
    while parts != 1:
        left = open_.count()
        if left == 0:
            break
        parts = -(-left // (fan_in * categories))
        flown = materialize(open_.repartition(parts, F.pmod(F.xxhash64("id"), F.lit(parts))).mapInPandas(_fly(seed + level), schema))
        taken.append(flown.where("p = whole"))
        open_, level = flown.where("p < whole"), level + 1
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)) / F.lit(2.0**31)
    out = open_.where(draw * F.col("whole") < F.col("p"))  # landing
    for part in taken:
        out = out.unionByName(part)
    return out.select("id", "category")


def imbalance(sample: DataFrame, candidates: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """One row per target category: wanted and available numbers, what was drawn, the actual share, the residual against the quota, and
    whether the draw meets the target."""
    q = quotas(candidates, targets, size)
    drawn = sample.groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))
    total = sample.agg(F.count(F.lit(1)).alias("total"))
    joined = q.join(drawn, "category", "left").crossJoin(F.broadcast(total))  # one-row total
    drawn_n = F.coalesce("drawn", F.lit(0))
    share = F.when(F.col("total") > 0, F.round(drawn_n / F.col("total"), 6))
    return joined.select(
        "category", "target_share", "min_rows", F.round("wanted", 6).alias("wanted"), "available", drawn_n.alias("drawn"), share.alias("actual_share"), (drawn_n - F.col("quota")).cast("double").alias("residual"),
        (drawn_n >= F.col("wanted") - EPS).alias("met"),
    )


def instruction_records(pairs: DataFrame) -> DataFrame:
    """``(id, category)``: each distinct non-blank instruction of a source once, by its smallest pair_id. Partially combined: repeats shuffle once."""
    text = F.regexp_replace(F.col("instruction"), f"^{BLANKS}|{BLANKS}$", "")
    src = pairs.select(F.col("pair_id").cast("bigint").alias("pid"), category_key(F.col("source")).alias("category"), text.alias("text"))
    src = src.where("pid is not null and category is not null and text <> ''")
    return src.groupBy("category", "text").agg(F.min("pid").alias("id")).select("id", "category")
