"""Features of words for the human-noun classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V

from .lexicon import symmetric_difference, union_distinct


def hypernym_scores(paths: DataFrame) -> DataFrame:
    """``(word, hypernym_human, hypernym_non_human)``. ``paths``: (word, synset, path_id, node); nodes match by substring; the sum is divided by the number of synsets."""
    hit = lambda nodes: F.sum(reduce(lambda x, y: x | y, [F.contains("node", F.lit(n)) for n in nodes]).cast("int"))
    n = F.count_distinct("synset")
    return paths.groupBy("word").agg(F.round(hit(V.HUMAN_NODES) / n, 6).alias("hypernym_human"), F.round(hit(V.NON_HUMAN_NODES) / n, 6).alias("hypernym_non_human"))


def definition_scores(glosses: DataFrame) -> DataFrame:
    """H2: mean number of indicators per synset gloss. ``glosses``: (word, synset, gloss)."""
    return glosses.groupBy("word").agg(
        F.round(F.sum(T.indicator_score(F.col("gloss"), V.HUMAN_INDICATORS)) / F.count_distinct("synset"), 6).alias("def_human"),
        F.round(F.sum(T.indicator_score(F.col("gloss"), V.NON_HUMAN_INDICATORS)) / F.count_distinct("synset"), 6).alias("def_non_human"),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null where one is zero or null."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm)


def seed_scores(vectors: DataFrame, seeds: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """H3: mean cosine to the human and to the other seeds; (0, 0) for a zero or missing vector. ``seeds``: (vector, is_human), a few fixed words.

    The seeds are one array literal per side: the mean of cosines is the dot product with the mean of the unit seeds, so each
    vector needs two dot products however many seeds there are.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(_dot(v, v)))
    means = seeds.where(_dot(F.col("vector"), F.col("vector")) > 0).select("is_human", F.posexplode(unit(F.col("vector"))).alias("p", "x"))
    means = means.groupBy("is_human", "p").agg(F.avg("x").alias("x")).groupBy("is_human").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]).alias("m"))
    both = means.groupBy().agg(F.max(F.when(F.col("is_human"), F.col("m"))).alias("h"), F.max(F.when(~F.col("is_human"), F.col("m"))).alias("n"))
    j = vectors.select(F.col(id_col), F.col(vec_col).alias("__v")).join(F.broadcast(both))  # one row
    norm = F.sqrt(_dot(F.col("__v"), F.col("__v")))
    side = lambda m: F.round(F.when(norm > 0, _dot(F.col("__v"), F.col(m)) / norm).otherwise(0.0), 6)
    return j.select(id_col, F.coalesce(side("h"), F.lit(0.0)).alias("seed_human"), F.coalesce(side("n"), F.lit(0.0)).alias("seed_non_human"))


def rule_scores(features: DataFrame, threshold: float = 0.02) -> DataFrame:
    """H5, H6: weighted scores, the two-way class and the class with ``uncertain``. Needs hypernym_*, def_*, seed_* and suffix."""
    w = V.SCORE_WEIGHTS
    side = lambda s: sum((F.col(f"{p}_{s}") * k for p, k in zip(("hypernym", "def", "seed"), w, strict=False)), F.lit(0.0)) + F.col("suffix") * w[3]
    out = features.withColumns({"human_score": F.round(side("human"), 6), "non_human_score": F.round(side("non_human"), 6)})
    human = F.col("human_score") > F.col("non_human_score")
    return out.withColumns({"classification": F.when(human, "human").otherwise("non_human"), "batch_class": F.when(F.abs(F.col("human_score") - F.col("non_human_score")) < threshold, "uncertain").when(human, "human").otherwise("non_human")})


FEATURES = ("hypernym_human", "hypernym_non_human", "def_human", "def_non_human", "seed_human", "seed_non_human", "suffix")


def feature_matrix(features: DataFrame, vector_col: str) -> DataFrame:
    """H7: ``features`` = the seven scores and the word vector as one array; a missing or NaN value raises."""
    whole = F.concat(F.array(*[F.col(c).cast("double") for c in FEATURES]), F.transform(vector_col, lambda x: x.cast("double")))
    bad = whole.isNull() | F.exists(whole, lambda x: x.isNull() | F.isnan(x))
    return features.withColumn("features", F.when(bad, F.raise_error(F.lit("a feature is missing"))).otherwise(whole))


def positive_words(wikidata: DataFrame, nhuma: DataFrame, wiktionary: DataFrame) -> DataFrame:
    """The set of human words with label 1, without forms that hold ``(`` or ``·``. wikidata: (entity_male_label, entityLabel)."""
    labels = wikidata.select(T.fallback_noun(F.col("entity_male_label"), F.col("entityLabel")).alias("noun"))
    words = union_distinct(labels, nhuma, wiktionary).where(~F.col("noun").rlike("[(·]"))
    return words.select(F.col("noun").alias("word"), F.lit(1).alias("label"))


def negative_words(paths: DataFrame, human: DataFrame, category: bool = False) -> DataFrame:
    """Words of synsets that are not human, by the first of artifact, living thing, object on their paths; human words are removed.

    ``paths``: (word, synset, node). A word may have more than one category.
    """
    has = lambda n: F.bool_or(F.col("node") == n)
    s = paths.groupBy("word", "synset").agg(has("person.n.01").alias("h1"), has("human.n.01").alias("h2"), has("human_being.n.01").alias("h3"), has("artifact.n.01").alias("a"), has("living_thing.n.01").alias("l"), has("object.n.01").alias("o"))
    kind = F.when(F.col("a"), "artifact").when(F.col("l"), "living_being").when(F.col("o"), "object")
    words = s.where(~(F.col("h1") | F.col("h2") | F.col("h3"))).withColumn("label", kind).where("label is not null").where(T.is_clean_noun(F.col("word")))
    words = words.select(F.replace("word", F.lit("_"), F.lit(" ")).alias("word"), "label" if category else F.lit(0).alias("label")).distinct()
    return words.join(human.select("word").distinct(), "word", "left_anti")


def removed_negatives(before: DataFrame, after: DataFrame) -> DataFrame:
    """U4 on the negative set: what the filter took away."""
    return symmetric_difference(before, after)
