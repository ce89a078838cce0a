"""Masculine generics, inclusive forms and neutral words in a token table, and the record of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V


def human_nouns(tokens: DataFrame, humans: DataFrame) -> DataFrame:
    """The noun tokens that are human: lemma in ``humans(noun)``, or an inclusive form (code words excepted), or a capital ending.

    Adds ``separator`` and ``upper``: T9 and T10 are logged only for tokens that pass here, and code words are not tested again.
    """
    known = humans.select(F.col("noun").alias("lemma")).distinct().withColumn("is_human", F.lit(True))
    nouns = tokens.where("pos = 'NOUN'").join(known, "lemma", "left")
    nouns = nouns.withColumns({"separator": T.separator_form(F.col("text")), "upper": T.upper_form(F.col("text"))})
    gate = F.coalesce("is_human", F.lit(False)) | (F.col("separator").isNotNull() & ~F.col("text").isin(*V.CODE_WORDS)) | F.col("upper").isNotNull()
    return nouns.where(gate).drop("is_human")


def masculine_generics(gated: DataFrame, generics: DataFrame) -> DataFrame:
    """One log per human token and *list entry* with its lemma; a noun that is twice in the list logs twice."""
    return gated.join(generics.select(F.col("noun").alias("lemma")), "lemma").select("text_id", "i", "text", F.col("lemma").alias("masc_gen"), F.lit(0).alias("from_epicene"))


def epicene_generics(tokens: DataFrame, gated: DataFrame, epicenes: DataFrame) -> DataFrame:
    """Epicene nouns right after a masculine determiner (its text is compared with case). Bag semantics as T6.

    Token tables that carry the token before (``p_text``, ``p_pos``) need no window; others get it from one.
    """
    found = gated.join(epicenes.select(F.col("noun").alias("lemma")), "lemma")
    if not {"p_text", "p_pos"} <= set(gated.columns):
        order = Window.partitionBy("text_id").orderBy("i")
        found = found.join(tokens.select("text_id", "i", F.lag("text").over(order).alias("p_text"), F.lag("pos").over(order).alias("p_pos")), ["text_id", "i"])
    found = found.where((F.col("p_pos") == "DET") & F.col("p_text").isin(*V.MASCULINE_DETERMINERS))
    return found.select("text_id", "i", "text", F.col("lemma").alias("masc_gen"), F.lit(1).alias("from_epicene"))


def marker_counts(tokens: DataFrame, humans: DataFrame, generics: DataFrame, epicenes: DataFrame) -> DataFrame:
    """``(text_id, human_noun_count, n_logs)``: what the scores need of T6-T8, in one pass over tokens that carry ``p_text`` and ``p_pos``.

    Lists become (noun, how often), so a repeated entry still logs twice; each token meets at most one row of each list and
    only per-text sums are shuffled. Texts without human noun have no row.
    """
    times = lambda words, name: words.groupBy(F.col("noun").alias("lemma")).agg(F.count(F.lit(1)).alias(name))
    gated = human_nouns(tokens, humans).join(times(generics, "n_generic"), "lemma", "left").join(times(epicenes, "n_epicene"), "lemma", "left")
    after_determiner = F.coalesce((F.col("p_pos") == "DET") & F.col("p_text").isin(*V.MASCULINE_DETERMINERS), F.lit(False))
    logs = F.coalesce("n_generic", F.lit(0)) + F.when(after_determiner, F.coalesce("n_epicene", F.lit(0))).otherwise(0)
    return gated.groupBy("text_id").agg(F.count(F.lit(1)).alias("human_noun_count"), F.sum(logs).alias("n_logs"))


def neutral_nouns(gated: DataFrame) -> DataFrame:
    """Neutral words among the human tokens."""
    return gated.where(F.col("lemma").isin(*V.NEUTRAL_NOUNS)).select("text_id", "i", "text", F.col("lemma").alias("neutral"))


def phrase_markers(text: Column) -> dict[str, Column]:
    """Greetings, pairs and neutral pronouns by sentence."""
    s = T.sentences(text)
    return {"incl_greetings_logs": T.phrase_hits(s, V.INCLUSIVE_GREETINGS), "incl_pairs_logs": T.phrase_hits(s, V.INCLUSIVE_PAIRS), "neutral_prons_logs": T.phrase_hits(s, V.NEUTRAL_PRONOUNS)}


def _logs(rows: DataFrame, name: str, *fields: Column) -> DataFrame:
    entry = F.struct("i", *fields)
    collected = rows.groupBy("text_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return collected.select("text_id", F.transform("x", lambda e: e.dropFields("i")).alias(name))


def records(texts: DataFrame, tokens: DataFrame, humans: DataFrame, generics: DataFrame, epicenes: DataFrame) -> DataFrame:
    """The analysis record of every text (dataset, text_id, text): all logs in token order, the human nouns and their number.

    Texts without tokens or markers keep a record with empty logs. The logs of one text are gathered per text: they are part
    of its one record. Token tables are read three times; pass written ones.
    """
    gated = human_nouns(tokens, humans)
    generic = masculine_generics(gated, generics).unionByName(epicene_generics(tokens, gated, epicenes))
    parts = [
        _logs(gated.where("separator is not null"), "separator_logs", F.col("text").alias("token"), F.col("separator")),
        _logs(gated.where("upper is not null"), "upper_logs", F.col("text").alias("token"), F.col("upper")),
        _logs(neutral_nouns(gated), "neutral_logs", F.col("text").alias("token"), F.col("neutral")),
        _logs(generic, "masc_gen_logs", F.col("text").alias("token"), F.col("masc_gen"), F.col("from_epicene")),
        _logs(gated, "human_nouns", F.col("text").alias("token")),
    ]
    out = texts.select("dataset", "text_id", "text").withColumns(phrase_markers(F.col("text")))
    for part in parts:
        out = out.join(part, "text_id", "left")
    names = F.transform(F.col("human_nouns"), lambda x: x["token"])
    out = out.withColumn("human_nouns", F.coalesce(names, F.array().cast("array<string>")))
    for c in ("separator_logs", "upper_logs", "neutral_logs", "masc_gen_logs"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])))
    return out.withColumn("human_noun_count", F.size("human_nouns"))
