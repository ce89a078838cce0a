"""Tests that blank cells of instruction data, on token and entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genlex.functions import values as V


def _noun_in(tokens: DataFrame, words: DataFrame, name: str) -> DataFrame:
    known = words.select(F.col("noun").alias("lemma")).distinct().withColumn("in_list", F.lit(True))
    joined = tokens.join(known, "lemma", "left")
    return joined.withColumn(name, F.coalesce("in_list", F.lit(False)) & (F.col("pos") == "NOUN")).drop("in_list")


def specific_determiner(tokens: DataFrame, generics: DataFrame) -> DataFrame:
    """Ids of texts with a specific determiner before a masculine-generic noun, or before an adjective and such a noun."""
    order = Window.partitionBy("text_id").orderBy("i")
    t = _noun_in(tokens, generics, "generic")
    t = t.select("text_id", "text", "pos", F.lead("pos").over(order).alias("pos1"), F.lead("generic").over(order).alias("gen1"), F.lead("generic", 2).over(order).alias("gen2"))
    hit = F.lower("text").isin(*V.SPECIFIC_DETERMINERS) & (F.col("pos") == "DET") & (F.col("gen1") | ((F.col("pos1") == "ADJ") & F.col("gen2")))
    return t.where(F.coalesce(hit, F.lit(False))).select("text_id").distinct()


def masculine_generic(tokens: DataFrame, generics: DataFrame) -> DataFrame:
    """Ids of texts with any masculine-generic noun."""
    return _noun_in(tokens, generics, "generic").where("generic").select("text_id").distinct()


def person_entity(entities: DataFrame, first_names: DataFrame) -> DataFrame:
    """Ids of texts with a person entity, or a MISC entity that has a first name among its words. ``entities``: (text_id, text, label)."""
    persons = entities.where("label = 'PER'").select("text_id")
    words = entities.where("label = 'MISC'").select("text_id", F.explode(F.split("text", r"\s+")).alias("word"))
    named = words.join(first_names.select(F.col(first_names.columns[0]).alias("word")), "word", "left_semi").select("text_id")
    return persons.unionByName(named).distinct()


def neutral_word(tokens: DataFrame) -> DataFrame:
    """T4: ids of texts with a neutral noun."""
    return tokens.where((F.col("pos") == "NOUN") & F.col("lemma").isin(*V.NEUTRAL_NOUNS)).select("text_id").distinct()


def interrogative_who(tokens: DataFrame) -> DataFrame:
    """T5 (off by default): ids of texts with interrogative ``qui`` as subject, object or root."""
    kinds = F.split(F.coalesce(F.try_element_at("morph", F.lit("PronType")), F.lit("")), ",")
    hit = (F.lower("text") == "qui") & (F.col("pos") == "PRON") & F.col("dep").isin("nsubj", "obj", "ROOT") & F.array_contains(kinds, "Int")
    return tokens.where(hit).select("text_id").distinct()


def content_columns(dataset: str, columns: list[str]) -> list[str]:
    """the text columns of a dataset; unknown datasets raise."""
    if dataset == "oracle":
        return [c for c in columns if c in ("instruction", "output")]
    if dataset in ("oasst2", "hh_rlhf", "alpaca"):
        return [c for c in columns if "content" in c]
    if dataset in (*V.DATASET_GROUPS["llm_prop"], *V.DATASET_GROUPS["llm_local"]):
        return [c for c in columns if c == "response"]
    raise ValueError(f"unknown dataset {dataset}")


def columns_of_type(columns: list[str], content_type: str) -> list[str]:
    """columns whose lower-case name contains the content type."""
    return [c for c in columns if content_type in c.lower()]


def blank_cells(rows: DataFrame, id_col: str, columns: list[str], flags: dict[str, dict[str, DataFrame | None]], neutral: bool = False) -> DataFrame:
    """cells with a hit become null, rows stay. ``flags[column]`` has the id tables ``spec``, ``generic``, ``person`` and ``neutral``
    (any may be None), whose ``text_id`` are ids of ``rows``.

    The first hit blanks the cell. With ``neutral=True`` the column ``neutral`` (0/1) is written by surviving cells only; the
    last column wins, and a row without a surviving cell has null.
    """
    out, neutral_cols = rows, []
    for k, c in enumerate(columns):
        bad: Column = F.lit(False)
        for name in ("spec", "generic", "person", "neutral"):
            ids = flags.get(c, {}).get(name)
            if ids is None:
                continue
            mark = f"__{k}_{name}"
            keyed = ids.select(F.col("text_id").alias(f"{mark}_id"), F.lit(True).alias(mark)).distinct()
            out = out.join(keyed, out[id_col] == keyed[f"{mark}_id"], "left").drop(f"{mark}_id")
            if name != "neutral":
                bad = bad | F.coalesce(F.col(mark), F.lit(False))
        if neutral:
            has = F.coalesce(F.col(f"__{k}_neutral"), F.lit(False)) if f"__{k}_neutral" in out.columns else F.lit(False)
            neutral_cols.insert(0, F.when(~bad & F.col(c).isNotNull(), has.cast("int")))
        out = out.withColumn(f"__{k}_bad", bad)
    result = {c: F.when(~F.col(f"__{k}_bad"), F.col(c)) for k, c in enumerate(columns)}
    if neutral:
        result["neutral"] = F.coalesce(*neutral_cols)
    out = out.withColumns(result)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def non_null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of non-null cells per column."""
    return rows.agg(*[F.count(c).alias(c) for c in columns])


def value_in(rows: DataFrame, column: str, values) -> DataFrame:
    """rows whose value is one of the given ones; null is none of them."""
    return rows.where(F.col(column).isin(*values))


def without_substring(rows: DataFrame, column: str, part: str) -> DataFrame:
    """rows whose text does not contain the part; null texts are dropped with them."""
    return rows.where(~F.contains(column, F.lit(part)))


def shape_columns(rows: DataFrame, rename: dict[str, str], drop=(), first=()) -> DataFrame:
    """columns dropped, then renamed, then those of ``first`` in front."""
    out = rows.drop(*drop).withColumnsRenamed(rename)
    return out.select(*first, *[c for c in out.columns if c not in first])


def assign_by_id(rows: DataFrame, values: DataFrame, id_col: str, column: str) -> DataFrame:
    """``column`` of the row of ``values`` with the same id, null where there is none. The id stands for the row's place; ids of ``values`` are unique."""
    return rows.drop(column).join(values.select(id_col, column), id_col, "left")
