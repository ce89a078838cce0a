"""Lexicons, class tables and the word index as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genlex.functions import text as T
from genlex.functions import values as V


def drop_words(rows: DataFrame, word_col: str, *lists: DataFrame) -> DataFrame:
    """rows whose word is in none of the lower-cased lists; null words stay (an anti join, not NOT IN)."""
    words = reduce(DataFrame.unionByName, [x.select(F.lower(F.col(x.columns[0])).alias("__w")) for x in lists]).distinct()
    return rows.join(words, rows[word_col] == words["__w"], "left_anti")


def epicene_nouns(dmnt: DataFrame, epicene: int = 1) -> DataFrame:
    """common nouns with the given epicene flag, bag semantics."""
    return dmnt.where((F.col("__dmnt__epicene") == epicene) & (F.col("__dmnt__proper_noun") == 0)).select(F.col("__dmnt__nm").alias("noun"))


def epicene_list(dmnt: DataFrame) -> DataFrame:
    """The epicene list: the extra entries and those of the table, not deduplicated."""
    extra = dmnt.sparkSession.createDataFrame([(w,) for w in V.EXTRA_EPICENES], "noun string")
    return extra.unionByName(epicene_nouns(lower_unless_proper(dmnt, "__dmnt__proper_noun")))


def lower_unless_proper(rows: DataFrame, flag_col: str) -> DataFrame:
    """all string columns in lower case, except in rows whose flag is 1."""
    strings = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    keep = F.coalesce(F.col(flag_col) == 1, F.lit(False))
    return rows.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lower(c)) for c in strings})


def lower_all(rows: DataFrame, *excluding: str) -> DataFrame:
    """all string columns in lower case but the named ones."""
    return rows.withColumns({f.name: F.lower(f.name) for f in rows.schema if f.dataType.typeName() == "string" and f.name not in excluding})


def union_all(*tables: DataFrame) -> DataFrame:
    """Tables under one another by column name, repeated rows kept; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Whole rows once; nulls are equal."""
    return rows.distinct()


def union_distinct(*lists: DataFrame) -> DataFrame:
    """The set of words of several one-column tables; nulls are dropped."""
    return reduce(DataFrame.unionByName, [x.select(F.col(x.columns[0]).alias("noun")) for x in lists]).where("noun is not null").distinct()


def except_words(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Words of the first table in none of the others."""
    out = left.select(F.col(left.columns[0]).alias("noun")).distinct()
    for o in others:
        out = out.join(o.select(F.col(o.columns[0]).alias("noun")).distinct(), "noun", "left_anti")
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: rows that occur exactly once in the union of both; rows repeated inside one table are lost too."""
    return a.unionByName(b).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per key in the given order. A partially combined minimum, no window: a hot key is no hot task."""
    cols = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*cols).alias("__row"))).alias("__m"))
    return first.select(*keys, *[F.col(f"__m.__row.{c}").alias(c) for c in cols]).select(*rows.columns)


def distinct_column(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def word_candidates(demonette: DataFrame, golden: DataFrame, recursive: DataFrame) -> DataFrame:
    """Demonette minus golden minus (recursive minus golden), without capitalised words."""
    new = except_words(recursive, golden)
    return except_words(except_words(demonette, golden), new).where(~F.substring("noun", 1, 1).rlike(r"^\p{Lu}"))


def classes_of(nouns: DataFrame, noun_col: str, nhuma: DataFrame, prefix: str) -> DataFrame:
    """Left join with the class table on the lower-cased noun; several class rows fan out; misses become ``""``."""
    right = nhuma.select(F.lower("lexeme").alias("__k"), F.col("class").alias("__c"), F.col("subclass").alias("__s"))
    joined = nouns.select(F.col(noun_col).alias("noun")).join(right, F.lower("noun") == F.col("__k"), "left")
    return joined.select("noun", F.coalesce("__c", F.lit("")).alias(f"class_{prefix}"), F.coalesce("__s", F.lit("")).alias(f"subclass_{prefix}"))


def merge_classes(tlfi: DataFrame, dmnt: DataFrame) -> DataFrame:
    """Full outer join of two class tables on noun, the left values first (an empty string counts as a value), one row per noun.

    Of several rows of a noun the smallest in the order (left class, left subclass, right class, right subclass) is kept.
    """
    j = tlfi.join(dmnt, "noun", "full_outer")
    j = j.select("noun", F.coalesce("class_tlfi", "class_dmnt").alias("class"), F.coalesce("subclass_tlfi", "subclass_dmnt").alias("subclass"), F.struct("class_tlfi", "subclass_tlfi", "class_dmnt", "subclass_dmnt").alias("__o"))
    return keep_first(j, ["noun"], ["__o"]).drop("__o")


def overwrite_classes(dictionary: DataFrame, annotated: DataFrame) -> DataFrame:
    """Annotated class and subclass before the dictionary's, on distinct nouns; nouns of either side are kept."""
    a = keep_first(annotated.select("noun", F.col("class").alias("a_c"), F.col("subclass").alias("a_s")), ["noun"], ["a_c", "a_s"])
    return dictionary.join(a, "noun", "full_outer").select("noun", F.coalesce("a_c", "class").alias("class"), F.coalesce("a_s", "subclass").alias("subclass"))


def final_dictionary(dictionary: DataFrame) -> DataFrame:
    """Class and subclass translated and merged."""
    d = dictionary.withColumns({"class": T.translate_values(F.col("class"), V.CLASS_NAMES), "subclass": T.translate_values(F.col("subclass"), V.SUBCLASS_NAMES)})
    return d.withColumn("merged_classes", T.merged_classes(F.col("class"), F.col("subclass")))


def missing_classes(dictionary: DataFrame) -> DataFrame:
    """Rows without class and their percentage."""
    miss = F.count_if(F.col("class").isNull() | (F.col("class") == ""))
    return dictionary.agg(miss.alias("n_missing"), F.count(F.lit(1)).alias("n"), F.round(F.try_divide(miss * F.lit(100.0), F.count(F.lit(1))), 6).alias("pct_missing"))


def demonym_entries(demonyms: DataFrame) -> DataFrame:
    """Demonyms with a masculine ending, with their class and subclass; a repeated line stays repeated."""
    hit = demonyms.where(F.col("noun").rlike("(?:" + "|".join(V.DEMONYM_ENDINGS) + ")$"))
    return hit.select("noun", F.lit(V.DEMONYM_CLASS[0]).alias("class"), F.lit(V.DEMONYM_CLASS[1]).alias("subclass"))


def feminine_forms(wikt: DataFrame, excluded: DataFrame) -> DataFrame:
    """Forms tagged feminine. ``wikt``: (forms_json, tags_json); the key of a tag with ``tags`` replaced by ``form`` is the key of its form.

    Kept if the first letter is lower case and the form is not excluded. Broken JSON gives nothing.
    """
    maps = wikt.select(F.from_json("forms_json", "map<string,string>").alias("forms"), F.from_json("tags_json", "map<string,string>").alias("tags"))
    pairs = maps.select("forms", F.explode(F.map_entries("tags")).alias("t")).where(F.contains("t.value", F.lit("feminine")))
    form = F.try_element_at("forms", F.replace("t.key", F.lit("tags"), F.lit("form")))
    out = pairs.select(form.alias("noun")).where(F.substring("noun", 1, 1).rlike(r"^\p{Ll}"))
    return drop_words(out, "noun", excluded).distinct()


def human_list(sources: list[DataFrame], demonyms: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """The set of human nouns: all sources without words that are demonyms when capitalised or ambiguous, then the demonyms."""
    base = union_distinct(*sources)
    shadow = demonyms.select(F.col("noun").alias("__d")).distinct()
    base = base.join(shadow, T.capitalize(F.col("noun")) == F.col("__d"), "left_anti")
    base = base.join(ambiguous.select(F.col("noun")).distinct(), "noun", "left_anti")
    return union_distinct(base, demonyms)


def word_index(sources: dict[str, DataFrame]) -> DataFrame:
    """All distinct words of ``name -> (id, word)`` tables with a running id in word order and each source's smallest id.

    The running id comes from range-partitioned ranks: counts per partition are added up, no task sorts all words.
    """
    words = reduce(DataFrame.unionByName, [s.select("word") for s in sources.values()]).where("word is not null").distinct()
    out = running_ids(words, "word", "word_id")
    for name, s in sources.items():
        out = out.join(s.where("word is not null").groupBy("word").agg(F.min("id").alias(f"{name}_id")), "word", "left")
    return out.select("word_id", "word", *[f"{name}_id" for name in sources])


def running_ids(rows: DataFrame, order_col: str, name: str) -> DataFrame:
    """1, 2, ... in the order of a unique column, without gathering all rows in one task."""
    from genlex.session import materialize

    ranged = materialize(rows.repartitionByRange(order_col).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # one row per partition
    inside = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order_col)))
    return inside.join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__r")).cast("bigint")).drop("__p", "__b", "__r")


def ordinals(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each key in the given order, without gathering a key in one task: a key may hold a third of all rows.

    Rows are range-partitioned by key and order, ranked per partition, and keys that lie over several partitions get the number
    of their rows before. Keys must not be null; rows that tie in everything share their numbers in any order.
    """
    from genlex.session import materialize

    ranged = materialize(rows.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per partition
    before = sizes.select(*keys, "__p", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__b")).where("__b > 0")
    inside = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order)))
    return inside.join(before, [*keys, "__p"], "left").withColumn(name, (F.coalesce("__b", F.lit(0)) + F.col("__r")).cast("bigint")).drop("__p", "__b", "__r")


def gendered_labels(entities: DataFrame, female: DataFrame, male: DataFrame) -> DataFrame:
    """Entities with a female label, their male label if any, without those described as a title of nobility.

    ``entities``: (entity, entityLabel, description), ``female`` and ``male``: (entity, label). No description is no reason to leave out.
    """
    kept = entities.where(F.col("description").isNull() | (F.col("description") != "titre de noblesse")).select("entity", "entityLabel")
    out = kept.join(female.select("entity", F.col("label").alias("entity_female_label")), "entity")
    return out.join(male.select("entity", F.col("label").alias("entity_male_label")), "entity", "left").distinct()


def noun_key(noun: Column) -> Column:
    """A noun as token forms are written: lower case, no invisible characters, its tokens joined by one blank; ``""`` if there are none."""
    plain = F.replace(F.regexp_replace(noun, r"\p{Cf}", ""), F.lit("’"), F.lit("'"))
    return F.array_join(T.tokens(F.lower(F.regexp_replace(plain, r"[\s\p{Z}]+", " "))), " ")


def best_values(entries: DataFrame, origins: DataFrame, columns: list[str]) -> DataFrame:
    """One row per noun key with, for each column, the value of the most trusted, then latest, then first row that has one; ``""`` if none has.

    ``entries``: (entry_id, noun, origin, updated_at, columns), ``origins``: (origin, trust_rank), unique. Stand-ins are no values; unlisted origins rank last.
    """
    e = entries.join(origins, "origin", "left").withColumn("noun", noun_key(F.col("noun"))).where("noun <> ''")
    order = [F.coalesce("trust_rank", F.lit(2**31 - 1)), F.coalesce(-F.unix_micros("updated_at"), F.lit(2**63 - 1)), F.col("entry_id")]
    best = []
    for c in columns:
        value = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
        best.append(F.coalesce(F.min(F.when(~F.lower(value).isin(*V.STAND_INS), F.struct(*order, value.alias("value"))))["value"], F.lit("")).alias(c))
    return e.groupBy("noun").agg(*best)
