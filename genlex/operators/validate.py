"""External verdicts and their application to analysis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = "map<string,int>"


def parse_verdicts(lines: DataFrame, positive_only: bool = False) -> DataFrame:
    """``(custom_id, verdicts)`` of batch-output lines. ``lines``: (line_no, value).

    A line without choices is skipped; the content is JSON inside a string; of several lines of one id the last one that
    parses counts. ``positive_only`` keeps verdicts of 1.
    """
    schema = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
    read = lines.select("line_no", F.from_json("value", schema).alias("j"))
    content = read.where(F.size("j.response.body.choices") > 0).select("line_no", F.col("j.custom_id").alias("custom_id"), F.from_json(F.get("j.response.body.choices", F.lit(0))["message"]["content"], VERDICTS).alias("v"))
    last = content.where("custom_id is not null and v is not null").groupBy("custom_id").agg(F.max_by("v", "line_no").alias("verdicts"))
    return last.withColumn("verdicts", F.map_filter("verdicts", lambda k, v: v == 1)) if positive_only else last


def count_unparsed(lines: DataFrame) -> DataFrame:
    """Number of lines whose inner content does not parse."""
    inner = F.get_json_object("value", "$.response.body.choices[0].message.content")
    return lines.where(inner.isNotNull() & F.from_json(inner, VERDICTS).isNull()).agg(F.count(F.lit(1)).alias("n_unparsed"))


def log_matches(token: Column, verdicts: Column) -> Column:
    """Some verdict key is the token, or the token with ``_`` and a number."""
    return F.exists(F.map_keys(verdicts), lambda k: (k == token) | (F.startswith(k, F.concat(token, F.lit("_"))) & F.substring(k, F.length(token) + 2, F.length(k)).rlike(r"^\d+$")))


def apply_verdicts(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records with ``real_human_nouns``, their count and ``real_masc_gen_logs``; all three null where there is no verdict."""
    v = verdicts.select(F.col("custom_id").alias("text_index_dataset"), "verdicts")
    kept = F.filter("masc_gen_logs", lambda x: log_matches(x["token"], F.col("verdicts")))
    has = F.col("verdicts").isNotNull()
    out = records.join(v, "text_index_dataset", "left")
    return out.withColumns({"real_human_nouns": F.col("verdicts"), "real_human_nouns_count": F.when(has, F.size("verdicts")), "real_masc_gen_logs": F.when(has, kept)}).drop("verdicts")
