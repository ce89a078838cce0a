"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    """K1, K6: a parquet table, overwritten; partition columns take the place of indexes."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_results(records: DataFrame, path: str) -> None:
    """K2, K3: JSON results by validated, dataset_group and dataset."""
    records.write.mode("overwrite").partitionBy("validated", "dataset_group", "dataset").json(path)


def column_arrays(rows: DataFrame, order_col: str, columns: list[str]) -> DataFrame:
    """K4: parallel arrays in one row, in the given order. A compatibility form for small results; prefer the rows."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("__order"), *columns)))
    return rows.agg(packed.alias("x")).select(*[F.col(f"x.{c}").alias(c) for c in columns])


def batch_requests(instructions: DataFrame, model: str, max_tokens: int = 1500, temperature: float = 1.0) -> DataFrame:
    """K5: request lines ``value`` with ``custom_id = {source}_{i}_{neutral}``. ``instructions``: (i, instruction, source, neutral)."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    line = F.struct(F.concat_ws("_", "source", F.col("i").cast("string"), F.col("neutral").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return instructions.select(F.to_json(line).alias("value"))


def entry_rows(entries: DataFrame) -> DataFrame:
    """K7: dictionary entries as flat rows: nested fields as JSON, parent columns filled where there is a parent."""
    return entries.select(
        "completeWordForm", "wordForm", "wordType", F.to_json("wordDefinitionFeatures").alias("wordDefinitionFeatures"), "etyhist", F.to_json("derives").alias("derives"), "url",
        *[F.col(c) if c in entries.columns else F.lit(None).cast("string").alias(c) for c in ("parentCompleteWord", "parentWord")],
    )


def annotator_sheet(records: DataFrame) -> DataFrame:
    """K8: the six columns for annotators, the last one empty."""
    return records.select("dataset", "text_index", "text_index_dataset", "text", F.to_json("real_human_nouns").alias("original_annotation"), F.lit("").alias("annotator_annotation"))


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """CSV or TSV with a header."""
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
