"""Scans. Each takes an explicit schema or column list; nothing is inferred from data."""

from __future__ import annotations

import io
import sqlite3
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genlex.operators.validate import parse_verdicts
from genlex.session import materialize, path_exists


def _binary_tables(spark: SparkSession, path: str, schema: str, parts: Callable[[bytes], Iterator]) -> DataFrame:
    """Rows of whole binary files, each opened by the task that reads it; ``path`` may be a folder or pattern on any file system."""
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield from parts(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_pickle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Import of pandas pickles of one's own; other suffixes raise. Pickles run code: never read foreign ones.

    With a ``schema`` files are read by the executors, one task each; without one a single local file is read to infer it.
    """
    if not path.endswith(".pkl"):
        raise ValueError("path must end in .pkl")
    import pandas as pd

    if schema is None:
        return spark.createDataFrame(pd.read_pickle(path))
    names = [f.split()[0] for f in schema.split(", ")]
    return _binary_tables(spark, path, schema, lambda content: iter([pd.read_pickle(io.BytesIO(content))[names]]))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None, batch: int = 50_000) -> DataFrame:
    """A SQLite table, registered as a view of the same name. Files are opened by the executors, in batches of rows.

    ``path`` may be a folder or pattern of files that have the table. Without ``schema`` the file must be local, and its column types are looked up.
    """
    if not table.replace("_", "").isalnum():
        raise ValueError("bad table name")
    if schema is None:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string"}
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            cols = [(r[1], kinds.get(r[2].upper(), "string")) for r in db.execute(f'PRAGMA table_info("{table}")')]
        if not cols:
            raise ValueError(f"no table {table}")
        schema = ", ".join(f"`{n}` {k}" for n, k in cols)
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def parts(content: bytes):
        import pandas as pd

        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        cursor = db.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{table}"')
        while rows := cursor.fetchmany(batch):
            yield pd.DataFrame(rows, columns=names)
        db.close()

    out = _binary_tables(spark, path, schema, parts)
    out.createOrReplaceTempView(table)
    return out


def read_values(rows: DataFrame, column: str, alternate: str | None = None) -> DataFrame | None:
    """S3: one column, or the first non-null of two; None if a column does not exist."""
    if column not in rows.columns or (alternate is not None and alternate not in rows.columns):
        return None
    return rows.select((F.coalesce(column, alternate) if alternate else F.col(column)).alias(column))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header line."""
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def first_names(spark: SparkSession, path: str) -> DataFrame:
    """The column Prenoms of a ``;`` separated file."""
    return read_csv(spark, path, "Prenoms string", ";")


def first_column(rows: DataFrame) -> DataFrame:
    """The first column, by position."""
    return rows.select(rows.columns[0])


def read_json_array(spark: SparkSession, path: str, schema: str, *columns: str) -> DataFrame:
    """A file that holds one JSON array of objects, optionally a subset of its columns."""
    out = spark.read.option("multiLine", True).schema(schema).json(path)
    return out.select(*columns) if columns else out


def read_batch_output(spark: SparkSession, path: str, positive_only: bool = False) -> DataFrame:
    """Verdicts of a JSONL batch-output file; line order decides between repeated ids.

    Line order is by file, then by the split's place in it, then by the row's place in the split, whatever order splits are read in.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(place.alias("line_no"), "value")
    return parse_verdicts(lines, positive_only)


def read_lines(spark: SparkSession, path: str, name: str = "noun") -> DataFrame:
    """One value per line, blank lines dropped."""
    return spark.read.text(path).select(F.col("value").alias(name)).where(F.trim(name) != "")


def merge_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Union of JSON array files; missing files and other suffixes warn and are skipped, corrupt records are dropped with a count.

    Paths may lie on any file system that Spark reads.
    """
    good = []
    for p in paths:
        if not p.endswith(".json") or not path_exists(spark, p):
            warnings.warn(f"skipped {p}", stacklevel=2)
        else:
            good.append(p)
    if not good:
        return spark.createDataFrame([], schema)
    read = materialize(spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "__corrupt").schema(f"{schema}, __corrupt string").json(good))
    broken = read.where("__corrupt is not null").count()
    if broken:
        warnings.warn(f"dropped {broken} corrupt records", stacklevel=2)
    return read.where("__corrupt is null").drop("__corrupt")


def union_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet splits of one dataset (train, validation, ...) under one another; columns a split lacks are null."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


ANNOTATIONS = "dataset string, text_index string, text_index_dataset string, text string, original_annotation string, annotator_annotation string"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of annotations; both annotation columns must be dict literals of 0 and 1, else reading the row raises."""
    raw = spark.read.option("header", True).option("sep", "\t").option("multiLine", True).schema(ANNOTATIONS).csv(path)
    checks = {}
    for c in ("original_annotation", "annotator_annotation"):
        parsed = F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "map<string,int>")
        bad = parsed.isNull() | F.exists(F.map_values(parsed), lambda v: v.isNull() | ~v.isin(0, 1))
        checks[f"{c}_map"] = F.when(bad, F.raise_error(F.concat(F.lit(f"{c} of row "), F.coalesce("text_index", F.lit("?")), F.lit(" is no dict of 0 and 1")))).otherwise(parsed)
    return raw.withColumns(checks)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words by suffix: JSON arrays of entries whole, CSV as wordForm only; other suffixes raise."""
    if path.endswith(".json"):
        return read_json_array(spark, path, "completeWordForm string, wordForm string, url string")
    if path.endswith(".csv"):
        return read_csv(spark, path, "id int, index int, word string, sum_prob double").select(F.col("word").alias("wordForm"))
    raise ValueError("words must be .json or .csv")
