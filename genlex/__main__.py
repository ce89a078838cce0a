"""python -m genlex QUERY TABLES OUT: run a named query over the folder of tables and write its rows as parquet; without arguments the names."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from genlex.plans import io_queries, queries  # noqa: F401  (io_queries adds its own)
from genlex.session import release


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code 0, or 2 for a query that does not exist."""
    parser = argparse.ArgumentParser(prog="genlex", description="Run a named query over a folder of parquet tables.")
    parser.add_argument("query", nargs="?", help="name of the query; none lists them")
    parser.add_argument("tables", nargs="?", help="folder with TABLE.parquet")
    parser.add_argument("out", nargs="?", help="folder to write to")
    parser.add_argument("--mode", choices=("error", "overwrite"), default="error", help="what to do if OUT exists")
    given = parser.parse_args(args)
    found = queries.QUERIES
    if given.query is None:
        print("\n".join(sorted(found)))
        return 0
    if given.query not in found or given.out is None:
        print(f"no query {given.query}" if given.query not in found else "QUERY TABLES OUT are needed", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName(f"genlex {given.query}").getOrCreate()
    found[given.query](spark, given.tables).write.mode(given.mode).parquet(given.out)
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
