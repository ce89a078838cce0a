"""Problem 9: personal information inside free text, found and replaced by typed placeholders.

Method: a semi-Markov conditional random field (``pii_model``): whole-span features score candidate segments and a dynamic
programme over bounded segments chooses boundaries and types together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pii_model import decode, normal_given, trained_weights

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
MAX_NAMES = 500_000  # the name list is broadcast to every executor; a longer one is refused


def _names(first_names: DataFrame) -> list[str]:
    names = [r[0] for r in first_names.select(F.col(first_names.columns[0]).cast("string")).where(F.col(first_names.columns[0]).isNotNull()).distinct().limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names")
    return sorted(names)


def _model(documents: DataFrame, first_names: DataFrame, sentences: int):
    """The trained weights and the name list, broadcast once to every executor: sizes bounded by the feature set and by MAX_NAMES."""
    given = normal_given(_names(first_names))
    return documents.sparkSession.sparkContext.broadcast((trained_weights(given, sentences), given))


def spans(documents: DataFrame, first_names: DataFrame, sentences: int = 3000) -> DataFrame:
    """``(doc_id, start, end, kind, found_text)``: every found value in text order; positions count characters from 0.

    ``documents``: (doc_id, text), ``first_names``: one column of given names, a hint and no condition. ``sentences`` is the
    bounded number of training sentences the model is fitted on. Null and empty texts give nothing; texts are read whole, of
    any length; repeated rows give repeated results; an empty name list only removes that hint. One narrow pass, no shuffle.
    """
    model = _model(documents, first_names, sentences)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, given = model.value
        for pdf in batches:
            rows = [(doc, a, b, kind, text[a:b]) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b, kind in decode(text, weights, given)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "kind", "found_text"]).astype({"doc_id": "int64", "start": "int32", "end": "int32"})

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    return src.mapInPandas(run, "doc_id bigint, start int, end int, kind string, found_text string")


def redact(documents: DataFrame, first_names: DataFrame, sentences: int = 3000) -> DataFrame:
    """``(doc_id, text, n_replaced)``: every row of ``documents`` with placeholders in place of found values, all else unchanged.

    Null texts stay null and empty ones empty, with n_replaced 0.
    """
    model = _model(documents, first_names, sentences)

    def clean(text: str | None) -> tuple[str | None, int]:
        found = decode(text, *model.value) if text else []
        parts, at = [], 0
        for a, b, kind in sorted(found):
            parts += [text[at:a], PLACEHOLDERS[kind]]
            at = b
        return (text if not found else "".join([*parts, text[at:]])), len(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [clean(t if isinstance(t, str) else None) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series([t for t, _ in done], dtype=object, index=pdf.index), "n_replaced": pd.Series([n for _, n in done], dtype="int32", index=pdf.index)})

    src = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return src.mapInPandas(run, f"doc_id {kind}, text string, n_replaced int")
