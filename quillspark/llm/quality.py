"""Quality by ordinal regression: graded ratings, one set of hashed-text weights, ordered cuts.

The cumulative-link model gives each document P(grade >= g) for every grade; their sum is the expected grade, and the
tail from a chosen grade on decides what is selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .features import style
from .labelled import sample
from .models import Ordinal
from .scratch import small_batches

BITS = 17
#: Labelled documents that a model is fitted on, at most.
SAMPLE = 12_000


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE, bits: int = BITS, use: Column | None = None) -> Ordinal:
    """A model for the grades in ``label``, from at most ``limit`` labelled documents; see :func:`labelled.sample`. Without labels all documents pass."""
    x, rating = sample(docs, labels, label, lambda column: style(column, bits), limit, use)
    return Ordinal.fit(x, rating, bits)


def _bits(model: Ordinal) -> int:
    return len(model.weights).bit_length() - 1


def _tail(model: Ordinal, tails: np.ndarray, grade: float | None) -> np.ndarray:
    """P(grade >= ``grade``); the top grade by default."""
    if len(model.grades) < 2:
        return np.ones(len(tails))
    at = len(model.grades) - 1 if grade is None else int(np.searchsorted(model.grades, grade))
    return np.ones(len(tails)) if at == 0 else tails[:, at - 1] if at <= tails.shape[1] else np.zeros(len(tails))


def score(docs: DataFrame, model: Ordinal, grade: float | None = None, least: float = 0.4) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= ``grade``)) and selected (tail >= ``least``) of every row, over its whole text.

    Null and empty texts are scored alike. Rows are taken one by one; repeated rows score the same, null doc_ids
    stay null, other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(style(batch.column(1), _bits(model)))
            tail = _tail(model, tails, grade)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.expected(tails), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail", "selected"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double, selected boolean")


def select(docs: DataFrame, model: Ordinal, grade: float | None = None, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that :func:`score` selects."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _tail(model, model.tails(style(batch.column(at), _bits(model))), grade) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
