"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings; besides a weight for each term the model learns factors whose products weigh
pairs of terms, so that two harmless words together can count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .features import terms
from .labelled import sample
from .models import Factors
from .scratch import small_batches

BITS = 20
#: Labelled documents that a model is fitted on, at most.
SAMPLE = 12_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0: such rows are never learnt from. A null id counts as not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE, bits: int = BITS) -> Factors:
    """A model for label 1 from at most ``limit`` labelled documents that are not held out; see :func:`labelled.sample`."""
    x, marked = sample(docs, labels, label, lambda column: terms(column, bits), limit, ~held_out())
    return Factors.fit(x, (marked >= 1).astype(float), bits)


def score(docs: DataFrame, model: Factors, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``least``) of every row, from its whole text alone.

    Null and empty texts get the score of no terms. Rows are taken one by one; repeated rows score the same, null doc_ids
    stay null, other columns are not read.
    """
    small_batches(docs.sparkSession)
    bits = len(model.weights).bit_length() - 1
    docs = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(terms(batch.column(2), bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
