"""Features of a bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .features import Sparse
from .scratch import small_batches


def sample(docs: DataFrame, labels: DataFrame, label: str, featurise: Callable[[pa.Array], Sparse], limit: int, use: Column | None = None) -> tuple[Sparse, np.ndarray]:
    """Features and labels of at most ``limit`` documents, the first by a hash of doc_id among those that have a label.

    labels: doc_id and ``label``; rows without either are left out, as are those whose document is absent, and of several labels
    of a doc_id the largest counts. Of several documents with one doc_id the least text counts (null as empty).
    ``use`` says which rows of labels may be learnt from. The rows are sorted, so equal inputs give equal models.
    """
    small_batches(docs.sparkSession)
    rows = labels.select("doc_id", F.col(label).cast("double").alias("_label")).where(F.col("doc_id").isNotNull() & F.col("_label").isNotNull())
    rows = rows.where(use) if use is not None else rows
    marked = rows.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    # labels of absent documents must not use up the bound, so ids meet first; of the documents only ids move for that
    present = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # at most ``limit`` pairs, so they may go to every task
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    # a repeated doc_id is one document; partial aggregation keeps one text of each in every task
    one = texts.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))
    joined = one.select(F.xxhash64("doc_id", "_text").alias("_order"), "_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = featurise(batch.column(1))
            first = pa.array(x.first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in (x.index.astype(np.int32), x.value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2)], names=["at", "index", "value", "label"])

    found = joined.mapInArrow(run, "at long, index array<int>, value array<float>, label double").toArrow()
    found = found.sort_by("at").combine_chunks()
    label_of = found["label"].to_numpy()
    if not len(label_of):
        return Sparse.join([]), label_of
    index, value = (found[c].combine_chunks() for c in ("index", "value"))
    return Sparse(index.flatten().to_numpy(), value.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(index.offsets.to_numpy()))).astype(np.int64)), label_of
