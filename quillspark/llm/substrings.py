"""Removal of long word sequences that occur in an earlier document, by recompression.

Recompression parses word sequences in rounds that first name maximal runs of one symbol and then pairs of adjacent symbols,
where a symbol is a first or a second half by a bit of its own name. Names are keyed hashes of what they stand for,
so a round names equal runs and pairs alike in all documents without asking anyone, and equal sequences get equal
symbols except near their ends. With each symbol goes the span of words that its parse depends on: where that span
lies inside a window of words, every other occurrence of the window has the same symbol at the same place.

So one high-level symbol can stand for a window: the one that covers most words, of equals the least by hash. Neighbouring
windows mostly choose the same, so a document has far fewer of them than windows, and only they are brought together
over the corpus. A window whose symbol occurs in no earlier document (and in no later one) cannot repeat; the others are
compared by 96-bit digests of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .scratch import drop_table, join_facts, persist_table, release, sent_if_few, small_batches

WINDOW = 50
ROUNDS = 4
_FAR = 1 << 40
_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F))


@dataclass
class Symbols:
    """High-level symbols of a chunk, in order: name, document, and the words that the parse depends on."""

    name: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray  # words that it covers


def _runs(x: Symbols, k: int) -> Symbols:
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], n) - 1
    times = tail - head + 1
    name = x.name[head]
    many = times > 1
    name[many] = W.mix(name[many] * _A + times[many].astype(np.uint64) * _B + np.uint64(2 * k))
    # a run is known where its neighbours are known to differ from it; beyond a document's end nothing is known
    low = np.full(len(head), -_FAR)
    high = np.full(len(head), _FAR)
    inner = np.flatnonzero((head > 0) & (x.doc[head] == x.doc[head - 1]))
    low[inner] = x.low[head[inner] - 1]
    after = np.minimum(tail + 1, n - 1)
    inner = np.flatnonzero((tail + 1 < n) & (x.doc[after] == x.doc[tail]))
    high[inner] = x.high[after[inner]]
    return Symbols(name, x.doc[head], low, high, np.add.reduceat(x.size, head))


def _pairs(x: Symbols, k: int) -> Symbols:
    n = len(x.name)
    first = (W.mix(x.name ^ np.uint64((int(_C) * (2 * k + 1)) % (1 << 64))) >> np.uint64(63)) == 0
    together = np.zeros(n, bool)
    together[:-1] = x.doc[:-1] == x.doc[1:]
    joins = np.zeros(n, bool)
    joins[:-1] = first[:-1] & ~first[1:] & together[:-1]
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    low, high, name = x.low.copy(), x.high.copy(), x.name.copy()
    at = np.flatnonzero(joins)
    name[at] = W.mix((x.name[at] * _B) ^ (W.mix(x.name[at + 1]) * _C) ^ np.uint64(2 * k + 1))
    high[at] = x.high[at + 1]
    # a symbol that stays alone depends on the neighbour that it did not pair with
    alone = np.flatnonzero(first & ~joins)
    high[alone] = np.where(together[alone], x.high[np.minimum(alone + 1, n - 1)], _FAR)
    alone = np.flatnonzero(~first & ~joined)
    before = np.maximum(alone - 1, 0)
    low[alone] = np.where((alone > 0) & together[before], x.low[before], -_FAR)
    size = x.size.copy()
    size[at] += x.size[at + 1]
    keep = ~joined
    return Symbols(name[keep], x.doc[keep], low[keep], high[keep], size[keep])


def window_digests(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each ``window`` consecutive words."""
    out = []
    up, down = W.powers(len(h) + 1)
    for k in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h * _A + np.uint64(k)) * up[: len(h)], out=total[1:])
        n = max(0, len(h) - window + 1)
        out.append(W.mix((total[window : window + n] - total[:n]) * down[:n]))
    return out[0], out[1]


@dataclass
class Parse:
    """The windows of a chunk's documents: where each begins, its document, and the name of the symbol that stands for it."""

    starts: np.ndarray
    doc: np.ndarray
    name: np.ndarray


def parse(found: W.Words, window: int = WINDOW, rounds: int = ROUNDS) -> Parse:
    """Symbols of a chunk by recompression, and each window's. A window that no symbol's dependence fits in stands for itself, by a digest."""
    doc = found.doc_of_word()
    n = len(doc)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if not len(starts):
        return Parse(starts, starts, np.zeros(0, np.uint64))
    x = Symbols(found.hash.copy(), doc, np.arange(n), np.arange(1, n + 1), np.ones(n, np.int64))
    for k in range(rounds):
        x = _pairs(_runs(x, k), k)
    use = np.flatnonzero(x.high - x.low <= window)
    begin, end = np.searchsorted(x.low[use], starts), np.searchsorted(x.high[use], starts + window, side="right")
    # the least of these keys within a window: most words first, then by hash
    key = ((63 - np.minimum(x.size[use], 63)).astype(np.uint64) << np.uint64(58)) | (W.mix(x.name[use] ^ _A) >> np.uint64(6))
    edges = np.stack([begin, np.maximum(end, begin + 1)], axis=1).ravel()
    least = np.minimum.reduceat(np.append(key, np.full(window + 2, 1 << 63, np.uint64)), edges)[::2]
    bare = np.flatnonzero(begin >= end)
    name = W.mix(least)
    if len(bare):
        name[bare] = W.mix(window_digests(found.hash, window)[0][starts[bare]] ^ _C)
    return Parse(starts, doc[starts], name)


def _names(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(name, doc_id): the distinct names that stand for windows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for found in W.chunks(batch.column(1)):
                x = parse(found, window, rounds)
                if not len(x.name):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])]))
                name, first = W.distinct_by_doc(x.name[new], x.doc[new], found.docs)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.repeat(ids[found.row : found.row + found.docs], np.diff(first)), pa.int64())], names=["name", "doc_id"])

    return docs.mapInArrow(run, "name long, doc_id long")


def _windows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """Windows whose name occurs in an earlier document (``late``) or in a later one (``early``)."""

    def lists(column: pa.ListArray, found: W.Words) -> np.ndarray:
        part = column.slice(found.row, found.docs)
        sizes = np.diff(part.offsets.to_numpy())
        values = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return np.sort((np.repeat(np.arange(found.docs, dtype=np.uint64), sizes) << np.uint64(W.SET_BITS)) | values)

    def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(keys), bool)
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for found in W.chunks(batch.column(1)):
                x = parse(found, window, rounds)
                keys = (x.doc.astype(np.uint64) << np.uint64(W.SET_BITS)) | (x.name >> np.uint64(64 - W.SET_BITS))
                late, early = (member(keys, lists(batch.column(k), found)) for k in (3, 4))
                some = np.flatnonzero(late | early)
                if not len(some):
                    continue
                at = x.starts[some]
                one, two = (d[at] for d in window_digests(found.hash, window))
                one, two = one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
                d = x.doc[some]
                columns = [one, two, ids[found.row + d], kinds[found.row + d], (at - found.first[d]).astype(np.int32), late[some], early[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "doc_id", "kind", "start", "late", "early"])

    return docs.mapInArrow(run, "one long, two int, doc_id long, kind long, start int, late boolean, early boolean")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept text of (doc_id, text, starts of removed windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if starts.is_valid and len(starts):
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                texts.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "text"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words joined by one space) of every row.

    Words are runs without ASCII white space, unchanged. A window is ``window`` consecutive words of one text; every word that
    a window covers whose word sequence also occurs in a row with a smaller doc_id is removed. Windows are judged on the
    input. Null and empty texts have no words. Rows with equal doc_id are separate but not earlier than each other;
    rows with a null doc_id keep all words and remove none. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    small_batches(docs.sparkSession)
    names = persist_table(_names(known, window, rounds), "names")
    shared = join_facts(names, ["name"], lambda x: x.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
    # sets, so that rows which share a doc_id and their text cost no more than one
    marked = shared.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("least") < F.col("doc_id"), F.col("name"))).alias("late"), F.collect_set(F.when(F.col("most") > F.col("doc_id"), F.col("name"))).alias("early")
    )
    marked = persist_table(marked, "marked")
    drop_table(names)
    release(docs.sparkSession)
    # texts with the same doc_id are told apart by a hash of the text, which only they carry; equal texts share their windows
    twice = persist_table(known.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_twice")), "twice")
    several = bool(twice.take(1))

    def told_apart(rows: DataFrame) -> DataFrame:
        if not several:
            return rows.withColumn("kind", F.lit(0).cast("long"))
        return rows.join(sent_if_few(twice), "doc_id", "left").withColumn("kind", F.when(F.col("_twice"), F.xxhash64("text")).otherwise(F.lit(0)))

    candidates = told_apart(known.join(marked, "doc_id")).select("doc_id", "text", "kind", "late", "early")
    windows = persist_table(_windows(candidates, window, rounds), "windows", compression="zstd")
    drop_table(marked)
    release(docs.sparkSession)
    again = join_facts(windows.where("late"), ["one", "two"], lambda x: x.groupBy("one", "two").agg(F.min("doc_id").alias("least")), windows.where("early")).where("least < doc_id")
    starts = persist_table(again.groupBy("doc_id", "kind").agg(F.collect_set("start").alias("starts")), "starts")
    drop_table(windows)
    release(docs.sparkSession)
    joined = told_apart(docs).join(starts, ["doc_id", "kind"], "left").select("doc_id", "text", "starts")
    return _kept(joined, window)


def digest(rows: DataFrame) -> DataFrame:
    """The result with the SHA-256 of the kept text in place of the text."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
