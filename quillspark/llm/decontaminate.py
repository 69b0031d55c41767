"""Benchmark decontamination by word seeds and local alignment.

An alignment that reaches the threshold keeps so many words of its item in so short a passage that, of any large enough
part of the item's words, some must occur there close together. That part is made of the words that are rarest in the
documents; where enough of them meet, and no bound excludes it, the item is aligned with the words around
(Smith-Waterman over words). So no copy is missed, however its edits are spread. Both passes over the documents run
where the documents are read: only the counts of the items' own words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .scratch import persist_table, small_batches

#: Words; a shorter item must occur whole and unchanged.
LEAST_ITEM = 6
MATCH, MISMATCH, GAP = 2, -1, 1
#: Share of an item's words that must meet as seeds at least, and how many pairs of a word and an item are held at once.
SEED_SHARE, PAIRS = 0.15, 1 << 20
_FILTER_BITS = 20


@dataclass
class Items:
    """Test items that one pass looks for, and their words as hashes; ``vocabulary`` is sorted."""

    ids: list
    words: list[np.ndarray]
    size: np.ndarray
    vocabulary: np.ndarray
    maybe: np.ndarray
    member: np.ndarray  # word of the vocabulary * items + item, ascending
    times: np.ndarray  # how often the item has the word

    @classmethod
    def read(cls, rows: list[tuple]) -> Items:
        ids, taken = [], []
        for item, text in rows:
            for found in W.chunks(pa.array([text], pa.string()), W.PUNCTUATION, fold=True, chunk_bytes=1 << 30):
                if not len(found.hash):
                    continue
                ids.append(item)
                taken.append(found.hash)
        size = np.array([len(x) for x in taken], np.int64)
        vocabulary, word = np.unique(np.concatenate(taken) if ids else np.zeros(0, np.uint64), return_inverse=True)
        member, times = np.unique(word * len(ids) + np.repeat(np.arange(len(ids)), size), return_counts=True)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[vocabulary >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(ids, taken, size, vocabulary, maybe, member, times)

    def places(self, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Where a chunk has words of the items, and which."""
        near = np.flatnonzero(self.maybe[found.hash >> np.uint64(64 - _FILTER_BITS)])
        if not len(near) or not len(self.vocabulary):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.vocabulary, found.hash[near]), len(self.vocabulary) - 1)
        real = self.vocabulary[at] == found.hash[near]
        return near[real], at[real]


@dataclass
class Seeds:
    """The items with their seeds: ``owner[first[v]:first[v + 1]]`` are the items that word v of the vocabulary is a seed of."""

    items: Items
    least: np.ndarray  # share of its full score that counts, for each item
    need: np.ndarray  # seeds that any such alignment holds
    span: np.ndarray  # words of a document that it covers at most
    owner: np.ndarray
    first: np.ndarray

    @classmethod
    def choose(cls, items: Items, counts: np.ndarray, least: float) -> Seeds:
        """Each item's rarest words, as many as make sure that some of them are left in every alignment.

        A score of ``least`` leaves at most ``lost`` words of an item without a match, so of ``lost + k`` of them k are
        matched, whichever they are: words that no document holds cost seeds, but hide nothing.
        """
        share = np.where(items.size < LEAST_ITEM, 1.0, least)
        lost = items.size - np.ceil(share * items.size - 1e-9).astype(np.int64)
        # a match gives MATCH and any other word of the passage costs at least GAP
        span = items.size + np.floor(MATCH * (1 - share) * items.size / GAP + 1e-9).astype(np.int64)
        target = np.minimum(items.size, lost + np.maximum(2, np.ceil(SEED_SHARE * items.size).astype(np.int64)))
        word, item = np.divmod(items.member, max(1, len(items.ids)))
        order = np.lexsort((word, counts[word], item))
        word, item, times = word[order], item[order], items.times[order]
        before = np.cumsum(times) - times
        before -= np.repeat(before[np.searchsorted(item, np.arange(len(items.ids)))], np.bincount(item, minlength=len(items.ids))) if len(item) else 0
        taken = before < target[item]
        held = np.bincount(item[taken], weights=times[taken], minlength=len(items.ids)).astype(np.int64)
        word, item = word[taken], item[taken]
        order = np.argsort(word, kind="stable")
        return cls(items, share, np.maximum(1, held - lost), span, item[order], np.searchsorted(word[order], np.arange(len(items.vocabulary) + 1)))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, and how many words of item and passage come before its end."""
    k, m, w = len(items), max(map(len, items)), max(map(len, passages))
    a = np.zeros((k, m), np.uint64)
    b = np.zeros((k, w), np.uint64)
    real_a, real_b = np.zeros((k, m), bool), np.zeros((k, w), bool)
    for n, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[n, : len(x)], real_a[n, : len(x)] = x, True
        b[n, : len(y)], real_b[n, : len(y)] = y, True
    slope = (GAP * np.arange(1, w + 1)).astype(np.int32)
    row = np.zeros((k, w + 1), np.int32)
    best, end_a, end_b = np.zeros(k, np.int32), np.zeros(k, np.int64), np.zeros(k, np.int64)
    every = np.arange(k)
    for i in range(m):
        same = (a[:, i : i + 1] == b) & real_b & real_a[:, i : i + 1]
        down = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] - GAP)
        np.maximum(down, 0, out=down)
        # a gap along the passage costs GAP a word: a running maximum on the slope covers gaps of any length
        row[:, 1:] = np.maximum.accumulate(down + slope, axis=1) - slope
        peak = row[:, 1:].argmax(axis=1)
        value = row[every, peak + 1]
        better = value > best
        best[better], end_a[better], end_b[better] = value[better], i + 1, peak[better] + 1
    return best, end_a, end_b


def _windows(seeds: Seeds, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of the chunk, item, first word, end word) of the passages that can hold an alignment."""
    items = seeds.items
    where, word = items.places(found)
    of_word = np.full(len(found.hash), -1, np.int64)
    of_word[where] = word
    times = np.diff(seeds.first)[word]
    where, word, times = where[times > 0], word[times > 0], times[times > 0]
    doc = np.searchsorted(found.first, where, side="right") - 1
    pairs = np.append(0, np.cumsum(times))
    parts, start = [], 0
    while start < len(where):
        # whole documents
        stop = max(start + 1, int(np.searchsorted(pairs, pairs[start] + PAIRS, side="right")) - 1)
        head = int(np.searchsorted(doc, doc[min(stop, len(doc) - 1)]))
        stop = len(doc) if stop >= len(doc) else head if head > start else int(np.searchsorted(doc, doc[start], side="right"))
        n = times[start:stop]
        at = np.repeat(seeds.first[word[start:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(doc[start:stop], n) * len(items.ids) + seeds.owner[at]
        order = np.argsort(key, kind="stable")
        key, place = key[order], np.repeat(where[start:stop], n)[order]
        start = stop
        item = key % len(items.ids)
        last = np.arange(len(key)) + seeds.need[item] - 1
        inside = np.minimum(last, len(key) - 1)
        close = np.flatnonzero((last < len(key)) & (key[inside] == key) & (place[inside] - place < seeds.span[item]))
        if not len(close):
            continue
        key, item, begin, end = key[close], item[close], place[inside[close]] + 1, place[close]
        begin, end = begin - seeds.span[item], end + seeds.span[item]
        # passages of one document and item that overlap are one
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (begin[1:] > end[:-1])
        heads = np.flatnonzero(new)
        d, t = np.divmod(key[heads], len(items.ids))
        lo, hi = np.maximum(begin[heads], found.first[d]), np.minimum(end[np.append(heads[1:], len(key)) - 1], found.first[d + 1])
        keep = _bound(items, of_word, t, lo, hi) >= MATCH * seeds.least[t] * items.size[t] - 1e-9
        parts.append((d[keep], t[keep], lo[keep], hi[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _bound(items: Items, of_word: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """No alignment within a passage scores more: its best run, where each word that the item has anywhere counts as matched."""
    n = hi - lo
    first = np.cumsum(n) - n
    word = of_word[np.repeat(lo - first, n) + np.arange(n.sum())]
    key = word * len(items.ids) + np.repeat(item, n)
    has = (word >= 0) & (items.member[np.minimum(np.searchsorted(items.member, key), len(items.member) - 1)] == key)
    gain = np.where(has, MATCH, -GAP)
    # sums of later passages lie below those of earlier ones, so that the running minimum starts anew with each
    total = np.cumsum(gain) - np.repeat(np.arange(len(n)), n) * (4 * MATCH * (len(gain) + 1))
    return np.maximum.reduceat(total - np.minimum.accumulate(total - gain), first)


def _matches(seeds: Seeds, found: W.Words) -> list[tuple[int, int, float, int, int]]:
    """(document of the chunk, item, share of the item's full score, first word, end word) of all alignments that reach the item's least share."""
    items = seeds.items
    d, t, lo, hi = _windows(seeds, found)
    out = []
    order = np.argsort(hi - lo, kind="stable")
    step = 0
    while step < len(order):
        wide = int(hi[order[step]] - lo[order[step]])
        take = order[step : step + max(1, 100_000 // max(1, 2 * wide))]
        step += len(take)
        a, b = [items.words[t[n]] for n in take], [found.hash[lo[n] : hi[n]] for n in take]
        score, end_a, end_b = align(a, b)
        share = score / np.array([MATCH * len(x) for x in a])
        for n in np.flatnonzero(share >= seeds.least[t[take]]):
            # the same from behind gives where the alignment begins
            back, _, length = align([a[n][: end_a[n]][::-1]], [b[n][: end_b[n]][::-1]])
            stop = int(lo[take[n]] + end_b[n] - found.first[d[take[n]]])
            out.append((int(d[take[n]]), int(t[take[n]]), float(share[n]), stop - int(length[0]), stop))
    best: dict[tuple[int, int], tuple] = {}
    for x in sorted(out, key=lambda x: (-x[2], x[3])):
        best.setdefault(x[:2], x)
    return sorted(best.values())


def blocks_of(benchmark: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple]]:
    """The test items in blocks of bounded size, each small enough to go to every task."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // (block_bytes // 2)))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(map(tuple, part.collect()), key=lambda x: (str(x[0]), x[1]))


def _rare(docs: DataFrame, blocks: list[Items], least: float) -> list[Seeds]:
    """Seeds of the items of several blocks, with word counts over the whole texts of all documents, in one pass."""

    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(items.vocabulary), np.int64) for items in blocks]
        for batch in batches:
            for found in W.chunks(batch.column(0), W.PUNCTUATION, fold=True):
                for items, total in zip(blocks, totals, strict=True):
                    total += np.bincount(items.places(found)[1], minlength=len(total))
        for k, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["block", "word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "block int, word int, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))
    counts = [np.zeros(len(items.vocabulary), np.int64) for items in blocks]
    for block, word, n in counted.collect():  # at most one row for each word of the blocks' items
        counts[block][word] = n
    return [Seeds.choose(items, n, least) for items, n in zip(blocks, counts, strict=True)]


#: Blocks of items that one pass over the documents looks for.
TOGETHER = 4


def _passes(docs: DataFrame, benchmark: DataFrame, least: float, block_bytes: int) -> Iterator[list[Seeds]]:
    """Seeds of the items, up to :data:`TOGETHER` blocks at a time. docs: text."""
    held: list[Items] = []
    for rows in blocks_of(benchmark, block_bytes):
        held.append(Items.read(rows))
        if len(held) == TOGETHER:
            yield _rare(docs, held, least)
            held = []
    if held:
        yield _rare(docs, held, least)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score (share of the item's full alignment score), start_word and end_word of every contaminated document and item.

    docs: doc_id and text; benchmark: item_id and text. Words are runs without white space and ASCII punctuation, A-Z
    folded. Null and empty texts and null ids of items are not searched; items of fewer than 6 words match only whole and unchanged. Null and empty document texts match nothing. A document with
    several alignments for an item gives the best, the first of equals. Repeated rows of documents give repeated rows;
    repeated items count once. Other columns are not read. The rows found do not depend on how items are dealt to blocks:
    seeds are so many that every alignment holds enough of them, so recall is that of aligning every item with every document.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for taken in _passes(docs, benchmark, least, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], taken: list[Seeds] = taken) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(c.row + x[0], seeds.items.ids[x[1]], *x[2:]) for c in W.chunks(batch.column(1), W.PUNCTUATION, fold=True) for seeds in taken for x in _matches(seeds, c)]
                at, item, score, start, end = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item).cast(item_type), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["doc_id", "item_id", "score", "start_word", "end_word"],
                )

        part = docs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start_word int, end_word int")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item; see :func:`matches`.

    Words are counted over the documents given, whatever earlier blocks dropped, and what a pass keeps is written before the next, so
    passes grow with the number of blocks and the result does not depend on it.
    """
    at = docs.columns.index(text)
    texts = docs.select(F.col(text).alias("text"))
    kept, passes = docs, 0
    for taken in _passes(texts, benchmark, least, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], taken: list[Seeds] = taken) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for found in W.chunks(batch.column(at), W.PUNCTUATION, fold=True):
                    for seeds in taken:
                        for x in _matches(seeds, found):
                            keep[found.row + x[0]] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        if passes:
            kept = persist_table(kept, "clean")
        kept = kept.mapInArrow(run, docs.schema)
        passes += 1
    return kept
