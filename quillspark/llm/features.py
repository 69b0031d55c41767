"""Hashed features of whole texts, as flat arrays for each chunk of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import words as W


@dataclass
class Sparse:
    """Features of ``docs`` documents: ``index[first[d]:first[d + 1]]`` are those of document d."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @classmethod
    def join(cls, parts: list[Sparse]) -> Sparse:
        starts = np.cumsum([0, *(len(p.index) for p in parts)])
        first = [p.first[:-1] + s for p, s in zip(parts, starts, strict=False)]
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) if parts else np.zeros(0, t) for k, t in (("index", np.int32), ("value", np.float32))), np.append(np.concatenate(first) if parts else [], starts[-1]).astype(np.int64))


def _distinct(keys: np.ndarray, bits: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document << bits | bucket) keys: bucket, how often, where each document's begin."""
    keys = np.sort(keys)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(keys)))
    keys = keys[head]
    return (keys & ((1 << bits) - 1)).astype(np.int32), times, np.searchsorted(keys >> bits, np.arange(docs + 1))


def terms(column: pa.Array, bits: int, prefixes: tuple[int, ...] = (4, 6)) -> Sparse:
    """Presence of words (A-Z folded, without ASCII punctuation) and of word beginnings of given bytes, in 2**bits buckets."""
    parts = []
    for found in W.chunks(column, W.PUNCTUATION, fold=True):
        doc = found.doc_of_word().astype(np.int64) << bits
        kinds = [found.hash, *(found.part_hash(n) for n in prefixes)]
        index, _, first = _distinct(np.concatenate([doc | (h >> np.uint64(64 - bits)).astype(np.int64) for h in kinds]), bits, found.docs)
        parts.append(Sparse(index, np.ones(len(index), np.float32), first))
    return Sparse.join(parts)


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_CAPITALS, _DIGITS = _flags((65, 90)), _flags((48, 57))
#: Kind of a word's last byte: letters and bytes beyond ASCII, marks that end clauses, shouts, bars, other signs, digits.
_LAST = np.full(256, 4, np.int64)
for _k, _bytes in ((0, [*range(65, 91), *range(97, 123), *range(128, 256)]), (1, b".,;:)\"'"), (2, b"!?"), (3, b"|"), (5, range(48, 58))):
    _LAST[list(_bytes)] = _k
_SHAPES = 3 * 6 * 2 * 4


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which of 16 steps a share is in."""
    return np.minimum(15, (16 * part / np.maximum(whole, 1)).astype(np.int64))


def style(column: pa.Array, bits: int) -> Sparse:
    """How a text is written, in 2**bits buckets: steps of the shares of word shapes, of repeated words, lines and five-word runs, of length; and its words.

    Shares rather than counts, so that long and short texts compare; words weigh by the root of their share.
    """
    parts = []
    for found in W.chunks(column):
        docs, n = found.docs, np.diff(found.first)
        doc = found.doc_of_word()
        size = found.end - found.begin
        capitals = found.count(_CAPITALS)
        level = np.where(capitals == 0, 0, np.where((capitals == 1) & (size > 1), 1, 2))
        shape = ((level * 6 + _LAST[found.data[found.end - 1]]) * 2 + (found.count(_DIGITS) > 0)) * 4 + np.minimum(3, size // 4)
        counts = np.bincount(doc * _SHAPES + shape, minlength=docs * _SHAPES).reshape(docs, _SHAPES)
        at, kind = np.nonzero(counts)
        names = [(at, kind * 16 + _share(counts[at, kind], n[at]))]
        every = np.arange(docs)
        base = _SHAPES * 16
        same = np.bincount(doc[1:], weights=(found.hash[1:] == found.hash[:-1]) & (doc[1:] == doc[:-1]), minlength=docs) if len(doc) > 1 else np.zeros(docs)
        _, first = W.distinct_by_doc(found.hash, doc, docs)
        _, run_first = W.distinct_by_doc(*W.grams(found, 5)[:2], docs)
        runs = np.maximum(n - 4, np.minimum(n, 1))
        for k, step in enumerate((_share(same, n), _share(np.diff(first), n), _share(np.diff(run_first), runs), np.minimum(15, np.log2(n + 1).astype(np.int64)))):
            names.append((every, base + k * 16 + step))
        who = np.concatenate([x for x, _ in names])
        names_hash = W.mix(np.concatenate([x for _, x in names]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        index = (names_hash >> np.uint64(64 - bits)).astype(np.int64)
        word, times, word_first = _distinct((doc << bits) | (found.hash >> np.uint64(64 - bits)).astype(np.int64), bits, docs)
        word_doc = np.repeat(every, np.diff(word_first))
        value = np.sqrt(times / np.maximum(n[word_doc], 1)) / 4
        who, index, value = np.concatenate([who, word_doc]), np.concatenate([index, word]), np.concatenate([np.ones(len(index)), value])
        order = np.argsort(who, kind="stable")
        parts.append(Sparse(index[order].astype(np.int32), value[order].astype(np.float32), np.searchsorted(who[order], np.arange(docs + 1))))
    return Sparse.join(parts)
