"""Whole texts as arrays: words, word hashes and n-gram hashes over Arrow buffers, without a Python loop per word.

All hashes are 64-bit and depend on the bytes of a word only, so they agree between documents, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and documents that are taken together at most; a longer single text is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 1 << 19, 1 << 10
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation.
PUNCTUATION = SPACES.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Words:
    """The words of consecutive documents: ``first[d]:first[d + 1]`` are those of document d of this chunk."""

    row: int  # of the chunk's first document in its batch
    data: np.ndarray  # bytes of the documents, without gaps
    begin: np.ndarray  # byte at which each word begins
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    total: np.ndarray  # running sums over the bytes, for hashes of parts of words

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def part_hash(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (of all, if it has fewer)."""
        stop = np.minimum(self.begin + size, self.end)
        return mix((self.total[stop] - self.total[self.begin]) * powers(len(self.data) + 1)[1][self.begin] + np.uint64(size))

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each word are of the kinds that ``marked`` (256 flags) marks."""
        runs = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(marked[self.data], out=runs[1:])
        return runs[self.end] - runs[self.begin]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACES, fold: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of every document of a string column, in chunks of about ``chunk_bytes``. Each text is taken whole."""
    data, at = text_buffers(column)
    n, row = len(at) - 1, 0
    while row < n:
        stop = int(np.searchsorted(at, at[row] + chunk_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), row + CHUNK_DOCS, n)
        part = data[at[row] : at[stop]]
        offsets = at[row : stop + 1] - at[row]
        yield _words(row, LOWER[part] if fold else part, offsets, separators)
        row = stop


def _words(row: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    size = len(data)
    inside = ~separators[data]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=total[1:])
    raw = (total[end] - total[begin]) * down[begin]
    raw += (end - begin).astype(np.uint64) * _MULT
    return Words(row, data, begin, end, np.searchsorted(begin, offsets), mix(raw), total)


def grams(words: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document: hash, document, first word.

    With ``short``, a document of fewer words (but at least one) gives its whole sequence as one run.
    """
    h, first = words.hash, words.first
    total = len(h)
    if total >= n:
        acc = h[: total - n + 1] * _MULT
        for j in range(1, n):
            acc = (acc ^ (acc >> np.uint64(29))) * _BASE + h[j : total - n + 1 + j]
        acc = mix(acc)
        doc = words.doc_of_word()
        keep = doc[: total - n + 1] == doc[n - 1 :]
        where = np.flatnonzero(keep)
        out, docs = acc[where], doc[where]
    else:
        out, docs, where = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not short:
        return out, docs, where
    sizes = np.diff(first)
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    if not len(few):
        return out, docs, where
    extra = []
    for d in few:
        acc = np.uint64(len(h[first[d] : first[d + 1]]))
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                acc = (acc ^ (acc >> np.uint64(29))) * _BASE + x
        extra.append(acc)
    out = np.concatenate([out, mix(np.array(extra, np.uint64) ^ _MULT)])
    docs = np.concatenate([docs, few])
    where = np.concatenate([where, first[few]])
    order = np.argsort(docs, kind="stable")
    return out[order], docs[order], where[order]


#: Bits of a hash that sets of hashes keep, so that a chunk's sets sort as single whole numbers.
SET_BITS = 54


def distinct_by_doc(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (their upper 54 bits) of each document of a chunk, ascending, and where each document's begin."""
    keys = (docs.astype(np.uint64) << np.uint64(SET_BITS)) | (hashes >> np.uint64(64 - SET_BITS))
    keys.sort()
    keep = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=keep[1:])
    keys = keys[keep]
    first = np.searchsorted(keys >> np.uint64(SET_BITS), np.arange(n_docs + 1, dtype=np.uint64))
    return keys & np.uint64((1 << SET_BITS) - 1), first


def int_list(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the places where each row's begin."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
