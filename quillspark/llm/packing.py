"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing. Tokenised documents stay in the partition that read them: each partition packs its
pieces by best fit and keeps its full sequences. Sequences with room left are then items themselves: a tree of
rounds brings the underfull ones of several groups together, packs them again by best fit, and goes on until one
group is left or a round gains nothing. Only (sequence, length) pairs of underfull sequences are shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import persist_table, small_batches

#: Token that ends every document.
END_ID = 2
#: Widths of the fields of a sequence id: partition, packed group of that partition, sequence of that group.
PARTITION_BITS, GROUP_BITS, SEQUENCE_BITS = 21, 21, 21
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_length long"
_TOKENIZERS: dict = {}


class Tokenizer:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file.

    The same vocabulary as ranks gives the same ids four times faster; texts that hold the text of a special token,
    which ``tokenizers`` reads as that token, go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer as Json

        self.json = Json.from_file(json_path)
        self.special = [t.content for t in self.json.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.json.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def _tokenizer(*paths: str | None) -> Tokenizer:
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = Tokenizer(*paths)
    return _TOKENIZERS[paths]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes into the fullest bin that still holds it. Items by index."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct rooms in use, ascending; at most ``capacity`` of them
    by_room: dict[int, list[int]] = {}
    for i in order.tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
            bins[at].append(i)
            room -= size
        else:
            at, room = len(bins), capacity - size
            bins.append([i])
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(at)
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = list(range(head, length, capacity))
    return [(0, head)] * bool(head) + [(s, capacity) for s in starts]


def sequence_ids(partition: int, group: int) -> int:
    """The first id of a packed group: fields of fixed width for partition, group and sequence, each checked."""
    if partition >> PARTITION_BITS or group >> GROUP_BITS:
        raise OverflowError(f"no sequence ids for group {group} of partition {partition}: use smaller partitions or larger groups")
    return ((partition << GROUP_BITS) | group) << SEQUENCE_BITS


def _packed(sizes: list, first_id: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence id, offset and sequence length of each item. Ids count on from ``first_id``."""
    lengths = np.array(sizes, np.int64)
    bin_id, offset, total = (np.zeros(len(lengths), np.int64) for _ in range(3))
    bins = best_fit(lengths, capacity)
    if len(bins) >> SEQUENCE_BITS:
        raise OverflowError(f"{len(bins)} sequences in one group: use smaller groups")
    for k, members in enumerate(bins):
        own = lengths[members]
        ends = np.cumsum(own)
        bin_id[members] = first_id + k
        offset[members] = ends - own
        total[members] = ends[-1]
    return bin_id, offset, total


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    end_id: int = END_ID,
    group_rows: int = 100_000,
    fan_in: int = 16,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id and text (null: empty); other columns are not read. A document is its ids and ``end_id``; only one
    longer than ``capacity`` is cut, its first piece takes what is left over. Rows with equal or null doc_id are
    documents of their own. An empty table gives no rows. Ties in length go by order of the rows in the partition.
    ``group_rows`` bounds what one task packs in a round (a group ends with the batch that fills it, at eight times as many in
    any case); ``fan_in`` is how many groups a round brings together. Raises OverflowError where ids would run out, rather than use one twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _tokenizer(tokenizer_path, ranks_path, pattern)
        partition, group = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        doc, piece, start, length, crc = [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal group, doc, piece, start, length, crc
            if doc:
                placed = _packed(length, sequence_ids(partition, group), capacity)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(v, k) for v, k in zip((doc, piece, start, length, crc, *placed), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _PIECES.split(", ")])
                group += 1
                doc, piece, start, length, crc = [], [], [], [], []

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    doc.append(key)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].astype("<u4").tobytes()))
                if len(doc) >= 8 * group_rows:  # long documents
                    yield from flush()
            if len(doc) >= group_rows:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    pieces = persist_table(docs.mapInArrow(local, _PIECES), "pieces")
    moved = _merge_underfull(pieces, capacity, group_rows, fan_in)
    if moved is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    # ``moved`` holds one row for each sequence that was underfull after the local round; Spark picks the join by its size
    joined = pieces.join(moved, "bin", "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _merge_underfull(pieces: DataFrame, capacity: int, group_rows: int, fan_in: int) -> DataFrame | None:
    """The tree of rounds: (bin, target, shift) for the underfull sequences of the local round."""
    state = pieces.where((F.col("bin_offset") == 0) & (F.col("bin_length") < capacity)).select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"), F.col("bin_length").alias("size"))
    state = persist_table(state, "underfull")
    left = state.count()
    if left < 2:
        return None
    groups = max(1, -(-left // group_rows), min(64, left // 2000))
    for k in range(1, 64):
        before = left
        tops = state.where(F.col("size") < capacity).select(F.col("target").alias("top"), "size").distinct()
        merged = persist_table(_round(tops, k, groups, capacity), f"round{k}")
        state = state.join(merged, state.target == merged.top, "left").select(
            "bin", F.coalesce("new", "target").alias("target"), (F.col("shift") + F.coalesce("add", F.lit(0))).alias("shift"), F.coalesce("total", "size").alias("size")
        )
        state = persist_table(state, f"state{k}")
        left = state.where(F.col("size") < capacity).select("target").distinct().count()
        if groups == 1 or left < 2 or (groups <= -(-left // group_rows) and left > 0.999 * before):
            break
        groups = max(1, -(-left // group_rows), groups // fan_in)
    return state.select("bin", "target", "shift")


def _round(tops: DataFrame, k: int, groups: int, capacity: int) -> DataFrame:
    def again(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("top", "ascending")])
        new, add, total = _packed(table["size"].to_pylist(), 0, capacity)
        # the new id is that of the first member: unique, and the same when a task runs again
        first = {int(b): int(t) for b, t, o in zip(new, table["top"].to_pylist(), add, strict=True) if o == 0}
        named = [first[int(b)] for b in new]
        return pa.table({"top": table["top"], "new": pa.array(named, pa.int64()), "add": pa.array(add, pa.int64()), "total": pa.array(total, pa.int64())})

    dealt = tops.withColumn("group", F.pmod(F.xxhash64("top", F.lit(k)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(again, "top long, new long, add long, total long")
