"""Documents that share most of their word n-grams: an exact Jaccard join by a blocked sparse product.

The incidence matrix has a row for each document and a column for each n-gram; two documents' overlap is an entry of its product with its
transpose. With all n-grams in one order, two linked documents must share columns among the first ones of both (a
share of each set that the threshold gives), and how many at least follows from their sizes. So only those columns are
multiplied, block by block of columns; overlap counts of a pair are added up over the blocks, and pairs below their bound
are discarded. The rest are compared in full.

The order puts n-grams that are frequent somewhere last, so that what only one document has comes first; how many such
columns a document has bounds its overlap with any other (its ``cap``). Documents with equal sets are one row. Before the
product, each document is compared with a few representatives of its columns; columns that hold a single component
by then have nothing to add, which is what keeps groups of thousands of copies linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .components import components
from .scratch import drop_table, join_facts, persist_table, release, sent_if_few, small_batches

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: N-grams that are put last in the order, at most; each is 8 bytes in every task. More than these only cost time.
FREQUENT = 1 << 21
#: N-grams that are counted together for that, and the count there from which one is reported.
_BLOCK, _OFTEN = 1 << 22, 2
_HOT_BITS = 22
PIVOTS = 3
#: Columns with more documents, or with more possible pairs for each document, are multiplied with whole sets, in blocks of so many members.
_LOOKED, _PAIRS, _MEMBERS = 4096, 8, 1024


def _sets(column: pa.Array, n: int) -> Iterator[tuple[W.Words, np.ndarray, np.ndarray]]:
    for found in W.chunks(column, fold=True):
        h, doc, _ = W.grams(found, n)
        yield (found, *W.distinct_by_doc(h, doc, found.docs))


def _signatures(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes of each set."""
    out = []
    for k in (1, 2):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(W.mix(values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


class _First:
    """Documents whose set this task has not met yet. Beyond so many sets it begins anew: equal sets then give one row more."""

    MOST = 1 << 18

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def __call__(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(one), bool)
        for k, pair in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
            if sizes[k] and pair not in self.seen:
                if len(self.seen) >= self.MOST:
                    self.seen.clear()
                self.seen.add(pair)
                keep[k] = True
        return keep


def _summary(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (doc_id, n_shingles, one, two), and rows (gram, times) of n-grams that a block of documents holds often."""
    names = ["doc_id", "n_shingles", "one", "two", "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, size = _First(), [], 0

        def often() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                values = np.sort(np.concatenate(held))
                head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                times = np.diff(np.append(head, len(values)))
                some = np.flatnonzero(times >= _OFTEN)
                nulls = [pa.nulls(len(some), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(values[head[some]].view(np.int64)), pa.array(times[some], pa.int64())], names=names)
            held, size = [], 0

        for batch in batches:
            for found, values, first in _sets(batch.column(1), n):
                one, two = _signatures(values, first)
                sizes = np.diff(first)
                new = fresh(one, two, sizes)
                held.append(values[np.repeat(new, sizes)])
                size += len(held[-1])
                ids = batch.column(0).slice(found.row, found.docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(one), pa.array(two), pa.nulls(found.docs, pa.int64()), pa.nulls(found.docs, pa.int64())], names=names)
                if size >= _BLOCK:
                    yield from often()
        yield from often()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, one long, two long, gram long, times long")


class _Frequent:
    """Membership in a sorted list of hashes."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.maybe = None

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(hashes), bool)
        if self.maybe is None:
            self.maybe = np.zeros(1 << _HOT_BITS, bool)
            self.maybe[self.values >> np.uint64(W.SET_BITS - _HOT_BITS)] = True
        out = self.maybe[hashes >> np.uint64(W.SET_BITS - _HOT_BITS)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        out[at] = self.values[place] == hashes[at]
        return out

    def __getstate__(self) -> np.ndarray:
        return self.values

    def __setstate__(self, values: np.ndarray) -> None:
        self.__init__(values)


def _least(size: np.ndarray | Column, percent: int) -> np.ndarray | Column:
    """The least overlap that a set of this size has with any linked one."""
    return F.ceil(size * percent / 100) if isinstance(size, Column) else -(-size * percent // 100)


def _columns(docs: DataFrame, n: int, percent: int, frequent: _Frequent) -> DataFrame:
    """(gram, doc_id, size): the first columns of each document's set, and -1 less the last of them; equal sets that one task meets give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _First()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for found, values, first in _sets(batch.column(1), n):
                sizes = np.diff(first)
                new = fresh(*_signatures(values, first), sizes)
                values = values[np.repeat(new, sizes)]
                sizes = sizes[new]
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                last = frequent(values)
                # frequent ones after the others, both by hash
                keys = np.sort((doc << np.uint64(W.SET_BITS)) | (values >> np.uint64(1)) | (last.astype(np.uint64) << np.uint64(W.SET_BITS - 1)))
                first = np.append(0, np.cumsum(sizes))
                take = sizes - _least(sizes, percent) + 1
                place = np.arange(len(keys)) - np.repeat(first[:-1], sizes)
                keep = place < np.repeat(take, sizes)
                gram = (keys[keep] & np.uint64((1 << W.SET_BITS) - 1)).view(np.int64)
                # one more row tells where each document's first columns end
                gram = np.concatenate([gram, -1 - gram[np.cumsum(take) - 1]])
                kept = ids[found.row : found.row + found.docs][new]
                columns = [pa.array(gram), pa.array(np.concatenate([np.repeat(kept, take), kept]), pa.int64()), pa.array(np.concatenate([np.repeat(sizes, take), sizes]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc_id", "size"])

    return docs.mapInArrow(run, "gram long, doc_id long, size int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows of whole grams (first column), from batches that are sorted by it."""
    rest: list[list[np.ndarray]] = []  # of the last gram so far
    for batch in batches:
        if not len(batch):
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest and now[0][-1] == rest[-1][0][-1]:
            rest.append(now)
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        yield_now = [*rest, [c[:cut] for c in now]]
        rest = [[c[cut:] for c in now]]
        whole = [np.concatenate(x) for x in zip(*yield_now, strict=True)]
        if len(whole[0]):
            yield whole
    if rest:
        yield [np.concatenate(x) for x in zip(*rest, strict=True)]


#: N-grams that so many documents hold are dealt to salts while rows are only passed on.
_CROWDED, _SALTS = 2048, 256


def _shared(columns: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of columns with two documents or more, and the rows that are no columns.

    A row is passed on when the next or the previous is of the same column, so no column is held. Columns in ``crowded`` (gram,
    at most FREQUENT of them) have many documents for sure; their rows are dealt out further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, not passed on yet
        same = False  # whether the row before it was of its column
        for batch in batches:
            if not len(batch):
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            gram, doc, size, sure = now
            new = np.concatenate([[not same], gram[1:] != gram[:-1]])
            last = np.append(new[1:], True)
            keep = ~(new & last) | (gram < 0) | sure
            held, same = [c[-1:] for c in now], not new[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in (gram, doc, size)], names=["gram", "doc_id", "size"])
        if held is not None and (same or held[0][0] < 0 or held[3][0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:3]], names=["gram", "doc_id", "size"])

    many = F.broadcast(crowded.select("gram", F.lit(True).alias("sure")))
    marked = columns.join(many, "gram", "left").select("gram", "doc_id", "size", F.coalesce("sure", F.lit(False)).alias("sure"))
    salt = F.when(F.col("sure"), F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).otherwise(F.lit(0))
    return marked.repartition(F.col("gram"), salt).sortWithinPartitions("gram").mapInArrow(run, columns.schema)


#: Above the size of any set.
_NO_CAP = (1 << 31) - 1


def _capped(shared: DataFrame, percent: int) -> DataFrame:
    """Shared columns with ``last``, the document's last first column, and ``cap``: its size less its first columns that it shares with none.

    Of two documents, the first columns of that with the smaller ``last`` are first columns of the other too, if it has them: so its
    cap bounds their overlap. A doc_id with several texts has no such bound: its cap is above all sizes and its last below all columns,
    so that no link of any of its texts is ruled out.
    """
    first = F.col("size") - _least(F.col("size"), percent) + 1
    ends = F.col("gram") < 0
    several = F.sum(ends.cast("int")) > 1
    own = F.first("size") - F.first(first) + F.sum((~ends).cast("int"))
    cap = F.when(several, F.lit(_NO_CAP)).otherwise(own).cast("int").alias("cap")
    last = F.when(several, F.lit(-1)).otherwise(F.max(F.when(ends, -1 - F.col("gram")))).alias("last")
    facts = shared.groupBy("doc_id").agg(cap, last)
    return shared.where("gram >= 0").join(facts, "doc_id").select("gram", "doc_id", "size", "cap", "last")


def _stars(rows: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, size_a, b, size_b): in each column, each document with up to ``pivots`` representatives that it can be linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, doc, size, cap, last in _groups(batches):
            head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            times = np.diff(np.append(head, len(gram)))
            group = np.repeat(np.arange(len(head)), times)
            for k in range(pivots):
                # first whoever has least of its own; then by hash, so that one document leads most columns that a group of copies shares
                order = [W.mix(doc.view(np.uint64) * np.uint64(2 * k + 1) + np.uint64(k)), group]
                if k == 0:
                    order.insert(1, (size - cap) / size)
                lead = np.lexsort(order)[head][group]
                keep = np.flatnonzero((doc != doc[lead]) & _possible((size, cap, last), (size[lead], cap[lead], last[lead]), percent))
                at = lead[keep]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[keep], size[keep], doc[at], size[at])], names=["a", "size_a", "b", "size_b"])

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, size_a int, b long, size_b int")


def _possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Whether size, cap and last column of two documents each leave room for a link."""
    needed = -(-(a[0].astype(np.int64) + b[0]) * percent // (100 + percent))
    cap = np.where(a[2] < b[2], a[1], np.where(a[2] > b[2], b[1], np.minimum(a[1], b[1])))
    return np.minimum(cap, np.minimum(a[0], b[0])) >= needed


def _pairs(size: np.ndarray, cap: np.ndarray, last: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """The pairs of a column's documents that can be linked and are not in one component, and which documents have any.

    Without pairs (None) where a column has more of them than _PAIRS for each document, or more than _LOOKED documents.
    """
    n = len(size)
    if n > _LOOKED:
        return None, None, np.ones(n, bool)
    first, second, total, some = [], [], 0, np.zeros(n, bool)
    for lo in range(0, n - 1, 256):
        i = np.arange(lo, min(lo + 256, n))[:, None]
        j = np.arange(lo + 1, n)[None, :]
        room = (j > i) & (component[i] != component[j]) & _possible((size[i], cap[i], last[i]), (size[j], cap[j], last[j]), percent)
        a, b = np.nonzero(room)
        some[a + lo] = some[b + lo + 1] = True
        total += len(a)
        if total <= _PAIRS * n:
            first.append(a + lo)
            second.append(b + lo + 1)
    if total > _PAIRS * n:
        return None, None, some
    return np.concatenate(first), np.concatenate(second), some


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """What the columns with several components multiply to.

    Most columns give pairs (a, size_a, b, size_b) with how many columns of this task they share (overlap). Columns with too many
    of them give their members (gram, a, component, blocks) instead: they are multiplied with whole sets, see :func:`_blocks`.
    """
    names = ["a", "size_a", "b", "size_b", "overlap", "gram", "component", "blocks"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            if held:
                pairs = np.concatenate(held, axis=1)
                pairs = pairs[:, np.lexsort((pairs[2], pairs[0]))]
                head = np.flatnonzero(np.concatenate([[True], (pairs[::2, 1:] != pairs[::2, :-1]).any(axis=0)]))
                times = np.diff(np.append(head, pairs.shape[1]))
                none = [pa.nulls(len(head), k) for k in kinds[5:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[head], k) for c, k in zip(pairs, kinds, strict=False)), pa.array(times), *none], names=names)
            held, waiting = [], 0

        for gram, doc, size, cap, last, component in _groups(batches):
            head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            tail = np.append(head[1:], len(gram))
            for lo, hi in zip(head.tolist(), tail.tolist(), strict=True):
                d, s, m, e, c = doc[lo:hi], size[lo:hi], cap[lo:hi], last[lo:hi], component[lo:hi]
                if (c == c[0]).all():
                    continue
                i, j, some = _pairs(s, m, e, c, percent)
                if i is None:
                    own = [d[some], s[some], gram[lo:hi][some], c[some]]
                    none = [pa.nulls(len(own[0]), k) for k in kinds[2:5]]
                    blocks = np.full(len(own[0]), -(-len(own[0]) // _MEMBERS), np.int32)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(own[:2], kinds, strict=False)), *none, *map(pa.array, own[2:]), pa.array(blocks)], names=names)
                elif len(i):
                    swap = d[j] < d[i]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    held.append(np.stack([d[i], s[i], d[j], s[j]]))
                    waiting += len(i)
                    if waiting >= 500_000:
                        yield from flush()
        yield from flush()

    schema = "a long, size_a int, b long, size_b int, overlap long, gram long, component long, blocks int"
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within large columns, by a blocked product of whole sets.

    A column with more members than a block holds is dealt to pairs of blocks, so no task holds more than two blocks; of all links
    between two components one is given.
    """
    mine = F.pmod(F.xxhash64("a"), F.col("blocks"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, mine.cast("int")).alias("x"), F.greatest(k, mine.cast("int")).alias("y")))
    dealt = members.join(sets.select(F.col("doc_id").alias("a"), "grams"), "a").withColumn("k", F.explode(both)).select("gram", "k.x", "k.y", "a", "component", "grams")

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        ids, component = rows["a"].to_numpy(), rows["component"].to_numpy()
        lists = rows["grams"].combine_chunks()
        first = lists.offsets.to_numpy()
        size = np.diff(first)
        owner = np.repeat(np.arange(len(ids)), size)
        values, place, times = np.unique(lists.values.to_numpy()[first[0] : first[-1]], return_inverse=True, return_counts=True)
        # columns of a single document add nothing to any overlap
        live = np.cumsum(times > 1) - 1
        keep = times[place] > 1
        owner, place = owner[keep], live[place[keep]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        overlap = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int((times > 1).sum()), 1024):
            a, b = np.searchsorted(place, (lo, lo + 1024))
            block = np.zeros((len(ids), 1024), np.float32)
            block[owner[a:b], place[a:b] - lo] = 1
            overlap += block @ block.T
        linked = (100 + percent) * overlap >= percent * (size[:, None] + size[None, :]).astype(np.float32)
        i, j = np.nonzero(np.triu(linked & (component[:, None] != component[None, :]), 1))
        pairs = np.sort(np.stack([component[i], component[j]]), axis=0)
        _, one = np.unique(pairs, axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        return pa.table({"a": pa.array(ids[i[one]], pa.int64()), "b": pa.array(ids[j[one]], pa.int64())})

    return dealt.groupBy("gram", "x", "y").applyInArrow(multiply, "a long, b long")


def _bound(percent: int, a: str = "size_a", b: str = "size_b") -> Column:
    """How many of their first columns two linked documents share at least."""
    both = F.ceil((F.col(a) + F.col(b)) * percent / F.lit(100 + percent))
    return both + 1 - F.greatest(_least(F.col(a), percent), _least(F.col(b), percent))


def _whole_sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams) of the documents in ``needed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, values, first in _sets(batch.column(1), n):
                ids = batch.column(0).slice(found.row, found.docs)
                yield pa.RecordBatch.from_arrays([ids, W.int_list(values.view(np.int64), first, pa.int64())], names=["doc_id", "grams"])

    return persist_table(docs.join(sent_if_few(needed.distinct()), "doc_id", "left_semi").mapInArrow(run, "doc_id long, grams array<long>"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    # few pairs meet the sets where they are read; then only one set of each pair moves
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")).join(sent_if_few(pairs), "a")
    # many pairs have the same representative, whose set moves once; sets that are no pair's second stay
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")).join(sent_if_few(pairs.select("b").distinct()), "b", "left_semi")
    both = left.join(right, "b")
    overlap = F.size(F.array_intersect("x", "y"))
    return persist_table(both.where(100 * overlap >= percent * (F.size("x") + F.size("y") - overlap)).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs without ASCII white space, A-Z folded; a text's set is its distinct runs of ``n`` words, or its whole
    sequence if it has fewer. Null, empty and blank texts have an empty set and link with nothing. Two rows link when
    100 * intersection >= ``percent`` * union; component_id is the least doc_id that links reach, the row's own included.
    Rows with equal doc_id are one node of the graph, linked by either's text, and each gives a row with its own n_shingles; a null doc_id takes no part and
    has a null component. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    small_batches(docs.sparkSession)
    summary = persist_table(_summary(docs, n), "summary")
    rows = summary.where("one is not null")
    often = summary.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(FREQUENT)
    # at most FREQUENT hashes
    often = often.toArrow()
    frequent = _Frequent(np.sort(often["gram"].to_numpy().astype(np.uint64)))
    # as columns call them: see _columns
    crowded = (often["gram"].to_numpy()[often["times"].to_numpy() >= _CROWDED] >> 1) | (1 << (W.SET_BITS - 1))
    crowded = docs.sparkSession.createDataFrame(pa.table({"gram": pa.array(crowded, pa.int64())})).distinct()
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    # groups of copies may be large: their least doc_id goes to where their rows are
    copies = join_facts(filled, ["one", "two"], lambda x: x.groupBy("one", "two").agg(F.min("doc_id").alias("least"))).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    copies = persist_table(copies, "copies")
    shared = persist_table(_shared(_columns(known, n, percent, frequent), crowded), "shared")
    rows_of = persist_table(_capped(shared, percent), "columns")
    drop_table(shared)
    release(docs.sparkSession)

    counted = _stars(rows_of, pivots, percent).groupBy("a", "size_a", "b", "size_b").agg(F.count("*").alias("overlap"))
    # a pivot may not lead all columns that it shares, so half of the bound is enough here: the product decides
    likely = persist_table(counted.where(2 * F.col("overlap") >= _bound(percent)).select("a", "b", "overlap"), "likely")
    best = persist_table(likely.groupBy("a").agg(F.max_by("b", F.struct("overlap", "b")).alias("b")), "best")
    sets = _whole_sets(known, _ends(likely), n)
    linked = _verified(best, sets, percent)
    release(docs.sparkSession)
    # whoever the best one does not link with tries the others
    others = likely.select("a", "b").join(linked.select("a"), "a", "left_anti").join(best, ["a", "b"], "left_anti")
    more = _verified(others, sets, percent)
    drop_table(sets)
    links = copies.unionByName(linked).unionByName(more)
    release(docs.sparkSession)

    label = persist_table(components(links), "labels")
    joined = rows_of.join(sent_if_few(label.withColumnRenamed("node", "doc_id")), "doc_id", "left")
    rest = persist_table(_product(joined.select("gram", "doc_id", "size", "cap", "last", F.coalesce("component", "doc_id").alias("component")), percent), "product")
    drop_table(rows_of)
    pairs = rest.where("gram is null").groupBy("a", "size_a", "b", "size_b").agg(F.sum("overlap").alias("overlap"))
    pairs = persist_table(pairs.where(F.col("overlap") >= _bound(percent)).select("a", "b"), "pairs")
    members = rest.where("gram is not null").select("gram", "a", "component", "blocks")
    needed = _ends(pairs).unionByName(members.select(F.col("a").alias("doc_id")))
    if needed.take(1):
        sets = _whole_sets(known, needed, n)
        verified = _verified(pairs, sets, percent)
        release(docs.sparkSession)
        added = verified.unionByName(_blocks(members, sets, percent))
        # components so far stand for their links
        label = persist_table(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(added)), "labels")
        drop_table(sets)
    release(docs.sparkSession)
    return rows.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
