"""Exact inner-product top-k by ball trees.

Vectors are dealt to shards by region; each shard becomes one ball tree, kept as a table in the shared folder. A query
is first searched in the shard that holds it. The k-th score found there decides, with the centre and radius of each
other shard's root, which shards the query goes to at all: those in order of their bound, in rounds, each with the
best k-th score of all rounds before. Within a shard branch and bound visits nodes by their inner-product upper bound
until none can beat the k-th score so far.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import persist_table

LEAF = 256
_INT64 = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Tree:
    """Points in tree order; node i covers ``low[i]:high[i]``, its children are ``child[i]`` and ``child[i] + 1`` (0: a leaf)."""

    ids: np.ndarray
    points: np.ndarray  # whole numbers, as float64
    center: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    least: np.ndarray  # smallest id of the node

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        center, radius, low, high, child = [], [], [0], [len(ids)], []
        at = 0
        while at < len(low):
            own = points[order[low[at] : high[at]]]
            same = bool((own == own[0]).all())
            middle = own[0] if same else own.mean(axis=0)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            center.append(middle)
            radius.append(0.0 if same else away.max() * (1 + 1e-9))
            if same or len(own) <= leaf:
                child.append(0)
            else:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                part = np.argsort(own @ (other - one), kind="stable")
                order[low[at] : high[at]] = order[low[at] : high[at]][part]
                half = low[at] + len(own) // 2
                child.append(len(low))
                low += [low[at], half]
                high += [half, high[at]]
            at += 1
        ids = ids[order]
        lows, highs = np.array(low), np.array(high)
        least = np.array([ids[a:b].min() for a, b in zip(low, high, strict=True)])
        return cls(ids, points[order], np.array(center), np.array(radius), lows, highs, np.array(child), least)

    def search(self, queries: np.ndarray, own: list[int | None], k: int, floor: list[tuple[int, int] | None]) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) beyond ``floor``, the k-th pair already known.

        ``own``: the id of a query that is a row of this shard; one row with this id and these components is no candidate.
        """
        length = np.sqrt((queries**2).sum(axis=1))
        reach = np.sqrt((self.center**2).sum(axis=1)) + self.radius
        dots = queries @ self.center.T + length[:, None] * self.radius
        bounds = np.floor(dots + 1e-9 * length[:, None] * reach + 1e-6)
        most = max(np.abs(self.points).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * max(1, queries.shape[1])
        exact = self.points if most < 2**53 else np.array([[int(x) for x in p] for p in self.points.tolist()], object).reshape(self.points.shape)
        out = []
        for n in range(len(queries)):
            query = queries[n] if most < 2**53 else np.array([int(x) for x in queries[n].tolist()], object)
            out.append(self._search(query, own[n], k, floor[n], bounds[n], exact))
        return out

    def _search(self, query: np.ndarray, own: int | None, k: int, floor: tuple[int, int] | None, bounds: np.ndarray, points: np.ndarray) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        last = (-floor[0], floor[1]) if floor else None  # a pair must come before this one
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if last and bound > last[0]:
                break
            if last and bound == last[0] and self.least[node] > last[1]:
                continue
            first = self.child[node]
            if first:
                for c in (first, first + 1):
                    heapq.heappush(heap, (max(bound, -bounds[c]), int(c)))
                continue
            low, high = self.low[node], self.high[node]
            score = points[low:high] @ query
            ids = self.ids[low:high]
            keep = np.ones(len(ids), bool)
            if own is not None:
                same = np.flatnonzero(ids == own)
                same = same[(points[low + same] == query).all(axis=1)]
                if len(same):
                    keep[same[0]] = False
                    own = None
            if last:
                keep &= (score > -last[0]) | ((score == -last[0]) & (ids < last[1]))
            if keep.any():
                found = score[keep], ids[keep]
                if len(found[0]) > k and found[0].dtype != object:
                    top = np.lexsort((found[1], -found[0]))[:k]
                    found = found[0][top], found[1][top]
                best = heapq.nsmallest(k, best + [(-int(s), int(i)) for s, i in zip(*found, strict=True)])
                if len(best) == k:
                    last = best[-1] if last is None else min(last, best[-1])
        return [(-s, i) for s, i in best]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _whole(x: Column) -> Column:
    """floor(x) as a double; beyond 2**53 every double is a whole number."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


class Regions:
    """Splits of space into regions, as ball trees split: by the projection on the line through two far points."""

    def __init__(self, points: np.ndarray, least: int):
        self.lines: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.child: list[int] = []  # of a split: its first child, the second follows; of a region: -1 - its number
        parts, self.count = [points], 0
        at = 0
        while at < len(parts):
            own = parts[at]
            cut = None
            if len(own) > least:
                away = ((own - own.mean(axis=0)) ** 2).sum(axis=1)
                one = own[away.argmax()]
                line = own[((own - one) ** 2).sum(axis=1).argmax()] - one
                side = own @ line
                cut = float(np.median(side))
                right = side >= cut if (side < cut).any() else side > cut
                cut = float(side[right].min()) if right.any() and not right.all() else None
            if cut is None:
                self.lines.append(np.zeros(points.shape[1]))
                self.cuts.append(0.0)
                self.child.append(-1 - self.count)
                self.count += 1
            else:
                self.lines.append(line)
                self.cuts.append(cut)
                self.child.append(len(parts))
                parts += [own[~right], own[right]]
            at += 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each point. Any region is right; near ones make bounds tight."""
        node = np.zeros(len(points), np.int64)
        child, cuts = np.array(self.child), np.array(self.cuts)
        live = np.flatnonzero(child[node] >= 0)
        while len(live):
            for n in np.unique(node[live]):
                here = live[node[live] == n]
                node[here] = child[n] + (points[here] @ self.lines[n] >= cuts[n])
            live = live[child[node[live]] >= 0]
        return -1 - child[node]


#: Vectors that regions are fitted on, for each region, and their bytes in all, at most.
SAMPLE_OF_REGION, SAMPLE_BYTES = 16, 64 << 20
#: Shards that a query goes to in the rounds after its own, in order of their bounds; the last round takes all that are left.
ROUNDS = (1, 4, 16)


def _dealt(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """vectors with their shard: a region, or a part of one by hash where it holds more than ``shard_rows``."""
    rows = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    fitted: dict[int, Regions] = {}
    for dim, n in rows.items():
        wanted = min(-(-n // shard_rows) * SAMPLE_OF_REGION, SAMPLE_BYTES // (8 * max(1, dim)) + 1)
        if n > shard_rows and dim:
            some = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "q")).limit(wanted).select("q").toArrow()
            fitted[dim] = Regions(matrix(some["q"]), SAMPLE_OF_REGION)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            region = np.zeros(len(batch), np.int64)
            for dim in np.unique(dims):
                if int(dim) in fitted:
                    at = np.flatnonzero(dims == dim)
                    region[at] = fitted[int(dim)].of(matrix(pa.chunked_array([batch.column(1).take(pa.array(at))])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    if all(n <= shard_rows for n in rows.values()):
        return vectors.withColumn("shard", F.lit(0).cast("long"))
    placed = persist_table(vectors.mapInArrow(place, "vec_id long, q array<double>, dim int, times long, asked long, region long"), "placed")
    parts = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    parts = parts.withColumn("first", F.sum("parts").over(Window.orderBy("dim", "region")) - F.col("parts"))  # a row for each region
    part = F.pmod(F.xxhash64("vec_id", "q"), F.col("parts"))
    return placed.join(F.broadcast(parts), ["dim", "region"]).select("vec_id", "q", "dim", "times", "asked", (F.col("first") + part).alias("shard"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best inner products; ties to the smaller vec_id.

    vectors: vec_id and embedding; components count as floor(scale * x), scores are exact whole numbers (held at the range of a long).
    Every row that ``is_query`` holds for is a query and every other row is a candidate for it, also one with the same
    vec_id; rows that repeat are found repeatedly, and asked repeatedly give their result as often. Vectors that are null or
    hold null or non-finite components, and those without vec_id, take no part. Vectors are compared with those of their own
    length; empty ones score 0 with each other. Fewer than k candidates give fewer rows. Other columns are not read.
    A task holds one shard of about ``shard_rows`` vectors and up to about ``block_rows`` queries.
    """
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    valid = valid.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    # equal rows are one point with how often it occurs and is asked for: copies of a row never fill a shard
    whole = valid.select("vec_id", F.transform("embedding", lambda x: _whole(x * scale)).alias("q"), "asked")
    points = whole.groupBy("vec_id", "q").agg(F.count("*").alias("times"), F.sum(F.col("asked").cast("long")).alias("asked"))
    points = persist_table(points.select("vec_id", "q", F.size("q").alias("dim"), "times", "asked"), "points")
    dealt = _dealt(points, shard_rows)

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        often = np.minimum(rows["times"].to_numpy(), k + 1)  # more copies of one row cannot all be among the best
        tree = Tree.build(np.repeat(rows["vec_id"].to_numpy(), often), np.repeat(matrix(rows["q"]), often, axis=0))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "center": pa.array([tree.center[0].tolist()], pa.list_(pa.float64())),
            "radius": pa.array([float(tree.radius[0])]), "tree": pa.array([pickle.dumps(tree)], pa.binary()),
        })

    trees = persist_table(dealt.groupBy("shard", "dim").applyInArrow(grow, "shard long, dim int, center array<double>, radius double, tree binary"), "trees")
    queries = dealt.where("asked > 0").select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "q", "dim", F.col("shard").alias("home"), F.col("asked").alias("copies"))
    queries = persist_table(queries, "queries")
    few = queries.count() <= block_rows

    def visit(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if asked.num_rows and held.num_rows:
            tree: Tree = pickle.loads(held["tree"][0].as_py())  # noqa: S301 - written by this operator
            floors = [None if s is None else (s, i) for s, i in zip(asked["floor_score"].to_pylist(), asked["floor_id"].to_pylist(), strict=True)]
            for q, best in zip(asked["query"].to_pylist(), tree.search(matrix(asked["q"]), asked["own"].to_pylist(), k, floors), strict=True):
                found += [(q, i, min(max(s, _INT64[0]), _INT64[1])) for s, i in best]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"])

    def visited(asked: DataFrame, name: str) -> DataFrame:
        """What queries (query, q, dim, shard, own, floor_score, floor_id) find in the shards they are sent to."""
        if few:
            return persist_table(asked.groupBy("shard", "dim").cogroup(trees.select("shard", "dim", "tree").groupBy("shard", "dim")).applyInArrow(visit, "query long, vec_id long, score long"), name)
        asked = persist_table(asked, "asked")
        blocks = persist_table(asked.groupBy("shard", "dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")  # a row for each shard
        dealt_out = asked.join(blocks, ["shard", "dim"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
        # a tree is copied for as many blocks as its shard has of queries, and not at all without any
        many = blocks.select("shard", "dim", F.sequence(F.lit(0), F.col("blocks") - 1).alias("every"))
        copies = trees.select("shard", "dim", "tree").join(many, ["shard", "dim"]).withColumn("block", F.explode("every"))
        out = dealt_out.groupBy("shard", "dim", "block").cogroup(copies.groupBy("shard", "dim", "block")).applyInArrow(visit, "query long, vec_id long, score long")
        return persist_table(out, name)

    none = F.lit(None).cast("long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = visited(queries.select("query", "q", "dim", F.col("home").alias("shard"), F.col("query_id").alias("own"), none.alias("floor_score"), none.alias("floor_id")), "home")
    best = found.withColumn("rank", F.row_number().over(order))
    shards = trees.count()
    if shards > 1:
        floors = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
        left = persist_table(_bounds(queries, trees, block_rows).join(floors, "query", "left").where("floor_score is null or bound >= floor_score").drop("floor_score", "floor_id"), "pairs")
        by_bound = Window.partitionBy("query").orderBy(F.col("bound").desc(), "shard")
        left = left.withColumn("place", F.row_number().over(by_bound))
        taken = 0
        for n, wide in enumerate((*ROUNDS, None)):
            # only pairs that can still beat the k-th score of all rounds so far
            now = left.where(F.col("place") > taken) if wide is None else left.where((F.col("place") > taken) & (F.col("place") <= taken + wide))
            now = now.join(floors, "query", "left").where("floor_score is null or bound >= floor_score")
            now = now.select("query", "shard", "floor_score", "floor_id")
            if now.take(1):
                more = visited(now.join(queries.select("query", "q", "dim"), "query").withColumn("own", none), "found")
                best = persist_table(best.select("query", "vec_id", "score").unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
                floors = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
            taken += wide or 0
            if taken >= shards - 1:
                break
    out = best.where(F.col("rank") <= k).join(queries.select("query", "query_id", "copies"), "query")
    # a query that was asked several times gives its result as often
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def _bounds(queries: DataFrame, trees: DataFrame, block_rows: int) -> DataFrame:
    """(query, shard, bound): how much a row of each shard but the query's own can score at most, from the roots' centres and radii."""
    roots, asked = trees.select("shard", "dim", "center", "radius"), queries.select("query", "q", "dim", "home")
    n_roots, n_asked = max(1, -(-roots.count() // block_rows)), max(1, -(-queries.count() // block_rows))
    blocks = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # stated queries against all roots, in blocks: roots are a row for each shard
    asked = asked.withColumn("x", blocks("query", n_asked)).withColumn("y", every(n_roots))
    roots = roots.withColumn("y", blocks("shard", n_roots)).withColumn("x", every(n_asked))

    def bound(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        queries, centers, radius = matrix(asked["q"]), matrix(held["center"]), held["radius"].to_numpy()
        if not (asked.num_rows and held.num_rows):
            return pa.table({"query": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        length = np.sqrt((queries**2).sum(axis=1))
        reach = np.sqrt((centers**2).sum(axis=1)) + radius
        bounds = np.floor(queries @ centers.T + length[:, None] * radius + 1e-9 * length[:, None] * reach + 1e-6)
        i, j = np.nonzero(asked["home"].to_numpy()[:, None] != held["shard"].to_numpy()[None, :])
        return pa.table({"query": pa.array(asked["query"].to_numpy()[i]), "shard": pa.array(held["shard"].to_numpy()[j]), "bound": pa.array(bounds[i, j])})

    return asked.groupBy("dim", "x", "y").cogroup(roots.groupBy("dim", "x", "y")).applyInArrow(bound, "query long, shard long, bound double")
