"""Call graph: neighbourhoods and bounded traversal as joins, and the depth-first tree over a fetched neighbourhood."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window, functions as F

from ..plans.durable import checkpointed
from ..plans.index import Index
from .predicates import is_callgraph_noise, is_cross_module, matches_exclude


#: Callers and callees of one symbol that a profile shows.
CALL_CAP = 50


def capped(edges: DataFrame, most: int = CALL_CAP) -> DataFrame:
    """The first ``most`` neighbours of every node, by id: a report's rows, the limit comes before they are gathered."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return edges.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def visible(located: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Symbols that call graphs show."""
    shown = located.where(~F.coalesce(is_callgraph_noise(), F.lit(False)))
    return shown.where(~matches_exclude(exclude)) if exclude else shown


def call_degrees(calls: DataFrame) -> DataFrame:
    """(symbol_id, callers, callees) of every symbol in a call."""
    both = calls.select(F.col("dst").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select(F.col("src").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("symbol_id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def trait_aware_callers(calls: DataFrame, overrides: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(symbol_id, caller): callers of a symbol and of what it overrides, without itself. ``of``: only these symbol_ids."""
    targets = overrides.select(F.col("dst").alias("symbol_id"), F.col("src").alias("target"))
    nodes = of.select("symbol_id") if of is not None else calls.select(F.col("dst").alias("symbol_id")).unionByName(targets.select("symbol_id")).distinct()
    both = nodes.withColumn("target", F.col("symbol_id")).unionByName(targets.join(nodes, "symbol_id", "left_semi"))
    found = both.join(calls.select(F.col("dst").alias("target"), F.col("src").alias("caller")), "target")
    return found.where("caller <> symbol_id").select("symbol_id", "caller").distinct()


def neighbours(edges: DataFrame, located: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Edges whose far end is shown."""
    return edges.join(visible(located, exclude).select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def cross_module(edges: DataFrame, located: DataFrame) -> DataFrame:
    """Edges between different known modules."""
    a = located.select(F.col("symbol_id").alias("src"), F.col("module_id").alias("_a"))
    b = located.select(F.col("symbol_id").alias("dst"), F.col("module_id").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where(is_cross_module("_a", "_b")).select("src", "dst")


def reachable(edges: DataFrame, roots: DataFrame, depth: int, cut_every: int = 3) -> DataFrame:
    """(src, dst, depth): edges within ``depth`` hops of the roots (symbol_id), each at its least depth.

    A hop is a join of the frontier; nodes are expanded once. Lineage is cut every few hops.
    """
    seen = roots.select(F.col("symbol_id").alias("src")).distinct()
    frontier, found = seen, None
    for d in range(1, depth + 1):
        hop = edges.join(frontier, "src").select("src", "dst", F.lit(d).alias("depth"))
        found = hop if found is None else found.unionByName(hop)
        frontier = hop.select(F.col("dst").alias("src")).distinct().join(seen, "src", "left_anti")
        seen = seen.unionByName(frontier)
        if d % cut_every == 0 and d < depth:
            found, frontier, seen = checkpointed(found), checkpointed(frontier), checkpointed(seen)
            if not frontier.take(1):
                break
    empty = edges.select("src", "dst", F.lit(0).alias("depth")).limit(0)
    return found if found is not None else empty


@dataclass
class Visit:
    """A node of a printed tree. depth: 1 below the root; last: of its siblings; again: printed before."""

    node: int
    parent: int
    depth: int
    last: bool
    again: bool


def walk(edges: dict[int, list[int]], root: int, depth: int) -> Iterator[Visit]:
    """Depth-first order below the root. A node that was met before is given again but not opened, wherever it was met: also at the last level."""
    met = {root}
    stack = [(root, 1, iter(enumerate(sorted(edges.get(root, [])))))] if depth else []
    while stack:
        node, level, rest = stack[-1]
        nxt = next(rest, None)
        if nxt is None:
            stack.pop()
            continue
        k, child = nxt
        again = child in met
        met.add(child)
        yield Visit(child, node, level, k == len(edges[node]) - 1, again)
        if not again and level < depth:
            stack.append((child, level + 1, iter(enumerate(sorted(edges.get(child, []))))))


#: Edges that one printed tree brings to the driver, at most.
PRINTED = 100_000


def fetch(index: Index, root: int, depth: int, exclude: list[str] | None = None, reverse: bool = False, cross: bool = False, most: int = PRINTED, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[dict[int, list[int]], dict[int, Row]]:
    """The edges within ``depth`` hops of one symbol, and the symbols on them: what one printed tree can show.

    A level is fetched at a time; ``shape`` makes the columns of the symbols. A tree with more than ``most`` edges is an error that names the limit: nobody reads it, and
    leaving rows out would show a wrong tree.
    """
    located = index.located()
    edges = neighbours(index.edges_of("calls", reverse), located, exclude)
    if cross:
        edges = cross_module(edges, located)
    out: dict[int, list[int]] = {}
    level, seen, n = [root], {root}, 0
    for _ in range(depth):
        if not level:
            break
        near = edges.join(F.broadcast(index.spark.createDataFrame([(x,) for x in level], "src long")), "src").limit(most - n + 1).collect()
        n += len(near)
        if n > most:
            raise ValueError(f"the tree has more than {most} calls: lower the depth or exclude more")
        for r in near:
            out.setdefault(r["src"], []).append(r["dst"])
        level = sorted({r["dst"] for r in near} - seen)
        seen.update(level)
    ids = index.spark.createDataFrame([(x,) for x in sorted(seen)], "symbol_id long")
    return out, {r["symbol_id"]: r for r in shape(located.join(F.broadcast(ids), "symbol_id", "left_semi")).collect()}
