"""Finding symbols by name: a cascade of ever looser matches, of which the first with any hit answers."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scorers import camel_score_to, edit_distance_to, max_edits, name_score_to, segments
from ..functions.text import contains_folded, fold, fold_text, terminal_name, trigrams
from ..plans.index import Index
from ..schema import TYPE_KINDS
from .build import name_trigrams
from .predicates import in_module, is_listed, is_noise, matches_exclude, matches_kind

STAGES = ("exact_fqn", "fqn_suffix", "owner_member", "exact_name", "substring", "camel_case", "fuzzy")


def ref_counts(refs: DataFrame) -> DataFrame:
    """(symbol_id, n_refs): occurrences of all roles, repeated ones too."""
    return refs.groupBy("symbol_id").agg(F.count("*").alias("n_refs"))


def rank_score() -> Column:
    """Lower is better: kind and source of a symbol and the length of its name, less its popularity. Over located symbols with n_refs.

    The arithmetic is signed, so that a much-used short class ranks first.
    """
    kind = F.when(F.col("kind").isin("class", "trait", "interface"), 0)
    for value, kinds in ((10, ("object",)), (20, ("type",)), (30, ("method", "constructor")), (40, ("field",)), (50, ("macro",))):
        kind = kind.when(F.col("kind").isin(*kinds), value)
    source = F.when(F.coalesce("is_generated", F.lit(False)), 40).when(F.coalesce("is_test", F.lit(False)), 20).otherwise(0)
    refs = F.coalesce("n_refs", F.lit(0))
    popular = F.when(refs > 0, F.least(F.floor(F.log2(refs) * 3), F.lit(40))).otherwise(0)
    return (kind.otherwise(100) + source + F.least(F.octet_length("name"), F.lit(30)) - popular).cast("int")


def ranked(found: DataFrame, refs: DataFrame, *first: str) -> DataFrame:
    """Symbols with ``rank_score``, best first; ties by id."""
    counts = ref_counts(refs.join(found.select("symbol_id"), "symbol_id", "left_semi"))
    return found.join(counts, "symbol_id", "left").withColumn("rank_score", rank_score()).orderBy(*first, "rank_score", "symbol_id")


def is_fqn_suffix(query: str) -> Column:
    fqn = F.col("fqn")
    return fqn.endswith(query) | fqn.endswith(query + ".") | fqn.endswith(query + "#") | fqn.endswith(query + "().")


def trigram_candidates(symbols: DataFrame, query: str) -> DataFrame:
    """symbol_id of symbols whose name or last path part has all trigrams of the query: an access path that loses no substring match."""
    wanted = symbols.sparkSession.range(1).select(F.explode(trigrams(F.lit(query))).alias("tri"))
    n = len({fold_text(query)[k : k + 3] for k in range(len(query) - 2)})
    hits = name_trigrams(symbols).join(F.broadcast(wanted), "tri")  # as many rows as the query has letters at most
    return hits.groupBy("symbol_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("symbol_id")


def members_named(symbols: DataFrame, members: DataFrame, owners: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """symbol_id of members with the name, of the given owners (symbol_id); where no owner has one directly, of their nested types, and so on.

    Owners are searched in order of id. The first whose own or nested types have the member decides: after it, later owners add
    direct members only.
    """
    kinds = symbols.select(F.col("symbol_id").alias("dst"), "kind", fold("name").alias("folded"))
    # every hit with the path of levels that led to it, so that the order of a depth-first search can be told
    level = owners.select(F.col("symbol_id").alias("src"), F.col("symbol_id").alias("root"), F.array("symbol_id").alias("path"))
    hits = None
    for d in range(depth + 1):
        step = level.join(members, "src").join(kinds, "dst")
        found = step.where(F.col("folded") == fold_text(name)).select(F.col("dst").alias("symbol_id"), "root", "path", F.lit(d).alias("depth"))
        hits = found if hits is None else hits.unionByName(found)
        level = step.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("dst").alias("src"), "root", F.concat("path", F.array("dst")).alias("path"))
    # a container counts if nothing before it, in the order of the search, had a hit; direct members of given owners always do
    containers = hits.select("root", "path", "depth").distinct()
    shallow = containers.groupBy("root").agg(F.min("depth").alias("least"))
    kept = containers.join(shallow, "root")
    first_root = shallow.agg(F.min("root").alias("r")).first()["r"]
    if first_root is None:
        return hits.select("symbol_id")
    rows = kept.where(F.col("root") == first_root).select("path", "depth").orderBy("path").collect() if kept.where((F.col("root") == first_root) & (F.col("least") > 0)).take(1) else None
    if rows is None:
        return hits.where("depth = 0").select("symbol_id").distinct()
    allowed = _visited([tuple(r["path"]) for r in rows])
    wanted = hits.sparkSession.createDataFrame([(list(p),) for p in allowed], "path array<long>")
    nested = hits.where(F.col("root") == first_root).join(wanted, "path", "left_semi").select("symbol_id")
    return nested.unionByName(hits.where((F.col("root") > first_root) & (F.col("depth") == 0)).select("symbol_id")).distinct()


def _visited(paths: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Of the containers with a hit, those that a depth-first search reports.

    After the first one it opens nothing more, but still looks into the later siblings of the places it came through.
    """
    first = min(paths)
    return [p for p in paths if p >= first and len(p) <= len(first) and p[:-1] == first[: len(p) - 1]]


@dataclass
class Resolver:
    """Queries over one index."""

    index: Index

    def __post_init__(self) -> None:
        self.symbols = self.index.located()

    def exact_fqn(self, query: str) -> DataFrame:
        return self.symbols.where(F.col("fqn") == query).orderBy("symbol_id")

    def fqn_suffix(self, query: str) -> DataFrame:
        return self.symbols.where(is_fqn_suffix(query)).orderBy("symbol_id")

    def exact_name(self, query: str) -> DataFrame:
        return ranked(self.symbols.where(fold("name") == fold_text(query)), self.index.refs)

    def substring(self, query: str) -> DataFrame:
        return ranked(self.symbols.where(contains_folded("name", query)), self.index.refs)

    def owner_member(self, query: str, depth: int = 0) -> DataFrame:
        """``Owner.member`` or ``Owner#member``; the owner can be such a pair itself, five levels deep."""
        none = self.symbols.where(F.lit(False))
        at = max(query.rfind("."), query.rfind("#"))
        owner, member = query[: max(at, 0)], query[at + 1 :]
        if depth > 5 or at < 0 or not owner or not member:
            return none
        owners = self.symbols.where(fold("name") == fold_text(owner))
        if not owners.take(1):
            if not any(c in owner for c in ".#"):
                return none
            owners = self.owner_member(owner, depth + 1)
        found = members_named(self.index.symbols, self.index.edges_of("member"), owners.select("symbol_id"), member)
        return self.symbols.join(found.distinct(), "symbol_id", "left_semi").orderBy("owner_id", "symbol_id")

    def _by_name(self, score: Column) -> DataFrame:
        """Distinct names with a score, each with its first symbol: scorers see a name once."""
        names = self.symbols.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))
        return names.withColumn("score", score).where("score is not null")

    def camel_case(self, query: str) -> DataFrame:
        parts = segments(query)
        if not parts or (len(parts) == 1 and len(parts[0].encode()) < 2):
            return self.symbols.where(F.lit(False))
        scored = self._by_name(name_score_to(query, F.col("name"))).select("symbol_id", "score")
        return ranked(self.symbols.join(scored, "symbol_id"), self.index.refs, "score")

    def fuzzy(self, query: str) -> DataFrame:
        return ranked(self.symbols.join(self.fuzzy_names(query), "name"), self.index.refs, "score")

    def fuzzy_names(self, query: str) -> DataFrame:
        """(name, score) of names within the allowed edits; built-in filters come before the scorer."""
        most, low = max_edits(len(query.encode())), fold_text(query)
        size = F.octet_length("name")
        names = self.symbols.select("name").distinct().where(F.lit(most > 0) & (F.abs(size - len(query.encode())) <= most))
        # a swap costs 2 in the built-in distance, so twice the allowed edits hold every hit
        names = names.where(F.levenshtein(fold("name"), F.lit(low), 2 * most) >= 0) if query.isascii() else names
        scored = names.withColumn("score", edit_distance_to(low, fold("name")))
        return scored.where((F.col("score") > 0) & (F.col("score") <= most) & (2 * F.col("score") <= F.greatest(size, F.lit(len(query.encode())))))

    def resolve(self, query: str) -> tuple[str | None, DataFrame]:
        """The first stage with hits, and its symbols in order."""
        for stage in STAGES:
            found = getattr(self, stage)(query)
            if found.take(1):
                return stage, found
        return None, self.symbols.where(F.lit(False))

    def filtered(self, query: str, kind: str | None = None, module: str | None = None) -> DataFrame:
        """The kind filter is strict; a module filter that leaves nothing is dropped with a warning."""
        _, found = self.resolve(query)
        if kind:
            found = found.where(matches_kind(kind))
        if module:
            inside = found.where(in_module(module))
            if inside.take(1) or not found.take(1):
                return inside
            warnings.warn(f"--module '{module}' matched no results, showing all matches", stacklevel=2)
        return found

    def in_module(self, module: str, kind: str | None = None) -> DataFrame:
        """Symbols of matching modules, without parameters and locals, best first."""
        found = self.symbols.where(in_module(module) & is_listed())
        return ranked(found.where(matches_kind(kind)) if kind else found, self.index.refs)

    def one(self, query: str, kind: str | None = None, module: str | None = None) -> DataFrame:
        """The best single answer: exact names first, then types before members."""
        found = self.filtered(query, kind, module)
        weight = F.when(F.col("kind").isin("class", "trait", "interface"), 3).when(F.col("kind") == "object", 2).when(F.col("kind").isin("method", "field", "type"), 1).otherwise(0)
        order = [(fold("name") == fold_text(query)).desc(), weight.desc()]
        return found.orderBy(*order, *([c for c in ("score", "rank_score") if c in found.columns]), "symbol_id").limit(1)

    def by_fqn(self, fqn: str) -> DataFrame:
        """A point lookup; the saved table is sorted by full name."""
        return self.symbols.where(F.col("fqn") == fqn)

    def search(self, query: str | None = None, kind: str | None = None, module: str | None = None, exclude: list[str] | None = None, include_noise: bool = False) -> DataFrame:
        if query is None and module is None:
            raise ValueError("search needs a query or a module")
        found = self.in_module(module, kind) if query is None else self.filtered(query, kind, module)
        if not include_noise:
            found = found.where(~is_noise())
        return found.where(~matches_exclude(exclude)) if exclude else found

    def other_kinds(self, query: str, module: str | None = None, exclude: list[str] | None = None, include_noise: bool = False) -> DataFrame:
        """What a query finds when its kind filter is left off."""
        _, found = self.resolve(query)
        found = found.where(in_module(module)) if module else found
        found = found if include_noise else found.where(~is_noise())
        return found.where(~matches_exclude(exclude)) if exclude else found

    def suggestions(self, query: str) -> DataFrame:
        """Up to five names for a query without answer; for a full name, symbols that its last part finds."""
        empty = self.symbols.limit(0).select("name", F.col("kind"), F.col("fqn"))
        if "/" in query or "#" in query:
            short = self.index.spark.range(1).select(terminal_name(F.lit(query)).alias("n")).first()["n"]
            if short and short != query:
                _, found = self.resolve(short)
                if found.take(1):
                    return found.limit(5)
        close = self.fuzzy_names(query)
        if not close.take(1):
            if not segments(query):
                return empty
            close = self._by_name(camel_score_to(query, F.col("name")))
        return close.orderBy("score", "name").limit(5).select("name", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("fqn"))


def stage_of(query: str, with_members: DataFrame | None = None) -> Column:
    """The number of the first built-in stage that a symbol matches (1 full name, 2 its end, 4 name, 5 part of the name), else null."""
    return F.when(F.col("fqn") == query, 1).when(is_fqn_suffix(query), 2).when(fold("name") == fold_text(query), 4).when(contains_folded("name", query), 5)


def first_stage(symbols: DataFrame, query: str) -> DataFrame:
    """The cascade's built-in stages in one pass: symbols of the lowest stage that any has."""
    staged = symbols.withColumn("stage", stage_of(query)).where("stage is not null")
    least = staged.agg(F.min("stage").alias("least"))
    return staged.join(F.broadcast(least), F.col("stage") == F.col("least")).drop("least")  # one row


__all__ = ["STAGES", "Resolver", "Window", "first_stage", "is_fqn_suffix", "members_named", "rank_score", "ranked", "ref_counts", "stage_of", "trigram_candidates"]
