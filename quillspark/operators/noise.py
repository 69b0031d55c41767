"""Symbols that clutter call graphs, by five detectors, and the exclude patterns made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.scorers import collapse
from ..plans.index import Index
from .graph import call_degrees
from .predicates import is_skipped
from .reports import display_kind
from .resolve import ref_counts

# Names of methods that make ids.
FACTORY_NAMES = "unsafeRandomId unsafeNode unsafeValue randomId generateId newId uuid nextId randomUUID freshId".split()
# Endings of owners that store, and names of their plain operations.
STORE_ENDINGS = "StoreOperations Store Repository Repo DAO Dao".split()
CRUD_NAMES = "upsert getOpt create delete update insert findBy findAll save get put remove list count exists deleteAll updateAll getAll exist getOptByTuple".split()
# Titles of the categories, in their order.
CATEGORIES = ("Effect plumbing", "Hub utilities", "ID factories", "Store ops", "Infrastructure plumbing")
TITLES = (
    "Effect plumbing (high fan-in, no callees):",
    "Hub utilities (high ref count, wide module spread):",
    "ID factories (pure generation, no business logic):",
    "Boilerplate store ops (low-level CRUD):",
    "Infrastructure plumbing (high fan-in, owner is cross-cutting):",
)


@dataclass(frozen=True)
class Thresholds:
    # From which counts on a symbol is noise.
    plumbing_callers: int = 5
    plumbing_callees: int = 1
    hub_refs: int = 300
    hub_modules: int = 10
    infra_callers: int = 10
    infra_owner_refs: int = 50
    infra_owner_modules: int = 5


def module_spreads(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, n_modules): modules with an occurrence of any role."""
    return refs.join(files.select("file_id", "module_id"), "file_id").where("module_id is not null").groupBy("symbol_id").agg(F.count_distinct("module_id").alias("n_modules"))


def metrics(index: Index) -> DataFrame:
    """Located symbols with callers, callees, n_refs, n_modules and the counts of their owners; 0 where there are none."""
    counts = ref_counts(index.refs).join(module_spreads(index.refs, index.files), "symbol_id", "full")
    own = index.located().join(call_degrees(index.edges_of("calls")), "symbol_id", "left").join(counts, "symbol_id", "left")
    owners = counts.select(F.col("symbol_id").alias("owner_id"), F.col("n_refs").alias("owner_refs"), F.col("n_modules").alias("owner_modules"))
    return own.join(owners, "owner_id", "left").fillna(0, ["callers", "callees", "n_refs", "n_modules", "owner_refs", "owner_modules"])


def pattern() -> Column:
    """What excludes a symbol: types by name; members by owner and name, joined as in their full name."""
    owner = F.coalesce("owner_name", F.lit(""))
    member = F.when(owner == "", F.col("name")).when(F.col("fqn").contains(F.concat(owner, F.lit("#"), "name")), F.concat(owner, F.lit("#"), "name")).otherwise(F.concat(owner, F.lit("."), "name"))
    return F.when(F.col("kind") == "method", member).otherwise(F.col("name"))


def detectors(n_modules: int, at: Thresholds = Thresholds()) -> list[tuple[Column, Column]]:
    """(rule, weight) of each category."""
    method = F.col("kind") == "method"
    owner = F.coalesce("owner_name", F.lit(""))
    called = method & (F.col("callers") >= 1)
    stores = owner.rlike("(?:" + "|".join(STORE_ENDINGS) + ")$")
    return [
        (method & (F.col("callers") >= at.plumbing_callers) & (F.col("callees") <= at.plumbing_callees), F.col("callers")),
        (F.col("kind").isin("class", "trait", "object") & (F.col("n_refs") >= at.hub_refs) & (F.col("n_modules") >= max(n_modules // 2, at.hub_modules)), F.col("n_refs")),
        (called & (F.col("name").isin(FACTORY_NAMES) | owner.contains("Factory") | owner.contains("Generator")), F.col("callers")),
        (called & stores & F.col("name").isin(CRUD_NAMES), F.col("callers")),
        (method & (F.col("callers") >= at.infra_callers) & (F.col("owner_refs") >= at.infra_owner_refs) & (F.col("owner_modules") >= at.infra_owner_modules), F.col("callers")),
    ]


def candidates(measured: DataFrame, n_modules: int, limit: int = 15, at: Thresholds = Thresholds()) -> DataFrame:
    """The ``limit`` heaviest symbols of each category (ties by id), without those of an earlier category.

    One pass tells a symbol's categories; the limit comes before symbols of earlier categories are left out.
    """
    rules = detectors(n_modules, at)
    found = F.filter(F.array(*[F.when(rule, F.struct(F.lit(k).alias("category"), weight.cast("long").alias("weight"))) for k, (rule, weight) in enumerate(rules)]), lambda x: x.isNotNull())
    rows = measured.where(~is_skipped()).withColumn("_x", F.explode(found)).select("*", "_x.*").drop("_x")
    top = Window.partitionBy("category").orderBy(F.desc("weight"), "symbol_id")
    rows = rows.withColumn("place", F.row_number().over(top)).where(F.col("place") <= limit)
    # at most five times ``limit`` rows are left
    first = rows.groupBy("symbol_id").agg(F.min("category").alias("category"))
    return rows.join(first, ["symbol_id", "category"]).withColumn("pattern", pattern()).withColumn("display_kind", display_kind())


def detect(index: Index, limit: int = 15, at: Thresholds = Thresholds()) -> list[list[Row]]:
    """Candidates of each category, heaviest first."""
    rows = candidates(metrics(index), index.modules.count(), limit, at).orderBy("category", "place").collect() if limit else []
    return [[r for r in rows if r["category"] == k] for k in range(len(CATEGORIES))]


def evidence(category: int, r: Row) -> str:
    if category == 0:
        return f"{r['callers']} call sites, {r['callees']} callees"
    return f"{r['n_refs']} refs, {r['n_modules']} modules" if category == 1 else f"{r['callers']} call sites"


def patterns(found: list[list[Row]]) -> list[tuple[str, list[str]]]:
    """Exclude patterns of each category that has any: no term twice, shared prefixes for groups of terms."""
    terms: dict[str, int] = {}
    for k, rows in enumerate(found):
        for r in rows:
            terms.setdefault(r["pattern"], k)
    short = collapse(list(terms))
    named = {t: next((s for s in short if t.startswith(s)), t) for t in terms}
    out = []
    for k, label in enumerate(CATEGORIES):
        own = list(dict.fromkeys(named[t] for t, c in terms.items() if c == k))
        if own:
            out.append((label, own))
    return out


def infra_hubs(index: Index, top: int, least: int = 200) -> DataFrame:
    """(name, n_refs) of much-used objects and classes with utility names, outside tests and generated code."""
    from .predicates import flag, looks_utility

    rows = index.located().join(ref_counts(index.refs), "symbol_id").where((F.col("n_refs") >= least) & F.col("kind").isin("object", "class") & ~flag("is_test") & ~flag("is_generated") & looks_utility())
    return rows.orderBy(F.desc("n_refs"), "symbol_id").limit(top).select("name", "n_refs")
