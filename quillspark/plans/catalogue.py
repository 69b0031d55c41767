"""Queries of the engine, by name: each applies an operator to the projected index, and has SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import build as B, graph as G, noise as N, predicates as P, reports as R, resolve as S
from ..schema import PROPERTIES, SHOWN_PROPERTIES
from . import built
from .index import Index, violations
from .projection import MEMBERS_FROM, Views, ctes, project

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Thresholds that tell symbols apart in the projection, where every type is used everywhere.
SCALED = N.Thresholds(plumbing_callers=18, plumbing_callees=18, hub_refs=620, hub_modules=10, infra_callers=26, infra_owner_refs=50, infra_owner_modules=5)
EXCLUDE = ["Store", "findBy", "mod3"]


def _query(sql: str = "", *views: str, name: str = "") -> Callable[[Callable], Callable]:
    """Register a function of an index under its name, with SQL over the named views (``v_...``)."""

    def add(f: Callable[[Index], DataFrame]) -> Callable[[Index], DataFrame]:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql:
            _SQL[key] = f"{ctes(*views)}\n{sql}" if views else sql
        return f

    return add


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_STD = f"regexp_matches(s.fqn, '^({'|'.join(P.STDLIB_PREFIXES)})')"
_PLUMB = f"s.name IN ({_quoted(P.PLUMBING_NAMES)})"
_NOISE = f"({_STD} OR coalesce(f.is_test, false) OR coalesce(f.is_generated, false) OR {_PLUMB})"
_CALL_NOISE = f"({_NOISE} OR contains(s.name, '$default$') OR regexp_matches(s.name, '^_[0-9]+$') OR ((s.properties & 3072) <> 0 AND s.kind IN ('method', 'field')))"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RANK = """(CASE WHEN s.kind IN ('class', 'trait', 'interface') THEN 0 WHEN s.kind = 'object' THEN 10 WHEN s.kind = 'type' THEN 20 WHEN s.kind IN ('method', 'constructor') THEN 30 WHEN s.kind = 'field' THEN 40 ELSE 100 END
  + CASE WHEN f.is_generated THEN 40 WHEN f.is_test THEN 20 ELSE 0 END + least(strlen(s.name), 30) - CASE WHEN coalesce(c.n, 0) > 0 THEN least(floor(log2(c.n) * 3), 40) ELSE 0 END)"""
_COUNTED = "v_symbols s LEFT JOIN v_files f ON s.file_id = f.file_id LEFT JOIN (SELECT symbol_id, count(*) AS n FROM v_refs GROUP BY symbol_id) c ON s.symbol_id = c.symbol_id"
_DISPLAY = "coalesce(nullif(m.artifact_name, ''), m.name, '')"
_EXCLUDED = " OR ".join(f"contains({c}, '{p}')" for p in EXCLUDE for c in ("s.fqn", "s.name", "coalesce(o.name, '')"))


# Overviews and references


@_query(
    f"""SELECT m.module_id, {_DISPLAY} AS module, coalesce(s.n, 0) AS symbol_count, coalesce(f.n, 0) AS file_count FROM v_modules0 m
LEFT JOIN (SELECT module_id, count(*) AS n FROM v_files GROUP BY module_id) f ON m.module_id = f.module_id
LEFT JOIN (SELECT f.module_id, count(*) AS n FROM v_symbols s JOIN v_files f ON s.file_id = f.file_id GROUP BY f.module_id) s ON m.module_id = s.module_id""",
    "modules0", "files", "symbols",
)
def overview_modules(x: Index) -> DataFrame:
    return R.overview(x)


@_query("SELECT (SELECT count(*) FROM v_modules0) AS n_modules, (SELECT count(*) FROM v_symbols) AS n_symbols, (SELECT count(*) FROM v_files) AS n_files", "modules0", "files", "symbols")
def overview_totals(x: Index) -> DataFrame:
    return R.totals(x)


_LINES = "SELECT r.symbol_id, f.module_id, r.file_id, list_sort(list(DISTINCT r.line + 1)) AS lines FROM v_refs r JOIN v_files f ON r.file_id = f.file_id WHERE r.role = 'Reference' GROUP BY ALL"


@_query(f"SELECT symbol_id, module_id, sum(len(lines))::BIGINT AS n_refs, count(*) AS n_files FROM ({_LINES}) GROUP BY ALL", "refs", "files")
def refs_by_module(x: Index) -> DataFrame:
    return R.refs_by_module(R.reference_lines(x.refs, x.files))


@_query(f"SELECT symbol_id, module_id, file_id, array_to_string(lines, ',') AS lines FROM ({_LINES})", "refs", "files")
def refs_locations(x: Index) -> DataFrame:
    return R.reference_lines(x.refs, x.files).withColumn("lines", F.concat_ws(",", F.col("lines").cast("array<string>")))


@_query(f"SELECT symbol_id, module_id, file_id FROM ({_LINES}) WHERE symbol_id = 7 ORDER BY module_id, file_id LIMIT 100", "refs", "files")
def refs_first_files(x: Index) -> DataFrame:
    return R.reference_lines(x.refs.where("symbol_id = 7"), x.files).orderBy("module_id", "file_id").limit(100).select("symbol_id", "module_id", "file_id")


@_query(f"SELECT symbol_id, sum(len(lines))::BIGINT AS n_refs, count(*) AS n_files, count(DISTINCT module_id) AS n_modules FROM ({_LINES}) GROUP BY ALL", "refs", "files")
def refs_totals(x: Index) -> DataFrame:
    return R.refs_totals(R.reference_lines(x.refs, x.files))


@_query("SELECT symbol_id, count(*) AS n_refs FROM v_refs GROUP BY symbol_id", "refs")
def ref_counts(x: Index) -> DataFrame:
    return S.ref_counts(x.refs)


@_query("SELECT symbol_id, count(DISTINCT module_id) AS n_modules FROM v_refs r JOIN v_files f ON r.file_id = f.file_id GROUP BY symbol_id", "refs", "files")
def module_spreads(x: Index) -> DataFrame:
    return N.module_spreads(x.refs, x.files)


@_query("SELECT symbol_id, count(*) AS n_sites, count(DISTINCT CASE WHEN role = 'Reference' THEN module_id END) AS n_modules FROM v_refs r LEFT JOIN v_files f ON r.file_id = f.file_id GROUP BY symbol_id", "refs", "files")
def count_refs_roles(x: Index) -> DataFrame:
    return R.count_refs(x.refs, x.files)


# Edges


@_query("SELECT src, dst FROM v_calls", "calls")
def call_edges(x: Index) -> DataFrame:
    return x.edges_of("calls")


@_query("SELECT dst AS src, src AS dst FROM v_calls", "calls")
def reverse_edges(x: Index) -> DataFrame:
    return x.edges_of("calls", reverse=True)


@_query("SELECT coalesce(i.dst, o.src) AS symbol_id, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM (SELECT dst, count(*) AS n FROM v_calls GROUP BY dst) i FULL JOIN (SELECT src, count(*) AS n FROM v_calls GROUP BY src) o ON i.dst = o.src", "calls")
def call_degrees(x: Index) -> DataFrame:
    return G.call_degrees(x.edges_of("calls"))


@_query(
    """SELECT DISTINCT symbol_id, caller FROM (SELECT dst AS symbol_id, src AS caller FROM v_calls UNION ALL SELECT o.dst, c.src FROM v_overrides o JOIN v_calls c ON c.dst = o.src) WHERE symbol_id <> caller""",
    "calls", "overrides",
)
def trait_aware_callers(x: Index) -> DataFrame:
    return G.trait_aware_callers(x.edges_of("calls"), x.edges_of("overrides"))


@_query(f"SELECT c.src, c.dst FROM v_calls c JOIN v_symbols s ON c.dst = s.symbol_id LEFT JOIN v_files f ON s.file_id = f.file_id LEFT JOIN v_symbols o ON s.owner_id = o.symbol_id WHERE NOT {_CALL_NOISE} AND NOT ({_EXCLUDED})", "calls", "symbols", "files")
def filtered_callees(x: Index) -> DataFrame:
    return G.neighbours(x.edges_of("calls"), x.located(), EXCLUDE)


@_query("SELECT c.src, c.dst FROM v_calls c JOIN v_symbols a ON c.src = a.symbol_id JOIN v_files fa ON a.file_id = fa.file_id JOIN v_symbols b ON c.dst = b.symbol_id JOIN v_files fb ON b.file_id = fb.file_id WHERE fa.module_id <> fb.module_id", "calls", "symbols", "files")
def cross_module_edges(x: Index) -> DataFrame:
    return G.cross_module(x.edges_of("calls"), x.located())


_REACH = """, reach AS (SELECT {root} AS node, 0 AS depth UNION SELECT c.{to}, depth + 1 FROM reach JOIN v_calls c ON c.{at} = node WHERE depth < {depth}),
nearest AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node) SELECT c.{at} AS src, c.{to} AS dst, n.depth + 1 AS depth FROM nearest n JOIN v_calls c ON c.{at} = n.node WHERE n.depth < {depth}"""


@_query(_REACH.format(root=MEMBERS_FROM + 5, to="dst", at="src", depth=2), "calls")
def calls_depth2(x: Index) -> DataFrame:
    return G.reachable(x.edges_of("calls"), x.spark.createDataFrame([(MEMBERS_FROM + 5,)], "symbol_id long"), 2)


@_query(_REACH.format(root=MEMBERS_FROM + 9, to="src", at="dst", depth=3), "calls")
def calls_depth3_reverse(x: Index) -> DataFrame:
    return G.reachable(x.edges_of("calls", reverse=True), x.spark.createDataFrame([(MEMBERS_FROM + 9,)], "symbol_id long"), 3)


@_query("SELECT kind, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM (SELECT 'calls' AS kind, src, dst FROM v_calls UNION ALL SELECT 'extends', src, dst FROM v_extends UNION ALL SELECT 'overrides', src, dst FROM v_overrides UNION ALL SELECT 'member', owner_id, symbol_id FROM v_members) GROUP BY kind", "calls", "extends", "overrides", "members")
def edge_totals(x: Index) -> DataFrame:
    return x.edges.groupBy("kind").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


# Search


@_query("SELECT symbol_id, fqn FROM v_symbols WHERE fqn = 'com/sup15/OrderStore0#'", "symbols")
def search_exact_fqn(x: Index) -> DataFrame:
    return S.Resolver(x).exact_fqn("com/sup15/OrderStore0#").select("symbol_id", "fqn")


@_query("SELECT symbol_id, fqn FROM v_symbols WHERE ends_with(fqn, 'save(+3)') OR ends_with(fqn, 'save(+3).') OR ends_with(fqn, 'save(+3)#') OR ends_with(fqn, 'save(+3)().')", "symbols")
def search_fqn_suffix(x: Index) -> DataFrame:
    return S.Resolver(x).fqn_suffix("save(+3)").select("symbol_id", "fqn")


def _ranked_sql(where: str) -> str:
    return f"SELECT s.symbol_id, cast({_RANK} AS INTEGER) AS rank_score, row_number() OVER (ORDER BY {_RANK}, s.symbol_id) AS place FROM {_COUNTED} WHERE {where}"


def _placed(found: DataFrame, limit: int | None = None) -> DataFrame:
    from pyspark.sql import Window

    # the answer of a search, not a table: the places are those of the rows shown
    found = found.limit(limit) if limit else found
    return found.withColumn("place", F.row_number().over(Window.orderBy("rank_score", "symbol_id"))).select("symbol_id", "rank_score", "place")


@_query(_ranked_sql(_FOLD.format("s.name") + " = 'redwidget'"), "symbols", "files", "refs")
def search_exact_name_ranked(x: Index) -> DataFrame:
    return _placed(S.Resolver(x).exact_name("redWidget"))


@_query(_ranked_sql("contains(" + _FOLD.format("s.name") + ", 'idge')") + " QUALIFY place <= 50", "symbols", "files", "refs")
def search_substring_ranked(x: Index) -> DataFrame:
    return _placed(S.Resolver(x).substring("iDgE"), 50)


@_query(
    """, t AS (SELECT symbol_id, lower(name) AS n, lower(regexp_extract(fqn, '([^/]*)$', 1)) AS q FROM v_symbols),
g AS (SELECT symbol_id, unnest([substr(n, i, 3) for i in range(1, length(n) - 1)]) AS tri FROM t UNION SELECT symbol_id, unnest([substr(q, i, 3) for i in range(1, length(q) - 1)]) FROM t)
SELECT symbol_id FROM g WHERE tri IN ('sto', 'tor', 'ore') GROUP BY symbol_id HAVING count(DISTINCT tri) = 3""",
    "symbols",
)
def search_trigram_candidates(x: Index) -> DataFrame:
    return S.trigram_candidates(x.symbols, "Store")


@_query("SELECT tri, count(*) AS n FROM (SELECT symbol_id, unnest(list_distinct([substr(lower(name), i, 3) for i in range(1, length(name) - 1)])) AS tri FROM v_symbols) GROUP BY tri", "symbols")
def trigram_postings(x: Index) -> DataFrame:
    return x.symbols.select(F.explode(T.trigrams("name")).alias("tri")).groupBy("tri").agg(F.count("*").alias("n"))


@_query(f"SELECT m.symbol_id FROM v_symbols o JOIN v_symbols m ON m.owner_id = o.symbol_id WHERE {_FOLD.format('o.name')} = 'orderstore0' AND {_FOLD.format('m.name')} = 'get'", "symbols")
def search_owner_member(x: Index) -> DataFrame:
    return S.Resolver(x).owner_member("OrderStore0.get").select("symbol_id")


@_query(
    f""", staged AS (SELECT symbol_id, CASE WHEN fqn = 'store' THEN 1 WHEN ends_with(fqn, 'store') OR ends_with(fqn, 'store.') OR ends_with(fqn, 'store#') OR ends_with(fqn, 'store().') THEN 2
  WHEN {_FOLD.format("name")} = 'store' THEN 4 WHEN contains({_FOLD.format("name")}, 'store') THEN 5 END AS stage FROM v_symbols)
SELECT symbol_id, stage FROM staged WHERE stage = (SELECT min(stage) FROM staged)""",
    "symbols",
)
def search_cascade_stage(x: Index) -> DataFrame:
    return S.first_stage(x.symbols, "store").select("symbol_id", "stage")


@_query(f"SELECT DISTINCT name, 1 AS score FROM v_symbols WHERE damerau_levenshtein({_FOLD.format('name')}, 'gte') = 1 AND strlen(name) BETWEEN 2 AND 4", "symbols")
def search_fuzzy_d1(x: Index) -> DataFrame:
    return S.Resolver(x).fuzzy_names("gte").select("name", "score")


@_query()
def search_camel_abbrev(x: Index) -> DataFrame:
    return S.Resolver(x).camel_case("hcfac").select("symbol_id", "name", "score")


@_query()
def search_full_cascade(x: Index) -> DataFrame:
    stage, found = S.Resolver(x).resolve("usrservice")
    return found.select("symbol_id", "name", F.lit(stage).alias("stage"))


@_query(_ranked_sql("s.kind = 'class' AND (s.properties & 128) = 0 AND (s.properties & 16384) = 0 AND EXISTS (SELECT 1 FROM v_files g JOIN v_modules0 m ON g.module_id = m.module_id WHERE g.file_id = s.file_id AND contains(lower(m.name), 'asia'))"), "symbols", "files", "refs", "modules0")
def module_listing(x: Index) -> DataFrame:
    return _placed(S.Resolver(x).in_module("ASIA", "class"))


@_query("SELECT s.symbol_id FROM v_symbols s WHERE s.name LIKE '%Store%' AND (s.kind IN ('class', 'interface') AND (s.properties & 16384) <> 0 AND (s.properties & 128) = 0)", "symbols")
def search_filtered_kind(x: Index) -> DataFrame:
    return S.Resolver(x).filtered("store", kind="enum").select("symbol_id")


# Filters


@_query("SELECT module_id FROM v_modules0 WHERE contains(lower(name), 'nation_1') OR (artifact_name <> '' AND contains(lower(artifact_name), 'nation_1'))", "modules0")
def module_filter_plain(x: Index) -> DataFrame:
    return x.modules.where(P.in_module("Nation_1", "name")).select("module_id")


@_query("SELECT module_id FROM v_modules0 WHERE regexp_matches(name, '^geo[.][^.]*er[^.]*[.][^.]*nation_2[^.]*$')", "modules0")
def module_filter_dotted(x: Index) -> DataFrame:
    return x.modules.where(P.in_module("geo.er.nation_2", "name")).select("module_id")


@_query(
    """SELECT symbol_id, kind = 'class' AND (properties & 128) <> 0 AS case_class, kind IN ('class', 'interface') AND (properties & 16384) <> 0 AND (properties & 128) = 0 AS enum_kind,
  kind = 'class' AND (properties & 16512) = 0 AS class_kind, kind = 'interface' AND (properties & 16384) = 0 AS interface_kind, kind = 'method' AS method_kind FROM v_symbols""",
    "symbols",
)
def kind_filter(x: Index) -> DataFrame:
    kinds = {"case_class": "case-class", "enum_kind": "enum", "class_kind": "class", "interface_kind": "interface", "method_kind": "Method"}
    return x.symbols.select("symbol_id", *(P.matches_kind(k).alias(c) for c, k in kinds.items()))


@_query(f"SELECT s.symbol_id, {_STD} AS stdlib, {_PLUMB} AS plumbing, {_NOISE} AS noise, {_CALL_NOISE} AS callgraph_noise FROM v_symbols s LEFT JOIN v_files f ON s.file_id = f.file_id", "symbols", "files")
def noise_flags(x: Index) -> DataFrame:
    return x.located().select("symbol_id", P.is_stdlib().alias("stdlib"), P.is_plumbing().alias("plumbing"), P.is_noise().alias("noise"), P.is_callgraph_noise().alias("callgraph_noise"))


@_query(f"SELECT s.symbol_id FROM v_symbols s LEFT JOIN v_symbols o ON s.owner_id = o.symbol_id WHERE {_EXCLUDED}", "symbols")
def exclude_patterns(x: Index) -> DataFrame:
    return x.located().where(P.matches_exclude(EXCLUDE)).select("symbol_id")


@_query(
    f"SELECT s.symbol_id, ({_PLUMB} OR contains(s.name, '$default$') OR regexp_matches(s.name, '^_[0-9]+$') OR regexp_matches(s.name, '^(\\$anon|derived\\$|given_)') OR s.name IN ('<init>', 'getMessage', 'writeReplace', 'ordinal')) AS synthetic FROM v_symbols s",
    "symbols",
)
def synthetic_names(x: Index) -> DataFrame:
    return x.symbols.select("symbol_id", P.is_synthetic_name().alias("synthetic"))


@_query(
    "SELECT file_id, regexp_matches(lower(path), '/test/|/tests/|/it/|/spec/|(test|spec|suite|integ)\\.scala$') AS test, regexp_matches(lower(path), '/generated/|/src_managed/|generatedsources|buildinfo\\.scala|(\\.pb|grpc)\\.scala$') AS made FROM v_files",
    "files",
)
def classify_files(x: Index) -> DataFrame:
    return x.files.select("file_id", P.is_test_path("path", F.lit(None).cast("string")).alias("test"), P.is_generated_path("path").alias("made"))


# Noise

_MEASURED = f"""measured AS (SELECT s.symbol_id, s.name, s.fqn, s.kind, s.owner_id, coalesce(o.name, '') AS owner_name, coalesce(ci.n, 0) AS callers, coalesce(co.n, 0) AS callees, coalesce(c.n, 0) AS n_refs, coalesce(c.m, 0) AS n_modules,
  coalesce(oc.n, 0) AS owner_refs, coalesce(oc.m, 0) AS owner_modules FROM v_symbols s LEFT JOIN v_files f ON s.file_id = f.file_id LEFT JOIN v_symbols o ON s.owner_id = o.symbol_id
  LEFT JOIN (SELECT dst, count(*) AS n FROM v_calls GROUP BY dst) ci ON ci.dst = s.symbol_id LEFT JOIN (SELECT src, count(*) AS n FROM v_calls GROUP BY src) co ON co.src = s.symbol_id
  LEFT JOIN counts c ON c.symbol_id = s.symbol_id LEFT JOIN counts oc ON oc.symbol_id = s.owner_id WHERE NOT ({_STD} OR coalesce(f.is_test, false) OR coalesce(f.is_generated, false)))"""
_COUNTS = "counts AS (SELECT symbol_id, count(*) AS n, count(DISTINCT module_id) AS m FROM v_refs r LEFT JOIN v_files f ON r.file_id = f.file_id GROUP BY symbol_id)"
_RULES = (
    f"kind = 'method' AND callers >= {SCALED.plumbing_callers} AND callees <= {SCALED.plumbing_callees}",
    f"kind IN ('class', 'trait', 'object') AND n_refs >= {SCALED.hub_refs} AND n_modules >= (SELECT greatest(count(*) // 2, {SCALED.hub_modules}) FROM v_modules0)",
    f"kind = 'method' AND callers >= 1 AND (name IN ({_quoted(N.FACTORY_NAMES)}) OR contains(owner_name, 'Factory') OR contains(owner_name, 'Generator'))",
    f"kind = 'method' AND callers >= 1 AND regexp_matches(owner_name, '({'|'.join(N.STORE_ENDINGS)})$') AND name IN ({_quoted(N.CRUD_NAMES)})",
    f"kind = 'method' AND callers >= {SCALED.infra_callers} AND owner_refs >= {SCALED.infra_owner_refs} AND owner_modules >= {SCALED.infra_owner_modules}",
)
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT {k} AS category, symbol_id, name, fqn, kind, owner_name, {'n_refs' if k == 1 else 'callers'} AS weight FROM measured WHERE {rule}" for k, rule in enumerate(_RULES)) + ")"
_PATTERN = "CASE WHEN kind <> 'method' OR owner_name = '' THEN name WHEN contains(fqn, owner_name || '#' || name) THEN owner_name || '#' || name ELSE owner_name || '.' || name END"


def _noise(sql_where: str, name: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    sql = f", {_COUNTS}, {_MEASURED}, {_HITS}, top AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, symbol_id) AS place FROM hits QUALIFY place <= 15),\nfirst AS (SELECT symbol_id, min(category) AS category FROM top GROUP BY symbol_id) SELECT t.category, t.symbol_id, t.place, {_PATTERN.replace('name', 't.name').replace('owner_t.name', 't.owner_name').replace('fqn', 't.fqn').replace('kind', 't.kind')} AS pattern FROM top t JOIN first USING (symbol_id, category) WHERE {sql_where}"
    _query(sql, "symbols", "files", "refs", "calls", "modules0", name=name)(lambda x: keep(N.candidates(N.metrics(x), x.modules.count(), 15, SCALED)).select("category", "symbol_id", "place", "pattern"))


_noise("true", "noise_all_dedup", lambda df: df)
for _k, _name in enumerate(("noise_effect_plumbing", "noise_hub_utilities", "noise_id_factories", "noise_store_ops", "noise_infra_plumbing")):
    _noise(f"t.category = {_k}", _name, lambda df, k=_k: df.where(F.col("category") == k))


@_query("SELECT s.name, c.n AS n_refs FROM v_symbols s JOIN v_files f ON s.file_id = f.file_id JOIN (SELECT symbol_id, count(*) AS n FROM v_refs GROUP BY symbol_id) c ON c.symbol_id = s.symbol_id WHERE s.kind IN ('object', 'class') AND NOT f.is_test AND NOT f.is_generated AND c.n >= 50 AND regexp_matches(s.name, 'Utils|Ops|Operations|Helper|IO|Factory|(Store|Database|Mapping|Converter|Provider|Enum|Companion|Defaults)$') ORDER BY c.n DESC, s.symbol_id LIMIT 20", "symbols", "files", "refs")
def infra_hubs(x: Index) -> DataFrame:
    return N.infra_hubs(x, 20, 50)


# Names and displays

_BARE = "regexp_replace(fqn, '((\\([^(]*\\))?\\.|[#/])$', '')"


@_query(f"SELECT symbol_id, regexp_extract({_BARE}, '^(.*[/#.])?[^/#.]*$', 1) AS owner, regexp_extract(regexp_replace(regexp_replace(fqn, '[./#]$', ''), '\\.?\\([^(]*\\)$', ''), '([^/#.]*)$', 1) AS display FROM v_symbols", "symbols")
def owner_and_display_name(x: Index) -> DataFrame:
    return x.symbols.select("symbol_id", T.symbol_owner("fqn").alias("owner"), T.symbol_display_name("fqn").alias("display"))


@_query(f"SELECT s.symbol_id, o.symbol_id AS owner_id FROM (SELECT symbol_id, regexp_extract({_BARE}, '^(.*[/#.])?[^/#.]*$', 1) AS owner FROM v_symbols) s LEFT JOIN v_symbols o ON o.fqn = s.owner", "symbols")
def owner_resolution(x: Index) -> DataFrame:
    named = x.symbols.select("symbol_id", T.symbol_owner("fqn").alias("owner"))
    return named.join(x.symbols.select(F.col("fqn").alias("owner"), F.col("symbol_id").alias("owner_id")), "owner", "left").select("symbol_id", "owner_id")


@_query(
    "SELECT symbol_id, CASE WHEN kind = 'class' AND (properties & 128) <> 0 THEN 'case class' WHEN kind IN ('class', 'interface') AND (properties & 16384) <> 0 THEN 'enum' ELSE kind END AS display_kind, concat_ws(', ', "
    + ", ".join(f"CASE WHEN (properties & {PROPERTIES[p]}) <> 0 THEN '{p}' END" for p in SHOWN_PROPERTIES)
    + ") AS props FROM v_symbols",
    "symbols",
)
def kinds_and_properties(x: Index) -> DataFrame:
    return x.symbols.select("symbol_id", R.display_kind().alias("display_kind"), R.property_names().alias("props"))


_SQL["location_string"] = "SELECT p_partkey AS id, ':' || (p_size + 1) || CASE WHEN p_partkey % 60 > p_size THEN '-' || (p_partkey % 60 + 1) ELSE '' END AS loc FROM part"
_QUERIES["location_string"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), R.location(F.col("p_size"), F.col("p_partkey") % 60).alias("loc"))


@_query(f"SELECT m.module_id, {_DISPLAY} AS display FROM v_modules0 m", "modules0")
def module_display(x: Index) -> DataFrame:
    return x.modules.select("module_id", R.module_display("name").alias("display"))


@_query("SELECT DISTINCT name, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([^0-9_])([0-9])', '\\1_\\2', 'g'), '_'), lambda x: x <> ''), lambda x: lower(x)), ' ') AS parts FROM v_symbols", "symbols")
def camel_segments(x: Index) -> DataFrame:
    return x.symbols.select("name", F.concat_ws(" ", T.camel_segments("name")).alias("parts")).distinct()


@_query("SELECT DISTINCT name, CASE WHEN strlen(name) <= 2 THEN 0 ELSE least(strlen(name) // 3, 5) END::INTEGER AS most FROM v_symbols", "symbols")
def fuzzy_thresholds(x: Index) -> DataFrame:
    return x.symbols.select("name", T.fuzzy_threshold(F.octet_length("name")).alias("most")).distinct()


@_query("SELECT name, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296) % 1024 AS BIGINT) AS bucket FROM (SELECT DISTINCT name FROM v_symbols)", "symbols")
def name_hash_buckets(x: Index) -> DataFrame:
    return x.symbols.select("name", T.name_hash("name", 1024).alias("bucket")).distinct()


# Relations of symbols


@_query("SELECT o.symbol_id AS src, m.symbol_id AS dst FROM v_symbols m JOIN v_symbols o ON m.owner_id = o.symbol_id", "symbols")
def members(x: Index) -> DataFrame:
    return x.edges_of("member")


@_query("SELECT src, dst FROM v_extends", "extends")
def inheritance(x: Index) -> DataFrame:
    return x.edges_of("extends")


@_query("SELECT src, dst FROM v_overrides", "overrides")
def overrides(x: Index) -> DataFrame:
    return x.edges_of("overrides")


@_query(f"SELECT e.src, e.dst FROM v_extends e JOIN v_symbols s ON e.dst = s.symbol_id LEFT JOIN v_files f ON s.file_id = f.file_id WHERE s.kind NOT IN ('local', 'parameter') AND NOT {_NOISE}", "extends", "symbols", "files")
def implementations(x: Index) -> DataFrame:
    return R.implementations(x).select("src", "dst")


@_query(
    f"""SELECT s.owner_id AS src, s.symbol_id AS dst, CASE WHEN s.kind IN ('class', 'trait', 'object', 'interface') THEN 0 WHEN s.kind = 'type' THEN 1 WHEN s.kind = 'method' AND (s.properties & 3072) = 0 THEN 2 WHEN s.kind IN ('method', 'field') THEN 3 ELSE 4 END AS bucket
FROM v_members s WHERE s.kind NOT IN ('parameter', 'typeparameter', 'selfparameter', 'constructor') AND NOT ({_PLUMB} OR contains(s.name, '$default$') OR regexp_matches(s.name, '^_[0-9]+$'))""",
    "members",
)
def member_order(x: Index) -> DataFrame:
    return R.members(x).select("src", "dst", "bucket")


@_query(f"SELECT dst, src FROM v_calls QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= {G.CALL_CAP}", "calls")
def call_cap(x: Index) -> DataFrame:
    return G.capped(x.edges_of("calls", reverse=True)).select(F.col("src").alias("dst"), F.col("dst").alias("src"))


@_query("SELECT rule, n FROM (VALUES " + ", ".join(f"('{r}', 0::BIGINT)" for r in ("symbol_id_repeated", "fqn_repeated", "path_repeated", "edge_repeated", "symbol_without_file", "symbol_without_owner", "file_without_module", "ref_without_symbol", "ref_without_file", "edge_without_src", "edge_without_dst", "call_to_itself", "ends_before_start", "dep_without_module")) + ") t(rule, n)")
def invariant_violations(x: Index) -> DataFrame:
    return violations(x)


# Build steps over the raw tables

_DEFS = "defs AS (SELECT user_id AS uri, user_id % 3 AS owner_id, event_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line, event_type FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    return Views(spark, sf_dir)["events"].select(F.col("user_id").alias("uri"), (F.col("event_id") % 3).alias("owner_id"), F.col("event_id").alias("sid"), line.alias("line"), "event_type")


def _signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = _events(spark, sf_dir).where("event_type = 'signup'").select("uri", "owner_id", "sid", F.col("line").alias("start_line"), F.lit(3).alias("end_col"), F.col("sid").alias("seq"))
    return B.sibling_bounds(defs)


_BOUNDS = "SELECT uri, sid, line AS start_line, CASE WHEN lead(line) OVER w > line THEN lead(line) OVER w END AS body_end FROM (SELECT user_id AS uri, event_id % 3 AS owner_id, event_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line, event_type FROM events) WHERE event_type = 'signup' WINDOW w AS (PARTITION BY uri, owner_id ORDER BY line, sid)"
_QUERIES["sibling_bounds"] = lambda spark, sf_dir: _signups(spark, sf_dir).select("uri", "sid", "start_line", "body_end")
_SQL["sibling_bounds"] = _BOUNDS


def _enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _events(spark, sf_dir).where("event_type <> 'signup'").select(F.col("sid").alias("ref"), "uri", "line", F.lit(0).alias("col"))
    return B.enclosing(refs, _signups(spark, sf_dir), ["ref"])


_QUERIES["enclosing_definition"] = _enclosing
_SQL["enclosing_definition"] = f"""WITH bounds AS ({_BOUNDS}), refs AS (SELECT user_id AS uri, event_id AS ref, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS line FROM events)
SELECT ref, arg_max(sid, (start_line, sid)) AS caller FROM refs r JOIN bounds d ON r.uri = d.uri AND d.start_line <= r.line AND (d.body_end IS NULL OR r.line < d.body_end) AND (r.line > d.start_line OR 0 > 3) WHERE event_type <> 'signup' GROUP BY ref"""

_QUERIES["first_definition"] = lambda spark, sf_dir: Views(spark, sf_dir)["items"].groupBy(F.col("l_partkey").alias("symbol")).agg(F.min_by(F.struct("l_orderkey", "pos"), F.struct("l_orderkey", "pos")).alias("d")).select("symbol", F.col("d.l_orderkey").alias("file_id"), F.col("d.pos").alias("pos"))
_SQL["first_definition"] = f"{ctes('items')} SELECT l_partkey AS symbol, l_orderkey AS file_id, pos FROM v_items QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, pos) = 1"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Views(spark, sf_dir)["part"].select("p_partkey", F.concat(F.lit(";"), F.regexp_replace("p_name", " ", ";"), F.lit(";;"), F.col("p_type")).alias("symbol"))
    return parts.select("p_partkey", F.posexplode(T.occurrence_symbols("symbol")).alias("k", "symbol"))


_QUERIES["multi_symbol_explode"] = _multi
_SQL["multi_symbol_explode"] = "SELECT p_partkey, (unnest(range(len(s))))::INTEGER AS k, unnest(s) AS symbol FROM (SELECT p_partkey, list_filter(string_split(';' || replace(p_name, ' ', ';') || ';;' || p_type, ';'), lambda x: x <> '') AS s FROM part)"

_REWRITES = [("mod1", "core"), ("mod", "app/mod"), ("mod12", "never/")]
_QUERIES["uri_rewrite"] = lambda spark, sf_dir: B.rewrite_uris(project(spark, sf_dir).files.select("file_id", F.col("path").alias("uri")), spark.createDataFrame([(*r, k) for k, r in enumerate(_REWRITES)], "from string, to string, rule int"))
_SQL["uri_rewrite"] = f"{ctes('files')} SELECT file_id, CASE WHEN starts_with(path, 'mod1') THEN 'core' || substr(path, 5) WHEN starts_with(path, 'mod') THEN 'app/mod' || substr(path, 4) ELSE path END AS uri FROM v_files"


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two build records for the nations below 12, and modules that no document has."""
    from ..schema import MODULE_IN

    nations = Views(spark, sf_dir)["nation"]
    empty = F.array().cast("array<string>")
    shape = {f.name: (empty if f.dataType.simpleString() == "array<string>" else F.lit("")) for f in MODULE_IN.fields}
    first = nations.where("n_nationkey < 12").select(*((shape | {"segments": F.concat(F.lit("m"), F.col("n_nationkey")), "artifact_name": F.lit("one"), "scala_version": F.lit("3"), "source_paths": F.array(F.lit("a"))})[f.name].alias(f.name) for f in MODULE_IN.fields), F.col("n_nationkey").cast("long").alias("seq"))
    second = nations.where("n_nationkey % 2 = 0").select(*((shape | {"segments": F.concat(F.lit("m"), F.col("n_nationkey")), "artifact_name": F.when(F.col("n_nationkey") % 4 == 0, "two").otherwise(""), "source_paths": F.array(F.lit("b"))})[f.name].alias(f.name) for f in MODULE_IN.fields), (F.col("n_nationkey") + 100).cast("long").alias("seq"))
    docs = nations.where("n_nationkey >= 10").select(F.concat(F.lit("m"), F.col("n_nationkey")).alias("module_segments"), F.col("n_nationkey").cast("long").alias("doc_seq"))
    return B.build_modules(docs, first.unionByName(second)).select("name", "artifact_name", "scala_version", F.concat_ws(",", "source_paths").alias("source_paths"))


_QUERIES["module_metadata_upsert"] = _metadata
_SQL["module_metadata_upsert"] = "SELECT 'm' || n_nationkey AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'two' WHEN n_nationkey < 12 THEN 'one' ELSE '' END AS artifact_name, CASE WHEN n_nationkey < 12 THEN '3' ELSE '' END AS scala_version, CASE WHEN n_nationkey < 12 THEN 'a' WHEN n_nationkey % 2 = 0 THEN 'b' ELSE '' END AS source_paths FROM nation"

_QUERIES["json_value_extract"] = lambda spark, sf_dir: Views(spark, sf_dir)["events"].select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
_SQL["json_value_extract"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _division(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.metadata import divided

    lines = Views(spark, sf_dir)["lineitem"]
    return divided(lines.select(F.col("l_suppkey").alias("made"), (F.col("l_partkey") % 11).cast("string").alias("name")), lines.select(F.col("l_suppkey").alias("held"), (F.col("l_partkey") % 13).cast("string").alias("name")))


_QUERIES["shared_source_division"] = _division
_SQL["shared_source_division"] = """WITH m AS (SELECT DISTINCT l_suppkey AS made, l_partkey % 11 AS name FROM lineitem), h AS (SELECT DISTINCT l_suppkey AS held, l_partkey % 13 AS name FROM lineitem)
SELECT a.made, b.held FROM (SELECT DISTINCT made FROM m) a CROSS JOIN (SELECT DISTINCT held FROM h) b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.made = a.made AND NOT EXISTS (SELECT 1 FROM h WHERE h.held = b.held AND h.name = m.name))"""

_QUERIES["source_lines"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "code"))
_SQL["source_lines"] = "SELECT doc_id, line, code FROM (SELECT doc_id, unnest(range(len(s)))::INTEGER AS line, unnest(s) AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


# Profiles


@_query(
    "SELECT symbol_id, CASE WHEN contains(t, '#') THEN regexp_extract(t, '([^#]*)$', 1) ELSE regexp_extract(t, '([^/]*)$', 1) END AS name FROM (SELECT symbol_id, regexp_replace(regexp_replace(fqn, '\\.+$', ''), '\\([^(]*$', '') AS t FROM v_symbols)",
    "symbols",
)
def terminal_names(x: Index) -> DataFrame:
    return x.symbols.select("symbol_id", T.terminal_name("fqn").alias("name"))


_ONE = MEMBERS_FROM + 20


@_query(
    f"""SELECT 'caller' AS side, s.symbol_id FROM (SELECT src AS id FROM v_calls WHERE dst = {_ONE} UNION SELECT c.src FROM v_overrides o JOIN v_calls c ON c.dst = o.src WHERE o.dst = {_ONE}) n JOIN v_symbols s ON s.symbol_id = n.id
  LEFT JOIN v_files f ON s.file_id = f.file_id WHERE n.id <> {_ONE} AND NOT {_CALL_NOISE}
UNION ALL SELECT 'callee', s.symbol_id FROM v_calls c JOIN v_symbols s ON s.symbol_id = c.dst LEFT JOIN v_files f ON s.file_id = f.file_id WHERE c.src = {_ONE} AND NOT {_CALL_NOISE}""",
    "calls", "overrides", "symbols", "files",
)
def call_neighbourhood(x: Index) -> DataFrame:
    me = x.spark.createDataFrame([(_ONE,)], "symbol_id long")
    shown = G.visible(x.located()).select("symbol_id")
    callers = G.trait_aware_callers(x.edges_of("calls"), x.edges_of("overrides"), me).select(F.lit("caller").alias("side"), F.col("caller").alias("symbol_id"))
    callees = x.edges_of("calls").where(F.col("src") == _ONE).select(F.lit("callee").alias("side"), F.col("dst").alias("symbol_id"))
    return callers.unionByName(callees).join(shown, "symbol_id", "left_semi").select("side", "symbol_id")


@_query("SELECT o.dst AS symbol_id, coalesce(b.name, regexp_extract(b.fqn, '([^/#.]*)$', 1)) AS base_name, b.fqn AS base_fqn FROM v_overrides o LEFT JOIN v_symbols b ON o.src = b.symbol_id", "overrides", "symbols")
def overridden_names(x: Index) -> DataFrame:
    bases = x.symbols.select(F.col("symbol_id").alias("src"), F.col("name").alias("base_name"), F.col("fqn").alias("base_fqn"))
    return x.edges_of("overrides").join(bases, "src", "left").select(F.col("dst").alias("symbol_id"), F.coalesce("base_name", T.symbol_display_name("base_fqn")).alias("base_name"), "base_fqn")


@_query(
    f"SELECT s.symbol_id, (s.kind IN ('parameter', 'typeparameter', 'selfparameter', 'local') OR {_PLUMB} OR contains(s.name, '$default$') OR regexp_matches(s.name, '^_[0-9]+$') OR ((s.properties & 1024) <> 0 AND s.kind = 'method' AND contains(s.fqn, '#`<init>`'))) AS synthetic FROM v_symbols s",
    "symbols",
)
def synthetic_symbols(x: Index) -> DataFrame:
    return x.symbols.select("symbol_id", P.is_synthetic().alias("synthetic"))


@_query(
    f"""SELECT s.symbol_id, f.module_id IS NOT NULL AND coalesce(f.is_test, false) AS test, coalesce(f.is_generated, false) AS made, {_DISPLAY} AS module, coalesce(o.name, '') AS owner FROM v_symbols s
LEFT JOIN v_files f ON s.file_id = f.file_id LEFT JOIN v_modules0 m ON f.module_id = m.module_id LEFT JOIN v_symbols o ON s.owner_id = o.symbol_id""",
    "symbols", "files", "modules0",
)
def located_symbols(x: Index) -> DataFrame:
    return x.located().select("symbol_id", P.flag("is_test").alias("test"), P.flag("is_generated").alias("made"), R.module_display().alias("module"), F.coalesce("owner_name", F.lit("")).alias("owner"))


@_query(f"SELECT s.symbol_id, s.name FROM {_COUNTED} WHERE contains({_FOLD.format('s.name')}, 'store') AND s.kind = 'class' AND (s.properties & 16512) = 0 ORDER BY {_RANK}, s.symbol_id LIMIT 1", "symbols", "files", "refs")
def search_best_one(x: Index) -> DataFrame:
    return S.Resolver(x).one("store", kind="class").select("symbol_id", "name")


@_query(
    f"SELECT name FROM (SELECT DISTINCT name, damerau_levenshtein({_FOLD.format('name')}, 'orderstor0') AS d FROM v_symbols) WHERE d BETWEEN 1 AND 3 AND 2 * d <= greatest(strlen(name), 10) ORDER BY d, name LIMIT 5",
    "symbols",
)
def search_suggestions(x: Index) -> DataFrame:
    return S.Resolver(x).suggestions("OrderStor0").select("name")


@_query(f"SELECT symbol_id, name FROM v_symbols WHERE contains({_FOLD.format('name')}, 'store')", "symbols")
def search_other_kinds(x: Index) -> DataFrame:
    return S.Resolver(x).other_kinds("Store", include_noise=True).select("symbol_id", "name")


def queries() -> dict[str, Query]:
    return dict(_QUERIES) | built.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | built.SQL
