"""The code model as a view of business tables, so that operators run on any scale of them.

Nations are modules, orders are files, suppliers are types, parts are their members and line items are occurrences. Each view is SQL that other
engines read too; :func:`project` puts the views together as an :class:`Index`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .index import Index

#: Ids of members come after all ids of types.
MEMBERS_FROM = 1_000_000_000

#: In order: later views read earlier ones. Names in braces are tables or earlier views.
VIEWS = {
    "modules0": """SELECT cast(n_nationkey AS BIGINT) AS module_id, 'geo.' || lower(replace(r_name, ' ', '_')) || '.' || lower(n_name) AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE '' END AS artifact_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "files": """SELECT o_orderkey AS file_id, 'mod' || c_nationkey || CASE WHEN o_orderpriority = '5-LOW' THEN '/test/' WHEN o_orderstatus = 'P' THEN '/generated/' ELSE '/src/' END || 'Order' || o_orderkey || '.scala' AS path,
  cast(c_nationkey AS BIGINT) AS module_id, o_orderpriority = '5-LOW' AS is_test, o_orderstatus = 'P' AS is_generated FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "items": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM {lineitem}""",
    "type_home": "SELECT l_suppkey, min(l_orderkey) AS file_id FROM {lineitem} GROUP BY l_suppkey",
    "member_home": "SELECT l_partkey, min(l_orderkey) AS file_id FROM {lineitem} GROUP BY l_partkey",
    "n_types": "SELECT count(*) AS n FROM {supplier}",
    "types0": """SELECT s_suppkey AS symbol_id, CASE s_suppkey % 8 WHEN 0 THEN 'Order' WHEN 1 THEN 'User' WHEN 2 THEN 'HttpClient' WHEN 3 THEN 'Id' WHEN 4 THEN 'Billing' WHEN 5 THEN 'Part' WHEN 6 THEN 'JSON' ELSE 'Stock' END
    || CASE s_suppkey % 7 WHEN 0 THEN 'Store' WHEN 1 THEN 'Factory' WHEN 2 THEN 'Service' WHEN 3 THEN 'Repository' WHEN 4 THEN 'Utils' WHEN 5 THEN 'Generator' ELSE 'Provider' END || s_suppkey AS name,
  CASE s_suppkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'trait' WHEN 2 THEN 'object' WHEN 3 THEN 'class' ELSE 'interface' END AS kind, s_nationkey, s_suppkey FROM {supplier}""",
    "types": """SELECT symbol_id, name, CASE WHEN s_suppkey % 11 = 10 THEN 'scala/collection/' ELSE 'com/sup' || s_nationkey || '/' END || name || CASE WHEN kind = 'object' THEN '.' ELSE '#' END AS fqn, kind, file_id,
  cast(s_suppkey % 40 AS INTEGER) AS line, cast(NULL AS BIGINT) AS owner_id, cast(CASE s_suppkey % 6 WHEN 0 THEN 128 WHEN 1 THEN 16384 WHEN 2 THEN 4 WHEN 3 THEN 24 ELSE 0 END AS INTEGER) AS properties
  FROM {types0} LEFT JOIN {type_home} ON symbol_id = l_suppkey""",
    "members0": """SELECT p_partkey, 1000000000 + p_partkey AS symbol_id, p_partkey % n AS owner_id, p_type, p_name,
  CASE p_partkey % 9 WHEN 0 THEN 'get' WHEN 1 THEN 'findBy' WHEN 2 THEN 'randomId' WHEN 3 THEN 'save' WHEN 4 THEN 'apply' WHEN 5 THEN '_' || (1 + p_partkey % 3) WHEN 6 THEN 'new$default$1'
    ELSE substr(p_name, 1, instr(p_name, ' ') - 1) || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || substr(p_name, instr(p_name, ' ') + 2) END AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'method' WHEN 'STANDARD' THEN 'method' WHEN 'PROMO' THEN 'method' WHEN 'LARGE' THEN 'field' WHEN 'SMALL' THEN 'constructor' ELSE 'type' END AS kind,
  cast(CASE p_size % 6 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4194304 WHEN 3 THEN 72 ELSE 0 END AS INTEGER) AS properties, cast(p_size AS INTEGER) AS line FROM {part} CROSS JOIN {n_types}""",
    "members": """SELECT m.symbol_id, m.name, t.fqn || m.name || '(+' || m.p_partkey || ').' AS fqn, m.kind, h.file_id, m.line, m.owner_id, m.properties
  FROM {members0} m JOIN {types} t ON m.owner_id = t.symbol_id LEFT JOIN {member_home} h ON m.p_partkey = h.l_partkey""",
    "symbols": """SELECT symbol_id, name, fqn, kind, file_id, line, owner_id, properties FROM {types} UNION ALL SELECT symbol_id, name, fqn, kind, file_id, line, owner_id, properties FROM {members}""",
    "refs": """SELECT 1000000000 + l_partkey AS symbol_id, l_orderkey AS file_id, l_linenumber AS line, CASE WHEN pos = 1 THEN 'Definition' ELSE 'Reference' END AS role FROM {items}
  UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN pos = 1 THEN 'Definition' ELSE 'Reference' END FROM {items}""",
    "calls": """SELECT DISTINCT 1000000000 + a.l_partkey AS src, 1000000000 + b.l_partkey AS dst FROM {items} a JOIN {items} b ON a.l_orderkey = b.l_orderkey AND b.pos = a.pos + 1 WHERE a.l_partkey <> b.l_partkey""",
    "same_parts": "SELECT p_name, p_type, min(p_partkey) AS base FROM {part} GROUP BY p_name, p_type",
    "overrides": """SELECT 1000000000 + base AS src, 1000000000 + p_partkey AS dst FROM {part} p JOIN {same_parts} s ON p.p_name = s.p_name AND p.p_type = s.p_type WHERE p_partkey <> base""",
    "extends": "SELECT DISTINCT l_suppkey % 10 AS src, l_suppkey AS dst FROM {lineitem} WHERE l_suppkey % 10 <> l_suppkey",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def needs(view: str) -> list[str]:
    """The views that one reads, itself last, in order."""
    found: list[str] = []
    for v in VIEWS:
        if v == view or any(f"{{{v}}}" in VIEWS[w] for w in needs_after(view, v)):
            found.append(v)
    return found


def needs_after(view: str, earlier: str) -> list[str]:
    """Views between that may read ``earlier`` on the way to ``view``."""
    wanted, names = {view}, list(VIEWS)
    for v in reversed(names[: names.index(view) + 1]):
        if any(f"{{{v}}}" in VIEWS[w] for w in wanted):
            wanted.add(v)
    return [w for w in wanted if names.index(w) > names.index(earlier)]


def ctes(*views: str) -> str:
    """``WITH`` and the definitions of views and of all that they read, for an engine where the tables are views."""
    wanted = [v for v in VIEWS if any(v in needs(w) for w in views)]
    parts = []
    for v in wanted:
        text = VIEWS[v]
        for name in (*TABLES, *VIEWS):
            text = text.replace(f"{{{name}}}", f"v_{name}" if name in VIEWS else name)
        parts.append(f"v_{v} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(parts)


class Views:
    """The views over one folder of tables, as DataFrames made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                read = [n for n in (*TABLES, *VIEWS) if f"{{{n}}}" in VIEWS[name]]
                self.made[name] = self.spark.sql(VIEWS[name], **{n: self[n] for n in read})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def project(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder of tables. Nothing runs until a query reads it, and then only what it needs."""
    v = Views(spark, sf_dir)
    files, symbols = v["files"], v["symbols"]
    per_file = files.groupBy("module_id").agg(F.count("*").alias("file_count"))
    per_symbol = symbols.join(files.select("file_id", "module_id"), "file_id").groupBy("module_id").agg(F.count("*").alias("symbol_count"))
    none, empty = F.lit(""), F.array().cast("array<string>")
    modules = v["modules0"].join(per_file, "module_id", "left").join(per_symbol, "module_id", "left").fillna(0, ["file_count", "symbol_count"])
    modules = modules.select(
        "module_id", "name", "artifact_name", empty.alias("source_paths"), empty.alias("generated_source_paths"), none.alias("scala_version"), empty.alias("scalac_options"), none.alias("main_class"), none.alias("test_framework"), "file_count", "symbol_count"
    )
    symbols = symbols.select(
        "symbol_id", "name", "fqn", "kind", "file_id", "line", F.lit(0).alias("col"), F.lit(None).cast("int").alias("end_line"), none.alias("type_signature"), "owner_id", "properties", F.lit("public").alias("access"), empty.alias("parents"), empty.alias("overridden_symbols")
    )
    refs = v["refs"].select("symbol_id", "file_id", "line", F.lit(0).alias("col"), "role")
    edges = None
    for kind, rows in (("calls", v["calls"]), ("extends", v["extends"]), ("overrides", v["overrides"]), ("member", v["members"].select(F.col("owner_id").alias("src"), F.col("symbol_id").alias("dst")))):
        part = rows.select(F.lit(kind).alias("kind"), "src", "dst")
        edges = part if edges is None else edges.unionByName(part)
    deps = spark.createDataFrame([], "src long, dst long")
    return Index(files, modules, symbols, refs, edges, deps, spark.createDataFrame([], "module_id long, dep string"))
