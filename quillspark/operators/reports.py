"""Display columns, and the relations behind overviews, reference reports and symbol profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.index import Index
from ..schema import CASE, ENUM, PROPERTIES, SHOWN_PROPERTIES, VAL, VAR
from .predicates import has, is_implementation, is_member


def display_kind() -> Column:
    kind = F.col("kind")
    return F.when((kind == "class") & has("properties", CASE), "case class").when(kind.isin("class", "interface") & has("properties", ENUM), "enum").otherwise(kind)


def property_names(properties: Column | str = "properties") -> Column:
    """Shown properties, joined by commas."""
    return F.concat_ws(", ", *[F.when(has(properties, PROPERTIES[p]), p) for p in SHOWN_PROPERTIES])


def location(line: Column | str = "line", end_line: Column | str = "end_line") -> Column:
    """``:first`` or ``:first-last``, counted from 1."""
    line, end = (F.col(x) if isinstance(x, str) else x for x in (line, end_line))
    first = F.concat(F.lit(":"), (line + 1).cast("string"))
    return F.when(end > line, F.concat(first, F.lit("-"), (end + 1).cast("string"))).otherwise(first)


def module_display(name: Column | str = "module_name", artifact: Column | str = "artifact_name") -> Column:
    name, artifact = (F.col(x) if isinstance(x, str) else x for x in (name, artifact))
    return F.coalesce(F.nullif(artifact, F.lit("")), name, F.lit(""))


def access_display(access: Column | str = "access") -> Column:
    # How an access is shown; public ones are not.
    access = F.col(access) if isinstance(access, str) else access
    out = F.when(access == "private", "private")
    for a, b in (("privatethis", "private[this]"), ("privatewithin", "private[scope]"), ("protected", "protected"), ("protectedthis", "protected[this]"), ("protectedwithin", "protected[scope]")):
        out = out.when(access == a, b)
    return out.otherwise("")


def overview(index: Index) -> DataFrame:
    """Modules with their counts, largest first."""
    return index.modules.select("module_id", module_display("name").alias("module"), "symbol_count", "file_count").orderBy(F.desc("symbol_count"), "module_id")


def totals(index: Index) -> DataFrame:
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("n_modules", index.modules), ("n_symbols", index.symbols), ("n_files", index.files))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def reference_lines(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, module_id, file_id, lines): distinct lines, from 1, of each symbol's references in each file; definitions are left out."""
    rows = refs.where("role = 'Reference'").join(files.select("file_id", "module_id"), "file_id")
    return rows.groupBy("symbol_id", "module_id", "file_id").agg(F.array_sort(F.collect_set(F.col("line") + 1)).alias("lines"))


def refs_by_module(lines: DataFrame) -> DataFrame:
    return lines.groupBy("symbol_id", "module_id").agg(F.sum(F.size("lines")).alias("n_refs"), F.count("*").alias("n_files"))


def refs_totals(lines: DataFrame) -> DataFrame:
    """Unknown modules count as one."""
    return lines.groupBy("symbol_id").agg(F.sum(F.size("lines")).alias("n_refs"), F.count("*").alias("n_files"), F.count_distinct(F.coalesce("module_id", F.lit(-1))).alias("n_modules"))


def count_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, n_sites, n_modules): occurrences of all roles; modules of references only."""
    rows = refs.join(files.select("file_id", "module_id"), "file_id", "left")
    return rows.groupBy("symbol_id").agg(F.count("*").alias("n_sites"), F.count_distinct(F.when(F.col("role") == "Reference", F.col("module_id"))).alias("n_modules"))


def member_bucket() -> Column:
    """Types, type members, methods, then values, then the rest."""
    value = has("properties", VAL | VAR)
    kind = F.col("kind")
    return F.when(kind.isin("class", "trait", "object", "interface"), 0).when(kind == "type", 1).when((kind == "method") & ~value, 2).when(kind.isin("method", "field"), 3).otherwise(4)


def members(index: Index) -> DataFrame:
    """(src, member columns, bucket) of every owner."""
    return index.edges_of("member").join(index.located().withColumnRenamed("symbol_id", "dst"), "dst").where(is_member()).withColumn("bucket", member_bucket())


def implementations(index: Index) -> DataFrame:
    return index.edges_of("extends").join(index.located().withColumnRenamed("symbol_id", "dst"), "dst").where(is_implementation())
