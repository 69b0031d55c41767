"""The index: a set of tables, saved as Parquet with a version row that is written last."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import INDEX_VERSION, TABLES
from .durable import ranges, release

#: Tables as they are saved: symbols, which take most room on the way, come last, and each table that is sorted by a column with it.
_SAVED = {"files": None, "modules": None, "module_deps": None, "ivy_deps": None, "edges": "src", "refs": "symbol_id", "symbols": "fqn"}


class IndexMissing(FileNotFoundError):
    """No index at the path, or one of another version."""


@dataclass
class Index:
    files: DataFrame
    modules: DataFrame
    symbols: DataFrame
    refs: DataFrame
    edges: DataFrame
    module_deps: DataFrame
    ivy_deps: DataFrame
    workspace_root: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def edges_of(self, kind: str, reverse: bool = False) -> DataFrame:
        """(src, dst) of one kind of edge; the reverse is the same rows, swapped."""
        edges = self.edges.where(F.col("kind") == kind)
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")

    def located(self) -> DataFrame:
        """Symbols with their file's path and flags, their module and the name of their owner."""
        files = self.files.select("file_id", "path", "module_id", "is_test", "is_generated")
        modules = self.modules.select("module_id", F.col("name").alias("module_name"), "artifact_name")
        owners = self.symbols.select(F.col("symbol_id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("fqn").alias("owner_fqn"))
        return self.symbols.join(files, "file_id", "left").join(modules, "module_id", "left").join(owners, "owner_id", "left")

    def _keys(self, table: str, column: str) -> DataFrame:
        """A column of a table, for its sizes and its quantiles."""
        return getattr(self, table).select(column)

    @contextmanager
    def _lent(self, table: str) -> Iterator[DataFrame]:
        """A table for as long as it is saved."""
        yield getattr(self, table)

    def save(self, path: str) -> str:
        """Write all tables, symbols sorted by full name for pruned lookups, edges and references by their symbol; then the version.

        Large tables are sorted a range of the column at a time, so that no more than one range is in shuffle files. A half-written index
        has no version row and is not read.
        """
        path = path.rstrip("/")
        _delete(self.spark, f"{path}/_meta")
        for table, column in _SAVED.items():
            with self._lent(table) as df:
                for i, within in enumerate(ranges(self._keys(table, column), column) if column else [F.lit(True)]):
                    rows = df.where(within)
                    writer = (rows.orderBy(column) if column else rows).write.mode("append" if i else "overwrite").option("compression", "zstd")
                    if table == "symbols":
                        writer = writer.option("parquet.bloom.filter.enabled#fqn", "true")
                    writer.parquet(f"{path}/{table}")
                    release(self.spark)
        self.spark.createDataFrame([(INDEX_VERSION, self.workspace_root)], "version int, workspace_root string").write.mode("overwrite").parquet(f"{path}/_meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        path = path.rstrip("/")
        try:
            meta = spark.read.parquet(f"{path}/_meta").first()
        except Exception as error:
            raise IndexMissing(f"Index not found: {path}. Run index first.") from error
        if meta is None or meta["version"] != INDEX_VERSION:
            raise IndexMissing(f"Index at {path} has version {meta and meta['version']}, not {INDEX_VERSION}; index again.")
        return cls(*(spark.read.schema(schema).parquet(f"{path}/{table}") for table, schema in TABLES.items()), workspace_root=meta["workspace_root"])

    def cached(self) -> Index:
        """The same tables, kept in memory for several queries."""
        return Index(*(getattr(self, f.name).cache() for f in fields(self)[:-1]), workspace_root=self.workspace_root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def violations(index: Index) -> DataFrame:
    """(rule, n): how many rows break each rule of a well-formed index; all 0 in one."""
    symbols, files, modules = (index.symbols.select(F.col("symbol_id").alias("id")), index.files.select(F.col("file_id").alias("id")), index.modules.select(F.col("module_id").alias("id")))

    def missing(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
        return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("id"), "left_anti")

    def repeated(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy(*columns).count().where("count > 1")

    calls = index.edges.where("kind = 'calls'")
    rules = {
        "symbol_id_repeated": repeated(index.symbols, "symbol_id"),
        "fqn_repeated": repeated(index.symbols, "fqn"),
        "path_repeated": repeated(index.files, "path"),
        "edge_repeated": repeated(index.edges, "kind", "src", "dst"),
        "symbol_without_file": missing(index.symbols, "file_id", files),
        "symbol_without_owner": missing(index.symbols, "owner_id", symbols),
        "file_without_module": missing(index.files, "module_id", modules),
        "ref_without_symbol": missing(index.refs, "symbol_id", symbols),
        "ref_without_file": missing(index.refs, "file_id", files),
        "edge_without_src": missing(index.edges, "src", symbols),
        "edge_without_dst": missing(index.edges, "dst", symbols),
        "call_to_itself": calls.where("src = dst"),
        "ends_before_start": index.symbols.where("end_line < line"),
        "dep_without_module": missing(index.module_deps, "dst", modules),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out
