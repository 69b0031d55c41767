"""Where build tools keep compiler output, told from paths, and what they know about modules."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import MODULE_IN, REWRITE
from .metadata import json_files, mill_modules, shared_source_rewrites
from .semanticdb import binary_files


@dataclass
class Metadata:
    modules: DataFrame
    rewrites: DataFrame


class BuildProvider(Protocol):
    """What an adapter for a build tool offers. Any object with these methods can be given to ``commands.index``."""

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        """(path, content, module_segments) of compiler output."""

    def metadata(self, spark: SparkSession, root: str, files: DataFrame) -> Metadata | None:
        """What the tool knows about modules, if anything."""


def _relative(root: str):
    return F.expr(f"substring(path, {len(root) + 2})")


def _rows(files: DataFrame, test: str, framework: str, version: str | None = None) -> DataFrame:
    """Module rows from paths alone: the last part of a module's name, whether any file is a test, the first version in a path."""
    found = files.where("module_segments <> ''").groupBy(F.col("module_segments").alias("segments")).agg(
        F.bool_or(F.col("path").rlike(test)).alias("tested"), F.min_by(*(F.nullif(F.regexp_extract("path", version or r"^(?!)()", 1), F.lit("")), F.when(F.col("path").rlike(version or r"^(?!)"), F.col("path")))).alias("v")
    )
    empty = F.array().cast("array<string>")
    known = {"segments": F.col("segments"), "artifact_name": F.element_at(F.split("segments", r"\."), -1), "scala_version": F.coalesce("v", F.lit("")), "test_framework": F.when(F.col("tested"), framework).otherwise("")}
    return found.select(*(known.get(f.name, empty if f.dataType.simpleString() == "array<string>" else F.lit("")).alias(f.name) for f in MODULE_IN.fields))


class Mill:
    #: Folders of compiler output lie at most so deep below ``out``.
    DEPTH = 8

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        out = f"{root}/out"
        if not os.path.isdir(out):
            raise FileNotFoundError(f"No out/ directory found at {root}")
        below = F.expr(f"substring(path, {len(out) + 2})")
        module = F.regexp_extract(below, r"^(?:(.*)/)?semanticDbDataDetailed\.dest/data/META-INF/semanticdb/", 1)
        files = binary_files(spark, out).withColumn("_m", module)
        deep = F.when(F.col("_m") == "", 0).otherwise(F.size(F.split("_m", "/")))
        kept = files.where((below.rlike(r"(?:^|/)semanticDbDataDetailed\.dest/data/META-INF/semanticdb/") & (deep < self.DEPTH)) | below.startswith("META-INF/semanticdb/"))
        return kept.select("path", "content", F.translate("_m", "/", ".").alias("module_segments"))

    def metadata(self, spark: SparkSession, root: str, files: DataFrame) -> Metadata | None:
        out = f"{root}/out"
        place = F.regexp_extract("path", r"^(.*?)/semanticDbDataDetailed\.dest/", 1)
        modules = files.where("module_segments <> ''").select(F.col("module_segments").alias("segments"), place.alias("dir")).distinct()
        rows = mill_modules(json_files(spark, out), modules, out)
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"))
        return Metadata(rows, shared_source_rewrites(rows, listing, root))


class Sbt:
    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        inside = F.concat(F.lit("/"), _relative(root))
        files = binary_files(spark, root).where(inside.rlike(r"/target/(?:.*/)?META-INF/semanticdb/"))
        return files.select("path", "content", F.translate(F.regexp_extract(_relative(root), r"^(.*?)/?(?<=^|/)target/", 1), "/", ".").alias("module_segments"))

    def metadata(self, spark: SparkSession, root: str, files: DataFrame) -> Metadata | None:
        return Metadata(_rows(files.select("path", "module_segments"), "/test-meta/", "sbt-test", r"/scala-([^/]*)/"), spark.createDataFrame([], REWRITE))


def _folders(root: str, name: str) -> list[str]:
    """Folders of that name below a workspace, outermost ones; a listing of names only."""
    found = []
    for at, names, _ in os.walk(root):
        if name in names:
            found.append(os.path.join(at, name))
            names.remove(name)
    return sorted(found)


class ScalaCli:
    FOLDER = ".scala-build"

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        # Spark's listings leave out names that begin with a dot unless they are asked for, so duplicates in .bloop are left out too
        folders = _folders(root, self.FOLDER)
        if not folders:
            return spark.createDataFrame([], "path string, content binary, module_segments string")
        inside = F.concat(F.lit("/"), _relative(root))
        files = binary_files(spark, *folders).where(inside.rlike(r"/META-INF/semanticdb/") & ~inside.contains("/.bloop/"))
        return files.select("path", "content", F.translate(F.regexp_extract(_relative(root), r"^(.*?)/?(?<=^|/)\.scala-build/", 1), "/", ".").alias("module_segments"))

    def metadata(self, spark: SparkSession, root: str, files: DataFrame) -> Metadata | None:
        rows = _rows(files.select("path", "module_segments"), "/classes/test/", "scala-cli-test")
        version = self._version(spark, root)
        folder = F.concat(F.lit(root + "/"), F.translate("segments", ".", "/"))
        real = [s for (s,) in rows.select("segments").collect() if os.path.exists(f"{root}/{s.replace('.', '/')}")]  # one row for each module
        sources = F.when(F.col("segments").isin(real), F.array(folder)).otherwise(F.array().cast("array<string>"))
        return Metadata(rows.withColumn("scala_version", F.lit(version)).withColumn("source_paths", sources), spark.createDataFrame([], REWRITE))

    def _version(self, spark: SparkSession, root: str) -> str:
        folders = [f for f in (os.path.join(d, ".bloop") for d in _folders(root, self.FOLDER)) if os.path.isdir(f)]
        if not folders:
            return ""
        found = json_files(spark, *folders).select("dir", "task", F.try_variant_get("json", "$.project.scala.version", "string").alias("v"))
        first = found.where("v is not null").orderBy("dir", "task").first()
        return first["v"] if first else ""


class Fallback:
    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        return binary_files(spark, root).where(F.concat(F.lit("/"), _relative(root)).contains("/semanticdb/")).select("path", "content", F.lit("").alias("module_segments"))

    def metadata(self, spark: SparkSession, root: str, files: DataFrame) -> Metadata | None:
        return None


def detect(root: str) -> BuildProvider:
    """The adapter for a workspace, by the files that build tools have there."""

    def there(*names: str) -> bool:
        return any(os.path.exists(os.path.join(root, *n.split("/"))) for n in names)

    if there("build.mill", "build.mill.scala", "build.sc"):
        return Mill()
    if there("build.sbt", "project/build.properties"):
        return Sbt()
    if there(".scala-build") or any(e.is_dir() and os.path.exists(os.path.join(e.path, ".scala-build")) for e in os.scandir(root)):
        return ScalaCli()
    return Fallback()
