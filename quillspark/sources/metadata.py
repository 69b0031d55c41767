"""Build metadata: cached JSON of a build tool as module rows, and copies of shared sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip_path_ref
from ..schema import MODULE_IN

# Names of the cached results that describe a module.
TEXTS = {"artifact_name": "artifactName", "scala_version": "scalaVersion", "main_class": "mainClass", "test_framework": "testFramework"}
LISTS = {"scalac_options": "scalacOptions", "source_paths": "sources", "generated_source_paths": "generatedSources", "direct_deps": "mvnDeps", "resolved_deps": "resolvedMvnDeps"}
UPSTREAM = "upstreamCompileOutput"


def json_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(dir, task, json) of all JSON files below folders; files that are no JSON have a null."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(list(folders))
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    return raw.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, r"([^/]*)\.json$", 1).alias("task"), F.try_parse_json("value").alias("json"))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def text_value(json: Column) -> Column:
    """``.value`` if that is text, else empty."""
    value = F.try_variant_get(json, "$.value", "variant")
    return F.coalesce(F.when(_is_text(value), F.try_variant_get(json, "$.value", "string")), F.lit(""))


def list_value(json: Column) -> Column:
    """The texts in ``.value`` if that is a list, else none."""
    items = F.try_variant_get(json, "$.value", "array<variant>")
    return F.coalesce(F.transform(F.filter(items, _is_text), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def coordinate(entry: Column) -> Column:
    """``group:artifact:version`` of a cached jar's path below ``maven2`` or ``artifactory/<repository>``; null for other paths."""
    parts = F.split(F.element_at(F.split(entry, ":"), -1), "/")
    n = F.size(parts)
    spot = F.transform(parts, lambda p, i: F.when(p == "maven2", i + 1).when(p == "artifactory", i + 2))
    start = F.element_at(F.filter(F.concat(spot, F.array(F.lit(None).cast("int"))), lambda x: x.isNotNull()), 1)
    made = F.concat_ws(":", F.concat_ws(".", F.slice(parts, start + 1, F.greatest(n - 3 - start, F.lit(0)))), F.element_at(parts, -3), F.element_at(parts, -2))
    return F.when((n >= 4) & start.isNotNull() & (start < n - 3), made)


def _first_or_null(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def mill_modules(jsons: DataFrame, modules: DataFrame, out_dir: str) -> DataFrame:
    """Module rows (``schema.MODULE_IN``) of modules (segments, dir) from the JSON files in their folders."""
    here = jsons.join(modules.select("segments", "dir"), "dir")
    text = {c: F.coalesce(F.max(F.when(F.col("task") == t, text_value(F.col("json")))), F.lit("")) for c, t in TEXTS.items()}
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.max(F.when(F.col("task") == t, list_value(F.col("json")))), empty) for c, t in LISTS.items()}
    facts = here.groupBy("segments").agg(*(v.alias(k) for k, v in (text | lists).items()))
    for c in ("source_paths", "generated_source_paths"):
        facts = facts.withColumn(c, F.transform(c, strip_path_ref))
    resolved = F.array_sort(F.array_distinct(F.filter(F.transform("resolved_deps", coordinate), lambda x: x.isNotNull())))
    facts = facts.withColumn("ivy_deps", F.when(F.size("direct_deps") > 0, F.col("direct_deps")).otherwise(resolved))
    return modules.select("segments").join(facts, "segments", "left").join(_upstream(here, modules, out_dir), "segments", "left").select(
        *(F.coalesce(F.col(f.name), empty if f.dataType.simpleString() == "array<string>" else F.lit("")).alias(f.name) for f in MODULE_IN.fields)
    )


def _upstream(here: DataFrame, modules: DataFrame, out_dir: str) -> DataFrame:
    """(segments, module_deps): modules whose compile output a module reads, in order."""
    entries = F.try_variant_get("json", "$.value", "array<variant>")
    rows = here.where(F.col("task") == UPSTREAM).select("segments", F.posexplode(entries).alias("at", "entry"))
    path = F.try_variant_get("entry", "$.analysisFile", "string")
    rows = rows.withColumn("dir", F.when(path.startswith(out_dir + "/"), F.regexp_extract(path, r"^(.+)/[^/]+/[^/]+$", 1)))
    named = rows.join(modules.select("dir", F.col("segments").alias("dep")), "dir")
    return named.groupBy("segments").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dep"))), lambda x: x["dep"]).alias("module_deps"))


def divided(made: DataFrame, held: DataFrame) -> DataFrame:
    """(made, held): pairs where every name of ``made`` (made, name) is also one of ``held`` (held, name)."""
    made, held = made.distinct(), held.distinct()
    total = made.groupBy("made").agg(F.count("*").alias("n"))
    common = made.join(held, "name").groupBy("made", "held").agg(F.count("*").alias("m"))
    return common.join(total, "made").where("m = n").select("made", "held")


def shared_source_rewrites(modules: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """(from, to) prefixes for generated folders below ``out`` whose files all are in a hand-written source folder too. listing: path of all files."""
    out_dir = f"{root}/out"
    generated = modules.select(F.explode("generated_source_paths").alias("made")).where(F.col("made").startswith(out_dir + "/")).distinct()
    canonical = modules.select(F.explode("source_paths").alias("held")).where(~(F.col("held").startswith(out_dir + "/") | (F.col("held") == out_dir))).distinct()
    folder = listing.withColumn("up", F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), k -> concat_ws('/', slice(split(path, '/'), 1, k)))")))
    named = folder.select("up", F.expr("substring(path, length(up) + 2)").alias("name"))
    pairs = divided(generated.join(named, F.col("made") == F.col("up")).select("made", "name"), canonical.join(named, F.col("held") == F.col("up")).select("held", "name"))

    def relative(c: str) -> Column:
        return F.concat(F.when(F.col(c).startswith(root + "/"), F.expr(f"substring({c}, {len(root) + 2})")).otherwise(F.col(c)), F.lit("/"))

    return pairs.select(relative("made").alias("from"), relative("held").alias("to")).distinct()
