"""Compiler output files as documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import DOCUMENT
from .signatures import Printer, kind_of, parents
from .wire import ROLE_OF, read


def _document(doc: dict, module: str) -> dict:
    infos = doc.get("symbols", [])
    printer = Printer({i.get("symbol", ""): i for i in infos})
    symbols = [
        {
            "fqn": i.get("symbol", ""),
            "display_name": i.get("display_name", ""),
            "kind": kind_of(i),
            "properties": i.get("properties", 0),
            "signature": printer.title(i),
            "parents": parents(i),
            "overridden_symbols": i.get("overridden_symbols", []),
            "access": next(iter(i.get("access", {})), "public"),
        }
        for i in infos
    ]
    occurrences = []
    for o in doc.get("occurrences", []):
        at = o.get("range", {})
        occurrences.append({"symbol": o.get("symbol", ""), "role": ROLE_OF.get(o.get("role", 0), "Unknown"), "start_line": at.get("start_line", 0), "start_col": at.get("start_character", 0), "end_col": at.get("end_character", 0)})
    return {"uri": doc["uri"], "module_segments": module, "symbols": symbols, "occurrences": occurrences}


def decode(data: bytes, module: str = "") -> list[dict]:
    """Documents of one file; those without uri are left out. Raises ValueError for bytes that are no such file."""
    return [_document(d, module) for d in read("TextDocuments", data).get("documents", []) if d.get("uri")]


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of files (content, module_segments), with an ``error`` column: files that cannot be decoded give one row with only that.

    A pass over whole files; bad files never fail the job. Split the result with :func:`good` and :func:`failures`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data, module in zip(batch["content"], batch["module_segments"], strict=True):
                try:
                    rows += [d | {"error": None} for d in decode(bytes(data), module or "")]
                except (ValueError, RecursionError) as error:
                    rows.append({"uri": None, "module_segments": module, "symbols": [], "occurrences": [], "error": str(error)[:200] or "error"})
            yield pd.DataFrame(rows, columns=[*DOCUMENT.names, "error"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT.fields) + ", error string"
    return files.select("content", "module_segments").mapInPandas(run, schema)


def good(documents: DataFrame) -> DataFrame:
    return documents.where("error is null").drop("error")


def failures(documents: DataFrame) -> int:
    return documents.where("error is not null").count()


def binary_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, content) of all compiler output files below folders, whatever the case of their ending. Folders whose names begin with a dot are read only if given."""
    glob = "*.[sS][eE][mM][aA][nN][tT][iI][cC][dD][bB]"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(roots)).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")
