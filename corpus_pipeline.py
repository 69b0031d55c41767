"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote, works on all of it and decides: low quality and all but one of each group of near duplicates
go, documents with benchmark passages go, personal data becomes pseudonyms, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import decontaminate, jaccard, packing, pii, quality
from quillspark.llm.queries import PSEUDONYM_KEY, table, tokenizer_files
from quillspark.llm.scratch import persist_table, sent_if_few


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression selects; it is fitted on labelled documents among those given."""
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id. Rows without doc_id stay.

    Rows that share a doc_id are told apart by their texts: equal and near ones are a group like others, different ones all stay.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not again.take(1):
        found = persist_table(jaccard.near_duplicates(docs), "near-duplicates")
        gone = found.where("component_id < doc_id").select("doc_id").distinct()
        return docs.join(sent_if_few(gone), "doc_id", "left_anti").select(docs.columns)
    # some doc_ids occur more than once, so rows are numbered; the numbers are written before they are used
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = persist_table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = numbered.where("doc_id is not null")
    found = persist_table(jaccard.near_duplicates(known.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id"), "near-duplicates")
    named = found.join(known.select(row, "doc_id"), row)
    kept = named.groupBy("component_id").agg(F.min_by(row, F.struct("doc_id", row)).alias(row)).select(row)
    gone = found.select(row).join(kept, row, "left_anti")
    return numbered.join(sent_if_few(gone), row, "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the text, all other columns stay as they are."""
    finds = "pii"
    while finds in docs.columns:
        finds += "_"
    out = pii.protect(docs, PSEUDONYM_KEY, finds=finds)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(finds) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("benchmark", drop_benchmark),
    ("personal data", hide_persons),
    ("packing", pack),
]

#: Model fitting, alignment, pseudonyms and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persist_table(docs, name.replace(" ", "-"))
    return docs
