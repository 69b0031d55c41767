"""The pipeline against its stages by brute force, and the queries with SQL against DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, pii, queries
from test_operators import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    kept = one(spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF, "labels").collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert np.mean([(i in ids) == bool(q) for i, q in labels.items()]) > 0.95
    single = two(spark, kept, SF).cache()
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in single.collect()} == {i for i, _, c in brute_components(rows) if c == i}
    clean = three(spark, single, SF).cache()
    leaks = {r["doc_id"] for r in decontaminate.matches(single, queries.table(spark, SF, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaks
    safe = four(spark, clean, SF)
    want = {r["doc_id"]: pii.pseudonymise(r["text"], queries.PSEUDONYM_KEY)[0] for r in clean.collect()}
    assert {r["doc_id"]: r["text"] for r in safe.collect()} == want and safe.columns == docs.columns
    packed = five(spark, safe, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(want)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, packed.drop("sequence_id", "offset").collect()))


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (None, "x y", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], queries.table(spark, SF, "documents").schema)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).collect()


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: each stage's rows by its operator's own model."""
    leak = "the one sentence of a benchmark that nobody should learn from in training at all today"
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [
        (1, "call +1 (706) 555-5481 " + "plain words " * 9, "en", "s", 99, "mine"), (1, "call +1 (706) 555-5481 " + "plain words " * 9, "en", "t", 99, "mine"), (1, "something else under the same id entirely", "en", "s", 9, None),
        (None, "x y", None, None, None, "n"), (None, None, None, None, None, None), (2, None, "en", "s", 0, ""), (2, "", "en", "s", 0, ""), (3, long, "en", "s", len(long), "z"), (4, long + " end", "en", "s", len(long) + 4, "z"),
        (5, f"before {leak} after", "en", "s", 7, "b"), (6, leak.upper(), "de", "s", 7, "b"), (7, "   ", "en", None, 3, "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, pii string"
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, schema).withColumn("_row", F.lit(8)).withColumn("gram", F.lit("g")).repartition(3)
    spark.createDataFrame([(i, int(i != 7), 0) for i in (1, 2, 3, 7, 99)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    key = lambda r: (str(r["doc_id"]), str(r["text"])[:40])
    quality, near, benchmark, personal, packing = (f for _, f in corpus_pipeline.STAGES)
    assert quality(spark, docs, folder).columns == docs.columns
    kept = near(spark, docs, folder)
    assert kept.columns == docs.columns
    left = sorted(map(key, kept.collect()))
    want = [r for k, r in enumerate(rows) if k not in (1, 8, 10)]  # the repeated row and near copies: 12 of 14 runs are those of row 9
    assert left == sorted((str(r[0]), str(r[1])[:40]) for r in want)
    assert sorted(map(key, benchmark(spark, docs, folder).collect())) == sorted((str(r[0]), str(r[1])[:40]) for r in rows if r[0] not in (5, 6))
    safe = personal(spark, docs, folder)
    assert safe.columns == docs.columns and sorted(str(r["pii"]) for r in safe.collect()) == sorted(str(r[5]) for r in rows)
    texts = [pii.pseudonymise(r[1], queries.PSEUDONYM_KEY)[0] if r[1] else r[1] for r in rows]
    assert sorted(map(str, (r["text"] for r in safe.collect()))) == sorted(map(str, texts)) and "706" not in texts[0]
    pieces = packing(spark, docs, folder).collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(rows)
    run = corpus_pipeline.run(spark, folder).collect()
    assert {"sequence_id", "offset"} <= set(run[0].asDict()) and not {5, 6} & {r["doc_id"] for r in run}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF).toPandas()
    want = db.execute(queries.oracle_sql()[name]).df()
    plain = lambda df: sorted(str([None if x != x or x is None else str(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_all_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries()
