"""The queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_text, jaccard, packing, pii, quality, substrings, topk, toxicity, urls

#: Key of the pseudonyms in the queries; deployments pass their own.
PSEUDONYM_KEY = b"quillspark demonstration key"
#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files(folder: str | None = None) -> tuple[str, str, str]:
    """Vocabulary as JSON, the same as ranks, and the pattern that splits texts."""
    if folder:
        pattern = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(pattern)
        pattern.loader.exec_module(module)
    else:
        import public_tokenizers as module
    return str(module.path("byte_bpe_50k.json")), str(module.path("byte_bpe_50k.tiktoken")), module.PATTERN


def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.coalesce(F.size("pii"), F.lit(0)).alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct("pii.kind"))).alias("kinds"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


OP1_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

OP3_SQL = r"""
WITH rules(rhost, rpath, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
hits AS (SELECT n, max(struct_pack(a := length(rhost || rpath), b := length(rhost), c := rv = 'allow', r := rhost || rpath, v := rv)) AS best
         FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM u LEFT JOIN hits USING (n)
"""


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
y AS (SELECT doc_id, n, i, array_to_string(w[i:i + 49], ' ') AS s FROM x),
z AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM y),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 50)) AS p FROM z WHERE least < doc_id),
word AS (SELECT doc_id, n, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
kept AS (SELECT word.n, count(gone.p) AS n_removed, string_agg(t, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS s FROM word LEFT JOIN gone ON word.n = gone.n AND word.p = gone.p GROUP BY word.n)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (n)
"""


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, n, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, n, len(s) AS size, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.n <> b.n GROUP BY a.n, b.n, a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
r AS (SELECT DISTINCT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.reach)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.reach) AS component_id FROM s LEFT JOIN r ON r.node = s.doc_id GROUP BY s.n, s.doc_id, s.s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_ball_tree_top_k": OP1_SQL, "op3_url_rules": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op7_ngram_jaccard": OP7_SQL}
