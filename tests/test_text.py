"""Names, scores and predicates against plain models."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scorers as S, text as T
from quillspark.operators import predicates as P

FQNS = {
    "scala/Option#get().": ("scala/Option#", "get"),
    "scala/Option#": ("scala/", "Option"),
    "scala/": ("", "scala"),
    "local0": ("", "local0"),
    "": ("", ""),
    "scala/Predef.println(+1).": ("scala/Predef.", "println"),
    "a/B#c().(x)": ("a/B#c().", "x"),
    "a/B.c.": ("a/B.", "c"),
    "a/B#[T]": ("a/B#", "[T]"),
}


def test_owner_and_display_name(spark):
    rows = spark.createDataFrame([(f,) for f in FQNS], "f string").select("f", T.symbol_owner("f").alias("o"), T.symbol_display_name("f").alias("d")).collect()
    got = {r["f"]: (r["o"], r["d"]) for r in rows}
    del got["a/B#c().(x)"]  # parameters: the owner is the method
    for f, want in got.items():
        assert want == FQNS[f], f
    (o,) = spark.range(1).select(T.symbol_owner(F.lit("a/B#c().(x)"))).first()
    assert o == "a/B#c()."


def test_terminal_name(spark):
    cases = {"com/example/Service#process().": "process", "com/example/Service#process(Ljava/lang/String;).": "process", "com/example/Service#": "", "com/example/Service.": "Service", "a/B.c().": "B.c"}
    rows = spark.createDataFrame(list(cases.items()), "f string, w string").select("w", T.terminal_name("f").alias("g")).collect()
    assert all(r["w"] == r["g"] for r in rows), rows


NAMES = ["HTMLParser", "getHTTPResponse", "Room2Go", "my_Func", "UserProfile", "a", "", "ABC", "x1y", "v2Beta10", "__a__B"]


def test_camel_segments_agree(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", T.camel_segments("n").alias("s")).collect()
    for r in rows:
        assert r["s"] == S.segments(r["n"])
    assert S.segments("getHTTPResponse") == ["get", "http", "response"]
    assert S.segments("Room2Go") == ["room", "2", "go"]
    assert S.segments("HTMLParser") == ["html", "parser"]


def _osa(a: bytes, b: bytes) -> int:
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=8), st.text("abcé", max_size=8))
def test_edit_distance(a, b):
    assert S.edit_distance(a, b) == _osa(a.encode(), b.encode())


def test_edit_distance_known():
    assert S.edit_distance("ab", "ba") == 1
    assert S.edit_distance("ca", "abc") == 3
    assert [S.max_edits(n) for n in (0, 2, 3, 5, 6, 9, 30)] == [0, 0, 1, 1, 2, 3, 5]


def test_camel_scores():
    assert S.camel_score("hcf", "HttpClientFactory") == 100
    assert S.camel_score("hf", "HttpClientFactory") == 101
    assert S.camel_score("UserService", "UserProfileService") == 50
    assert S.camel_score("UserService", "UserService") == 0
    assert S.camel_score("UsSe", "UserService") == 20
    assert S.camel_score("UserServive", "UserService") == 20
    assert S.camel_score("Order", "UserService") is None
    assert S.subsequence_score("lpfuse", "linkProfileForUser") is not None
    assert S.subsequence_score("zz", "linkProfileForUser") is None
    assert S.subsequence_score("a", "abc") is None


def test_collapse():
    assert S.collapse(["prefixOne", "prefixTwo", "prefixThree", "x"]) == ["prefix", "x"]
    assert S.collapse(["prefixOne", "prefixTwo", "x"]) == ["prefixOne", "prefixTwo", "x"]
    assert S.collapse([]) == []
    assert len(S.collapse([f"{k:02d}" for k in range(30)])) == 20


@pytest.mark.parametrize(
    "name, pattern, want",
    [
        ("modules.billing.billing.js", "billing.js", True), ("modules.billing.billing-jvm", "billing.js", False), ("modules.billing", "BILL", True), ("modules.billing", "...", True),
        ("a.b.c", "c.a", False), ("a.b.c", "a.c", True), ("ab", "a.b", False), ("a.b", ".b.", True), ("x.a+b.c", "a+b.c", True),
    ],
)
def test_module_names(spark, name, pattern, want):
    assert spark.range(1).select(P.module_name_matches(F.lit(name), pattern)).first()[0] is want


def test_module_names_random(spark):
    rng = random.Random(4)

    def model(name: str, pattern: str) -> bool:
        rest = iter(name.split("."))
        return all(any(p in s for s in rest) for p in pattern.split(".") if p)

    names = [".".join("".join(rng.choice("ab") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for pattern in ("a.b", "ab.a", "a.a.b", "b..a", "bb.b"):
        rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.module_name_matches("n", pattern).alias("m")).collect()
        assert [r["m"] for r in rows] == [model(r["n"], pattern) for r in rows]


def test_hash_and_trigrams(spark):
    (h, i, g, none) = spark.range(1).select(T.name_hash(F.lit("Abc"), 1000), T.name_hash(F.lit("Abc"), 1000, True), T.trigrams(F.lit("AbcAbc")), T.trigrams(F.lit("ab"))).first()
    assert h == (65 * 961 + 98 * 31 + 99) % 1000 and i == (97 * 961 + 98 * 31 + 99) % 1000
    assert g == ["abc", "bca", "cab"] and none == []


def test_sql_functions(spark):
    S.register(spark)
    assert spark.sql("SELECT osa_distance('ab', 'ba'), camel_score('hcf', 'HttpClientFactory'), subsequence_score('zz', 'abc')").first() == (1, 100, None)
