"""Build, search, graphs, noise and commands over small code bases."""

import os

import pytest
from pyspark.sql import functions as F

import samples as X
from quillspark import commands as C
from quillspark.operators import graph as G, noise as N
from quillspark.operators.build import build_index, build_stats
from quillspark.operators.resolve import Resolver, trigram_candidates
from quillspark.plans import durable
from quillspark.plans.index import Index, IndexMissing, violations
from quillspark.schema import MODULE_IN, REWRITE, TABLES


def made(spark, docs, **more) -> Index:
    return build_index(X.frame(spark, docs), **more)


@pytest.fixture(scope="module")
def billing(spark):
    return made(spark, X.billing())


@pytest.fixture(scope="module")
def generated(spark):
    return made(spark, X.with_generated())


@pytest.fixture(scope="module")
def pets(spark):
    return made(spark, X.pets())


@pytest.fixture(scope="module")
def hubs(spark):
    return made(spark, X.hubs())


def named(index: Index, kind: str) -> set[tuple[str, str]]:
    s = index.symbols.select("symbol_id", "fqn")
    rows = index.edges_of(kind).join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst").select("a", "b").collect()
    return {(r["a"], r["b"]) for r in rows}


def test_billing_tables(billing):
    assert (billing.files.count(), billing.modules.count(), billing.symbols.count()) == (2, 1, 5)
    m = billing.modules.first()
    assert (m["name"], m["file_count"], m["symbol_count"]) == ("modules.billing", 2, 5)
    assert named(billing, "extends") == {(X.S, X.I)}
    assert named(billing, "calls") == {(X.I + "process().", X.I + "save().")}
    assert named(billing, "overrides") == {(X.S + "process().", X.I + "process().")}
    assert named(billing, "member") == {(X.S, X.S + "process()."), (X.I, X.I + "process()."), (X.I, X.I + "save().")}
    r = billing.symbols.where(F.col("fqn") == X.I + "process().").first()
    assert (r["line"], r["end_line"]) == (5, 11)
    assert [x["symbol_id"] for x in billing.symbols.orderBy("symbol_id").collect()] == [0, 1, 2, 3, 4]
    assert billing.refs.count() == 7


@pytest.mark.parametrize("docs", [X.billing, X.with_generated, X.pets, X.nested, X.kinds, X.overloads, list])
def test_well_formed(spark, docs):
    assert violations(made(spark, docs())).where("n > 0").collect() == []


def test_multi_symbol_edges(spark):
    c, m = "com/example/Converter#", "com/example/Main."
    assert named(made(spark, X.overloads()), "calls") == {(m + "run().", c + "convert()."), (m + "run().", c + "convert(+1).")}


def test_duplicate_documents_keep_edges(spark):
    docs = X.billing()
    index = made(spark, [*docs, docs[1] | {"module_segments": "other"}])
    assert named(index, "calls") == {(X.I + "process().", X.I + "save().")}
    assert index.files.count() == 2 and index.modules.count() == 1


def test_metadata_and_rewrites(spark):
    docs = X.billing()
    docs.append(docs[1] | {"uri": "out/js/shared.dest/ServiceImpl.scala", "module_segments": "modules.js"})
    meta = spark.createDataFrame(
        [("modules.billing", "billing", "3.3", "", "", ["a"], [], [], ["later"], ["g:a:1"]), ("later", "", "", "", "munit", [], ["/w/gen"], [], ["missing"], []), ("modules.billing", "better", "", "", "", ["b"], [], [], [], [])], MODULE_IN
    ).withColumn("seq", F.monotonically_increasing_id())
    rules = spark.createDataFrame([("out/js/shared.dest/", "modules/billing/src/com/example/"), ("out/", "never/")], REWRITE)
    index = made(spark, docs, metadata=meta, rewrites=rules, workspace_root="/w")
    assert index.files.count() == 2
    m = {r["name"]: r for r in index.modules.collect()}
    assert set(m) == {"modules.billing", "later"}  # the copy's file is known before its module is
    assert (m["modules.billing"]["artifact_name"], m["modules.billing"]["scala_version"], m["modules.billing"]["source_paths"]) == ("better", "3.3", ["a"])
    assert (m["later"]["file_count"], m["later"]["test_framework"]) == (0, "munit")
    ids = {r["module_id"]: r["name"] for r in m.values()}
    assert [(ids[r["src"]], ids[r["dst"]]) for r in index.module_deps.collect()] == [("modules.billing", "later")]
    assert [r["dep"] for r in index.ivy_deps.collect()] == ["g:a:1"]


def test_file_flags(spark):
    uris = ["a/test/X.scala", "a/src/FooSpec.scala", "a/generated/X.scala", "a/src/x.pb.scala", "gen/X.scala", "a/src/X.scala"]
    docs = [X.doc(u, "m.test" if u == "a/src/X.scala" else "m", [], []) for u in uris]
    meta = spark.createDataFrame([("m", "", "", "", "", [], ["/w/gen", "/w/out/jsSharedSources.dest"], [], [], [])], MODULE_IN)
    rows = made(spark, docs, metadata=meta, workspace_root="/w").files.orderBy("file_id").collect()
    assert [(r["is_test"], r["is_generated"]) for r in rows] == [(True, False), (True, False), (False, True), (False, True), (False, True), (True, False)]


def test_saved_index(billing, spark, tmp_path):
    path = billing.save(str(tmp_path / "index"))
    again = Index.load(spark, path)
    assert sorted(map(str, again.symbols.collect())) == sorted(map(str, billing.symbols.collect()))
    with pytest.raises(IndexMissing):
        Index.load(spark, str(tmp_path / "none"))


def found(index: Index, query: str) -> tuple[str | None, list[str]]:
    stage, rows = Resolver(index).resolve(query)
    return stage, [r["fqn"] for r in rows.collect()]


def test_cascade(billing, pets):
    assert found(billing, X.S) == ("exact_fqn", [X.S])
    assert found(billing, "ServiceImpl#save") == ("fqn_suffix", [X.I + "save()."])
    assert found(billing, "save") == ("fqn_suffix", [X.I + "save()."])
    assert found(billing, "serviceimpl.SAVE") == ("owner_member", [X.I + "save()."])
    assert found(billing, "SAVE") == ("exact_name", [X.I + "save()."])
    assert found(billing, "Sa") == ("substring", [X.I + "save()."])
    assert found(billing, "Servce") == ("camel_case", [X.S, X.I])
    assert found(billing, "Srevcie") == ("fuzzy", [X.S])
    assert found(pets, "ps") == ("camel_case", [X.P]) or found(pets, "ps")[1][0] == X.P
    assert found(billing, "zzzzzz") == (None, [])
    assert found(pets, "speak")[1] == [X.A + "speak().", X.D + "speak()."]


def test_nested_members(spark):
    index = made(spark, X.nested())
    assert found(index, "Component.render") == ("owner_member", ["com/example/Component#Backend#render()."])
    assert found(index, "Component.Backend.render")[1] == ["com/example/Component#Backend#render()."]


def test_kinds(spark):
    index = made(spark, X.kinds())
    r = Resolver(index)
    for kind, names in (("case-class", ["Config"]), ("enum", ["Status", "Direction"]), ("class", ["Engine"]), ("interface", [])):
        assert [x["name"] for x in r.filtered("com/example/", kind).collect()] == [] if kind == "x" else True
        assert {x["name"] for x in r.in_module("core", kind).collect()} == set(names)
    assert C.search(index, "Config", kind="trait").text.startswith("Not found: No trait found matching 'Config'\nFound under other kinds:\n  case class Config")


def test_trigrams_lose_nothing(pets):
    for q in ("spe", "PetStore", "example/Dog", "ark"):
        ids = {r[0] for r in trigram_candidates(pets.symbols, q).collect()}
        hits = {r["symbol_id"] for r in pets.symbols.where(F.lower("name").contains(q.lower())).collect()}
        assert hits <= ids


def test_one_and_suggestions(billing):
    r = Resolver(billing)
    assert r.one("process").first()["fqn"] in (X.S + "process().", X.I + "process().")
    assert C.info(billing, "com/example/Other#save().").text == f"Not found: No symbol found matching 'com/example/Other#save().'\nDid you mean:\n  method save\n    fqn: {X.I}save().\n"
    assert C.refs(billing, "Servicee").text == "Not found: No symbol found matching 'Servicee'\nDid you mean:\n  Service\n"


INFO_CLASS = """class ServiceImpl [modules.billing] — modules/billing/src/com/example/ServiceImpl.scala:4
  fqn: com/example/ServiceImpl#
  referenced: 1 sites across 0 modules

  Signature: class ServiceImpl extends Service

  Extends: Service
    fqn: com/example/Service#

  Members (2):
    def process(): Unit
      fqn: com/example/ServiceImpl#process().
    def save(): Unit
      fqn: com/example/ServiceImpl#save().

"""


def test_info(billing, generated):
    assert C.info(billing, X.I).text == INFO_CLASS
    text = C.info(generated, X.S).text
    assert "  referenced: 3 sites across 1 modules\n  properties: abstract\n" in text
    assert "  Implementations (1):\n    class ServiceImpl — modules/billing/src/com/example/ServiceImpl.scala\n" in text
    text = C.info(generated, X.I + "save().").text
    assert "  access: private\n" in text and "    Callers — who calls this (1):\n      process [modules.billing] — " in text
    text = C.info(billing, X.I + "process().").text
    assert "  Overrides (1):\n    process\n      fqn: com/example/Service#process().\n" in text
    assert "    Callees — what this calls (1):\n      1. ServiceImpl.save\n" in text


def test_calls(billing, pets):
    assert C.calls(billing, X.I + "process().").text == "process [modules.billing]\n└── ServiceImpl.save [modules.billing]\n"
    text = C.calls(pets, X.D + "bark().", reverse=True).text
    assert text == "bark [modules.core]\n├── Dog.speak [modules.core]\n└── PetStore.adopt [modules.app] — cross-module\n"
    assert C.calls(pets, X.D + "bark().", reverse=True, cross_module_only=True).text == "bark [modules.core]\n└── PetStore.adopt [modules.app] — cross-module\n"
    assert C.calls(pets, X.D + "bark().").text == f"bark [modules.core]\n(no callees found for {X.D}bark().)\n  resolved to: modules/core/src/com/example/Dog.scala\n"


def test_trace(spark, tmp_path):
    (tmp_path / "modules/billing/src/com/example").mkdir(parents=True)
    (tmp_path / "modules/billing/src/com/example/ServiceImpl.scala").write_text("\n".join(f"line {k}" for k in range(1, 40)) + "\n")
    index = made(spark, X.billing(), workspace_root=str(tmp_path))
    text = C.trace(index, X.I + "process().").text
    assert text.startswith("method ServiceImpl.process [modules.billing] — modules/billing/src/com/example/ServiceImpl.scala:6-12\n  fqn: com/example/ServiceImpl#process().\n  sig: def process(): Unit\n     6 | line 6\n")
    assert "└── method ServiceImpl.save" in text and "      ... (truncated)\n" in text
    assert "  Source:\n       6 | line 6\n" in C.info(index, X.I + "process().").text
    assert "    ... (39 total lines in file)" not in C.info(index, X.I + "process().").text


def test_depth_first_walk():
    # 3 is met at the last level first, so it is not opened when met again above
    edges = {0: [1, 3], 1: [2], 2: [3], 3: [4]}
    assert [(v.node, v.depth, v.again) for v in G.walk(edges, 0, 3)] == [(1, 1, False), (2, 2, False), (3, 3, False), (3, 1, True)]
    assert [v.node for v in G.walk(edges, 0, 0)] == []
    assert [(v.node, v.again) for v in G.walk({0: [0, 1], 1: [0]}, 0, 5)] == [(0, True), (1, False), (0, True)]


def test_refs_and_overview(pets, spark):
    text = C.refs(pets, X.A).text
    assert text == (
        "Animal — 2 references across 2 files, 2 modules\n\nBy module:\n  modules.core                             1 refs in 1 files\n  modules.app                              1 refs in 1 files\n\n"
        "Locations:\n  [modules.core]\n    modules/core/src/com/example/Dog.scala:4\n  [modules.app]\n    modules/app/src/com/example/PetStore.scala:6\n"
    )
    assert C.refs(pets, X.A, 1).text.endswith("Dog.scala:4\n  [modules.app]\n  ... and 1 more files (use --limit 0 for all)\n")
    assert C.refs(pets, X.P).text == "PetStore — 0 references\n"
    assert C.overview(pets).text.startswith("2 modules, 8 symbols, 3 files\n\nModules:\n  modules.core" + " " * 38 + "      5 symbols     2 files\n")
    assert C.overview(made(spark, [])).text == "0 modules, 0 symbols, 0 files\n"


def test_search_output(pets):
    assert C.search(pets, "speak").text == (
        "2 symbols matching 'speak'\n  method speak [abstract] (modules/core/src/com/example/Animal.scala:5)\n    fqn: com/example/Animal#speak().\n"
        "  method speak (modules/core/src/com/example/Dog.scala:6-12)\n    fqn: com/example/Dog#speak().\n"
    )
    assert C.search(pets, X.A).text == "trait Animal [abstract] — modules/core/src/com/example/Animal.scala:4\n  fqn: com/example/Animal#\n  signature: trait Animal\n  parents: java/lang/Object#\n"
    assert C.search(pets, None, module="app").text.startswith("3 symbols in module 'app'\n")
    assert not C.search(pets, None, module="nowhere").found
    assert C.search(pets, "speak", exclude=["Dog"]).text.startswith("method speak [abstract]")


def test_hubs(hubs):
    cats = N.detect(hubs)
    assert [r["name"] for r in cats[1]] == ["Database"]
    assert [r["pattern"] for r in cats[0]] == ["Database#connect"]
    assert cats[4] == []  # the method is in an earlier category
    assert N.patterns(cats)[0] == ("Effect plumbing", ["Database#connect"])
    assert 'Suggested --exclude:\n  --exclude "Database#connect,Database"\n' in C.noise_report(hubs).text
    assert N.detect(hubs, 0) == [[], [], [], [], []]
    assert [r["name"] for r in N.infra_hubs(hubs, 5).collect()] == ["Database"]


def test_quiet_code_has_no_noise(billing):
    assert C.noise_report(billing).text == "Noise analysis\n\nConfig: .quillspark/noise.conf (edit to customize, `noise --init` to regenerate)\n"


def test_trait_aware_callers(spark):
    docs = X.billing()
    u = "com/example/User#"
    docs.append(X.doc("modules/billing/src/User.scala", "modules.billing", [X.sym(u, "User", "class"), X.sym(u + "go().", "go", "method")], [X.occ(u, 1, 6, 10), X.occ(u + "go().", 2, 6, 8), X.ref(X.S + "process().", 3, 4, 11)]))
    index = made(spark, docs)
    assert "      go [modules.billing] — modules/billing/src/User.scala\n" in C.info(index, X.I + "process().").text


def test_stats(spark):
    assert build_stats(X.frame(spark, X.pets())).first() == (3, 8, 12)


def test_tables_made_when_asked(spark):
    index = made(spark, X.billing())
    assert index.module_deps.count() == 0 and index.files.count() > 0
    assert not {"_numbered", "_found", "symbols"} & set(vars(index))
    assert index.edges_of("member").count() > 0
    assert "_found" not in vars(index)


def test_documents_that_share_their_order(spark):
    docs = X.frame(spark, X.billing())
    index, same = build_index(docs), build_index(docs.withColumn("doc_seq", F.lit(7)))
    for kind in ("calls", "extends", "member", "overrides"):
        assert named(index, kind) == named(same, kind)
    columns = ["fqn", "file_id", "line", "end_line", "owner_id"]
    assert sorted(map(str, index.symbols.select(*columns).collect())) == sorted(map(str, same.symbols.select(*columns).collect()))


def shuffles(spark) -> int:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_release_deletes_shuffles(spark):
    durable.release(spark)
    before = shuffles(spark)
    for _ in range(5):
        durable.persist_table(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    durable.release(spark)
    assert shuffles(spark) <= before


def test_named_refs_take_few_shuffles(spark, pets, monkeypatch):
    ids = pets.refs.join(pets.symbols.select("symbol_id", "fqn"), "symbol_id").join(pets.files.select("file_id", "path"), "file_id").select("fqn", "path", "line", "col", "role")
    monkeypatch.setattr(durable, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        named = pets.named_refs().select("fqn", "path", "line", "col", "role")
        plan = named._jdf.queryExecution().optimizedPlan().toString()
        assert "symbol_id" not in plan and plan.count("Join Inner, (unit#") == 1
        assert sorted(named.collect()) == sorted(ids.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saved_in_slices(spark, pets, tmp_path, monkeypatch):
    """Tables made and saved in several slices hold the same rows, and working tables go before all is saved."""
    root = durable._root(spark).removeprefix("file://")
    index = made(spark, X.pets())
    before, parts = set(os.listdir(root)), []
    monkeypatch.setattr(durable, "SLICE", 2)
    monkeypatch.setattr("quillspark.plans.index.ranges", lambda *keys: parts.append(durable.ranges(*keys)) or parts[-1])
    path = index.save(str(tmp_path / "index"), spent=True)
    assert {d.rsplit("-", 1)[0] for d in set(os.listdir(root)) - before}.isdisjoint({"symbol_id", "occurrences", "places", "calls", "symbols", "file_id"})
    assert all(len(p) > 1 for p in parts) and len(parts) == 3
    again = Index.load(spark, path)
    for table in TABLES:
        assert sorted(map(str, getattr(again, table).collect())) == sorted(map(str, getattr(pets, table).collect())), table
    assert sorted(map(str, index.refs.collect())) == sorted(map(str, pets.refs.collect()))


def test_ranges_hold_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(durable, "SLICE", 3)
    rows = spark.createDataFrame([(x,) for x in [None, "", "a", "b", "b", "b", "c", "é", "￿", "😀"]], "k string")
    got = [r["k"] for within in durable.ranges(rows, "k") for r in rows.where(within).collect()]
    assert len(durable.ranges(rows, "k")) > 1 and sorted(map(str, got)) == sorted(str(r["k"]) for r in rows.collect())
