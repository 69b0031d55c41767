"""Compiler output, signatures, providers and build metadata."""

import json

from pyspark.sql import functions as F

from quillspark import commands as C
from quillspark.sources import metadata as M, noise_conf, providers, semanticdb
from quillspark.sources.signatures import Printer
from quillspark.sources.wire import KIND_OF, MESSAGES

KIND = {v: k for k, v in KIND_OF.items()}


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def encode(message: str, value: dict) -> bytes:
    import struct

    out = b""
    for number, (name, kind) in MESSAGES[message].items():
        if name not in value:
            continue
        for v in value[name] if kind.endswith("*") else [value[name]]:
            k = kind.rstrip("*")
            if k in "ilb":
                out += varint(number << 3) + varint(int(v))
            elif k in "fd":
                out += varint(number << 3 | (5 if k == "f" else 1)) + struct.pack("<f" if k == "f" else "<d", v)
            else:
                data = v.encode() if k == "s" else encode(k, v)
                out += varint(number << 3 | 2) + varint(len(data)) + data
    return out


def ref(symbol: str, *args: dict, prefix: dict | None = None) -> dict:
    out = {"symbol": symbol}
    if args:
        out["type_arguments"] = list(args)
    if prefix:
        out["prefix"] = prefix
    return {"ref": out}


INT, TEXT = ref("scala/Int#"), ref("scala/Predef.String#")


def show(info: dict, known: dict | None = None) -> str:
    return Printer(known or {}).title(info)


def test_titles():
    assert show({"kind": KIND["method"], "properties": 0x400, "display_name": "rootDirName", "signature": {"value": {"tpe": TEXT}}}) == "val method rootDirName: String"
    assert show({"kind": KIND["method"], "display_name": "keySpace", "signature": {"value": {"tpe": ref("com/example/KeySpace#")}}}) == "method keySpace: KeySpace"
    assert show({"kind": KIND["method"], "display_name": "process", "signature": {"method": {"return_type": ref("scala/Unit#")}}}) == "method process: Unit"
    assert show({"kind": KIND["field"], "display_name": "count", "signature": {"value": {"tpe": INT}}}) == "field count: Int"
    cls = {"kind": KIND["class"], "properties": 0x88, "display_name": "C", "signature": {"class": {"type_parameters": {"symlinks": ["c#[T]"]}, "parents": [ref("a/P#"), ref("a/Q#", TEXT)], "declarations": {"symlinks": ["x", "y"]}, "self": ref("a/S#")}}}
    known = {"c#[T]": {"kind": KIND["typeparameter"], "properties": 0x100, "display_name": "T", "signature": {"type": {"lower_bound": ref("scala/Nothing#"), "upper_bound": ref("a/Up#")}}}}
    assert show(cls, known) == "final case class C[+T <: Up] extends P with Q[String] { self: S => +2 decls }"
    meth = {"kind": KIND["method"], "display_name": "m", "signature": {"method": {"parameter_lists": [{"hardlinks": [{"kind": KIND["parameter"], "display_name": "x", "signature": {"value": {"tpe": {"by_name": {"tpe": INT}}}}}]}, {}], "return_type": TEXT}}}
    assert show(meth) == "method m(x: => Int)(): String"
    assert show({"kind": KIND["type"], "display_name": "A", "signature": {"type": {"lower_bound": INT, "upper_bound": INT}}}) == "type A = Int"
    assert show({"kind": 99, "display_name": ""}) == "unknown <?>"


def test_types():
    p = Printer({})
    cases = {
        "x.type": {"single": {"symbol": "a/x."}},
        "C.this.type": {"this": {"symbol": "a/C#"}},
        "super[M].type": {"super": {"symbol": "a/M#"}},
        "x.T": ref("a/T#", prefix={"single": {"symbol": "a/x."}}),
        "A#T": ref("a/T#", prefix=ref("a/A#")),
        "Int & String": {"intersection": {"types": [INT, TEXT]}},
        "Int | String": {"union": {"types": [INT, TEXT]}},
        "Int with String": {"with": {"types": [INT, TEXT]}},
        "Int*": {"repeated": {"tpe": INT}},
        "Int {}": {"structural": {"tpe": INT}},
        "Int @ann": {"annotated": {"tpe": INT, "annotations": [{"tpe": ref("a/ann#")}]}},
        "Int match { Int => String }": {"match": {"scrutinee": INT, "cases": [{"key": INT, "body": TEXT}]}},
        "[X] =>> Int": {"lambda": {"tpe": INT, "declarations": {"hardlinks": [{"kind": KIND["typeparameter"], "display_name": "X"}]}}},
        "[X] => Int": {"universal": {"tpe": INT, "declarations": {"hardlinks": [{"kind": KIND["typeparameter"], "display_name": "X"}]}}},
        "Int forSome { type X }": {"existential": {"tpe": INT, "declarations": {"hardlinks": [{"kind": KIND["type"], "display_name": "X"}]}}},
        "5L": {"constant": {"constant": {"long": {"value": 5}}}},
        "'a'": {"constant": {"constant": {"char": {"value": 97}}}},
        "-1": {"constant": {"constant": {"byte": {"value": 255}}}},
        "1.5f": {"constant": {"constant": {"float": {"value": 1.5}}}},
        "2": {"constant": {"constant": {"double": {"value": 2.0}}}},
        '"hi"': {"constant": {"constant": {"string": {"value": "hi"}}}},
        "true": {"constant": {"constant": {"boolean": {"value": True}}}},
        "null": {"constant": {"constant": {"null": {}}}},
        "()": {"constant": {"constant": {"unit": {}}}},
    }
    for want, t in cases.items():
        assert p.type(t) == want


FILE = {
    "documents": [
        {
            "uri": "src/A.scala",
            "symbols": [{"symbol": "a/A#", "kind": KIND["class"], "display_name": "A", "properties": 8, "access": {"privatewithin": {}}, "signature": {"class": {"parents": [ref("a/P#"), {"annotated": {"tpe": ref("a/Q#")}}, {"union": {"types": [INT]}}]}}, "overridden_symbols": ["x", "y"]}],
            "occurrences": [{"symbol": "a/A#", "role": 2, "range": {"start_line": 3, "start_character": 4, "end_line": 3, "end_character": 9}}, {"symbol": "b", "role": 7}],
        },
        {"uri": ""},
    ]
}


def test_decode():
    (d,) = semanticdb.decode(encode("TextDocuments", FILE), "m")
    (s,) = d["symbols"]
    assert (s["kind"], s["parents"], s["access"], s["overridden_symbols"], s["properties"]) == ("class", ["a/P#", "a/Q#"], "privatewithin", ["x", "y"], 8)
    assert d["occurrences"][0] == {"symbol": "a/A#", "role": "Definition", "start_line": 3, "start_col": 4, "end_col": 9}
    assert d["occurrences"][1]["role"] == "Unknown" and d["occurrences"][1]["start_line"] == 0


def write(path, data=b"\n") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def found(spark, provider, root) -> set:
    return {(r["path"].removeprefix(str(root) + "/"), r["module_segments"]) for r in provider.discover(spark, str(root)).select("path", "module_segments").collect()}


def test_detect(tmp_path):
    assert isinstance(providers.detect(str(tmp_path)), providers.Fallback)
    write(tmp_path / "app/.scala-build/x")
    assert isinstance(providers.detect(str(tmp_path)), providers.ScalaCli)
    write(tmp_path / "project/build.properties")
    assert isinstance(providers.detect(str(tmp_path)), providers.Sbt)
    write(tmp_path / "build.sc")
    assert isinstance(providers.detect(str(tmp_path)), providers.Mill)


def test_sbt(spark, tmp_path):
    write(tmp_path / "tests/unit/target/scala-2.13/meta/META-INF/semanticdb/A.scala.semanticdb", encode("TextDocuments", FILE))
    write(tmp_path / "foo/target/scala-3.3/test-meta/META-INF/semanticdb/B.scala.SemanticDB", encode("TextDocuments", FILE))
    write(tmp_path / "target/scala-3.3/meta/META-INF/semanticdb/C.scala.semanticdb")
    write(tmp_path / "other/META-INF/semanticdb/D.scala.semanticdb")
    p = providers.Sbt()
    assert {m for _, m in found(spark, p, tmp_path)} == {"tests.unit", "foo", ""}
    rows = {r["segments"]: r for r in p.metadata(spark, str(tmp_path), p.discover(spark, str(tmp_path))).modules.collect()}
    assert (rows["foo"]["test_framework"], rows["foo"]["scala_version"]) == ("sbt-test", "3.3")
    assert (rows["tests.unit"]["artifact_name"], rows["tests.unit"]["test_framework"], rows["tests.unit"]["scala_version"]) == ("unit", "", "2.13")


def test_scala_cli(spark, tmp_path):
    write(tmp_path / "src/.scala-build/h/classes/main/META-INF/semanticdb/A.scala.semanticdb")
    write(tmp_path / "src/.scala-build/h/classes/test/META-INF/semanticdb/B.scala.semanticdb")
    write(tmp_path / "src/.scala-build/.bloop/h/META-INF/semanticdb/A.scala.semanticdb")
    write(tmp_path / "src/.scala-build/.bloop/p.json", json.dumps({"project": {"scala": {"version": "3.6.4"}}}))
    p = providers.ScalaCli()
    assert {m for _, m in found(spark, p, tmp_path)} == {"src"}
    (row,) = p.metadata(spark, str(tmp_path), p.discover(spark, str(tmp_path))).modules.collect()
    assert (row["scala_version"], row["test_framework"], row["source_paths"]) == ("3.6.4", "scala-cli-test", [f"{tmp_path}/src"])


def mill(root) -> None:
    out = root / "out"
    write(root / "build.mill")
    for module, name in (("core/jvm", "A"), ("core/js", "A"), ("app", "B")):
        write(out / module / f"semanticDbDataDetailed.dest/data/META-INF/semanticdb/{name}.scala.semanticdb", encode("TextDocuments", FILE))
    write(out / "META-INF/semanticdb/Z.scala.semanticdb", encode("TextDocuments", FILE))
    write(root / "core/shared/A.scala", "class A")
    write(out / "core/js/jsSharedSources.dest/A.scala", "class A")
    value = lambda v: json.dumps({"value": v})
    write(out / "core/jvm/sources.json", value([f"ref:v0:abc:{root}/core/shared"]))
    write(out / "core/js/generatedSources.json", value([f"qref:v1:abc:{out}/core/js/jsSharedSources.dest".removeprefix("q").replace("ref:v1", "ref:v0")]))
    write(out / "core/jvm/artifactName.json", value("core"))
    write(out / "core/jvm/scalacOptions.json", value(["-a", 5, "-b"]))
    write(out / "core/jvm/mainClass.json", value(7))
    write(out / "app/mvnDeps.json", "not json")
    write(out / "app/resolvedMvnDeps.json", value(["qref:v1:h:/c/maven2/org/typelevel/cats_3/2.9/cats_3-2.9.jar", "qref:v1:h:/c/artifactory/repo/a/b/c/1/c-1.jar", "qref:v1:h:/nowhere/x.jar"]))
    write(out / "app/upstreamCompileOutput.json", value([{"analysisFile": f"{out}/core/jvm/compile.dest/zinc"}, {"analysisFile": "/elsewhere/zinc"}, {}]))


def test_mill(spark, tmp_path):
    mill(tmp_path)
    p = providers.Mill()
    assert {m for _, m in found(spark, p, tmp_path)} == {"core.jvm", "core.js", "app", ""}
    meta = p.metadata(spark, str(tmp_path), p.discover(spark, str(tmp_path)))
    rows = {r["segments"]: r for r in meta.modules.collect()}
    assert (rows["core.jvm"]["artifact_name"], rows["core.jvm"]["scalac_options"], rows["core.jvm"]["main_class"]) == ("core", ["-a", "-b"], "")
    assert rows["core.jvm"]["source_paths"] == [f"{tmp_path}/core/shared"]
    assert rows["app"]["ivy_deps"] == ["a.b:c:1", "org.typelevel:cats_3:2.9"]
    assert rows["app"]["module_deps"] == ["core.jvm"]
    assert [tuple(r) for r in meta.rewrites.collect()] == [("out/core/js/jsSharedSources.dest/", "core/shared/")]


def test_whole_workspace(spark, tmp_path):
    mill(tmp_path)
    write(tmp_path / "out/app/semanticDbDataDetailed.dest/data/META-INF/semanticdb/bad.semanticdb", b"\xff\xff\xff\xff")
    path = C.build(spark, str(tmp_path))
    text = C.run(spark, ["--idx", path, "search", "A"])
    assert text.startswith("class A [final] — src/A.scala:4\n  fqn: a/A#\n  signature: final class A extends P with Q with Int\n"), text
    assert C.run(spark, ["--idx", path, "overview"]).startswith("3 modules, 1 symbols, 1 files\n")
    assert (tmp_path / ".quillspark/noise.conf").exists()
    (tmp_path / ".quillspark/noise.conf").write_text("# mine\n\n A# \n")
    assert noise_conf.read(str(tmp_path / ".quillspark")) == ["A#"]
    assert C.run(spark, ["--idx", path, "search", "A"]).startswith("Not found: No symbol found matching 'A'")
    assert C.run(spark, ["--idx", path, "search", "A", "--include-noise"]).startswith("class A")
    assert C.run(spark, ["--idx", str(tmp_path / "no"), "overview"]).startswith("Index not found")


def test_fallback(spark, tmp_path):
    write(tmp_path / "x/META-INF/semanticdb/A.semanticdb")
    write(tmp_path / "y/A.semanticdb")
    assert found(spark, providers.Fallback(), tmp_path) == {("x/META-INF/semanticdb/A.semanticdb", "")}


def test_noise_conf(tmp_path):
    assert noise_conf.read(str(tmp_path)) is None
    noise_conf.write(str(tmp_path), [("Hub utilities", ["A", "B"])])
    assert noise_conf.read(str(tmp_path)) == ["A", "B"]
    noise_conf.write(str(tmp_path), [])
    assert noise_conf.read(str(tmp_path)) == []


def test_division(spark):
    made = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "made string, name string")
    held = spark.createDataFrame([("h", "x"), ("h", "z"), ("k", "x"), ("k", "y")], "held string, name string")
    assert {tuple(r) for r in M.divided(made, held).collect()} == {("a", "k"), ("b", "h"), ("b", "k")}


def test_coordinates(spark):
    (c,) = spark.range(1).select(M.coordinate(F.lit("qref:v1:h:/c/maven2/org/x/art/1.0/art-1.0.jar"))).first()
    assert c == "org.x:art:1.0"
