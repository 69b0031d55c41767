"""Small code bases as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.schema import DOCUMENT


def sym(fqn: str, name: str, kind: str, signature: str = "", properties: int = 0, parents: tuple = (), overrides: tuple = (), access: str = "public") -> dict:
    return {"fqn": fqn, "display_name": name, "kind": kind, "properties": properties, "signature": signature, "parents": list(parents), "overridden_symbols": list(overrides), "access": access}


def occ(symbol: str, line: int, start: int, end: int, role: str = "Definition") -> dict:
    return {"symbol": symbol, "role": role, "start_line": line, "start_col": start, "end_col": end}


def ref(symbol: str, line: int, start: int, end: int) -> dict:
    return occ(symbol, line, start, end, "Reference")


def doc(uri: str, module: str, symbols: list, occurrences: list) -> dict:
    return {"uri": uri, "module_segments": module, "symbols": symbols, "occurrences": occurrences}


def frame(spark: SparkSession, docs: list[dict]) -> DataFrame:
    schema = StructType([*DOCUMENT.fields, StructField("doc_seq", LongType())])
    return spark.createDataFrame([d | {"doc_seq": k} for k, d in enumerate(docs)], schema)


S, I = "com/example/Service#", "com/example/ServiceImpl#"


def billing() -> list[dict]:
    return [
        doc("modules/billing/src/com/example/Service.scala", "modules.billing", [sym(S, "Service", "trait", "trait Service", 4, ["scala/AnyRef#"]), sym(S + "process().", "process", "method", "def process(): Unit", 4)], [occ(S, 3, 6, 13), occ(S + "process().", 5, 6, 13)]),
        doc(
            "modules/billing/src/com/example/ServiceImpl.scala", "modules.billing",
            [sym(I, "ServiceImpl", "class", "class ServiceImpl extends Service", 0, [S]), sym(I + "process().", "process", "method", "def process(): Unit", 0, (), [S + "process()."]), sym(I + "save().", "save", "method", "def save(): Unit", access="private")],
            [occ(I, 3, 6, 17), occ(I + "process().", 5, 6, 13), occ(I + "save().", 12, 6, 10), ref(I + "save().", 8, 4, 8), ref(S, 6, 10, 17)],
        ),
    ]


def with_generated() -> list[dict]:
    p = "com/example/ServiceProto#"
    made = doc(
        "out/modules/billing/compileScalaPB.dest/com/example/ServiceProto.scala", "modules.billing",
        [sym(p, "ServiceProto", "class", "final class ServiceProto extends Service", 8, [S]), sym(p + "process().", "process", "method", "def process(): Unit", 0, (), [S + "process()."])],
        [occ(p, 5, 6, 18), occ(p + "process().", 7, 6, 13), ref(I + "save().", 9, 4, 8), ref(S, 5, 30, 37)],
    )
    return [*billing(), made]


def nested() -> list[dict]:
    c = "com/example/Component#"
    names = [(c, "Component", "class", 1), (c + "Backend#", "Backend", "class", 3), (c + "Backend#render().", "render", "method", 5)]
    return [doc("modules/app/src/com/example/Component.scala", "modules.app", [sym(f, n, k, f"{k} {n}") for f, n, k, _ in names], [occ(f, line, 6, 15) for f, _, _, line in names])]


A, D, P = "com/example/Animal#", "com/example/Dog#", "com/example/PetStore."


def pets() -> list[dict]:
    """Two modules: a trait with an implementation, and an object that calls it from the other module."""
    return [
        doc("modules/core/src/com/example/Animal.scala", "modules.core", [sym(A, "Animal", "trait", "trait Animal", 4, ["java/lang/Object#"]), sym(A + "speak().", "speak", "method", "abstract method speak: String", 4)], [occ(A, 3, 6, 12), occ(A + "speak().", 4, 6, 11)]),
        doc(
            "modules/core/src/com/example/Dog.scala", "modules.core",
            [sym(D, "Dog", "class", "class Dog extends Animal", 0, [A]), sym(D + "speak().", "speak", "method", "method speak: String", 0, (), [A + "speak()."]), sym(D + "bark().", "bark", "method", "method bark: String")],
            [occ(D, 3, 6, 9), occ(D + "speak().", 5, 6, 11), occ(D + "bark().", 12, 6, 10), ref(D + "bark().", 8, 4, 8), ref(A, 3, 20, 26)],
        ),
        doc(
            "modules/app/src/com/example/PetStore.scala", "modules.app",
            [sym(P, "PetStore", "object", "object PetStore", 8, ["java/lang/Object#"]), sym(P + "adopt().", "adopt", "method", "method adopt: Animal"), sym(P + "name.", "name", "method", "val method name: String", 0x400)],
            [occ(P, 3, 7, 15), occ(P + "adopt().", 5, 6, 11), occ(P + "name.", 10, 6, 10), ref(D + "bark().", 7, 4, 8), ref(A, 5, 15, 21)],
        ),
    ]


def kinds() -> list[dict]:
    rows = [("Config", "class", 0x80), ("Status", "class", 0x4000), ("Direction", "interface", 0x4000), ("Engine", "class", 0)]
    return [doc("modules/core/src/com/example/Types.scala", "modules.core", [sym(f"com/example/{n}#", n, k, f"{k} {n}", p) for n, k, p in rows], [occ(f"com/example/{n}#", 2 + 3 * i, 6, 12) for i, (n, _, _) in enumerate(rows)])]


def overloads() -> list[dict]:
    c, m = "com/example/Converter#", "com/example/Main."
    return [
        doc("src/com/example/Converter.scala", "modules.core", [sym(c, "Converter", "class"), sym(c + "convert().", "convert", "method"), sym(c + "convert(+1).", "convert", "method")], [occ(c, 1, 6, 15), occ(c + "convert().", 2, 6, 13), occ(c + "convert(+1).", 5, 6, 13)]),
        doc("src/com/example/Main.scala", "modules.core", [sym(m, "Main", "object"), sym(m + "run().", "run", "method")], [occ(m, 1, 7, 11), occ(m + "run().", 2, 6, 9), ref(f";{c}convert().;{c}convert(+1).", 3, 20, 27)]),
    ]


def hubs(modules: int = 50) -> list[dict]:
    """A type that every module uses and a method that most call, beside ones that few do."""
    d, u = "com/infra/Database#", "com/infra/Rare#"
    docs = [doc("infra/src/Db.scala", "infra", [sym(d, "Database", "class"), sym(d + "connect().", "connect", "method"), sym(u, "Rare", "class")], [occ(d, 1, 6, 14), occ(d + "connect().", 2, 6, 13), occ(u, 30, 6, 10)])]
    for k in range(modules):
        s = f"com/m{k}/Service{k}#"
        lines = [ref(d, 10 + j, 4, 12) for j in range(8)] + [ref(d + "connect().", 30, 4, 11)] + ([ref(u, 40, 4, 8)] if k < 3 else [])
        docs.append(doc(f"m{k}/src/Service{k}.scala", f"m{k}", [sym(s, f"Service{k}", "class"), sym(s + "run().", "run", "method")], [occ(s, 1, 6, 14), occ(s + "run().", 3, 6, 9), *lines]))
    return docs
