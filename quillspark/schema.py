"""Schemas and fixed values of the code model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# Property bits of a symbol.
PROPERTIES = {
    "abstract": 0x4,
    "final": 0x8,
    "sealed": 0x10,
    "implicit": 0x20,
    "lazy": 0x40,
    "case": 0x80,
    "covariant": 0x100,
    "contravariant": 0x200,
    "val": 0x400,
    "var": 0x800,
    "static": 0x1000,
    "primary": 0x2000,
    "enum": 0x4000,
    "default": 0x8000,
    "given": 0x10000,
    "inline": 0x20000,
    "open": 0x40000,
    "transparent": 0x80000,
    "infix": 0x100000,
    "opaque": 0x200000,
    "override": 0x400000,
}
# Properties that are shown, in this order.
SHOWN_PROPERTIES = "abstract final sealed implicit lazy val var static primary default given inline open transparent infix opaque override".split()
# Kinds of symbols.
KINDS = "class trait object method field type constructor parameter typeparameter package packageobject macro local interface selfparameter unknown".split()

CASE, ENUM, VAL, VAR = (PROPERTIES[x] for x in ("case", "enum", "val", "var"))
TYPE_KINDS = ("class", "trait", "object", "interface")
CALLER_KINDS = ("method", "constructor", "field", "object", "class")
CALLEE_KINDS = ("method", "constructor", "field")
INDEX_VERSION = 1


def _struct(**fields: object) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _B = StringType(), IntegerType(), LongType(), BooleanType()
_A = ArrayType(_S)

SYMBOL_IN = _struct(fqn=_S, display_name=_S, kind=_S, properties=_I, signature=_S, parents=_A, overridden_symbols=_A, access=_S)
OCCURRENCE_IN = _struct(symbol=_S, role=_S, start_line=_I, start_col=_I, end_col=_I)
#: A compiled source file: what the SemanticDB reader gives and the build takes.
DOCUMENT = _struct(uri=_S, module_segments=_S, symbols=ArrayType(SYMBOL_IN), occurrences=ArrayType(OCCURRENCE_IN))
MODULE_IN = _struct(segments=_S, artifact_name=_S, scala_version=_S, main_class=_S, test_framework=_S, source_paths=_A, generated_source_paths=_A, scalac_options=_A, module_deps=_A, ivy_deps=_A)
REWRITE = StructType([StructField("from", _S), StructField("to", _S)])

FILES = _struct(file_id=_L, path=_S, module_id=_L, is_test=_B, is_generated=_B)
MODULES = _struct(module_id=_L, name=_S, artifact_name=_S, source_paths=_A, generated_source_paths=_A, scala_version=_S, scalac_options=_A, main_class=_S, test_framework=_S, file_count=_L, symbol_count=_L)
SYMBOLS = _struct(symbol_id=_L, name=_S, fqn=_S, kind=_S, file_id=_L, line=_I, col=_I, end_line=_I, type_signature=_S, owner_id=_L, properties=_I, access=_S, parents=_A, overridden_symbols=_A)
REFS = _struct(symbol_id=_L, file_id=_L, line=_I, col=_I, role=_S)
EDGES = _struct(kind=_S, src=_L, dst=_L)
MODULE_DEPS = _struct(src=_L, dst=_L)
IVY_DEPS = _struct(module_id=_L, dep=_S)
TABLES = {"files": FILES, "modules": MODULES, "symbols": SYMBOLS, "refs": REFS, "edges": EDGES, "module_deps": MODULE_DEPS, "ivy_deps": IVY_DEPS}
