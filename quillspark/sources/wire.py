"""A small reader of protobuf messages: a table says which fields of a message are wanted, the rest is skipped."""

from __future__ import annotations

import struct

# Fields of the SemanticDB messages, as number: (name, type). Types: s text, i 32-bit number, l 64-bit number, b truth, f and d floating point,
# or the name of a message; a star marks repeated fields.
MESSAGES = {
    "TextDocuments": {1: ("documents", "TextDocument*")},
    "TextDocument": {2: ("uri", "s"), 5: ("symbols", "SymbolInformation*"), 6: ("occurrences", "SymbolOccurrence*")},
    "Range": {1: ("start_line", "i"), 2: ("start_character", "i"), 3: ("end_line", "i"), 4: ("end_character", "i")},
    "SymbolOccurrence": {1: ("range", "Range"), 2: ("symbol", "s"), 3: ("role", "i")},
    "Scope": {1: ("symlinks", "s*"), 2: ("hardlinks", "SymbolInformation*")},
    "SymbolInformation": {1: ("symbol", "s"), 3: ("kind", "i"), 4: ("properties", "i"), 5: ("display_name", "s"), 17: ("signature", "Signature"), 18: ("access", "Access"), 19: ("overridden_symbols", "s*")},
    "Access": {1: ("private", "Empty"), 2: ("privatethis", "Empty"), 3: ("privatewithin", "Empty"), 4: ("protected", "Empty"), 5: ("protectedthis", "Empty"), 6: ("protectedwithin", "Empty"), 7: ("public", "Empty")},
    "Empty": {},
    "Signature": {1: ("class", "ClassSignature"), 2: ("method", "MethodSignature"), 3: ("type", "TypeSignature"), 4: ("value", "ValueSignature")},
    "ClassSignature": {1: ("type_parameters", "Scope"), 2: ("parents", "Type*"), 3: ("self", "Type"), 4: ("declarations", "Scope")},
    "MethodSignature": {1: ("type_parameters", "Scope"), 2: ("parameter_lists", "Scope*"), 3: ("return_type", "Type")},
    "TypeSignature": {1: ("type_parameters", "Scope"), 2: ("lower_bound", "Type"), 3: ("upper_bound", "Type")},
    "ValueSignature": {1: ("tpe", "Type")},
    "Type": {
        2: ("ref", "TypeRef"), 20: ("single", "SingleType"), 21: ("this", "ThisType"), 22: ("super", "SingleType"), 23: ("constant", "ConstantType"), 17: ("intersection", "Types"), 18: ("union", "Types"), 19: ("with", "Types"),
        7: ("structural", "StructuralType"), 8: ("annotated", "AnnotatedType"), 9: ("existential", "ExistentialType"), 10: ("universal", "UniversalType"), 13: ("by_name", "ValueSignature"), 14: ("repeated", "ValueSignature"),
        25: ("match", "MatchType"), 26: ("lambda", "LambdaType"),
    },
    "TypeRef": {1: ("prefix", "Type"), 2: ("symbol", "s"), 3: ("type_arguments", "Type*")},
    "SingleType": {1: ("prefix", "Type"), 2: ("symbol", "s")},
    "ThisType": {1: ("symbol", "s")},
    "ConstantType": {1: ("constant", "Constant")},
    "Types": {1: ("types", "Type*")},
    "StructuralType": {4: ("tpe", "Type"), 5: ("declarations", "Scope")},
    "AnnotatedType": {1: ("tpe", "Type"), 3: ("annotations", "AnnotationTree*")},
    "AnnotationTree": {1: ("tpe", "Type")},
    "ExistentialType": {1: ("tpe", "Type"), 3: ("declarations", "Scope")},
    "UniversalType": {2: ("tpe", "Type"), 3: ("declarations", "Scope")},
    "MatchType": {1: ("scrutinee", "Type"), 2: ("cases", "CaseType*")},
    "CaseType": {1: ("key", "Type"), 2: ("body", "Type")},
    "LambdaType": {1: ("declarations", "Scope"), 2: ("tpe", "Type")},
    "Constant": {
        1: ("unit", "Empty"), 2: ("boolean", "Bool"), 3: ("byte", "Int"), 4: ("short", "Int"), 5: ("char", "Int"), 6: ("int", "Int"), 7: ("long", "Long"), 8: ("float", "Float"), 9: ("double", "Double"), 10: ("string", "Text"), 11: ("null", "Empty"),
    },
    "Bool": {1: ("value", "b")},
    "Int": {1: ("value", "i")},
    "Long": {1: ("value", "l")},
    "Float": {1: ("value", "f")},
    "Double": {1: ("value", "d")},
    "Text": {1: ("value", "s")},
}
# Codes of kinds and roles.
KIND_OF = {3: "method", 6: "macro", 7: "type", 8: "parameter", 9: "typeparameter", 10: "object", 11: "package", 12: "packageobject", 13: "class", 14: "trait", 17: "selfparameter", 18: "interface", 19: "local", 20: "field", 21: "constructor"}
ROLE_OF = {1: "Reference", 2: "Definition"}
#: Of these messages only the field read last counts.
_ONE_OF = frozenset(("Signature", "Type", "Constant", "Access"))


class Malformed(ValueError):
    """Bytes that are no such message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed("number cut short")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & ((1 << 64) - 1), at
        shift += 7


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise Malformed(f"wire type {wire}")
        if at > len(data):
            raise Malformed("field cut short")
        yield key >> 3, wire, value


def _numbers(wire: int, value: int | bytes):
    """A number, or those of a packed field."""
    if wire == 0:
        yield value
    else:
        at = 0
        while at < len(value):
            n, at = _varint(value, at)
            yield n


def read(message: str, data: bytes) -> dict:
    """A message as a dict of its wanted fields; absent fields are left out, repeated ones are lists."""
    spec, out = MESSAGES[message], {}
    for number, wire, value in _fields(data):
        if number not in spec:
            continue
        name, kind = spec[number]
        many, kind = kind.endswith("*"), kind.rstrip("*")
        if kind == "s":
            got = [value.decode("utf-8")]
        elif kind in ("i", "l", "b"):
            got = [_signed(n, 32) if kind == "i" else _signed(n, 64) if kind == "l" else bool(n) for n in _numbers(wire, value)]
        elif kind in ("f", "d"):
            got = [struct.unpack("<f" if kind == "f" else "<d", value)[0]]
        else:
            if wire != 2:
                raise Malformed(f"{message}.{name}")
            got = [read(kind, value)]
        if message in _ONE_OF:
            out = {}
        if many:
            out.setdefault(name, []).extend(got)
        elif got:
            out[name] = got[-1]
    return out
