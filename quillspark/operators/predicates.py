"""Predicates over symbols, files and modules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..functions.text import contains_folded, fold, fold_text
from ..schema import CASE, ENUM, VAL, VAR

# Name prefixes of the standard library. Bare "scala/" is not one of them.
STDLIB_PREFIXES = (
    "scala/Predef scala/Option scala/Some scala/None scala/collection/ scala/runtime/ scala/reflect/ scala/math/ scala/util/ scala/io/ scala/sys/ scala/concurrent/ scala/jdk/"
    " scala/compiletime/ scala/deriving/ scala/quoted/ scala/Any scala/AnyRef scala/AnyVal scala/Nothing scala/Null scala/Unit scala/Boolean scala/Byte scala/Short scala/Int"
    " scala/Long scala/Float scala/Double scala/Char scala/String scala/Array scala/Tuple scala/Product scala/Serializable scala/Function scala/PartialFunction"
    " scala/Enumeration scala/StringContext java/lang/ java/util/ java/io/ java/net/"
).split()
# Method names that carry no business meaning.
PLUMBING_NAMES = (
    "apply unapply toString hashCode equals copy map flatMap filter foreach collect foldLeft foldRight get getOrElse orElse isEmpty nonEmpty isDefined mkString"
    " productElement productPrefix canEqual productArity productIterator productElementName succeed pure attempt fromOption when unless traverse traverseOption"
    " traverseOptionUnit foreachDiscard validate parTraverseN"
).split()
# Parents that say nothing about a type.
BOILERPLATE_PARENTS = "java/lang/Object# scala/Product# scala/Serializable# java/io/Serializable# scala/AnyRef# scala/Any# scala/Equals#".split()
# Parts and endings of utility names.
UTILITY_PARTS = "Utils Ops Operations Helper IO Factory".split()
UTILITY_ENDINGS = "Store Database Mapping Converter Provider Enum Companion Defaults".split()
# Parts and endings of test and of generated paths, folded.
TEST_PATH = r"/test/|/tests/|/it/|/spec/|(?:test|spec|suite|integ)\.scala$"
GENERATED_PATH = r"compilescalapb\.dest|compilepb\.dest|/generated/|/src_managed/|generatedsources|buildinfo\.scala|(?:\.pb|grpc)\.scala$"
TEST_MODULE = r"\.(?:test|it|multiregionit)$|\.test\.|\.it\."


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(properties: Column | str, mask: int) -> Column:
    return _c(properties).bitwiseAND(F.lit(mask)) != 0


def is_stdlib(fqn: Column | str = "fqn") -> Column:
    return _c(fqn).rlike("^(?:" + "|".join(map(re.escape, STDLIB_PREFIXES)) + ")")


def is_plumbing(name: Column | str = "name") -> Column:
    return _c(name).isin(PLUMBING_NAMES)


def is_val_accessor(kind: Column | str = "kind", properties: Column | str = "properties") -> Column:
    return has(properties, VAL | VAR) & _c(kind).isin("method", "field")


def flag(column: Column | str) -> Column:
    """A file's flag; false where there is no file."""
    return F.coalesce(_c(column), F.lit(False))


def is_noise() -> Column:
    """Over symbols joined with their files."""
    return is_stdlib() | flag("is_test") | flag("is_generated") | is_plumbing()


def is_skipped() -> Column:
    """As noise, but plumbing counts: what noise detection leaves out."""
    return is_stdlib() | flag("is_test") | flag("is_generated")


def is_tuple_field(name: Column | str = "name") -> Column:
    return _c(name).rlike(r"^_[0-9]+$")


def is_callgraph_noise() -> Column:
    return is_noise() | F.col("name").contains("$default$") | is_tuple_field() | is_val_accessor()


def is_synthetic_name(name: Column | str = "name") -> Column:
    name = _c(name)
    return is_plumbing(name) | name.contains("$default$") | is_tuple_field(name) | name.rlike(r"^(?:\$anon|derived\$|given_)") | name.isin("<init>", "getMessage", "writeReplace", "ordinal")


def is_synthetic() -> Column:
    hidden = F.col("kind").isin("parameter", "typeparameter", "selfparameter", "local")
    return hidden | is_synthetic_name() | (has("properties", VAL) & (F.col("kind") == "method") & F.col("fqn").contains("#`<init>`"))


def matches_exclude(patterns: list[str], fqn: Column | str = "fqn", name: Column | str = "name", owner_name: Column | str = "owner_name") -> Column:
    """Any pattern is part of the full name, the name or the owner's name."""
    found = F.lit(False)
    for p in patterns:
        for column in (_c(fqn), _c(name), F.coalesce(_c(owner_name), F.lit(""))):
            found = found | column.contains(p)
    return found


def module_name_matches(name: Column | str, pattern: str) -> Column:
    """Without dots, a part of the name; with dots, each piece is a part of a piece of the name, in order."""
    if "." not in pattern:
        return contains_folded(name, pattern)
    pieces = [re.escape(p) for p in fold_text(pattern).split(".") if p]
    if not pieces:
        return _c(name).isNotNull()
    # each pattern piece takes the first piece of the name that holds it, and the next one goes on after that
    rule = r"^(?:[^.]*\.)*?" + r"\.(?:[^.]*\.)*?".join(rf"[^.]*{p}[^.]*" for p in pieces) + r"(?:\..*)?$"
    return fold(name).rlike("(?s)" + rule)


def in_module(pattern: str, name: Column | str = "module_name", artifact: Column | str = "artifact_name") -> Column:
    artifact = _c(artifact)
    return F.coalesce(module_name_matches(name, pattern), F.lit(False)) | F.coalesce((artifact != "") & module_name_matches(artifact, pattern), F.lit(False))


def matches_kind(kind: str) -> Column:
    """The kinds that a kind filter means: plain classes, case classes, enums and interfaces are disjoint."""
    k = F.col("kind")
    case, enum = has("properties", CASE), has("properties", ENUM)
    if kind == "case-class":
        return (k == "class") & case
    if kind == "enum":
        return k.isin("class", "interface") & enum & ~case
    if kind == "class":
        return (k == "class") & ~case & ~enum
    if kind == "interface":
        return (k == "interface") & ~enum
    return k == fold_text(kind)


def is_listed() -> Column:
    return ~F.col("kind").isin("parameter", "typeparameter", "selfparameter", "local")


def is_member() -> Column:
    return ~F.col("kind").isin("parameter", "typeparameter", "selfparameter", "constructor") & ~is_synthetic_name()


def is_implementation() -> Column:
    return ~F.col("kind").isin("local", "parameter") & ~is_noise()


def is_cross_module(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return a.isNotNull() & b.isNotNull() & (a != b)


def is_test_path(uri: Column | str, segments: Column | str) -> Column:
    """By module name or path; modules with a test framework come on top, by a semi-join."""
    return fold(uri).rlike(TEST_PATH) | F.coalesce(_c(segments).rlike(TEST_MODULE), F.lit(False))


def is_generated_path(uri: Column | str) -> Column:
    return fold(uri).rlike(GENERATED_PATH)


def looks_utility(name: Column | str = "name") -> Column:
    return _c(name).rlike("|".join(UTILITY_PARTS) + "|(?:" + "|".join(UTILITY_ENDINGS) + ")$")


def parse_patterns(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]
