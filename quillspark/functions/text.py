"""Names and identifiers as column expressions. Case folding is ASCII only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    return F.translate(_c(text), UPPER, LOWER)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def contains_folded(text: Column | str, part: str) -> Column:
    return fold(text).contains(fold_text(part))


def starts_with_folded(text: Column | str, part: str) -> Column:
    return fold(text).startswith(fold_text(part))


def symbol_owner(fqn: Column | str) -> Column:
    """The fully qualified name without its last part; empty for locals and top-level packages."""
    fqn = _c(fqn)
    bare = F.regexp_replace(fqn, r"(?s)(?:(?:\([^(]*\))?\.|[#/])$", "")
    return F.when(fqn.startswith("local"), "").otherwise(F.regexp_extract(bare, r"(?s)^(.*[/#.])?[^/#.]*$", 1))


def symbol_display_name(fqn: Column | str) -> Column:
    """The last part of a fully qualified name, without its descriptor; locals stay as they are."""
    fqn = _c(fqn)
    bare = F.regexp_replace(F.regexp_replace(fqn, r"[./#]$", ""), r"(?s)\.?\([^(]*\)$", "")
    return F.when(fqn.startswith("local"), fqn).otherwise(F.regexp_extract(bare, r"([^/#.]*)$", 1))


def terminal_name(fqn: Column | str) -> Column:
    """What follows the last ``#``, else the last ``/``, without parameters: members of objects keep their object."""
    bare = F.regexp_replace(F.regexp_replace(_c(fqn), r"\.+$", ""), r"(?s)\([^(]*$", "")
    return F.when(bare.contains("#"), F.regexp_extract(bare, r"([^#]*)$", 1)).otherwise(F.regexp_extract(bare, r"([^/]*)$", 1))


def bytes_of(text: Column | str) -> Column:
    """UTF-8 bytes as an array of numbers."""
    digits = F.hex(F.encode(_c(text), "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def name_hash(text: Column | str, buckets: int, ignore_case: bool = False) -> Column:
    """Polynomial hash of the bytes (factor 31, modulo 2**32), modulo ``buckets``."""
    text = fold(text) if ignore_case else _c(text)
    return F.aggregate(bytes_of(text), F.lit(0).cast("long"), lambda h, b: (h * 31 + b) % 4294967296) % buckets


def trigrams(text: Column | str) -> Column:
    """Distinct runs of three characters, folded, sorted; none for shorter texts."""
    low = fold(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def occurrence_symbols(symbol: Column | str) -> Column:
    """An occurrence can name several symbols, divided by ``;``."""
    return F.filter(F.split(_c(symbol), ";"), lambda x: x != "")


def fuzzy_threshold(size: Column | int) -> Column:
    """Most edits that a name of ``size`` bytes may be away: a third of it, 5 at most, none for up to two bytes."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(size <= 2, 0).otherwise(F.least(F.floor(size / 3), F.lit(5))).cast("int")


def camel_segments(name: Column | str) -> Column:
    """Folded parts of an identifier: split at case changes, before digits and at underscores."""
    marked = F.regexp_replace(_c(name), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^0-9_])(?=[0-9])", "_")
    return F.transform(F.filter(F.split(marked, "_"), lambda x: x != ""), fold)


def strip_path_ref(text: Column | str) -> Column:
    """A path without its ``ref:v0:hash:`` prefix."""
    return F.regexp_replace(_c(text), r"^q?ref:[^:]*:[^:]*:", "")
