"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern and kept only when they are valid (check digits, ranges, calendar). Each is
then moved by a keyed Feistel permutation within its own format, so the pseudonym is as valid as the original and
equal values stay equal in all documents, whatever task they are in: nothing is shared but the key.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .scratch import small_batches

ROUNDS = 8
_DAY_0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY_0


def _rounds(key: bytes, tweak: str, value: int, half: int, order: range) -> int:
    """Feistel rounds over two halves of ``half`` bits; the reverse order undoes them."""
    mask, width = (1 << half) - 1, (half + 7) // 8
    label = tweak.encode()
    left, right = value >> half, value & mask
    forward = order.step > 0
    for k in order:
        if not forward:
            left, right = right, left
        word = hashlib.blake2b(right.to_bytes(width, "big") + bytes((k,)) + label, key=key, digest_size=min(64, width + 8)).digest()
        left ^= int.from_bytes(word, "big") & mask
        if forward:
            left, right = right, left
    return (left << half) | right


def permute(key: bytes, tweak: str, value: int, size: int, undo: bool = False) -> int:
    """A keyed permutation of 0 to size - 1: balanced Feistel rounds over an even number of bits, walked until the range is met."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    while True:
        value = _rounds(key, tweak, value, half, order)
        if value < size:
            return value


def moved(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation without fixed points (for sizes over 1): one step along a secret order of all values."""
    return permute(key, tweak, (permute(key, tweak, value, size) + 1) % size, size, undo=True)


def luhn(digits: str) -> int:
    """Check digit of a payload."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _digits(key: bytes, tweak: str, digits: str) -> str:
    return f"{moved(key, f'{tweak}{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}"


def _refill(shape: str, digits: str) -> str:
    """Put digits in place of those of ``shape``; separators stay."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(key: bytes, m: re.Match) -> str | None:
    digits = _only_digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + _digits(key, "card" + digits[0], digits[1:-1])
    return _refill(m[0], body + str(luhn(body)))


#: Country calling codes of one and two digits (ITU-T E.164); all others have three. Fixed values.
_CODES_1 = frozenset(("1", "7"))
_CODES_2 = frozenset(
    ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58")
    + ("60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
)


def calling_code(digits: str) -> str:
    """The country code that an international number begins with; it follows from the digits, however they are spaced."""
    return next((digits[:n] for n, codes in ((1, _CODES_1), (2, _CODES_2)) if digits[:n] in codes), digits[:3])


def _regular(code: str, national: str) -> bool:
    """Whether area and exchange of a number of the North American plan begin as they must."""
    return code == "1" and len(national) == 10 and national[0] in "23456789" and national[3] in "23456789"


def phone(key: bytes, m: re.Match) -> str | None:
    """Numbers are told apart by country code and national digits alone, so all spellings of one share a pseudonym.

    Without a country code a number of ten digits is taken for one of the North American plan.
    """
    digits = _only_digits(m[0])
    code = calling_code(digits) if m["country"] else "1"
    national = digits[len(code) :] if m["country"] else digits
    if not 7 <= len(national) <= 12:
        return None
    out = _digits(key, "phone" + code, national)
    while _regular(code, out) != _regular(code, national):  # a regular number stays one
        out = _digits(key, "phone" + code, out)
    return _refill(m[0], (code if m["country"] else "") + out)


def ssn(key: bytes, m: re.Match) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = area - 1 - (area > 666)
    at = moved(key, "ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    at, serial = divmod(at, 9999)
    rank, group = divmod(at, 99)
    return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def ipv4(key: bytes, m: re.Match) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    out = moved(key, "ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, out.to_bytes(4, "big")))


def iban(key: bytes, m: re.Match) -> str | None:
    raw = m[0].replace(" ", "")
    if not 15 <= len(raw) <= 34 or int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 != 1:
        return None
    body = raw[:2], "".join(_symbols(key, "iban" + raw[:2], raw[4:]))
    check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
    it = iter(f"{body[0]}{check:02d}{body[1]}")
    return "".join(c if c == " " else next(it) for c in m[0])


def _symbols(key: bytes, tweak: str, text: str) -> str:
    """Permute letters and digits within their places: every digit stays a digit, every letter a letter of its case."""
    classes = [next((a for a in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in a), "") for c in text]
    value, size = 0, 1
    for c, a in zip(text, classes, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return text
    pattern = "".join("d" if a == string.digits else "l" if a == string.ascii_lowercase else "u" if a else "-" for a in classes)
    out = moved(key, f"{tweak}{pattern}", value, size)
    made = []
    for c, a in zip(reversed(text), reversed(classes), strict=True):
        if a:
            out, k = divmod(out, len(a))
            made.append(a[k])
        else:
            made.append(c)
    return "".join(reversed(made))


def email(key: bytes, m: re.Match) -> str | None:
    # the domain keeps its last two labels; what identifies a person is moved
    labels = m["domain"].split(".")
    host = ".".join([*(_symbols(key, "host", x.lower()) for x in labels[:-2]), *labels[-2:]])
    return f"{_symbols(key, 'email', m['local'])}@{host}"


def _day(key: bytes, year: int, month: int, day: int) -> datetime.date | None:
    try:
        at = datetime.date(year, month, day).toordinal() - _DAY_0
    except ValueError:
        return None
    return datetime.date.fromordinal(_DAY_0 + moved(key, "date", at, _DAYS)) if 0 <= at < _DAYS else None


def date_iso(key: bytes, m: re.Match) -> str | None:
    day = _day(key, int(m[1]), int(m[3]), int(m[4]))
    return day and f"{day.year:04d}{m[2]}{day.month:02d}{m[2]}{day.day:02d}"


def date_local(key: bytes, m: re.Match) -> str | None:
    """Day first; month first where only that is a date."""
    a, b, year = int(m[1]), int(m[3]), int(m[4])
    if day := _day(key, year, b, a):
        return f"{day.day:02d}{m[2]}{day.month:02d}{m[2]}{day.year:04d}"
    day = _day(key, year, a, b)
    return day and f"{day.month:02d}{m[2]}{day.day:02d}{m[2]}{day.year:04d}"


def secret(key: bytes, m: re.Match) -> str | None:
    value = m["value"]  # of any length, so in parts
    return m["name"] + "".join(_symbols(key, "secret", value[k : k + 128]) for k in range(0, len(value), 128))


#: Kind, pattern, pseudonym; of overlapping finds the first kind counts.
KINDS: list[tuple[str, str, Callable[[bytes, re.Match], str | None]]] = [
    ("email", r"(?<![\w.+%-])(?P<local>[A-Za-z0-9](?:[\w.+%'-]{0,62}[\w+%-])?)@(?P<domain>(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])", email),
    ("secret", r"(?<![A-Za-z0-9])(?P<name>(?:AKIA|ASIA))(?P<value>[A-Z0-9]{16})(?![A-Za-z0-9])", secret),
    ("secret", r"(?P<name>(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey)\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9_./+-]{8,})", secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])(?!\.\d)", card),
    ("ssn", r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])", ssn),
    ("date", r"(?<![\w./-])((?:19|20)\d\d)([-/.])(\d\d)\2(\d\d)(?![\w/-])(?!\.\d)", date_iso),
    ("date", r"(?<![\w./-])(\d\d?)([-/.])(\d\d?)\2((?:19|20)\d\d)(?![\w/-])(?!\.\d)", date_local),
    ("ip", r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-])(?!\.\d)", ipv4),
    ("phone", r"(?<![\w+])(?P<country>\+)\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?![\w-])", phone),
    ("phone", r"(?<![\w+(.-])(?P<country>)(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", phone),
]
_COMPILED = [(kind, re.compile(pattern, re.ASCII), make) for kind, pattern, make in KINDS]


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the original, in order."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of what earlier kinds took, in order; no two overlap
    for kind, pattern, make in _COMPILED:
        new = []
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.end())
            if k and found[k - 1][1] > m.start():
                continue
            out = make(key, m)
            if out is not None:
                new.append((m.start(), m.end(), kind, out))
        if new:
            found = sorted(found + new)
            starts = [x[0] for x in found]
    parts, at = [], 0
    for a, b, _, out in found:
        parts += [text[at:a], out]
        at = b
    return "".join([*parts, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


def protect(docs: DataFrame, key: bytes, text: str = "text", finds: str = "pii") -> DataFrame:
    """All columns of docs with ``text`` pseudonymised, and a last column ``finds``: array of (kind, start, end) in the original text.

    Null texts stay null, with no finds. Rows are taken one by one, whole texts: repeated rows give the same result. A
    column of docs that is called as ``finds`` says is replaced; pass another name to keep it.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(finds)
    at = docs.columns.index(text)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            # every kind needs a digit, an @, a key prefix or a named secret; most texts have none and pass as they are
            maybe = pc.fill_null(pc.match_substring_regex(column, r"[0-9@]|AKIA|ASIA|(?i:passw|secret|token|api[_-]?key)"), False)
            texts, spans = column, [[]] * len(batch)
            if pc.any(maybe).as_py():
                out = column.to_pylist()
                for k in pc.indices_nonzero(maybe).to_pylist():
                    out[k], found = pseudonymise(out[k], key)
                    spans[k] = [{"kind": kind, "start": a, "end": b} for kind, a, b in found]
                texts = pa.array(out, column.type)
            columns = [*batch.columns, pa.array(spans, kinds)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, finds])

    schema = docs.withColumn(finds, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema
    return docs.mapInArrow(run, schema)
