"""Encodings: names, byte order marks, detection, and conversion of columns."""

from __future__ import annotations

import codecs
import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings by their names, and the byte order marks.
NAMES = {
    "utf8": "utf-8", "utf-8": "utf-8", "utf8-bom": "utf-8-sig", "utf-8-bom": "utf-8-sig", "utf16le": "utf-16-le", "utf-16le": "utf-16-le", "utf16be": "utf-16-be", "utf-16be": "utf-16-be",
    "utf32le": "utf-32-le", "utf-32le": "utf-32-le", "utf32be": "utf-32-be", "utf-32be": "utf-32-be", "ascii": "ascii", "gbk": "gbk", "gb2312": "gbk", "cp936": "gbk", "big5": "big5", "latin1": "latin-1", "iso-8859-1": "latin-1", "iso8859-1": "latin-1",
}
MARKS = [("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff"), ("utf-8-sig", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")]
#: Those that Spark itself converts.
NATIVE = {"utf-8": "UTF-8", "ascii": "US-ASCII", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-le": "UTF-32", "utf-32-be": "UTF-32"}


#: Byte classes, and the pairs of GBK.
_ASCII, _CONTROL = bytes(range(128)), bytes(b for b in range(32) if b not in (9, 10, 13))
_PAIR = re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]")


def named(name: str) -> str | None:
    return NAMES.get(name.strip().lower())


def mark_of(data: bytes) -> str | None:
    return next((name for name, mark in MARKS if data.startswith(mark)), None)


def without_mark(data: bytes) -> bytes:
    return next((data[len(mark) :] for _, mark in MARKS if data.startswith(mark)), data)


def with_mark(data: bytes, name: str) -> bytes:
    return dict(MARKS).get(name, b"") + without_mark(data)


def control_share(data: bytes) -> float:
    return sum(b < 32 and b not in (9, 10, 13) for b in data) / max(1, len(data))


def gbk_share(data: bytes) -> float:
    """Of the bytes above ASCII, the share in pairs that GBK has."""
    i = high = good = 0
    while i < len(data):
        if data[i] < 0x80:
            i += 1
            continue
        pair = i + 1 < len(data) and 0x81 <= data[i] <= 0xFE and 0x40 <= data[i + 1] <= 0xFE and data[i + 1] != 0x7F
        high, good, i = high + 1 + pair, good + 2 * pair, i + 1 + pair
    return good / high if high else 0.0


def decodes(data: bytes, encoding: str) -> bool:
    """Whether bytes are valid in an encoding (surrogate pairs in UTF-16 included)."""
    try:
        data.decode(named(encoding) or encoding)
    except UnicodeDecodeError:
        return False
    return True


def is_ascii(data: bytes) -> bool:
    return data.isascii()


def could_be_latin1(data: bytes) -> bool:
    """No control characters of the upper half."""
    return not any(0x80 <= b < 0xA0 for b in data)


def could_be_gbk(data: bytes) -> bool:
    return gbk_share(data) > 0.8


def looks_binary(head: bytes) -> bool:
    """Whether a file's first bytes have zeros or many control characters."""
    return 0 in head or control_share(head) > 0.3


@dataclass(frozen=True)
class Counts:
    """What bytes say of their encoding. Counts of parts that end in a line feed
    add up to those of the whole: no character of UTF-8 or GBK has one inside."""

    size: int = 0
    zeros: tuple[int, int] = (0, 0)  # at even and odd places
    control: int = 0
    utf8: bool = True
    high: int = 0  # bytes above ASCII, and bytes in pairs that GBK has
    good: int = 0

    def then(self, other: Counts) -> Counts:
        at = self.size % 2
        zeros = (self.zeros[0] + other.zeros[at], self.zeros[1] + other.zeros[1 - at])
        return Counts(self.size + other.size, zeros, self.control + other.control, self.utf8 and other.utf8, self.high + other.high, self.good + other.good)


def counts_of(data: bytes, complete: bool = True) -> Counts:
    """complete: nothing follows, so that a character that is cut off is not valid."""
    utf8, high, pairs = True, 0, 0
    if not data.isascii():
        try:
            codecs.getincrementaldecoder("utf-8")().decode(data, complete)
        except UnicodeDecodeError:
            utf8 = False
        rest, pairs = _PAIR.subn(b"", data)
        high = 2 * pairs + len(rest.translate(None, _ASCII))
    return Counts(len(data), (data[0::2].count(0), data[1::2].count(0)), len(data) - len(data.translate(None, _CONTROL)), utf8, high, 2 * pairs)


def judged(c: Counts, mark: str | None = None) -> tuple[str, float]:
    """Encoding and confidence: a mark, then ASCII, valid UTF-8, UTF-16 by its
    zero bytes, GBK by its pairs, else Latin-1. Valid UTF-8 always wins over GBK."""
    if mark:
        return mark, 0.95
    if c.utf8 and not any(c.zeros):
        ascii_only = not c.high and not c.good
        return ("ascii", 0.9) if ascii_only else ("utf-8", 0.95 if c.control <= 0.05 * c.size else 0.7)
    if c.size % 2 == 0 and max(c.zeros) * 4 > c.size // 2:
        return ("utf-16-le" if c.zeros[1] >= c.zeros[0] else "utf-16-be"), 0.5
    share = c.good / c.high if c.high else 0.0
    return ("gbk", share) if share > 0.8 else ("latin-1", 0.3)


def detect(data: bytes) -> tuple[str, float]:
    """Encoding and confidence of bytes, the last character of which may be cut off."""
    return judged(counts_of(data, complete=False), mark_of(data))


def _udf(encoding: str, decode: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else (bytes(x).decode(encoding, "replace") if decode else x.encode(encoding, "replace")))

    return F.pandas_udf(run, "string" if decode else "binary")


def decoded(content: Column, encoding: str) -> Column:
    """Bytes to text, natively where Spark has the encoding; bytes that are not
    valid become U+FFFD."""
    name = named(encoding) or encoding
    if name == "utf-8":
        return F.make_valid_utf8(content.cast("string"))
    if name in ("latin-1", "utf-16-le", "utf-16-be"):
        return F.decode(content, NATIVE[name])
    return _udf(name, True)(content)


def encoded(text: Column, encoding: str) -> Column:
    """Text to bytes; what the encoding lacks becomes a question mark."""
    name = named(encoding) or encoding
    if name in ("utf-8", "utf-16-le", "utf-16-be"):
        return F.encode(text, NATIVE[name])
    return _udf(name, False)(text)


def _known(name: str) -> str:
    if name not in NAMES.values() and not named(name):
        raise ValueError(f"cannot convert: there is no encoding {name!r}")
    return named(name) or name


def converted(data: bytes, source: str, target: str, strict: bool = False) -> tuple[bytes, int, bool]:
    """Bytes in another encoding, what was lost (bytes that are not valid,
    characters that target lacks) and whether that is a success. What is lost
    becomes U+FFFD or a question mark; strict leaves it out and is no success.
    Equal encodings change nothing; encodings not known are an error."""
    a, b = _known(source), _known(target)
    if a == b:
        return data, 0, True
    lost = 0

    def told(e: UnicodeError) -> tuple[str, int]:
        nonlocal lost
        lost += e.end - e.start
        mark = "\ufffd" if isinstance(e, UnicodeDecodeError) else "?" * (e.end - e.start)
        return "" if strict else mark, e.end

    name = f"sluice-{threading.get_ident()}"
    codecs.register_error(name, told)
    out = data.decode(a, name).encode(b, name)
    return out, lost, not (strict and lost)


def converted_column(content: Column, source: str, target: str, strict: bool = False) -> Column:
    """converted() of a binary column: output, n_lost, success; null for null."""
    source, target = _known(source), _known(target)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            made = [(None, None, None) if x is None else converted(bytes(x), source, target, strict) for x in s]
            yield pd.DataFrame({"output": [m[0] for m in made], "n_lost": pd.array([m[1] for m in made], "Int64"), "success": pd.array([m[2] for m in made], "boolean")})

    struct = F.pandas_udf(run, "output binary, n_lost long, success boolean")(content)
    return F.when(content.isNotNull(), struct)


def detected(content: Column) -> Column:
    """Encoding and confidence of a binary column's whole contents, as judged() has
    them, by native expressions over bytes as Latin-1; null for null."""
    chars, size = F.decode(content, NATIVE["latin-1"]), F.octet_length(content)
    zeros = lambda c: F.regexp_count(c, F.lit(r"\x00"))
    even = zeros(F.regexp_replace(chars, r"(?s)(.).?", "$1"))
    odd = zeros(chars) - even
    pair = r"[\x81-\xfe][\x40-\x7e\x80-\xfe]"
    good = 2 * F.regexp_count(chars, F.lit(pair))
    share = good / (good + F.regexp_count(F.regexp_replace(chars, pair, ""), F.lit(r"[\x80-\xff]")))
    control = F.regexp_count(chars, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    made = lambda name, sure: F.struct(F.lit(name).alias("encoding"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    out = F
    for name, mark in MARKS:
        out = out.when(content.startswith(F.lit(mark)), made(name, 0.95))
    plain = is_valid_utf8(content) & ~chars.contains("\0")
    out = out.when(plain & ~chars.rlike(r"[\x80-\xff]"), made("ascii", 0.9)).when(plain, made("utf-8", F.when(control <= 0.05 * size, 0.95).otherwise(0.7)))
    wide = (size % 2 == 0) & (F.greatest(even, odd) * 4 > F.floor(size / 2))
    out = out.when(wide & (odd >= even), made("utf-16-le", 0.5)).when(wide, made("utf-16-be", 0.5))
    out = out.when(chars.rlike(r"[\x80-\xff]") & (share > 0.8), made("gbk", share))
    return out.when(content.isNotNull(), made("latin-1", 0.3))


def is_valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))
