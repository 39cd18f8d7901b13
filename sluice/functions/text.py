"""String functions as Column expressions: trimming, CSV fields, patterns, classes."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The six characters that count as white space.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What counts as null, as boolean and as a date or time in a field.
NULL_LIKE = ["", "null", "nil", "none", "na", "n/a", "undefined", "?"]
BOOLEAN_LIKE = ["true", "false", "yes", "no", "1", "0", "on", "off"]
DATETIME_PATTERNS = [
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"\d{1,2}:\d{1,2}",
    r"\d{8}",
]
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d*)([eE][+-]?\d*)?\z"


def quoted(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", literal)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def trim_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def trim_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def is_blank(c: Column) -> Column:
    return trim_space(c) == ""


def contains_ignoring_case(c: Column, literal: str) -> Column:
    return ascii_lower(c).contains(literal.translate(str.maketrans(UPPER, LOWER)))


def replace_all(c: Column, old: str, new: str) -> Column:
    """Every occurrence of a literal, from the left, without overlap."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def occurrences(c: Column, literal: str) -> Column:
    """How often a literal occurs without overlap; 0 for the empty literal."""
    return F.regexp_count(c, F.lit(quoted(literal))).cast("long") if literal else F.lit(0).cast("long")


def split_literal(c: Column, delimiter: str, keep_empty: bool = True) -> Column:
    """Parts between a literal delimiter. The empty delimiter is not allowed."""
    if not delimiter:
        raise ValueError("the delimiter is empty")
    parts = F.split(c, quoted(delimiter), -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def join_parts(parts: Column, delimiter: str) -> Column:
    return F.array_join(parts, delimiter)


def csv_fields(line: Column, delimiter: str = ",") -> Column:
    """Fields of a CSV line: a quote opens or closes anywhere, two quotes inside
    quotes are one, an open quote runs to the end; nothing is trimmed. The empty
    line has no fields. Delimiters of other than one character split plainly."""
    if len(delimiter) != 1:
        return F.when(line == "", F.array().cast("array<string>")).otherwise(split_literal(line, delimiter))
    unquoted = lambda x: F.replace(F.regexp_replace(x, r'"([^"]*+(?:""[^"]*+)*+)(?:"|\z)', "$1"), F.lit('""'), F.lit('"'))
    if delimiter == '"':
        return F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(unquoted(line)))
    d = quoted(delimiter)
    plain = rf'[^"{d}]*+'
    pattern = rf'{d}({plain}(?:"[^"]*+(?:""[^"]*+)*+(?:"|\z){plain})*+)'
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(pattern), F.lit(1))
    # Most lines have no quote: for them a plain split is the same and faster.
    return F.when(line == "", F.array().cast("array<string>")).when(~line.contains('"'), split_literal(line, delimiter)).otherwise(F.transform(fields, unquoted))


def csv_line(fields: Column, delimiter: str = ",") -> Column:
    """Fields as a CSV line, quoted only where a delimiter, quote or line end is inside."""
    needs = lambda x: x.contains(delimiter) | x.contains('"') | x.contains("\n") | x.contains("\r")
    each = F.transform(fields, lambda x: F.when(needs(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    return F.array_join(each, delimiter)


def field(fields: Column, index: int) -> Column:
    """A field by its place from 0; null where the row is too short."""
    return F.get(fields, F.lit(index))


def padded(fields: Column, width: int) -> Column:
    """Fields with empty ones added up to width."""
    return F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(width) - F.size(fields))))


def column_range(fields: Column, first: int, last: int = -1) -> Column:
    """Fields first to last (from 0, -1: the last one). A range beyond the row is
    drawn in to its last field, and its ends are swapped where out of order."""
    end = F.size(fields) - 1
    a = F.least(F.lit(first), end)
    b = end if last < 0 else F.least(F.lit(last), end)
    low, high = F.greatest(F.lit(0), F.least(a, b)), F.greatest(a, b)
    return F.when(F.size(fields) == 0, fields).otherwise(F.slice(fields, low + 1, high - low + 1))


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[]")


def observed_class(inner: str) -> str:
    """A class whose members are rewritten as outside of it: * adds a point, ? is
    a point, and signs, ^ included, stand for themselves; an empty one is never found."""
    if not inner:
        return "(?!)"
    rewritten = inner.replace("*", ".*").replace("?", ".")
    return "[" + "".join(c if c == "-" or c.isalnum() else quoted(c) for c in rewritten) + "]"


def glob_search(pattern: str, compat: str = "documented") -> str:
    """A glob as a Java pattern to search for: * any run, ? one character,
    brackets a class as they stand (observed: as observed_class rewrites it)."""
    if compat == "observed":
        parts = re.split(r"\[([^\]]*)\]", pattern)
        return "".join(observed_class(p) if k % 2 else glob_search(p) for k, p in enumerate(parts))
    out, inside = "", False
    for c in pattern:
        if c in "[]":
            inside = c == "["
            out += c
        elif inside:
            out += c
        elif c in "*?":
            out += ".*" if c == "*" else "."
        else:
            out += quoted(c)
    return out


def wildcard(pattern: str) -> str:
    """A wildcard as a Java pattern of the whole text: only * and ? are special."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else quoted(c) for c in pattern) + r"\z"


def usable(pattern: str) -> bool:
    """Whether a pattern compiles (checked with Python's syntax, close to Java's)."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def checked(pattern: str) -> str:
    """The pattern, or an error if Java can't compile it."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:
            raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return pattern


def matches(c: Column, pattern: str, ignore_case: bool = False, compat: str = "documented") -> Column:
    """Whether a filter pattern matches: a glob found anywhere or equal to the
    whole text with literal brackets; a plain pattern found as a regular
    expression or as a literal. `re:` before a pattern makes it an expression."""
    flag = "(?i)" if ignore_case else ""
    if pattern.startswith("re:"):
        return c.rlike(flag + checked(pattern[3:]))
    if is_glob(pattern):
        search, whole = glob_search(pattern, compat), wildcard(pattern)
        if "[" not in pattern and "]" not in pattern:
            return c.rlike(flag + search)
        anchored = c.rlike(flag + whole)
        return c.rlike(flag + search) | anchored if usable(search) else anchored
    literal = contains_ignoring_case(c, pattern) if ignore_case else c.contains(pattern)
    return c.rlike(flag + pattern) | literal if usable(pattern) else literal


def is_numeric(c: Column) -> Column:
    return trim_space(c).rlike(NUMERIC_PATTERN)


def is_boolean(c: Column) -> Column:
    return ascii_lower(trim_space(c)).isin(BOOLEAN_LIKE)


def is_datetime(c: Column) -> Column:
    return (F.octet_length(c) >= 6) & c.rlike("|".join(DATETIME_PATTERNS))


def is_null_like(c: Column) -> Column:
    return ascii_lower(trim_space(c)).isin(NULL_LIKE)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """With its dot; empty where the name has none."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)\z", 1)


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def combined_path(left: Column, right: Column) -> Column:
    """right below left; right alone where it is absolute or left is empty."""
    inside = F.concat(F.rtrim(left, F.lit("/")), F.lit("/"), right)
    return F.when(is_absolute(right) | (left == ""), right).when(right == "", left).otherwise(inside)


def normal_path(path: Column) -> Column:
    """Without empty and . parts, and with .. taken back where a part is before
    it; . where nothing is left of a relative path."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    back = lambda done: (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
    step = lambda done, x: F.when(x != "..", F.array_append(done, x)).when(back(done), F.slice(done, 1, F.size(done) - 1)).when(is_absolute(path), done).otherwise(F.array_append(done, x))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(is_absolute(path), F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.*?)(?:\.[^.]*)?\z", 1)


def crc32_of(content: Column) -> Column:
    return F.crc32(content)
