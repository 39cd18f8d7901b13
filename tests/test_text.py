"""Column functions against small models in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import sniff, text


def values(spark, strings, *columns):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(strings)], "k int, s string").repartition(2)
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def model_fields(line, d):
    if not line:
        return []
    if len(d) != 1:
        return line.split(d)
    out, inside, k = [""], False, 0
    while k < len(line):
        c = line[k]
        if c == '"':
            if inside and line[k + 1 : k + 2] == '"':
                out[-1] += '"'
                k += 1
            else:
                inside = not inside
        elif c == d and not inside:
            out.append("")
        else:
            out[-1] += c
        k += 1
    return out


@pytest.mark.parametrize("d", [",", "\t", "|", ".", '"', "::"])
def test_csv_fields(spark, d):
    rnd = random.Random(5)
    fixed = ['a,"b,c",d', 'a"b""c"d', "", ",", '""', '"""', '"x', "a::b", '"', '""""', '"a""', ' "a" , b ']
    lines = fixed + ["".join(rnd.choice(f'ab{d} ""') for _ in range(rnd.randrange(14))) for _ in range(1500)] + ['"a""b",' * 20000]
    got = values(spark, lines, text.csv_fields(F.col("s"), d))
    want = [model_fields(x, d) for x in lines]
    assert [r[0] for r in got] == want
    assert [sniff.fields_of(x, d) for x in lines] == want


def test_csv_line(spark):
    rows = [["x,y", 'q"', ""], ["a", "b"], [], ["l\n", "r\r"], [""]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, f array<string>")
    got = [r[0] for r in df.orderBy("k").select(text.csv_line(F.col("f"))).collect()]
    assert got == ['"x,y","q""",', "a,b", "", '"l\n","r\r"', ""]


def test_column_range(spark):
    ranges = {(0, 0): "a", (1, -1): "b,c", (5, 5): "c", (2, 1): "b,c", (0, 9): "a,b,c"}
    for (a, b), want in ranges.items():
        assert values(spark, ["a,b,c"], F.array_join(text.column_range(text.csv_fields(F.col("s")), a, b), ",")) == [(want,)]
    assert values(spark, [""], F.array_join(text.column_range(text.csv_fields(F.col("s")), 1, 2), ",")) == [("",)]


@pytest.mark.parametrize("pattern, line, want", [
    ("err*", "an error", True), ("a[bc]", "xacx", True), ("a[bc]", "a[bc]", True), ("a[bc]", "a[b", False), ("a.c", "abc", True), ("(", "f(x)", True), ("(", "fx", False),
    ("a?c", "xabcx", True), ("a?c", "ac", False), ("a.b*", "axbz", False), ("re:^a+$", "aaa", True), ("re:^a+$", "aab", False), ("[", "a[", False), ("[", "[", True),
])
def test_patterns(spark, pattern, line, want):
    assert values(spark, [line], text.matches(F.col("s"), pattern)) == [(want,)]


def test_case(spark):
    assert values(spark, ["an ERROR", "É"], text.matches(F.col("s"), "error", True), text.ascii_lower(F.col("s")), text.contains_ignoring_case(F.col("s"), "É")) == [(True, "an error", False), (False, "É", True)]


def test_blank_and_trim(spark):
    lines = ["", " \t\x0b\x0c\r\n", "a", " \x0ba\n\n", " a b "]
    got = values(spark, lines, text.is_blank(F.col("s")), text.trim_space(F.col("s")), text.trim_left(F.col("s")), text.trim_right(F.col("s")))
    space = " \t\n\x0b\x0c\r"
    assert got == [(not s.strip(space), s.strip(space), s.lstrip(space), s.rstrip(space)) for s in lines]


def test_classes(spark):
    numeric = {"+1.5e-3": True, ".": True, "1e": True, "5.": True, "": True, " 7 ": True, "+": True, "e5": False, "1 2": False, "0x1": False}
    numeric |= {"+": False, "": False}
    rule = re.compile(r"[+-]?(\d+\.?\d*|\.\d*)([eE][+-]?\d*)?\Z")
    assert {s: r[0] for s, r in zip(numeric, values(spark, list(numeric), text.is_numeric(F.col("s"))))} == {s: bool(rule.match(s.strip())) for s in numeric} == numeric
    dates = {"x12345678": True, "1:2": False, "2024-1-2": True, "at 10:30": True, "1/2/24": True, "abcdef": False}
    assert [r[0] for r in values(spark, list(dates), text.is_datetime(F.col("s")))] == list(dates.values())
    assert [r[0] for r in values(spark, ["", "N/A", "?", " none ", "0"], text.is_null_like(F.col("s")))] == [True, True, True, True, False]
    assert [r[0] for r in values(spark, ["Yes", "off", "2"], text.is_boolean(F.col("s")))] == [True, True, False]


def test_occurrences_and_parts(spark):
    assert values(spark, ["aaa.a", ""], text.occurrences(F.col("s"), "aa"), text.occurrences(F.col("s"), "."), text.occurrences(F.col("s"), "")) == [(1, 1, 0), (0, 0, 0)]
    assert values(spark, ["/a/b.c/d.tar.gz", "x", "/"], text.directory(F.col("s")), text.file_name(F.col("s")), text.extension(F.col("s")), text.stem(F.col("s"))) == [("/a/b.c", "d.tar.gz", ".gz", "d.tar"), ("", "x", "", "x"), ("", "", "", "")]
    with pytest.raises(ValueError):
        text.split_literal(F.col("s"), "")


def test_header_and_formats():
    csv = ["name,age", "Bob,3"]
    assert sniff.has_header(csv, ",") and not sniff.has_header(["1,2", "3,4"], ",") and not sniff.has_header(["a,b"], ",")
    assert [sniff.content_format(["[INFO] x"], c) for c in ("documented", "observed")] == ["log", "json"]
    assert sniff.content_format(['{"a": 1}']) == "json" and sniff.content_format(["<a>"]) == "xml" and sniff.content_format(["plain"]) == "text"
    assert sniff.delimiter_of(["a b,c d", "e f,g h"])[0] == "," and sniff.delimiter_of(["a\tb", "c\td"])[0] == "\t" and sniff.delimiter_of_line("a;b;c,d") == ";"
    p = sniff.profile_lines(["t,v", "2024-01-02 03:04:05,1", "2024-01-02 03:04:06,2"], "x.csv")
    assert (p.format, p.has_header, p.header) == ("csv", True, ["t", "v"])
    assert not sniff.profile_lines(["plain"], "a.txt").has_header and sniff.profile_lines(["plain"], "a.txt", "observed").has_header
    assert sniff.profile_lines([]).confidence == 0.0
