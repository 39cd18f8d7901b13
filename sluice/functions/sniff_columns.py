"""What the sniffer tells of lines, as native expressions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sniff import _LOG, DELIMITERS
from .text import csv_fields, trim_space


def delimiter_of_line(line: Column) -> Column:
    """The delimiter that a line has most of; the one named first on ties."""
    counts = F.array(*(F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS))
    return F.get(F.array(*map(F.lit, DELIMITERS)), F.array_position(counts, F.array_max(counts)).cast("int") - 1)


def _shown(lines: Column) -> Column:
    return F.filter(lines, lambda x: trim_space(x) != "")


def delimiter_confidence(lines: Column, delimiter: str) -> Column:
    """How evenly a delimiter parts the lines that are not blank."""
    widths = F.transform(_shown(lines), lambda x: F.size(csv_fields(x, delimiter)))
    kinds = F.size(F.array_distinct(widths))
    uneven = F.when(F.array_max(widths) >= 2, 0.5 + 0.3 * (1 - (kinds - 1).cast("double") / F.size(widths))).otherwise(0.1)
    return F.when(kinds == 0, 0.0).when(kinds == 1, F.when(F.get(widths, F.lit(0)) >= 2, 0.9).otherwise(0.1)).otherwise(uneven).cast("double")


def _balanced(lines: Column, open_: str, close: str) -> Column:
    whole = F.array_join(lines, "")
    return F.get(lines, F.lit(0)).contains(open_) & (F.length(F.replace(whole, F.lit(open_), F.lit(""))) == F.length(F.replace(whole, F.lit(close), F.lit(""))))


def content_format(lines: Column) -> Column:
    """log, json, xml, tsv, csv or text, tried in this order; null for null."""
    shown = F.transform(_shown(lines), trim_space)
    logged = F.filter(lines, lambda x: x.rlike(_LOG[0].pattern) | x.rlike(f"(?i){_LOG[1].pattern}"))
    json = (F.size(shown) > 0) & (F.substring(F.get(shown, F.lit(0)), 1, 1).isin("[", "{") | _balanced(lines, "{", "}") | _balanced(lines, "[", "]"))
    xml = F.exists(shown, lambda x: x.startswith("<?xml") | x.startswith("<!DOCTYPE") | ((F.length(x) > 2) & x.startswith("<") & x.endswith(">")))
    comma, tab = delimiter_confidence(lines, ","), delimiter_confidence(lines, "\t")
    found = F.when(F.size(logged) > 0.3 * F.size(lines), "log").when(json, "json").when(xml, "xml")
    return F.when(lines.isNotNull(), found.when((tab > 0.5) & (tab > comma), "tsv").when(comma > 0.5, "csv").otherwise("text"))
