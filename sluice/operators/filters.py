"""Line filters: blank, comment, include, exclude, custom, in that order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, matches, trim_left
from ..spec import FilterSpec


def is_comment(c: Column, prefix: str = "#") -> Column:
    return trim_left(c).startswith(prefix)


def any_match(c: Column, patterns: tuple[str, ...], ignore_case: bool = False, compat: str = "documented") -> Column:
    return reduce(or_, (matches(c, p, ignore_case, compat) for p in patterns if p), F.lit(False))


def condition(c: Column, spec: FilterSpec, compat: str = "documented") -> Column:
    """Whether a line stays."""
    stays = F.lit(True)
    if spec.skip_blank:
        stays = stays & ~is_blank(c)
    if spec.skip_comments:
        stays = stays & ~is_comment(c, spec.comment_prefix)
    if any(spec.include):
        stays = stays & any_match(c, spec.include, spec.ignore_case, compat)
    if any(spec.exclude):
        stays = stays & ~any_match(c, spec.exclude, spec.ignore_case, compat)
    return stays & spec.custom(c) if spec.custom else stays


def filtered(lines: DataFrame, spec: FilterSpec, column: str = "content") -> DataFrame:
    return lines.where(condition(F.col(column), spec))
