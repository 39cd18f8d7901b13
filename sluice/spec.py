"""Option records: what to merge and how, with the names that options may have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column

#: Other names of modes, joins, duplicates' keys and keeping.
MODES = {"sequential": "sequential", "seq": "sequential", "s": "sequential", "interleaved": "interleaved", "interleave": "interleaved", "i": "interleaved", "conditional": "conditional", "join": "conditional", "c": "conditional", "timestamp": "timestamp", "ts": "timestamp", "t": "timestamp", "binary": "binary", "bin": "binary", "b": "binary"}
JOINS = {"inner": "inner", "inner_join": "inner", "left": "left", "left_join": "left", "left_outer": "left", "right": "right", "right_join": "right", "right_outer": "right", "full": "full", "full_join": "full", "outer": "full", "full_outer": "full", "right_anti": "right_anti"}
DEDUP_KEYS = {"none": "none", "line": "line", "full": "line", "column": "columns", "columns": "columns", "partial": "columns"}
KEEPS = {"first": "first", "last": "last", "last_in_place": "last_in_place", "all": "all"}
TIMES = {"auto": "auto", "unix": "unix", "iso8601": "iso8601", "iso": "iso8601", "rfc2822": "rfc2822", "rfc": "rfc2822", "custom": "custom"}


#: Options taken and ignored: sizes and strategies that Spark chooses itself.
IGNORED = ("max_memory", "max_memory_buffer", "chunk_size", "strategy", "file_type", "smart_io", "keep_original_headers", "preserve_headers")


def chosen(names: dict[str, str], name: str, otherwise: str | None = None) -> str:
    """The option that a name stands for; of unknown names otherwise, or an error."""
    try:
        return names[name.strip().lower()]
    except KeyError:
        if otherwise is not None:
            return otherwise
        raise ValueError(f"unknown option {name!r}; there are {sorted(set(names))}") from None


@dataclass(frozen=True)
class FilterSpec:
    """Lines that are blank, comments, or excluded go; with includes, so do those
    that match none of them. custom: any condition on the column content."""

    skip_blank: bool = False
    skip_comments: bool = False
    comment_prefix: str = "#"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore_case: bool = False
    custom: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class DedupSpec:
    key: str = "none"
    keep: str = "first"
    ignore_case: bool = False
    first: int = 0
    last: int = -1
    delimiter: str = ","


@dataclass(frozen=True)
class TimestampSpec:
    kind: str = "auto"
    column: int = -1
    delimiter: str = ","
    pattern: str = ""
    epoch_ms: bool = True
    honor_tz: bool = False


@dataclass(frozen=True)
class MergeSpec:
    mode: str = "sequential"
    filter: FilterSpec = field(default_factory=FilterSpec)
    dedup: DedupSpec = field(default_factory=DedupSpec)
    timestamp: TimestampSpec = field(default_factory=TimestampSpec)
    chunk: int = 1
    join_type: str = "inner"
    key: int | str = 0
    delimiter: str = ","
    header: bool = True
    recursive: bool = False
    pattern: str = "*"
    source_encoding: str = "auto"
    target_encoding: str = "utf-8"
    compat: str = "documented"

    @classmethod
    def from_options(cls, options: dict[str, object]) -> MergeSpec:
        """From flat options, named as the command line's; names not known are errors,
        as are unknown values but for modes and duplicates' keys in observed compatibility."""
        o = {k: v for k, v in options.items() if k not in IGNORED}
        lenient = o.get("compat") == "observed"
        pick = lambda record, **names: record(**{k: o.pop(n) for k, n in names.items() if n in o})
        if "dedup" in o:
            o["dedup"] = chosen(DEDUP_KEYS, str(o["dedup"]), "line" if lenient else None)
        if "dedup_keep" in o:
            o["dedup_keep"] = chosen(KEEPS, str(o["dedup_keep"]))
        if "time_format" in o:
            o["time_format"] = chosen(TIMES, str(o["time_format"]))
        made = {
            "filter": pick(FilterSpec, skip_blank="skip_blank", skip_comments="skip_comments", comment_prefix="comment_prefix", include="include", exclude="exclude", ignore_case="ignore_case", custom="custom"),
            "dedup": pick(DedupSpec, key="dedup", keep="dedup_keep", ignore_case="dedup_ignore_case", first="dedup_first", last="dedup_last", delimiter="dedup_delimiter"),
            "timestamp": pick(TimestampSpec, kind="time_format", column="time_column", delimiter="time_delimiter", pattern="time_pattern", epoch_ms="epoch_ms", honor_tz="honor_tz"),
        }
        if "mode" in o:
            o["mode"] = chosen(MODES, str(o["mode"]), "sequential" if lenient else None)
        if "join_type" in o:
            o["join_type"] = chosen(JOINS, str(o["join_type"]))
        if "delimiter" in o:
            o["delimiter"] = str(o["delimiter"]).replace("\\t", "\t")
        if isinstance(o.get("key"), str) and o["key"].isdigit():
            o["key"] = int(o["key"])
        if unknown := o.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown options {sorted(unknown)}")
        return cls(**made, **o)
