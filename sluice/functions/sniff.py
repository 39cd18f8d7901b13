"""Format, delimiter and header of a file, from its first lines (plain Python)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .encodings import detect, named

#: Lines that are looked at.
SAMPLE = 30
#: Formats by extension, delimiters in order of preference on ties.
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "xml": "xml", "log": "log", "txt": "text", "text": "text"}
DELIMITERS = [",", "\t", " ", ":", ";", "|"]
_SPACE = " \t\n\x0b\f\r"
#: What makes a line a log's, and the shape of a number.
_LOG = [re.compile(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}"), re.compile(r"\b(INFO|DEBUG|WARN|ERROR|FATAL|TRACE)\b", re.IGNORECASE)]
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d*)([eE][+-]?\d*)?\Z")


@dataclass(frozen=True)
class Profile:
    """What a file seems to be."""

    format: str = "text"
    confidence: float = 0.0
    delimiter: str = ","
    has_header: bool = False
    header: list[str] = field(default_factory=list)
    width: int = 0
    encoding: str = "utf-8"
    encoding_confidence: float = 0.0


def fields_of(line: str, delimiter: str = ",") -> list[str]:
    """The fields of a CSV line, as text.csv_fields has them."""
    if not line:
        return []
    if len(delimiter) != 1:
        return line.split(delimiter)
    # Between quotes, odd parts are quoted; an empty even part amid them is a doubled quote.
    parts, out = line.split('"'), [""]
    for k, part in enumerate(parts):
        if k % 2:
            out[-1] += part
        elif part == "" and 0 < k < len(parts) - 1:
            out[-1] += '"'
        else:
            first, *rest = [part] if delimiter == '"' else part.split(delimiter)
            out[-1] += first
            out += rest
    return out


def delimiter_confidence(lines: list[str], delimiter: str) -> float:
    widths = [len(fields_of(x, delimiter)) for x in lines if x.strip(_SPACE)]
    if not widths:
        return 0.0
    kinds = len(set(widths))
    if kinds == 1:
        return 0.9 if widths[0] >= 2 else 0.1
    return 0.5 + 0.3 * (1 - (kinds - 1) / len(widths)) if max(widths) >= 2 else 0.1


def delimiter_of(lines: list[str]) -> tuple[str, float]:
    """The delimiter of most confidence; the comma on ties."""
    scored = [(delimiter_confidence(lines, d), d) for d in DELIMITERS]
    best = max(s for s, _ in scored)
    return next((d, s) for s, d in scored if s == best)


def delimiter_of_line(line: str) -> str:
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def is_number(value: str) -> bool:
    return bool(_NUMBER.match(value.strip(_SPACE)))


def has_header(lines: list[str], delimiter: str) -> bool:
    """A first line without numbers, and a later one of equal width."""
    if len(lines) < 2 or not lines[0]:
        return False
    first = fields_of(lines[0], delimiter)
    return not any(map(is_number, first)) and any(len(fields_of(x, delimiter)) == len(first) for x in lines[1:])


def is_json(lines: list[str]) -> bool:
    some = [x.strip(_SPACE) for x in lines if x.strip(_SPACE)]
    if not some:
        return False
    if some[0][0] in "[{":
        return True
    text = "".join(lines)
    return any(open_ in lines[0] and text.count(open_) == text.count(close) for open_, close in ("{}", "[]"))


def is_xml(lines: list[str]) -> bool:
    return any(s.startswith(("<?xml", "<!DOCTYPE")) or (len(s) > 2 and s[0] == "<" and s[-1] == ">") for s in (x.strip(_SPACE) for x in lines))


def is_log(lines: list[str]) -> bool:
    return bool(lines) and sum(any(p.search(x) for p in _LOG) for x in lines) > 0.3 * len(lines)


def content_format(lines: list[str], compat: str = "documented") -> str:
    """documented: logs are tried before JSON, so that `[INFO] x` is a log."""
    tests = [("json", is_json), ("xml", is_xml), ("log", is_log)]
    if compat == "documented":
        tests = [tests[2], tests[0], tests[1]]
    for name, test in tests:
        if test(lines):
            return name
    comma, tab = (delimiter_confidence(lines, d) for d in ",\t")
    if tab > 0.5 and tab > comma:
        return "tsv"
    return "csv" if comma > 0.5 else "text"


def profile_lines(lines: list[str], name: str = "", compat: str = "documented") -> Profile:
    """From at most SAMPLE lines and the file's name."""
    lines = lines[:SAMPLE]
    by_name = EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None
    if not lines:
        return Profile(by_name or "text", 0.0)
    found = content_format(lines, compat)
    if compat == "documented" and by_name in ("csv", "tsv") and found in ("log", "text"):
        found = by_name
    confidence = 0.9 if found == by_name else 0.7
    if found not in ("csv", "tsv"):
        return Profile(found, confidence, has_header=compat == "observed")
    delimiter = "\t" if found == "tsv" else delimiter_of(lines)[0]
    header = has_header(lines, delimiter)
    first = fields_of(lines[0], delimiter)
    return Profile(found, confidence, delimiter, header, first if header else [], len(first))


def profile_bytes(head: bytes, name: str = "", compat: str = "documented", complete: bool = True, known: tuple[str, float] | None = None) -> Profile:
    """From a file's first bytes; a line that is cut off is left out. known: the
    encoding and confidence of the whole file, where the first bytes are not all."""
    encoding, sure = known or detect(head)
    text = head.decode(named(encoding) or encoding, "replace").removeprefix("\ufeff")
    lines = text.split("\n")
    if not complete or lines[-1] == "":
        lines = lines[:-1] or lines
    found = profile_lines([x.removesuffix("\r") for x in lines if x is not None], name, compat)
    return Profile(**{**found.__dict__, "encoding": encoding, "encoding_confidence": sure})
