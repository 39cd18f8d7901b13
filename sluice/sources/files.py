"""Input expansion, file listings and small file helpers, on the driver."""

from __future__ import annotations

import filecmp
import hashlib
import os
import re
import shutil
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession


def list_files(directory: str, pattern: str = "*", recursive: bool = False) -> list[str]:
    """Files whose names match, hidden ones and links included, in order."""
    found = []
    with os.scandir(directory) as entries:
        for e in entries:
            if e.is_dir():
                if recursive:
                    found += list_files(e.path, pattern, True)
            elif fnmatchcase(e.name, pattern):
                found.append(e.path)
    return sorted(found)


def list_directories(directory: str, recursive: bool = False) -> list[str]:
    """Directories, each before what is inside it."""
    out = []
    with os.scandir(directory) as entries:
        for e in sorted((e for e in entries if e.is_dir()), key=lambda e: e.name):
            out.append(e.path)
            if recursive:
                out += list_directories(e.path, True)
    return out


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def remote_files(spark: SparkSession, item: str, recursive: bool = False, pattern: str = "*") -> Iterator[str]:
    """Files of a URI that names a file, a directory or a glob in a directory, in
    any of Hadoop's file systems; files of the local one by their plain paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path(item)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def name(path) -> str:
        return path.toUri().getPath() if path.toUri().getScheme() == "file" else path.toString()

    def under(folder, pattern: str) -> Iterator[str]:
        for status in fs.listStatus(folder):
            if status.isDirectory():
                if recursive:
                    yield from under(status.getPath(), pattern)
            elif fnmatchcase(status.getPath().getName(), pattern):
                yield name(status.getPath())

    if fs.exists(at):
        status = fs.getFileStatus(at)
        if status.isDirectory():
            yield from under(at, pattern)
        else:
            yield name(status.getPath())
    elif at.getParent() is not None and fs.exists(at.getParent()):
        yield from under(at.getParent(), at.getName())


def expand_inputs(inputs: list[str], recursive: bool = False, pattern: str = "*", output: str | None = None, spark: SparkSession | None = None) -> list[str]:
    """Files of files, directories and globs, sorted and without repeats; never
    the output file. With a session, URIs of any file system that Spark reads."""
    found: set[str] = set()
    for item in inputs:
        if spark is not None and is_uri(item):
            found.update(remote_files(spark, item, recursive, pattern))
        elif os.path.isfile(item):
            found.add(item)
        elif os.path.isdir(item):
            found.update(list_files(item, pattern, recursive))
        else:
            head, tail = os.path.split(item)
            if os.path.isdir(head or "."):
                found.update(p if head else os.path.relpath(p) for p in list_files(head or ".", tail, recursive))
    skip = os.path.abspath(output) if output else None
    return sorted((p for p in found if os.path.abspath(p) != skip), key=os.fsencode)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def read_text(path: str, encoding: str = "utf-8") -> str:
    with open(path, encoding=encoding, newline="") as f:
        return f.read()


def write_bytes(path: str, data: bytes, append: bool = False) -> int:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "ab" if append else "wb") as f:
        return f.write(data)


def write_text(path: str, text: str, encoding: str = "utf-8", append: bool = False) -> int:
    return write_bytes(path, text.encode(encoding), append)


def write_lines(path: str, lines: list[str], encoding: str = "utf-8", append: bool = False) -> int:
    return write_text(path, "".join(f"{x}\n" for x in lines), encoding, append)


def copy(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    shutil.copyfile(source, target)


def move(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    shutil.move(source, target)


def remove(path: str) -> bool:
    """Whether there was a file to remove."""
    try:
        os.remove(path)
    except FileNotFoundError:
        return False
    return True


def crc32(path: str) -> int:
    """IEEE CRC-32 of a file, read in blocks."""
    value = 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            value = zlib.crc32(block, value)
    return value


def digest(path: str, name: str = "md5") -> str:
    """A digest of a file in lowercase hex, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, name).hexdigest()


def same_files(left: str, right: str) -> bool:
    return filecmp.cmp(left, right, shallow=False)
