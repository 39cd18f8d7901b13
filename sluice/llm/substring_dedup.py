"""Removal of token windows that occur more than once.

Every window of `window` words of a text has a Rabin-Karp hash, a polynomial in
the words' 64-bit hashes modulo 2^64, taken from running sums for all windows of
a batch at once. Windows are counted in Spark in a way that shuffles few of
them, and loses none:

1. Each window is known by an anchor, the least of the (window - GRAM + 1)
   hashes of GRAM words inside it. Equal windows have equal anchors, and
   neighbouring windows share theirs, so anchors are few. An anchor found at one
   place only has no window that occurs twice; places of the others go on.
2. At such a place, the run of windows that the anchor stands for is one row,
   with their hashes and the run's own hash. Equal runs are counted first, with
   partial aggregation, so copies shrink to a row each. The windows of the
   distinct runs are then counted by (anchor, window hash), 128 bits together.
3. A window counted twice or more is repeated. Repeated windows go back to
   their documents and merge into maximal intervals of words to remove.

Joins on anchors and runs are against tables in the shared folder, so that
adaptive execution can split the hot ones; what is collected for a document is
bounded by its own length. Texts travel compressed, and only those that have a
repeated anchor are read again.

Null texts have no words. Texts shorter than a window lose nothing. Repeated
rows repeat each other's windows. Rows are told apart by id and text, so rows of
one id may differ, and null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, kept

#: Words of an anchor; bytes of text hashed at once (one text at least).
GRAM, PART_BYTES = 12, 2_000_000
#: Base of the polynomials (odd, so that it can be divided by).
BASE = 0x9E3779B97F4A7C15
BITS = (1 << 64) - 1


class Powers:
    """Powers of BASE and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            for series in (self.up, self.down):
                series[0] = 1
                np.multiply.accumulate(series, out=series)
        return self.up, self.down


powers = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values; no result is 0 but of 0."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * down[:n])


def slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    if have < width:
        rest = width - have
        out = pick(out[:-rest], out[rest:])
    return out


class Scan:
    """Words, hashes and anchors of a part of a batch."""

    def __init__(self, texts: pa.Array, window: int):
        lists = pc.ascii_split_whitespace(texts)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
        self.words = flat
        self.ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.window, self.span = window, window - GRAM + 1
        coded = pc.dictionary_encode(flat)
        by_code = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        hashes = by_code[coded.indices.to_numpy()]
        self.owner = owner
        n = len(hashes) - window + 1
        if n <= 0:
            self.valid, self.least, self.grams, self.hashes = np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        self.hashes = rolling(hashes, window)
        self.valid = owner[:n] == owner[window - 1 :]
        self.grams = rolling(hashes, GRAM) | np.uint64(1)
        self.least = slide(self.grams, self.span, np.minimum)

    def anchors(self) -> np.ndarray:
        """Places of GRAM words that are the least of some window."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        least = np.where(self.valid, self.least, np.uint64(0))
        padded = np.concatenate([np.zeros(self.span - 1, np.uint64), least, np.zeros(self.span - 1, np.uint64)])
        return np.flatnonzero(slide(padded, self.span, np.maximum) == self.grams)

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows whose anchor is marked: the anchor's place, the first
        window and the end. marked: bool for each place. The leftmost of equal
        anchors in a window is its own, so that a window is in one run."""
        at = np.flatnonzero(self.valid)
        own = np.full(len(at), -1)
        for d in range(self.span - 1, -1, -1):
            own = np.where(self.grams[at + d] == self.least[at], at + d, own)
        some = marked[own] if len(at) else np.zeros(0, bool)
        at, own = at[some], own[some]
        if not len(at):
            return at, at, at
        first = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1])
        ends = np.concatenate([first[1:], [len(at)]])
        return own[first], at[first], at[ends - 1] + 1


def parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch's texts (large_string) of about PART_BYTES."""
    texts = batch.column(column).cast(pa.large_string())
    ends, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_BYTES, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def unzipped(packed: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about PART_BYTES at once, and the place of the first."""
    unzip, part, start, size = zstandard.ZstdDecompressor(), [], 0, 0
    for k, z in enumerate(packed):
        part.append(unzip.decompress(z.as_py()))
        size += len(part[-1])
        if size >= PART_BYTES:
            yield start, part
            part, start, size = [], k + 1, 0
    if part:
        yield start, part


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def row_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc (long) and th (int): the id, or what stands for it, and the text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    own = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col)))
    return [F.coalesce(own, F.xxhash64(text)).alias("doc"), F.hash(text, F.lit(7)).alias("th")]


def removed_words(starts: list[int], masks: list[int], window: int, n: int) -> np.ndarray:
    """Which of n words the windows cover; bit k of a mask is window start + k."""
    covered = np.zeros(n + 1, np.int64)
    for start, mask in zip(starts, masks, strict=True):
        for k in range(mask.bit_length()):
            if mask >> k & 1:
                covered[start + k] += 1
                covered[min(n, start + k + window)] -= 1
    return np.cumsum(covered[:-1]) > 0


def repeated_windows(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. The texts with a repeated anchor: doc, th, z (compressed
    text). And the repeated windows: doc, th, runs (start, mask)."""
    assert GRAM < window <= GRAM + 63
    keyed = df.select(*row_key(df, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    @frugal
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in parts(batch, 2):
                scan = Scan(texts, window)
                at = scan.anchors()
                row = scan.owner[at]
                take = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([signed(scan.grams[at]), batch.column(0).take(take), batch.column(1).take(take), pa.array((at - scan.starts[row]).astype(np.int32))], names=["anchor", "doc", "th", "pos"])

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zip_.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())], names=["doc", "th", "z"])

    @frugal
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, unpacked in unzipped(batch.column(2)):
                scan = Scan(pa.array(unpacked, pa.large_binary()).cast(pa.large_string()), window)
                own = batch.column(3).slice(start, len(unpacked))
                marked = np.zeros(len(scan.grams) + 1, bool)
                marked[own.flatten().to_numpy() + np.repeat(scan.starts, pc.list_value_length(own).to_numpy())] = True
                place, first, end = scan.runs(marked)
                row = scan.owner[first] if len(first) else first
                hashes = [scan.hashes[a:b] for a, b in zip(first.tolist(), end.tolist())]
                run_hash = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in hashes], np.uint64)
                take = pa.array(row + start, pa.int64())
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)), signed(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [signed(scan.grams[place]), signed(run_hash), batch.column(0).take(take), batch.column(1).take(take), pa.array((first - scan.starts[row]).astype(np.int32)), listed],
                    names=["anchor", "run", "doc", "th", "start", "hashes"],
                )

    found = kept(keyed.mapInArrow(anchors, "anchor long, doc long, th int, pos int"), "found")
    shared = kept(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    marks = found.join(shared, "anchor").groupBy("doc", "th").agg(F.collect_set("pos").alias("marks"))
    texts = kept(keyed.mapInArrow(pack, "doc long, th int, z binary").join(marks, ["doc", "th"]), "texts")

    places = kept(texts.mapInArrow(runs, "anchor long, run long, doc long, th int, start int, hashes array<long>"), "places")
    distinct = kept(places.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.first("hashes").alias("hashes")), "runs")
    each = distinct.select("anchor", "run", "n", F.posexplode("hashes").alias("k", "hash"))
    twice = kept(each.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "hash"), "windows")
    whole = distinct.where("n > 1").select("anchor", "run", F.expr("shiftleft(1L, size(hashes)) - 1").alias("mask"))
    some = each.where("n = 1").join(twice, ["anchor", "hash"]).groupBy("anchor", "run").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    masks = kept(whole.union(some), "masks")
    repeated = places.drop("hashes").join(masks, ["anchor", "run"]).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "mask")).alias("runs"))
    return texts.select("doc", "th", "z"), repeated


def changed_texts(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct doc, th with something to remove: n_removed, the
    digest of the words kept, the text without the words removed and the white
    space before them, and the intervals of words removed."""
    texts, repeated = repeated_windows(df, window, id_col, text_col)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for first, unpacked in unzipped(batch.column(2)):
                out: list[list] = [[], [], [], []]
                for text, runs in zip(unpacked, batch.column(3).slice(first, len(unpacked))):
                    words, rows = text.split(), runs.as_py()
                    gone = removed_words([r["start"] for r in rows], [r["mask"] for r in rows], window, len(words))
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                    keep, at, pieces = [], 0, []
                    for w, g in zip(words, gone.tolist()):
                        end = text.index(w, at) + len(w)
                        if not g:
                            keep.append(w)
                            pieces.append(text[at:end])
                        at = end
                    pieces.append(text[at:])
                    out[0].append(int(gone.sum()))
                    out[1].append(hashlib.sha256(b" ".join(keep)).hexdigest())
                    out[2].append(b"".join(pieces))
                    out[3].append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], kind)]
                own = [batch.column(k).slice(first, len(unpacked)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=["doc", "th", "n_removed", "kept_sha256", "kept_text", "intervals"])

    joined = texts.dropDuplicates(["doc", "th"]).join(repeated, ["doc", "th"]).select("doc", "th", "z", "runs")
    return joined.mapInArrow(cut, "doc long, th int, n_removed long, kept_sha256 string, kept_text string, intervals array<struct<start:int,end:int>>")


def removal_digests(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, n_words, n_removed and the SHA-256 of the
    kept words joined by one space."""

    @frugal
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            for t in batch.column(3):  # the words of one text at a time
                words = t.as_py().split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digests, pa.string())], names=[id_col, "doc", "th", "n_words", "sha"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, *row_key(df, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    whole = rows.mapInArrow(plain, f"{id_col} {kind}, doc long, th int, n_words long, sha string")
    changed = changed_texts(df, window, id_col, text_col).select("doc", "th", "n_removed", "kept_sha256")
    both = whole.join(changed, ["doc", "th"], "left")
    return both.select(id_col, "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeated windows removed from its texts; other columns stay."""
    changed = changed_texts(df, window, id_col, text_col).select("doc", "th", "kept_text")
    names = [f"_own_{k}" for k in range(len(df.columns))]  # columns of df may be called doc or th
    own = df.select(*row_key(df, id_col, text_col), *(F.col(c).alias(n) for c, n in zip(df.columns, names)))
    both = own.join(changed, ["doc", "th"], "left")
    return both.select(*(F.coalesce("kept_text", n).alias(c) if c == text_col else F.col(n).alias(c) for c, n in zip(df.columns, names)))
