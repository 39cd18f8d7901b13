"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in Arrow batches. Equal fingerprints are one from then
on, so copies cost nothing. Distinct fingerprints are compared in tiles, by
exclusive-or and bit counts in numpy: a bundle of them is put in the order of
population count and cut into tiles of SIDE; two tiles whose population counts
lie further apart than the radius r are skipped, since each differing bit
changes the count by one. That is the one comparison for bundles of any size.

To put in one bundle all that can be linked, without comparing the whole table
with itself, the 64 bits are cut into b blocks: r differences leave b - r of
them untouched, so two linked fingerprints agree on one choice of b - r blocks,
which is the key that deals them out. b is r + 2 to r + 4, so that few
fingerprints share a key by chance however many there are (see blocks_for).
Keys that one fingerprint only has go; of the others, consecutive small ones
make up a bundle. A key with more than TILE fingerprints is cut into tiles by
population count and hash before it is dealt out, and each pair of tiles within
r is a bundle of its own; so no task holds an unbounded key, and no link is
lost. Bundles give a star for each set that they link, not the pairs.

Null and empty texts have no words and fingerprint zero. Repeated rows are in
one class; rows of one id are each judged by their own text. A null id never
names a class while another id is in it. Very long texts are read whole, one at
a time. Extra columns of any name stay or are not read. No rows: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, kept
from .graph import components

#: Fingerprints in a tile of a large key and, about, in a bundle of small ones;
#: side of the tiles compared at once.
TILE, SIDE = 4096, 64
#: Fingerprints that may share a key by chance before keys get longer.
CHANCE = 8


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """SimHash of a text's word shingles, XXH64 of each; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    hashes = np.array([xxhash.xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row and its fingerprint, fp (long)."""
    return _with_print(df.select(id_col, F.col(text_col).cast("binary").alias("t")), "t", shingle, "fp").select(id_col, "fp")


def _with_print(df: DataFrame, text_col: str, shingle: int, name: str) -> DataFrame:
    """df with the fingerprint (long) of its texts (binary), the last column."""
    at = df.columns.index(text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks, radius + 2 to radius + 4, at which n
    fingerprints share a key by chance at most CHANCE at a time. More blocks make
    longer keys, and more of them: for a radius of 4, 15 keys of 21 bits, 35 of
    27 or 70 of 32."""
    for blocks in (radius + 2, radius + 3):
        if n <= CHANCE << 64 * (blocks - radius) // blocks:
            return blocks
    return radius + 4


def block_keys(fp: Column, radius: int, n: int) -> Column:
    """The keys of a fingerprint: a hash of its bits in each n - radius of n
    blocks. (Two keys of one hash would only be compared for nothing.)"""
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(n), n - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m, k: F.xxhash64(fp.bitwiseAND(m), k))


def hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives all that the links i, j connect the least label among them."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def tiles_links(a: np.ndarray, b: np.ndarray | None, radius: int, seen: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (None: a with itself) of fingerprints within radius.
    seen: gets how many pairs of tiles were compared and skipped."""
    count_a = np.bitwise_count(a)
    order_a = np.argsort(count_a, kind="stable")
    order_b, count_b = (order_a, count_a) if b is None else (o := np.argsort(np.bitwise_count(b), kind="stable"), np.bitwise_count(b))
    b_all = a if b is None else b
    for s in range(0, len(a), SIDE):
        rows = order_a[s : s + SIDE]
        for t in range(s if b is None else 0, len(b_all), SIDE):
            columns = order_b[t : t + SIDE]
            skip = int(count_b[columns[0]]) - int(count_a[rows[-1]]) > radius or int(count_a[rows[0]]) - int(count_b[columns[-1]]) > radius
            if seen is not None:
                seen["skipped" if skip else "compared"] += 1
            if skip:
                continue
            near = np.bitwise_count(a[rows][:, None] ^ b_all[columns][None, :]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if b is None and s == t else near)
            yield rows[i], columns[j]


def bundles(lengths: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first group of each bundle: consecutive groups of about TILE rows in
    all; a group of two sides is a bundle by itself."""
    at = np.cumsum(np.where(two, 0, lengths)) // TILE
    return np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | two[1:] | two[:-1]]))


def linked(fp: np.ndarray, side: np.ndarray, starts: np.ndarray, radius: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links within bundles of groups: fingerprints, and the one each
    hangs on. starts: of the groups, in order; side: 0 or 1; with a side 1, only
    links between the sides count. Links between groups are links as well."""
    lengths = np.diff([*starts, len(fp)])
    label = np.arange(len(fp))
    two = np.zeros(len(starts), bool)
    two[np.repeat(np.arange(len(starts)), lengths)[side == 1]] = True
    first = bundles(lengths, two)
    for g, start, end in zip(first, starts[first], [*starts[first[1:]], len(fp)]):
        own, cut = label[start:end] - start, int((side[start:end] == 0).sum()) if two[g] else None
        part = fp[start:end]
        for i, j in tiles_links(part[:cut], part[cut:] if two[g] else None, radius, seen):
            hook(own, i, j + cut if two[g] else j)
        label[start:end] = own + start
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def dealt(prints: DataFrame, radius: int, n_blocks: int) -> DataFrame:
    """prints: distinct fp. Rows key, a, b, side, fp: what is to be compared, by
    group (key, a, b); with a side 1, one side of the group with the other."""
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), radius, n_blocks)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    small = shared.where(F.col("n") <= TILE).select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    large = shared.where(F.col("n") > TILE).withColumn("ones", F.bit_count("fp"))
    # Tiles of a large key: by population count, and beyond TILE of one count by hash.
    tiles = large.groupBy("key", "ones").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = tiles.groupBy("key").agg(F.collect_list(F.struct("ones", "tiles")).alias("all"))  # 65 at most
    large = large.drop("n").join(tiles, "key")
    own = F.filter("all", lambda x: x["ones"] == F.col("ones"))[0]["tiles"]
    large = large.withColumn("own", F.col("ones") * (1 << 24) + F.pmod(F.xxhash64("fp"), own).cast("int"))
    beside = F.filter("all", lambda x: F.abs(x["ones"] - F.col("ones")) <= radius)
    others = F.flatten(F.transform(beside, lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda t: x["ones"] * (1 << 24) + t)))
    large = large.withColumn("other", F.explode(others))
    large = large.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    return small.union(large)


def links(prints: DataFrame, radius: int, n_blocks: int | None = None) -> DataFrame:
    """prints: distinct fp. Edges u, v whose components are those of all links
    between fingerprints at radius or fewer differing bits."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(k).to_numpy() for k in range(5)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if rest is None or not len(rest[0]):
                continue
            key, a, b, side, fp = rest
            new = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], new])
            end = len(key) if batch is None else int(starts[-1])  # the last group may go on
            starts = starts if batch is None else starts[:-1]
            if len(starts):
                u, v = linked(fp[:end].view(np.uint64), side[:end], starts, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
            rest = [x[end:] for x in rest]

    rows = dealt(prints, radius, n_blocks or blocks_for(prints.count(), radius))
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side").mapInArrow(run, "u long, v long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _classes(docs: DataFrame, radius: int, id_col: str) -> DataFrame:
    """docs: the id and fp of each row. One row per fp: fp, component_id (the
    smallest id that links reach from it) and root (the fp that stands for the class)."""
    prints = kept(docs.groupBy("fp").agg(F.min(id_col).alias("first_id")), "prints")
    found = components(links(prints.select("fp"), radius))
    members = kept(found.union(found.select("root", "root").distinct()).join(prints, F.col("node") == F.col("fp")).select("fp", "root", "first_id"), "members")
    least = members.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = prints.join(members.join(least, "root").select("fp", "root", "least_id"), "fp", "left")
    return kept(named.select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes")


def near_classes(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, its fingerprint (16 hex digits) and the
    smallest id that links reach from it."""
    docs = kept(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    named = _classes(docs, radius, id_col).drop("root")
    return docs.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stand for their class: one with the smallest id of
    each class, judged by its own text, so rows of one id in two classes may both
    stay. Of rows without an id, which name no class, one of each class stays."""
    names = [f"_own_{k}" for k in range(len(df.columns))]
    own_id, own_text = (names[df.columns.index(c)] for c in (id_col, text_col))
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(df.columns, names)), F.col(text_col).cast("binary").alias("_t"))
    rows = kept(_with_print(rows.drop(own_text), "_t", shingle, "fp").withColumn(own_text, F.col("_t").cast(df.schema[text_col].dataType)).drop("_t"), "prints-of-rows")
    docs = rows.select(own_id, "fp")
    classes = _classes(docs, radius, own_id)
    # Light rows first: those of one class may be many.
    firsts = docs.where(F.col(own_id).isNotNull()).distinct().join(classes, "fp").where(F.col(own_id) == F.col("component_id")).select(own_id, "fp", "root")
    some = rows.join(firsts, [own_id, "fp"]).dropDuplicates(["root"])
    without = rows.where(F.col(own_id).isNull()).dropDuplicates(["fp"]).join(classes, "fp").dropDuplicates(["root"])
    back = [F.col(n).alias(c) for c, n in zip(df.columns, names)]
    return some.select(back).union(without.select(back))
