import os
from collections import Counter

import numpy as np
import pytest
import xxhash

from sluice.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, k=4, radius=4):
    prints = [brute_print(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    names = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return sorted((rows[i][0] is None, rows[i][0] or 0, f"{prints[i]:016x}", names.get(find(i))) for i in range(len(rows)))


def near_copies():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    rows, k = [], 0
    for _ in range(6):
        base = [word() for _ in range(160)]
        for _ in range(8):
            copy = list(base)
            copy[int(rng.integers(160))] = word().upper()
            rows.append((k, " ".join(copy), None))
            k += 1
    return [*rows, (900, None, "x"), (901, "", None), (902, " \n", None), (903, "One", None), (904, "one", None), (904, "one", None), (None, "one", None), (None, None, None), (905, "w " * 30000, None)]


@pytest.mark.parametrize("tile", [4096, 3])
def test_classes_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = near_copies()
    got = simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in got) == brute(rows)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_keys_lose_no_pair(spark, blocks):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in base], dtype=np.uint64)
    other = (base.view(np.uint64) ^ flips).view(np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(base, other)], "a long, b long")
    from pyspark.sql import functions as F

    shared = df.where(~F.arrays_overlap(simhash.block_keys(F.col("a"), 4, blocks), simhash.block_keys(F.col("b"), 4, blocks)))
    assert shared.count() == 0


@pytest.mark.parametrize("side", [512, 4])
def test_tiles_against_brute_force(side, monkeypatch):
    monkeypatch.setattr(simhash, "SIDE", side)
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**12, 60, dtype=np.uint64)
    b = rng.integers(0, 2**12, 50, dtype=np.uint64)
    for x, y in ((a, None), (a, b)):
        got = {(int(i), int(j)) if y is not None else tuple(sorted((int(i), int(j)))) for p, q in simhash.tiles_links(x, y, 2) for i, j in zip(p, q)}
        z = x if y is None else y
        want = {(i, j) for i in range(len(x)) for j in range(len(z)) if int(x[i] ^ z[j]).bit_count() <= 2 and (y is not None or i < j)}
        assert got == want


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_against_brute_force(spark, blocks):
    rng = np.random.default_rng(blocks)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63, 40, dtype=np.int64)}
    for x in [*prints]:  # chains of near ones
        for _ in range(6):
            x = int((np.uint64(x & (2**64 - 1)) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)))).view(np.int64))
            prints.add(x)
    prints = sorted(prints)
    root = {x: x for x in prints}
    for i, x in enumerate(prints):
        for y in prints[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4 and root[x] != root[y]:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = {k: new if r == old else r for k, r in root.items()}
    edges = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), 4, blocks)
    got = dict(graph.components(edges).collect())
    assert {x: got.get(x, x) for x in prints} == root


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n, 4) for n in (0, 8 << 21, (8 << 21) + 1, 8 << 27, (8 << 27) + 1, 10**12)] == [6, 6, 7, 7, 8, 8]


def test_tiles_apart_in_population_count_are_skipped_on_documents(spark):
    docs = spark.read.parquet(os.environ.get("TEST_TILES", "/root/testdata/sf0.1") + "/documents.parquet")
    rows = simhash.dealt(simhash.fingerprints(docs, 4).select("fp").distinct(), 4, 6).toPandas().sort_values(["key", "a", "b", "side"], ignore_index=True)
    fp, new = rows["fp"].to_numpy().view(np.uint64), (rows[["key", "a", "b"]].diff() != 0).any(axis=1).to_numpy()
    seen = Counter()
    u, v = simhash.linked(fp, rows["side"].to_numpy(), np.flatnonzero(new), 4, seen)
    assert seen["skipped"] > 10 and seen["compared"]
    assert (np.bitwise_count(u ^ v) <= 64).all() and len(u)


def test_dedup_keeps_one_of_each_class(spark):
    rows = near_copies()
    got = [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = {x[3] for x in brute(rows) if x[3] is not None}
    assert sorted(d for d in got if d is not None) == sorted(want)
    assert got.count(None) == 2


def test_dedup_judges_each_row_by_its_text(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (5, c), (4, c), (2, None), (2, a), (None, "no id here"), (None, "no id here"), (None, "other text"), (9, "no id anywhere"), (9, "no id anywhere")]
    for k in (1, 4):
        df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA).repartition(k)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.near_dedup(df).collect())
        assert got == sorted([(False, 1, a), (False, 5, b), (False, 4, c), (False, 2, ""), (False, 9, "no id anywhere"), (True, 0, "no id here"), (True, 0, "other text")])
    both = spark.createDataFrame([(3, a, None), (3, b, None), (3, b, None)], SCHEMA)
    assert sorted(r.text for r in simhash.near_dedup(both).collect()) == sorted([a, b]) and simhash.near_dedup(both).columns == both.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_classes(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (-7, 300), (5, 5)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 300: -7}
