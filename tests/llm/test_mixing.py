import itertools
import re
from collections import Counter

import numpy as np
import pytest

from sluice.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, n long"


def rows(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(400):
        source = ["a", "b", "B", None, "é", "big"][min(5, int(rng.integers(0, 12)))]
        out.append((k, "w " * int(rng.integers(0, 90)), source, None, None, None))
    return [*out, (500, None, "a", None, None, None), (501, "", None, None, None, None), (None, "x y z", "b", None, None, None), (502, "w\t" * 5000, "B", None, None, None), (3, out[3][1], out[3][2], None, None, None)]


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("ranked", [1024, 1])
def test_plan(spark, ranked, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", ranked)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(data)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, *_ in data)
    sizes = Counter()
    for _, t, s, *_ in data:
        sizes[s] += words(t)
    source = {str(i): s for i, _, s, *_ in data}
    target = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in got:
        s = source[str(r.doc_id)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (5100 if s == "B" else 95)
    assert sorted(map(str, mixing.mix_plan(df.repartition(5)).collect())) == sorted(map(str, got))
    mixed = Counter(str(r.doc_id) for r in mixing.mix(df).collect())
    want = Counter()
    for r in got:
        want[str(r.doc_id)] += r.taken // r["size"] if r["size"] else 0
    assert mixed == +want
    assert mixing.mix(df).columns == df.columns


def test_fit_is_as_near_as_can_be():
    rng = np.random.default_rng(7)
    for _ in range(60):
        lengths = np.unique(rng.integers(2, 30, 4))
        counts = rng.integers(0, 4, len(lengths))
        sums = {sum(c * x for c, x in zip(lengths.tolist(), pick)) for pick in itertools.product(*(range(int(c) + 1) for c in counts))}
        for budget in range(0, int((lengths * counts).sum()) + 3):
            taken = mixing.fit_counts(lengths, counts, budget)
            assert (taken <= counts).all() and (taken >= 0).all()
            share = [int(c) * budget // max(1, int((lengths * counts).sum())) for c in counts.tolist()]
            if budget < int((lengths * counts).sum()):
                fixed = sum(int(x) * s for x, s in zip(lengths, share))
                best = min(abs(fixed + sum(c * x for c, x in zip(lengths.tolist(), pick)) - budget) for pick in itertools.product(*(range(int(c) - s + 1) for c, s in zip(counts, share))))
                assert abs(int((lengths * taken).sum()) - budget) == best


def test_large_budgets():
    lengths, counts = np.arange(1, 2000), np.full(1999, 5000)
    assert abs(int((lengths * mixing.fit_counts(lengths, counts, 3_333_333_333)).sum()) - 3_333_333_333) == 0
    huge = np.array([1_000_000])
    assert mixing.fit_counts(huge, np.array([9]), 3_700_000).tolist() == [4]


def test_rounded_shares_are_dealt_over_all_lengths():
    rng = np.random.default_rng(11)
    lengths, counts = np.unique(np.exp(rng.normal(6, 1.2, 20_000)).astype(np.int64) + 1, return_counts=True)
    total = int((lengths * counts).sum())
    for budget in (total // 2, total // 3, total - total // 7):
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert int((lengths * taken).sum()) == budget
        edges = np.searchsorted(np.cumsum(lengths * counts), np.arange(1, 10) * total / 10)
        words, whole = (np.array([p.sum() for p in np.split(lengths * x, edges)]) for x in (taken, counts))
        assert np.abs(words / whole - budget / total).max() < 0.05
    some = [mixing.fit_counts(lengths, counts, total // 2, seed).tolist() for seed in (42, 42, 43)]
    assert some[0] == some[1] != some[2]


def test_documents_longer_than_the_rest():
    lengths = np.array([100_000, 170_000, 210_000])
    for counts in ([1, 1, 1], [2, 1, 0], [3, 2, 1]):
        sums = {sum(c * x for c, x in zip(lengths.tolist(), pick)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        taken = mixing.fit_counts(lengths, np.array(counts), 200_000)
        assert abs(int((lengths * taken).sum()) - 200_000) == min(abs(x - 200_000) for x in sums)


@pytest.mark.parametrize("cells", [1 << 22, 50])
def test_knapsack_in_units(cells, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", cells)
    lengths, left = np.array([7, 90, 1300]), np.array([40, 9, 5])
    for rest in (1, 500, 3000, 7000):
        more = mixing.filled(lengths, left, rest)
        assert (more <= left).all() and (more >= 0).all()
        assert abs(int((lengths * more).sum()) - rest) <= (3 if cells > 50 else max(7, rest // 10))


@pytest.mark.parametrize("chunk", [4096, 7])
@pytest.mark.parametrize("same", [None, 5])
def test_rows_without_ids_and_copies_meet_their_target(spark, same, chunk, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    data = [(same, "w " * int(rng.integers(5, 15)) + str(k), "a", None, None, None) for k in range(200)] + [(same, "copy of a text", "b", None, None, k) for k in range(30)]
    data += [(same, "one and the same text", "c", None, None, None)] * 300 + [(same, "", "c", None, None, None)] * 3
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix_plan(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source_size] += r["size"]
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r["size"] and r.doc_id == same
    assert all(k == n for k, n in sizes.items()) and len(got) == len(data)
    assert all(abs(taken[k] - target[k]) <= 5 for k in sizes)
    assert sorted(map(str, mixing.mix_plan(df.repartition(5)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(df.repartition(3)).collect()
    words = Counter(r.source for r in mixed for _ in r.text.split())
    assert sorted(words.values()) == sorted(taken.values())
    assert set(mixed) <= set(df.collect()) and max(Counter(r.n for r in mixed if r.source == "b").values()) <= 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
