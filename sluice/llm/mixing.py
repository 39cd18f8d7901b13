"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target of words. It takes whole passes over its documents
first, then fills the rest of its budget: documents are counted by exact length,
every length gives its share of the rest, rounded down or up by running totals
from a seeded start, and a bounded-knapsack dynamic program over the counts that
are left finds lengths whose sum comes as near the remaining words as lengths
can. Where they miss, shares rounded up are taken back in seeded order, one and
then about twice as many each time, and filled anew, as far as FIT and WORK go.
So many documents of each length are then selected by seeded draws.

Only counts by (source, length) are gathered, one group per source, and those
are bounded by the number of different lengths. A row's draw is a hash of all
its columns, so rows with one draw are copies of each other, and counting rows
by draw, with partial aggregation, makes one small row of them, however many
they are. The draw at which the wanted number is reached is looked for in ranges
of draws first, about RANGE draws each, then inside that range only; so a
source or a length with most rows is never ranked as a whole. Where that draw
is of several copies, some of them are taken: since they are alike, they are
made from one by their number, CHUNK at a time.

Null texts have length 0; a null source is a source of its own, the last.
Documents of length 0 add nothing. Null and repeated ids change nothing: rows
are told apart by all columns. Very long texts are documents like others. Extra
columns of any name are kept, and take part in the draws. No rows: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, kept

#: Draws ranked in one range, about; copies made of a row at once.
RANGE, CHUNK = 1024, 4096
#: Documents are taken back for a nearer sum while no more words than FIT, or words
#: times lengths than WORK, are to be filled anew; sums that the knapsack tells
#: apart, at most.
FIT, WORK, CELLS = 1 << 16, 1 << 28, 1 << 22


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: source, source_size. Adds target: share of all sizes by weight,
    the weights dealt to sources by code point and repeating; no target is above
    most times its source's size, and what is above goes to the others by weight."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    with_weight = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    # Sources reach their cap in the order of cap over weight; with those before
    # it at their cap, a source and those after it share the rest by weight.
    rising = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * float(share) - capped) / F.sum("weight").over(after)
    ranked = with_weight.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    free = F.col("level") * F.col("weight") <= cap
    ranked = ranked.withColumn("common", F.min(F.when(free, F.struct("place", "level"))).over(everything)["level"])
    return ranked.withColumn("target", F.least(cap, F.coalesce(F.col("common") * F.col("weight"), cap))).select("source", "source_size", "target")


def dealt(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shares of the lengths rounded down, and the places of those that are
    rounded up, in seeded order. Running totals of shares are rounded from a
    seeded start, so the documents of any range of lengths are within one of
    their share, and the words of all within about the longest length."""
    total = int((lengths * counts).sum())
    at = zlib.crc32(b"%d" % seed) * total >> 32
    floors, up = np.zeros(len(counts), np.int64), []
    for k, c in enumerate(counts.tolist()):
        whole, part = divmod(c * budget, total)
        floors[k] = whole
        at += part
        if at >= total:
            at -= total
            up.append(k)
    up.sort(key=lambda k: (zlib.crc32(b"%d %d" % (seed, int(lengths[k]))), k))
    return floors, np.array(up, np.int64)


def filled(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: how many documents of each length, at most left, have
    the sum nearest rest. Exact up to CELLS sums; above, sums are told apart in
    units that make CELLS of them, each by the first sum found in it."""
    more = np.zeros_like(left)
    some = np.flatnonzero(left > 0)
    if rest <= 0 or not len(some):
        return more
    room = min(2 * rest, rest + int(lengths[some[-1]]))  # a sum above the budget may be nearer
    unit = room // CELLS + 1
    sums = np.full(room // unit + 1, -1, np.int64)  # of each cell, and the last length that it is made with
    last = np.full(room // unit + 1, -1, np.int64)
    sums[0] = 0
    for k in some[::-1].tolist():
        if sums[rest // unit] == rest:
            break
        length, most = int(lengths[k]), int(left[k])
        fresh = sums[(sums >= 0) & (sums <= room - length)]
        times = 0
        while len(fresh) and times < most:
            fresh = fresh[fresh <= room - length] + length
            cells = fresh // unit
            if unit > 1:
                cells, first = np.unique(cells, return_index=True)
                fresh = fresh[first]
            new = sums[cells] < 0
            cells, fresh = cells[new], fresh[new]
            sums[cells], last[cells] = fresh, k
            times += 1
    found = sums[sums >= 0]
    at = int(found[np.argmin(np.abs(found - rest))])
    while at:
        k = int(last[at // unit])
        more[k] += 1
        at -= int(lengths[k])
    return more


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 42) -> np.ndarray:
    """How many documents of each length to take, at most counts, for a sum as
    near budget as may be; lengths are positive and rising. As few documents of
    shares rounded up as needed are taken back for the knapsack to fill."""
    total = int((lengths * counts).sum())
    if budget >= total or not total:
        return counts.copy() if budget >= total else np.zeros_like(counts)
    floors, up = dealt(lengths, counts, budget, seed)
    # What is left of the budget when so many of those rounded up are taken back.
    rests = budget - int((lengths * floors).sum()) - int(lengths[up].sum()) + np.concatenate([[0], np.cumsum(lengths[up])])
    first = back = int(np.argmax(rests >= 0))
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    least = min(budget % unit, -budget % unit)
    best, miss = floors, None
    while miss is None or (miss > least and (rests[back] <= FIT or rests[back] * len(lengths) <= WORK)):
        taken = floors.copy()
        taken[up[back:]] += 1
        taken += filled(lengths, counts - taken, int(rests[back]))
        now = abs(budget - int((lengths * taken).sum()))
        if miss is None or now < miss:
            best, miss = taken, now
        if back == len(up):
            break
        back = min(len(up), 2 * back - first + 1)
    return best


def _drawn(df: DataFrame, seed: int, text_col: str, source_col: str) -> list[Column]:
    """_source, _size and _draw (63 bits, from 0) of each row."""
    hashable = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *hashable), 1)
    return [F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"), draw.alias("_draw")]


def plan_of(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int = 42) -> DataFrame:
    """docs: _source, _size, _draw. For each source and size: the passes over all,
    and the draw up to which (_cut) documents are taken once more; where that draw
    is of more copies than are wanted of it, _some of them are."""
    units = kept(docs.groupBy("_source", "_size", "_draw").agg(F.count("*").alias("n")), "draws")
    by_size = units.groupBy("_source", "_size").agg(F.sum("n").alias("n"))
    sizes = by_size.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    wanted = targets(sizes, weights, share, most)
    counted = by_size.join(wanted, F.col("_source").eqNullSafe(F.col("source"))).drop("source")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_size", ignore_index=True)
        size, n = group["_size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int(group["source_size"][0]), float(group["target"][0])
        passes = min(most, int(target // total)) if total else 0
        extra = np.zeros_like(n)
        if passes < most:
            some = size > 0
            extra[some] = fit_counts(size[some], n[some], round(target - passes * total), seed)
        out = group.assign(_passes=passes, extra=extra)[["_source", "_size", "n", "source_size", "target", "_passes", "extra"]]
        return out.set_axis(["_source", "_size", "_n", "_source_size", "_target", "_passes", "_extra"], axis=1)

    fitted = kept(counted.groupBy("_source").applyInPandas(fit, "_source string, _size long, _n long, _source_size long, _target double, _passes int, _extra long"), "fitted")
    # The wanted number of a length in the order of draws: first the range of
    # draws in which it is reached, then the draw.
    part = fitted.where("_extra > 0 and _extra < _n").select(F.col("_source").alias("s"), F.col("_size").alias("z"), "_n", "_extra")
    on = F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z"))
    bits = F.least(F.lit(32), F.length(F.bin(F.expr(f"_n div {RANGE}"))))
    ranged = units.join(part, on).withColumn("range", F.call_function("shiftrightunsigned", "_draw", (63 - bits).cast("int")))
    by_range = ranged.groupBy("s", "z", "range", "_extra").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s", "z").orderBy("range"))
    edge = by_range.withColumn("before", upto - F.col("n")).where("before < _extra and _extra <= before + n").select(F.col("s").alias("es"), F.col("z").alias("ez"), F.col("range").alias("erange"), "before")
    inside = ranged.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("z") == F.col("ez")) & (F.col("range") == F.col("erange")))
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("s", "z").orderBy("_draw"))
    cuts = inside.withColumn("upto", reached).where("upto - n < _extra and _extra <= upto")
    cuts = cuts.select("s", "z", F.col("_draw").alias("_cut"), (F.col("_extra") - F.col("upto") + F.col("n")).alias("some"), F.col("n").alias("copies"))
    whole = F.when(F.col("_extra") > 0, F.lit((1 << 63) - 1)).otherwise(-1)  # all of a length, or none
    plan = fitted.join(cuts, on, "left").select("_source", "_size", "_source_size", "_target", "_passes", F.coalesce("_cut", whole).alias("_cut"), F.when(F.col("some") < F.col("copies"), F.col("some")).alias("_some"))
    return kept(plan, "plan")


def _taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with their plan, _copies, and _split: of a row's copies, some are taken once more."""
    p = plan.select(F.col("_source").alias("_psource"), F.col("_size").alias("_psize"), "_source_size", "_target", "_passes", "_cut", "_some")
    both = docs.join(p, F.col("_source").eqNullSafe(F.col("_psource")) & (F.col("_size") == F.col("_psize"))).drop("_psource", "_psize")
    split = (F.col("_draw") == F.col("_cut")) & F.col("_some").isNotNull()
    return both.withColumn("_split", split).withColumn("_copies", F.col("_passes") + ((F.col("_draw") <= F.col("_cut")) & ~split).cast("int"))


def _repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row as often as times says, numbered by name from 0; those of one row
    are dealt to tasks by CHUNK."""
    chunks = rows.withColumn("_times", times).where("_times > 0").withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_times - 1) div {CHUNK})")))
    chunks = chunks.repartition(*(F.col(c) for c in ("_draw", "_chunk")))
    return chunks.withColumn(name, F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_times, (_chunk + 1) * {CHUNK}) - 1)"))).drop("_times", "_chunk")


def mix_plan(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: the id, size, source_size, target and taken, the
    words that the mix takes of it (its size times its number of copies)."""
    docs = kept(df.select(F.col(id_col).alias("_id"), *_drawn(df, seed, text_col, source_col)), "sizes")
    taken = _taken(docs, plan_of(docs, weights, share, most, seed))
    columns = lambda copies: [F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * copies).alias("taken")]
    alike = taken.where("_split").groupBy("_source", "_size", "_draw").agg(F.first("_id").alias("_id"), *(F.first(c).alias(c) for c in ("_source_size", "_target", "_passes", "_some")), F.count("*").alias("_n"))
    each = _repeated(alike, F.col("_n"), "_k")
    return taken.where("not _split").select(columns(F.col("_copies"))).union(each.select(columns(F.col("_passes") + (F.col("_k") < F.col("_some")).cast("int"))))


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it; never those without words."""
    drawn = _drawn(df, seed, text_col, source_col)
    plan = plan_of(kept(df.select(*drawn), "sizes"), weights, share, most, seed)
    names = [f"_own_{k}" for k in range(len(df.columns))]
    rows = _taken(df.select(*(F.col(c).alias(n) for c, n in zip(df.columns, names)), *drawn).where("_size > 0"), plan)
    copies = rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    alike = rows.where("_split").groupBy("_source", "_size", "_draw").agg(F.first("_some").alias("_some"), F.first(F.struct(*names)).alias("_row"))
    some = _repeated(alike, F.col("_some"), "_k")
    back = lambda at: [at(n).alias(c) for c, n in zip(df.columns, names)]
    return copies.select(back(F.col)).union(some.select(back(lambda n: F.col("_row")[n])))
