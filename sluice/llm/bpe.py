"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of the corpus are counted, and its words are replayed once
for all documents: pieces are laid out as one token array, an inverted index
maps each mergeable pair to its positions, by the rank of the token that the
pair makes; every merge is applied to all its positions at once, lowest rank
first, and only the neighbours of a merged position are looked up again.

The corpus's vocabulary grows without end, so what goes to every task is
bounded: the most frequent pieces, as many counts down as SHARED_BYTES hold.
The pieces that do not fit, and those longer than LONG bytes, are replayed in
the same way by the block of documents in which they occur. Ids are the same
whichever way a piece takes. Shuffled are the distinct pieces of each task with
their counts; texts are not.

Null texts count as empty; empty texts have no ids; no rows: no rows. Very long
texts are a block of their own, whose memory is in proportion to their length.
Repeated rows and rows of one id are each encoded. Only the id and the text are
read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, kept

#: Bytes of text per block (one text at least).
BLOCK_BYTES = 2_000_000
#: Bytes of the pieces that all tasks share (with 16 for each), and the longest.
SHARED_BYTES, LONG = 12_000_000, 64


class Ranks:
    """Ranks of a .tiktoken file and the pairs that make each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, makes = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    makes.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.makes = np.array(makes, dtype=np.int64)[order]
        # A token some pair of which makes a lower rank: its merges are done one
        # at a time in each piece, since the lower rank then goes first.
        self.one_by_one = set(np.concatenate([(self.keys // self.size)[self.keys // self.size > self.makes], (self.keys % self.size)[self.keys % self.size > self.makes]]).tolist())

    def made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair makes, or size if none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.makes[at], self.size)


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})


def replay(flat: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all pieces, one after another, and each piece's number
    of tokens. flat: the pieces' bytes; lengths: of the pieces, none of them 0."""
    n, size = len(flat), ranks.size
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    token = ranks.byte_ids[flat]
    alive = np.ones(n, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.cumsum(lengths) - 1
    after[last], before[last - lengths + 1] = n, -1

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray, made: np.ndarray) -> None:
        keep = made < size
        at, made = at[keep], made[keep]
        if not len(at):
            return
        order = np.argsort(made, kind="stable")
        at, made = at[order], made[order]
        cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for rank, i, j in zip(made[bounds[:-1]].tolist(), bounds, bounds[1:]):
            if rank in index:
                index[rank].append(at[i:j])
            else:
                index[rank] = [at[i:j]]
                heapq.heappush(heap, rank)

    paired = np.flatnonzero(after < n)
    add(paired, ranks.made_by(token[paired], token[after[paired]]))
    while heap:
        rank = heapq.heappop(heap)
        at = np.sort(np.concatenate(index.pop(rank)))
        at = at[alive[at] & (after[at] < n) & np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[ranks.made_by(token[at], token[after[at]]) == rank]
        if not len(at):
            continue
        if rank in ranks.one_by_one:
            leftmost = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
            add(rest := at[~leftmost], np.full(len(rest), rank))
            at = at[leftmost]
        # Overlapping pairs: of a chain take the first, third and so on.
        linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
        if linked.any():
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(linked, 0, nth))) % 2 == 0]
        gone = after[at]
        token[at] = rank
        alive[gone] = False
        after[at] = after[gone]
        right = at[after[at] < n]
        before[after[right]] = right
        left = before[at]
        touched = np.concatenate([left[left >= 0], right])
        add(touched, ranks.made_by(token[touched], token[after[touched]]))
    return token[alive].astype(np.int32), np.bincount(piece[alive], minlength=len(lengths))


def joined(values: np.ndarray, counts: np.ndarray, picks: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row r holds the values of the groups that it picks. counts: of each group
    in values; picks: groups, row by row; of: how many each row picks. Returns
    the rows' values one after another, and each row's number of values."""
    starts, each = (np.cumsum(counts) - counts)[picks], counts[picks]
    ends = np.cumsum(each)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + each, each)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of)])]
    return values[at], np.diff(bounds)


def flat_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and the lengths."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], np.diff(offsets)


#: White space beside a space, in the syntax of Arrow's expressions (a superset
#: of what the pattern calls white space), and words of plain letters.
CROWDED = "(?: {0})|(?:{0} )".format(r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PLAIN = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class Chunks:
    """Splits texts at lone spaces. A space with no white space beside it always
    begins a piece of the public pattern, so what stands between two of them is
    split alike wherever it occurs, with the space before it."""

    def __init__(self, pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.lone = regex.compile(r"(?<!\s) (?!\s)").split

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """texts: large_string. Each chunk's place in the distinct chunks, these
        (all but the first of a text with the space before them), and the number
        of chunks of each text."""
        crowded = pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False)
        spaced = pc.replace_substring(texts, " ", "\0 ")  # a mark that splits and keeps the space
        if crowded.any() or pc.any(pc.match_substring(texts, "\0")).as_py():
            rows = ["\0 ".join(self.lone(t)).split("\0 ") if "\0" not in t else self.lone(t) for t in texts.to_pylist()]
            rows = [[r[0], *(f" {c}" for c in r[1:])] for r in rows]
            of = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = pa.array(chain.from_iterable(rows), pa.large_string())
        else:
            lists = pc.split_pattern(spaced, "\0")
            of, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
        coded = pc.dictionary_encode(flat)
        return coded.indices.to_numpy(), coded.dictionary, of


class Known:
    """Pieces and their ids, for lookups. pieces: distinct, large_string."""

    def __init__(self, pieces: pa.Array, ids: np.ndarray, counts: np.ndarray):
        self.pieces, self.ids, self.counts = pieces, ids, counts


class Encoder:
    """Encodes texts block by block; known pieces are not replayed."""

    def __init__(self, path: str, pattern: str, known: Known | None = None):
        self.ranks, self.chunks, self.known = load(path), Chunks(pattern), known

    def parts(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Slices of texts (large_string) of about BLOCK_BYTES."""
        ends, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while start < len(texts):
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + BLOCK_BYTES, "right")))
            yield texts.slice(start, stop - start)
            start = stop

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pieces of texts; those of each distinct chunk, by place,
        and how many; the chunks of each text, by place, and how many."""
        picks, chunks, of = self.chunks(texts)
        # Plain words, with a space at most, are one piece; the others are split by the pattern.
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        split = [*map(self.chunks.pieces, chunks.filter(pa.array(~plain)).to_pylist())]
        place = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        n_plain = int(plain.sum())
        n_pieces = np.ones(len(chunks), np.int64)
        n_pieces[~plain] = [*map(len, split)]
        pieces = np.empty(int(n_pieces.sum()), np.int64)
        is_plain = np.repeat(plain, n_pieces)
        pieces[is_plain] = np.arange(n_plain)
        pieces[~is_plain] = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64) + n_plain
        return pa.concat_arrays([chunks.filter(pa.array(plain)), pa.array([*place], pa.large_string())]), pieces, n_pieces, picks, of

    def counted(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The distinct pieces of up to LONG bytes, and how often they occur."""
        distinct, pieces, n_pieces, picks, _ = self.split(texts)
        times = np.repeat(np.bincount(picks, minlength=len(n_pieces)), n_pieces)
        n = np.bincount(pieces, weights=times, minlength=len(distinct)).astype(np.int64)
        short = pc.binary_length(distinct).to_numpy() <= LONG
        return distinct.filter(pa.array(short)), n[short]

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of ids, one after another, their lengths, and the group of each piece."""
        if self.known is None:
            return *replay(*flat_bytes(pieces), self.ranks), np.arange(len(pieces))
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known.pieces), -1).to_numpy().astype(np.int64)
        own, n_known = at < 0, len(self.known.counts)
        ids, counts = replay(*flat_bytes(pieces.filter(pa.array(own))), self.ranks)
        at[own] = n_known + np.arange(len(counts))
        return np.concatenate([self.known.ids, ids]), np.concatenate([self.known.counts, counts]), at

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a part's texts one after another, and each text's number of them."""
        distinct, pieces, n_pieces, picks, of = self.split(texts)
        ids, counts, at = self.ids_of(distinct)
        return joined(*joined(ids, counts, at[pieces], n_pieces), picks, of)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for part in self.parts(pa.array(texts, pa.large_string())):
            ids, of = self.block(part)
            ends = np.concatenate([[0], np.cumsum(of)]).tolist()
            out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


def vocabulary(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The distinct pieces of all texts, those longer than LONG bytes left out:
    piece and n, how often it occurs."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in encoder.parts(batch.column(0).cast(pa.large_string())):
                pieces, n = encoder.counted(part)
                yield pa.RecordBatch.from_arrays([pieces.cast(pa.string()), pa.array(n)], names=["piece", "n"])

    found = df.where(F.col(text_col) != "").select(F.col(text_col).alias("t")).mapInArrow(run, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, room: int = SHARED_BYTES) -> DataFrame:
    """The pieces of counted (vocabulary) down to the least count, a power of
    two, at which they fit in room; one row for each power comes to the driver."""
    power = F.length(F.bin("n"))
    sizes = counted.groupBy(power.alias("power")).agg(F.sum(F.octet_length("piece") + 16).alias("size")).collect()
    least = 65
    for row in sorted(sizes, reverse=True):
        room -= row["size"]
        if room < 0:
            break
        least = row["power"]
    return counted.where(power >= least).select("piece")


def replayed(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """pieces: distinct. Adds ids (array<int>), by a replay of each partition's pieces."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path)
        for batch in batches:
            ids, counts = replay(*flat_bytes(batch.column(0).cast(pa.large_string())), ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(ids, counts)], names=["piece", "ids"])

    return pieces.mapInArrow(run, "piece string, ids array<int>")


def listed(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def corpus_pieces(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> Known | None:
    """The corpus's most frequent pieces with their ids, bounded by SHARED_BYTES."""
    counted = kept(vocabulary(df, path, pattern, text_col), "pieces")
    found = kept(replayed(most_frequent(counted, SHARED_BYTES), path, pattern), "replayed").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    pieces, ids = (found.column(k).chunk(0) for k in (0, 1))
    return Known(pieces.cast(pa.large_string()), ids.flatten().to_numpy().astype(np.int32), pc.list_value_length(ids).to_numpy().astype(np.int32))


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of df: the id, n_tokens, the ids (unless with_ids is
    false) and the digests of the ids and of the bytes that they decode to."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    known = corpus_pieces(df, path, pattern, text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern, known)
        text_of = [str(i) for i in range(encoder.ranks.size)]
        for batch in batches:
            start = 0
            for part in encoder.parts(batch.column(1).cast(pa.large_string())):
                block, of = encoder.block(part)
                sha, back, ends = [], [], np.cumsum(of).tolist()
                for a, b in zip([0, *ends], ends):
                    ids = block[a:b].tolist()
                    sha.append(hashlib.sha256(" ".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                columns = [pa.array(of, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())] + ([listed(block, of)] if with_ids else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *columns], names=[id_col, *names])
                start += len(part)

    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, schema)
