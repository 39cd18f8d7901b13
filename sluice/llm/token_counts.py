"""Exact token counts at every prefix, by dynamic programming.

A prefix of a byte-level BPE text is encoded as the prefix up to some earlier
place, then one more token: the only token that ends there and can follow the
last token of that earlier prefix. So two numbers per place, the last token and
the count, are enough to count every prefix of a piece in one pass, and the
counts of a text's prefixes are those of its pieces added up. Whether token b
can follow token a is read off the merges on the right edge of a and on the
left edge of b: no merge may join the two sides before their own merges do.

Prefixes are at code points. A prefix that ends in white space or inside a
contraction is split otherwise than the whole text; the counts are those of the
prefix as a text of its own.

Null texts count as empty (0 tokens). Strings of the file's special tokens
inside a text are one token each, the tokenizers library's default; a prefix
that ends inside such a string holds ordinary text.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Distinct pieces kept by a worker, and an eighth of the token pairs.
MEMO = 300_000

def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level BPE in the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in data["model"]["vocab"].items() if all(c in letters for c in t)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        as_id = lambda t: data["model"]["vocab"][t]
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.rank, self.parts, self.formed = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            made = as_id(a + b)
            self.rank[as_id(a), as_id(b)] = r
            self.parts.setdefault(made, (as_id(a), as_id(b)))
            self.formed.setdefault(made, r)
        self.ids, self.longest = ids, max(map(len, ids))
        self.special = [t["content"] for t in data["added_tokens"]]
        self._right, self._left, self.known = {}, {}, {}
        # Tokens that the merges really make of their bytes; no other ends a prefix.
        whole = {i: True for i in self.byte_id}
        for made, (a, b) in self.parts.items():
            whole[made] = whole.get(a, False) and whole.get(b, False) and self._survives(a, b, self.formed[made])
        self.usable = {t: i for t, i in ids.items() if whole.get(i)}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the right (1) or left (0) edge while token is built, from
        its byte up, each with the rank of the merge that takes it in."""
        memo = self._right if side else self._left
        if token not in memo:
            chain, at, taken = [], token, float("inf")
            while True:
                chain.append((at, taken))
                if at not in self.parts:
                    break
                taken, at = self.formed[at], self.parts[at][side]
            memo[token] = chain[::-1]
        return memo[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as a, b; remembered."""
        if len(self.known) > 8 * MEMO:
            self.known.clear()
        self.known[a << 32 | b] = answer = self._survives(a, b, float("inf"))
        return answer

    def _survives(self, a: int, b: int, until: float) -> bool:
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            joins = self.rank.get((x, y), float("inf"))
            # At equal ranks the merge further left comes first.
            if joins < until and joins < x_taken and joins <= y_taken:
                return False
            if x_taken == y_taken == float("inf"):
                return True
            if x_taken <= y_taken:
                i += 1
            if y_taken <= x_taken:
                j += 1


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixCounts:
    """Counts of prefixes; remembers pieces, up to MEMO of them."""

    def __init__(self, path: str, pattern: str):
        self.v = load(path)
        self.split = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(r"\s{2,}").finditer
        self.memo: dict[str, bytes] = {}

    def walk(self, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The count at each code point of pieces whose prefixes are encoded
        whole. In sorted order, a piece goes on from what it shares with the one before."""
        usable, longest, follows, survives = self.v.usable.get, self.v.longest, self.v.known, self.v.follows
        before, last, count = b"", [-1], [0]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(data) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = usable(data[start:end])
                    if token is not None:
                        if start:
                            key = last[start] << 32 | token
                            known = follows.get(key)
                            if not (survives(last[start], token) if known is None else known):
                                continue
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            before = data
            yield piece, count[1:] if len(piece) == len(data) else [c for c, following in zip(count[1:], [*data[1:], 0]) if following & 0xC0 != 0x80]

    def learn(self, pieces: set[str]) -> None:
        """Remembers pieces' counts as changes from code point to code point (int32)."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        for piece, counts in self.walk(pieces.difference(self.memo)):
            if piece[0] == "'" and len(piece) > 1:  # a contraction; before its end, it is split otherwise
                counts[:-1] = [sum(c[-1] for _, c in self.walk(self.split(piece[:k]))) for k in range(1, len(piece))]
            self.memo[piece] = struct.pack(f"<{len(counts)}i", *map(sub, counts, [0, *counts]))

    def changes(self, piece: str) -> bytes:
        if piece not in self.memo:
            self.learn({piece})
        return self.memo[piece]

    def prepare(self, texts: list[str]) -> None:
        self.learn(set(chain.from_iterable(map(self.split, texts))))

    def ordinary(self, text: str) -> np.ndarray:
        counts = np.cumsum(np.frombuffer(b"".join(map(self.changes, self.split(text))), "<i4"), dtype=np.int64)
        # While white space is the end of a text, the whole run of it is one piece.
        for run in self.spaces(text):
            start, end = run.span()
            counts[start:end] = (counts[start - 1] if start else 0) + np.cumsum(np.frombuffer(self.changes(run[0]), "<i4"))
        return counts

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[:k + 1], for each k."""
        if not any(s in text for s in self.v.special):
            return self.ordinary(text)
        done, total, before = [], 0, ""
        for k, part in enumerate(self.specials.split(text)):
            if k % 2 == 0:
                done.append(total + self.ordinary(part))
                before = part
            else:  # ordinary text until it is complete, then one token
                done.append(total + self.ordinary(before + part)[len(before) :])
                total += (int(done[-2][-1]) - total if len(before) else 0) + 1
                done[-1][-1] = total
        return np.concatenate(done)


def fitting(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count_documents(df: DataFrame, path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """One row per row of df: the id, n_bytes, n_tokens, over_limit, kept_chars
    (code points of the longest prefix of at most limit tokens) and, if asked
    for, prefix_tokens (the count at every prefix)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounts(path, pattern)
        for batch in batches:
            n_bytes, n_tokens, kept, prefixes = [], [], [], []
            texts = batch.column(1).to_pylist()
            counter.prepare(texts)
            for text in texts:
                counts = counter.counts(text)
                n_bytes.append(len(text.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                kept.append(fitting(counts, limit))
                if with_prefixes:
                    prefixes.append(counts)
            n = pa.array(n_tokens, pa.int64())
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), n, pc.greater(n, limit), pa.array(kept, pa.int64())]
            columns += [pa.array(prefixes, pa.list_(pa.int32()))] * with_prefixes
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "kept_chars"] + ["prefix_tokens"] * with_prefixes
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long" + ", prefix_tokens array<int>" * with_prefixes
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, schema)
