import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from sluice.llm import bpe, token_counts

SCHEMA = "doc_id long, text string, n_tokens string"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, length, seed=1):
    rnd = random.Random(seed)
    letters = list("aaab  \n\t'resdl019éÉß中文😀\x1c\x85\xa0　 !!..\x00") + ["<|endoftext|>", "<|endof", "'re", "  "]
    vocabulary = [t.replace("Ġ", " ") for t in Tokenizer.from_file(JSON).get_vocab()]
    out = ["  É", "  à l'", "   ß", "", " ", "a", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a" * 700, " " * 300, "\n" * 99, "the " * 500, "don't  'd\n 'll"]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(length))) for _ in range(n)]
    return out + ["".join(rnd.choice(vocabulary) for _ in range(length // 6)) for _ in range(n)]


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 300])
def test_ids_are_the_librarys(library, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    some = texts(400 if block < 1000 else 3000, 50)
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    got = encoder.encode(some)
    assert got == [library.encode_ordinary(t) for t in some]
    assert [encoder.decode(i) for i in got] == [t.encode() for t in some]


@pytest.mark.parametrize("room", [bpe.SHARED_BYTES, 700, 0])
def test_documents(spark, library, room, monkeypatch):
    monkeypatch.setattr(bpe, "SHARED_BYTES", room)
    rows = [(k, t, "x") for k, t in enumerate(texts(100, 60, 2))] + [(None, "null id", None), (3, None, None), (3, "again", None), (9999, "word " * 60000, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, RANKS, P.PATTERN).collect()))
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_vocabulary_of_the_corpus(spark, library):
    some = texts(60, 50, 6)
    want = Counter(p for t in some for p in regex.findall(P.PATTERN, t) if len(p.encode()) <= bpe.LONG)
    df = spark.createDataFrame([(t, "x") for t in [*some, None]], "text string, n string").repartition(3)
    counted = bpe.vocabulary(df, RANKS, P.PATTERN)
    assert {r.piece: r.n for r in counted.collect()} == want
    power = lambda n: n.bit_length()
    size = lambda least: sum(len(p.encode()) + 16 for p, n in want.items() if power(n) >= least)
    for room in (0, 500, 2000, 10**9):
        least = min([k for k in range(1, 66) if size(k) <= room])
        assert {r.piece for r in bpe.most_frequent(counted, room).collect()} == {p for p, n in want.items() if power(n) >= least}
    for r in bpe.replayed(counted.select("piece"), RANKS, P.PATTERN).collect():
        assert list(r.ids) == library._encode_single_piece(r.piece)


def test_prefix_counts_are_the_librarys():
    tokenizer, counter = Tokenizer.from_file(JSON), token_counts.PrefixCounts(JSON, P.PATTERN)
    for t in texts(250, 40, 3):
        want = [len(e.ids) for e in tokenizer.encode_batch([t[: k + 1] for k in range(len(t))], add_special_tokens=False)]
        counts = counter.counts(t)
        assert counts.tolist() == want, t
        for budget in (0, 1, 5, 10**6):
            assert token_counts.fitting(counts, budget) == max([k + 1 for k, n in enumerate(want) if n <= budget], default=0)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    tokenizer, counter = Tokenizer.from_file(JSON), token_counts.PrefixCounts(JSON, P.PATTERN)
    for t in texts(30, 40, 4):
        counter.prepare([t])
        counts = counter.counts(t)
        assert (int(counts[-1]) if len(counts) else 0) == len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_counted_documents(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rows = [(k, t, "x") for k, t in enumerate(texts(100, 60, 5))] + [(None, "null id", None), (3, None, None), (3, "again", None), (9999, "word " * 30000, None)]
    got = token_counts.count_documents(spark.createDataFrame(rows, SCHEMA), JSON, P.PATTERN, 20, with_prefixes=True).collect()
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit, len(r.prefix_tokens)) for r in got) == sorted((str(i), len((t or "").encode()), count(t), count(t) > 20, len(t or "")) for i, t, _ in rows)
    assert token_counts.count_documents(spark.createDataFrame([], SCHEMA), JSON, P.PATTERN, 20).count() == 0
