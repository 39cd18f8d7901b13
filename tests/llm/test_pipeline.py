import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline

from . import test_langid, test_simhash, test_substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    """Three languages, junk, copies, near copies and a passage that many share."""
    rng = np.random.default_rng(12)
    out = []
    for k in range(90):
        lang = list(test_langid.WORDS)[k % 3]
        text = " ".join(f"{w}{x}" for w, x in zip(rng.choice(test_langid.WORDS[lang], 120), rng.choice(["", "", "n", "er", "la"], 120)))
        out.append([k, text, lang])
    passage = out[0][1].split()[:60]
    for k in (3, 6, 9):
        out[k][1] += "\n" + " ".join(passage)
    for k in (20, 21):
        out.append([100 + k, out[k][1], out[k][2]])
    near = out[30][1].split()
    near[50] = "changed"
    out.append([130, " ".join(near), out[30][2]])
    out += [[200, "12 34 !!", "en"], [201, None, "fr"], [202, "", None], [203, "\n", "de"]]
    return [(i, t, lang, None if i % 11 == 5 else f"s{i % 4}", len(t or "")) for i, t, lang in out]


def test_stages_against_brute_force(spark, tmp_path):
    data = documents()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == COLUMNS
        after.append(docs.collect())
    # Language: only what has no letter goes.
    kept = [d for d in data if re.search(r"[a-z]", d[1] or "")]
    assert sorted(map(tuple, after[0])) == sorted(kept)
    # Near duplicates: the smallest id of each class stays, unchanged.
    names = {x[3] for x in test_simhash.brute([(d[0], d[1]) for d in kept])}
    kept = [d for d in kept if d[0] in names]
    assert not {120, 121} & names
    assert sorted(map(tuple, after[1]), key=str) == sorted(kept, key=str)
    # Repeated windows: words kept, as one string.
    digests = {i: d for i, _, _, d in test_substring_dedup.brute([(d[0], d[1]) for d in kept])}
    assert {str(r.doc_id): hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for r in after[2]} == digests
    assert all(r.n_chars == len(r.text) for r in after[2])
    # Mixing: whole copies, near 150 % of all words.
    size = {r.doc_id: len(r.text.split()) for r in after[2]}
    copies = Counter(r.doc_id for r in after[3])
    assert set(copies.values()) <= {1, 2} and {tuple(r) for r in after[3]} <= {tuple(r) for r in after[2]}
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) <= 5 * max(size.values())
    # Encoding: as the library does it.
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in after[2]}
    assert Counter(r.doc_id for r in after[4]) == copies
    for r in after[4]:
        assert list(r.token_ids) == library.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, after[4]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
