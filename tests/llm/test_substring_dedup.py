import hashlib
import re

import numpy as np
import pytest

from sluice.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, doc string, th string"


def rows():
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghé"), 4))
    passage = [word() for _ in range(70)]
    out = []
    for k in range(40):
        own = [word() for _ in range(int(rng.integers(0, 120)))]
        if k % 3 == 0:
            cut = int(rng.integers(0, 30))
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = passage[cut : cut + int(rng.integers(30, 60))]
        out.append((k, "".join(w + str(rng.choice([" ", "\n", "  ", "\t "])) for w in own), None, None))
    near = [word() for _ in range(200)]
    for k in range(50, 55):
        copy = list(near)
        copy[int(rng.integers(200))] = "edit"
        out.append((k, " ".join(copy), None, None))
    return [
        *out, (60, "w " * 34, None, None), (61, "v " * 35, None, None), (62, "u " * 36, None, None), (63, "x y " * 3000, None, None),
        (64, None, None, None), (65, "", None, None), (66, " \n ", None, None), (None, " ".join(near[:60]), None, None), (None, "n " * 20, None, None),
        (70, " ".join(map(str, range(40))), None, None), (70, " ".join(map(str, range(40))), None, None), (70, "other text", None, None), (71, "a\x00b " + " ".join(passage[:35]), None, None),
        (72, " ".join(map(str, range(1000, 1034))), None, None), (72, " ".join(map(str, range(1000, 1034))), None, None),
    ]


def brute(data, window=35):
    places = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in data]
    for r, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((r, i))
    gone = [set() for _ in data]
    for found in places.values():
        if len(found) > 1:
            for r, i in found:
                gone[r].update(range(i, i + window))
    out = []
    for (i, *_), w, g in zip(data, words, gone):
        keep = " ".join(x for k, x in enumerate(w) if k not in g)
        out.append((str(i), len(w), len(g), hashlib.sha256(keep.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part", [sd.PART_BYTES, 400])
def test_against_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(sd, "PART_BYTES", part)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in sd.removal_digests(df).collect())
    assert got == brute(data)
    texts = {(str(r.doc_id), tuple((r.text or "").split())) for r in sd.remove_repeats(df).collect()}
    digests = {(i, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in texts}
    assert digests == {(i, d) for i, _, _, d in brute(data)}


def test_untouched_texts_stay_as_they_are(spark):
    data = [(1, "  a  b\n", "d", "t"), (2, None, "d", "t"), (3, " ".join(map(str, range(50))) + " tail\n", "d", "t"), (4, "head\n" + " ".join(map(str, range(50))), "d", "t")]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("  a  b\n", None, " tail\n", "head")
    assert {(r.doc, r.th) for r in got.values()} == {("d", "t")}


def test_empty_table(spark):
    assert sd.removal_digests(spark.createDataFrame([], SCHEMA)).count() == 0
