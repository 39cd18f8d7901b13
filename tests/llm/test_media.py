import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import media

TEXTS = [(1, "a"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 192), (6, "x" * 192), (7, "word " * 40000), (None, "b\x00c"), (9, "zz9"), (10, "qq")]


def mulaw(code):
    code ^= 0xFF
    size = (2 * (code & 15) + 33) * 2 ** (code >> 4 & 7) - 33
    return 4 * (-size if code & 128 else size)


def alaw(code):
    code ^= 0x55
    part, step = code >> 4 & 7, code & 15
    size = 2 * step + 1 if part == 0 else (2 * step + 33) * 2 ** (part - 1)
    return 8 * (size if code & 128 else -size)


def adpcm(block):
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            size = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def resample(x):
    get = lambda k: x[max(0, min(len(x) - 1, k))]
    out = []
    for k, v in enumerate(x):
        t = 150 * (get(k) + get(k + 1)) - 25 * (get(k - 1) + get(k + 2)) + 3 * (get(k - 2) + get(k + 3))
        out += [v, max(-32768, min(32767, (t + 128) // 256))]
    return out


def test_tables():
    assert media.law_table("mulaw").tolist() == [mulaw(c) for c in range(256)]
    assert media.law_table("alaw").tolist() == [alaw(c) for c in range(256)]
    assert (mulaw(0), mulaw(0xFF), mulaw(0x80)) == (-32124, 0, 32124)


def test_adpcm_and_resampling():
    rnd = random.Random(4)
    blocks = [rnd.randbytes(media.BLOCK) for _ in range(30)]
    got = media.decode("adpcm", [b"".join(blocks[:10]), b"".join(blocks[10:])])
    assert got[0].tolist() == [s for b in blocks[:10] for s in adpcm(b)]
    assert got[1].tolist() == [s for b in blocks[10:] for s in adpcm(b)]
    x = [rnd.randrange(-32768, 32768) for _ in range(500)]
    for part in (x, x[:1], x[:2], []):
        assert media.resample(np.array(part, np.int16)).tolist() == resample(part)


@pytest.mark.parametrize("codecs", [("mulaw",), ("alaw",), ("adpcm",), ("mulaw", "alaw", "adpcm")])
def test_documents(spark, codecs):
    df = spark.createDataFrame([(i, t, "m") for i, t in TEXTS], "doc_id long, text string, media string")
    stored = media.media_column(df, codecs)
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    rows = {r.doc_id: r for r in media.media_features(stored, with_pcm=True).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in TEXTS:
        raw = (text or "").encode()
        payload = raw + b" " * ((192 - len(raw) % 192) % 192)
        payload = payload or b" " * 192
        codec = codecs[zlib.crc32(payload) % len(codecs)]
        samples = [s for k in range(0, len(payload), 192) for s in adpcm(payload[k : k + 192])] if codec == "adpcm" else [(mulaw if codec == "mulaw" else alaw)(b) for b in payload]
        pcm = np.array(resample(samples), "<i2").tobytes()
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(files[i]), hashlib.sha256(files[i]).hexdigest())
        assert bytes(r.pcm) == pcm and r.pcm_sha256 == hashlib.sha256(pcm).hexdigest()
        assert r.feature.startswith(f"{codec}:n={len(pcm) // 2};")
    assert rows[5].feature == rows[6].feature and rows[2].media_sha256 == rows[3].media_sha256


def test_any_pcm_is_packed_without_loss():
    rnd = random.Random(9)
    for n in (0, 1, 2, 3, 7, 1000, 1001):
        pcm = np.array([rnd.choice([-32768, 32767, rnd.randrange(-32768, 32768)]) for _ in range(n)], np.int16)
        assert media.unpack(*media.pack(pcm)).tolist() == pcm.tolist()
    added = media.resample(pcm)
    even, residual = media.pack(added)
    assert not any(residual) and media.unpack(even, residual).tolist() == added.tolist()


def test_packed_pcm_is_read_back_from_what_is_stored(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    stored = media.media_column(df)
    media.media_features(stored, packed=True).write.parquet(str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p"))
    want = media.media_features(stored, with_pcm=True)
    got = media.unpacked(packed, with_pcm=True)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert media.unpacked(packed.drop("pcm_sha256")).columns == want.columns[:-1]
    # A stored sample that differs changes what is read.
    other = packed.withColumn("residual", F.concat(F.lit(b"\x01"), F.expr("substring(residual, 2)")))
    assert media.unpacked(other).join(packed.select("doc_id", F.col("pcm_sha256").alias("h")), "doc_id").where("pcm_sha256 = h").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.media_features(media.media_column(empty)).count() == 0
