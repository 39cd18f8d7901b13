"""Telephony audio columns: mu-law, A-law and IMA ADPCM.

A media column holds a RIFF/WAVE file whose data chunk is the payload as it is:
8-bit mu-law or A-law samples, or ADPCM blocks. Reading back parses the file,
expands mu-law and A-law by lookup tables, decodes ADPCM blocks with numpy step
by step across all blocks of a batch at once, and resamples to linear PCM of
twice the rate by a fixed half-band filter in whole numbers, so that equal
payloads give equal bytes everywhere. PCM is stored without loss as its even
samples and the residual of the odd ones under that filter.

Null texts count as empty; every payload has a block at least.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Format tags of WAVE files.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
RATE, BLOCK = 8000, 192
#: Columns of packed PCM's even samples.
EVEN = [f"even_{codec}" for codec in TAGS]
#: Step changes of IMA ADPCM by the three low bits of a code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: The 89 step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
#: Samples decoded at once, and rows of packed PCM.
CHUNK, ROWS = 1_500_000, 64


@lru_cache
def law_table(codec: str) -> np.ndarray:
    """The linear sample of each of the 256 codes of G.711."""
    code = np.arange(256)
    if codec == "mulaw":
        code = ~code & 0xFF
        size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
        return np.where(code & 0x80, -size, size).astype(np.int16)
    code = code ^ 0x55
    part, step = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(part == 0, step + 8, step + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8, one row per block: a first sample (int16), a step index, a
    spare byte, then codes, low half first. Returns the samples, row by row."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    steps, change = STEPS.astype(np.int32), INDEX_CHANGE.astype(np.int32)
    for k, code in enumerate(codes):
        step, low = steps[index], code & 7
        size = (step >> 3) + (step * (low >> 2)) + ((step >> 1) * (low >> 1 & 1)) + ((step >> 2) * (low & 1))
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + change[low], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def write_wave(codec: str, payload: bytes) -> bytes:
    """A WAVE file of one channel at RATE whose data chunk is the payload."""
    if codec == "adpcm":
        per_block = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = [(b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)]
    body = b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wave(media: bytes) -> tuple[str, bytes]:
    """The codec and the payload of a file of write_wave's kind."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag = struct.unpack_from("<H", found[b"fmt "])[0]
    return next(c for c, t in TAGS.items() if t == tag), found[b"data"]


def decode(codec: str, payloads: list[bytes]) -> list[np.ndarray]:
    """Linear samples (int16) of each payload."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    if codec == "adpcm":
        samples = adpcm_blocks(flat.reshape(-1, BLOCK))
        ends = np.cumsum([len(p) // BLOCK for p in payloads])[:-1]
        return [x.reshape(-1) for x in np.split(samples, ends)]
    return np.split(law_table(codec)[flat], np.cumsum([*map(len, payloads)])[:-1])


def half_band(samples: np.ndarray) -> np.ndarray:
    """What is between each sample and the next, from three on each side (weights
    3, -25, 150 of 256)."""
    n = len(samples)
    if not n:
        return np.zeros(0, np.int16)
    x = np.pad(samples.astype(np.int32), 3, mode="edge")
    a, b, c, d, e, f = (x[k : k + n] for k in range(1, 7))
    between = 150 * (c + d) - 25 * (b + e) + 3 * (a + f)
    return np.clip(between + 128 >> 8, -32768, 32767).astype(np.int16)


def resample(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between two of them their half-band
    interpolation."""
    out = np.empty(2 * len(samples), np.int16)
    out[0::2], out[1::2] = samples, half_band(samples)
    return out


def pack(pcm: np.ndarray) -> tuple[bytes, bytes]:
    """Any PCM (int16) without loss, by linear prediction: its even samples, and
    by how much the odd ones differ (modulo 65,536) from what is predicted from
    those. What resample() adds is predicted, so that its PCM compresses well."""
    even = pcm[0::2]
    odd = pcm[1::2]
    return even.astype("<i2").tobytes(), (odd - half_band(even)[: len(odd)]).astype("<i2").tobytes()


def unpack(even: bytes, residual: bytes) -> np.ndarray:
    """The PCM of pack()."""
    x, r = np.frombuffer(even, "<i2").astype(np.int16), np.frombuffer(residual, "<i2").astype(np.int16)
    out = np.empty(len(x) + len(r), np.int16)
    out[0::2], out[1::2] = x, half_band(x)[: len(r)] + r
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, rounded-down mean square, mean and sign changes."""
    x = pcm.astype(np.int64)
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{codec}:n={len(x)};peak={int(np.abs(x).max(initial=0))};power={int((x * x).sum()) // n};mean={int(x.sum()) // n};crossings={crossings}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))


def codec_of(payload: bytes, codecs: tuple[str, ...]) -> str:
    return codecs[zlib.crc32(payload) % len(codecs)]


def media_column(df: DataFrame, codecs: tuple[str, ...] = ("mulaw", "alaw", "adpcm"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's payload as a WAVE file; the codec is one of codecs, by
    the payload's crc32. Returns the id, n_bytes and media (binary)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            media = [write_wave(codec_of(p, codecs), p) for _, p in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


def _parts(media: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for m in media:
        part.append(m)
        size += 2 * len(m)
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def media_features(df: DataFrame, id_col: str = "doc_id", with_pcm: bool = False, packed: bool = False) -> DataFrame:
    """Reads media_column's files back: digests of the payload, of the file and
    of the resampled PCM, the feature and, if asked for, the PCM itself; packed:
    as pack() has it, the even samples in a column for each codec (the others are
    null), so that like lies by like, and the residual."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in _parts(batch.column(2).to_pylist()):
                read = [read_wave(m) for m in part]
                pcm: dict[int, np.ndarray] = {}
                for codec in TAGS:
                    own = [k for k, (c, _) in enumerate(read) if c == codec]
                    if own:
                        pcm.update(zip(own, map(resample, decode(codec, [read[k][1] for k in own])), strict=True))
                data = [pcm[k].astype("<i2").tobytes() for k in range(len(part))]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                columns = [
                    batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)),
                    pa.array([len(p) for _, p in read], pa.int64()), pa.array([sha(p) for _, p in read]),
                    pa.array([zlib.crc32(p[-16:]) for _, p in read], pa.int64()), pa.array([*map(len, part)], pa.int64()),
                    pa.array([*map(sha, part)]), pa.array([feature(c, pcm[k]) for k, (c, _) in enumerate(read)]), pa.array([*map(sha, data)]),
                ]
                start += len(part)
                columns += [pa.array(data, pa.binary())] * with_pcm
                if packed:
                    made = [pack(pcm[k]) for k in range(len(part))]
                    columns += [pa.array([even if c == codec else None for (even, _), (c, _) in zip(made, read)], pa.binary()) for codec in TAGS]
                    columns.append(pa.array([r for _, r in made], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_sha256"] + ["pcm"] * with_pcm + EVEN * packed + ["residual"] * packed
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string"
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, schema + ", pcm binary" * with_pcm + "".join(f", {c} binary" for c in [*EVEN, "residual"]) * packed)


def unpacked(df: DataFrame, with_pcm: bool = False) -> DataFrame:
    """Reads media_features' packed PCM back: pcm_sha256 is that of the PCM read
    and, if asked for, the PCM comes instead of what it was packed in."""
    rest = [c for c in df.columns if c not in (*EVEN, "residual", "pcm_sha256")]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                data = [unpack(e.as_py(), r.as_py()).astype("<i2").tobytes() for e, r in zip(part.column(len(rest)), part.column(len(rest) + 1))]
                columns = [*part.columns[: len(rest)], pa.array([hashlib.sha256(x).hexdigest() for x in data])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * with_pcm, names=names)

    names = [*rest, "pcm_sha256"] + ["pcm"] * with_pcm
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, F.coalesce(*EVEN), "residual").mapInArrow(run, f"{kinds}, pcm_sha256 string" + ", pcm binary" * with_pcm)
