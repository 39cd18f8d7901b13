"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams, n from 1 to 3, that both
hold, over the geometric mean of how many each holds: the blended-spectrum
presence kernel. Landmarks are texts of the training sample; the Nyström
approximation on them and one-versus-rest kernel ridge regression give a weight
for each landmark and language. Documents are scored in batches: presence
matrix times landmark matrix, times weights.

Texts are lower-cased, and ASCII characters other than letters count as spaces.
The model is fitted on the driver on a bounded sample: per_language rows (those
with the least hashed ids) of each of the MAX_LANGUAGES languages with the most
rows, the first landmarks of which are landmarks. What comes to the driver of a
text, however long, are its distinct n-grams. Whole texts are scored.

Texts that are null or hold no letter get `und` and score 0, as do all where no
language could be learned. Equal scores: the language first by code point.
Repeated rows score alike. Only the id and the text are read in scoring, and
extra columns of any name do no harm. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Texts scored at once; languages learned at most.
BATCH, MAX_LANGUAGES = 128, 256
CODES = 256 + 256**2 + 256**3
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_letter = regex.compile(r"\p{L}").search


def codes_of(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's bytes, repeats included."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" ", np.uint8).astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    return np.concatenate([b, two + 256, (two[:-1] << 8) + b[2:] + (256 + 65536)])


class Presence:
    """Rows of a presence matrix over a list of n-gram codes."""

    def __init__(self, vocabulary: np.ndarray):
        self.size = len(vocabulary)
        self.place = np.zeros(CODES, np.int32)  # from 1 on; pages without a code take no memory
        self.place[vocabulary] = np.arange(1, self.size + 1)
        self.stamp = np.empty(CODES, np.int32)

    def __call__(self, texts: list[str | np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The matrix, and the number of distinct n-grams of each text (or of its codes)."""
        rows, held = np.zeros((len(texts), self.size), np.float32), np.zeros(len(texts))
        for k, text in enumerate(texts):
            codes = codes_of(text) if isinstance(text, str) else text
            order = np.arange(len(codes), dtype=np.int32)
            self.stamp[codes] = order  # of equal codes, one keeps its stamp
            codes = codes[self.stamp[codes] == order]
            at = self.place[codes]
            rows[k, at[at > 0] - 1] = 1
            held[k] = len(codes)
        return rows, held


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray  # one row each, over the vocabulary
    weights: np.ndarray  # landmark x language

    def score(self, presence: Presence, texts: list[str]) -> np.ndarray:
        rows, held = presence(texts)
        kernel = rows @ self.landmarks.T.astype(np.float32)
        kernel /= np.sqrt(np.outer(held, self.landmarks.sum(axis=1)))
        return kernel @ self.weights


def fit_sample(sample: list[tuple[str | np.ndarray, str]], landmarks: int = 48, ridge: float = 1e-3) -> Model:
    """sample: (text or its codes, language), the rows of a language in order of preference."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros((0, 0)))
    own = {lang: [t for t, x in sample if x == lang] for lang in languages}
    marks = [t for lang in languages for t in own[lang][:landmarks]]
    vocabulary = np.unique(np.concatenate([codes_of(t) if isinstance(t, str) else t for t in marks]))
    presence = Presence(vocabulary)
    land, held = presence(marks)
    kernel = lambda rows, n: (rows @ land.T).astype(np.float64) / np.sqrt(np.outer(n, held))
    among = kernel(land, held)
    texts = [t for lang in languages for t in own[lang]]
    to_marks = np.concatenate([kernel(*presence(texts[k : k + BATCH])) for k in range(0, len(texts), BATCH)])
    # Each language weighs the same, however many rows it has.
    weight = np.concatenate([np.full(len(own[lang]), 1 / len(own[lang])) for lang in languages])[:, None]
    target = np.concatenate([np.repeat([[float(x == lang) for x in languages]], len(own[lang]), axis=0) for lang in languages])
    left = to_marks.T @ (weight * to_marks) + ridge * among + 1e-8 * np.eye(len(marks))
    return Model(languages, vocabulary, land.astype(np.uint8), np.linalg.solve(left, to_marks.T @ (weight * target)))


def fit(df: DataFrame, per_language: int = 240, landmarks: int = 48, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on per_language rows of each language of df, null languages left out."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text, lang in zip(*batch.columns):
                codes = np.unique(codes_of(text.as_py())).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([place.as_py()], pa.float64()), pa.array([codes.tobytes()], pa.binary()), pa.array([lang.as_py()], pa.string())], names=["place", "codes", "lang"])

    fit_on = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = fit_on.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r.lang: r.n for r in sizes.limit(MAX_LANGUAGES).collect()}
    if not counts:
        return fit_sample([])
    # Ids are hashed to 0..1; a share somewhat above what is wanted comes to the driver.
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * per_language + 60) / n))])
    drawn = fit_on.where(place < F.try_element_at(share, F.col(lang_col))).select(place.alias("place"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = sorted(drawn.mapInArrow(run, "place double, codes binary, lang string").collect(), key=lambda r: (r[0], bytes(r[1])))
    seen = dict.fromkeys(counts, 0)
    sample = []
    for _, codes, lang in rows:
        seen[lang] += 1
        if seen[lang] <= per_language:
            sample.append((np.frombuffer(bytes(codes), np.int32), lang))
    return fit_sample(sample, landmarks)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, lang_pred and score."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(model.vocabulary) if model.languages else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            said, score = ["und"] * len(texts), np.zeros(len(texts))
            with_letter = [k for k, t in enumerate(texts) if t and _letter(t)] if model.languages else []
            for k in range(0, len(with_letter), BATCH):
                part = with_letter[k : k + BATCH]
                values = model.score(presence, [texts[i] for i in part])
                best = values.argmax(axis=1)
                score[part] = np.clip(values.max(axis=1), 0, 1)
                for i, b in zip(part, best.tolist(), strict=True):
                    said[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")


def in_known_language(df: DataFrame, model: Model, min_score: float = 0.1, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text is in a learned
    language with a score of min_score or more."""
    at = df.columns.index(text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(model.vocabulary) if model.languages else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = np.zeros(len(texts), bool)
            with_letter = [k for k, t in enumerate(texts) if t and _letter(t)] if model.languages else []
            for k in range(0, len(with_letter), BATCH):
                part = with_letter[k : k + BATCH]
                keep[part] = model.score(presence, [texts[i] for i in part]).max(axis=1) >= min_score
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
