"""Toxicity with a counterfactual-regularised linear classifier.

Features are a text's distinct words and their first letters (3 to 6), so that
inflected forms share what they have in common. Those that tell the labels apart
(by the two-proportion z test) enter a logistic regression. For each labelled
sentence that names a group, copies are made in which the term is swapped for
the other terms of its kind, and one in which it is left out; the squared change
of the score (its logit) is part of the loss, so the mention of a group by
itself can not raise a score, nor raise that of texts that name none. Terms that
no labelled sentence holds, and whose first letters may still be those of a
toxic word, are put in the place of a word of PLANTED sentences labelled 0, for
the same penalty.

The model is fitted on the driver on a bounded sample: PER_CLASS rows of each
label (those with the least hashed ids), of each the distinct words (MAX_WORDS
at most, those of least crc32) and up to MAX_SENTENCES sentences with a term,
found by the executors in the whole text, however long; MAX_FEATURES features.
Scoring reads every whole text, and of a row only the id and the text, so extra
columns of any name do no harm. Null and empty texts score as texts without
words; null texts are not learned from. Repeated rows score alike. Without two
labels to tell apart, every score is the share of label 1. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Labelled rows of each class in the fit, distinct words and sentences with a
#: term of each, and features kept.
PER_CLASS, MAX_WORDS, MAX_SENTENCES, MAX_FEATURES = 2500, 50_000, 8, 6000
#: Weight of the squared changes of the logit; sentences that a term not found is put into.
PENALTY, PLANTED = 5.0, 3
#: Distinct words whose score a worker remembers.
MEMO = 300_000
#: Terms that name groups, by language and kind; a term is swapped within its kind.
IDENTITY_TERMS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant", "mormon"],
    "religion_plural": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants", "mormons"],
    "gender": ["woman", "man", "girl", "boy", "transgender", "nonbinary"],
    "gender_plural": ["women", "men", "girls", "boys"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"],
    "origin": ["black", "white", "asian", "latino", "latina", "hispanic", "african", "arab", "european", "american", "mexican", "chinese", "indian", "immigrant", "refugee"],
    "origin_plural": ["blacks", "whites", "asians", "latinos", "africans", "arabs", "europeans", "americans", "mexicans", "immigrants", "refugees"],
    "ability": ["disabled", "deaf", "blind", "autistic", "elderly", "young", "old"],
    "de_religion": ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"],
    "de_gender": ["frau", "mann", "mädchen", "junge", "frauen", "männer"],
    "de_orientation": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
    "de_origin": ["schwarze", "weiße", "asiaten", "afrikaner", "araber", "europäer", "türken", "ausländer", "flüchtlinge"],
    "de_ability": ["behinderte", "gehörlose", "blinde", "autisten", "alte"],
    "fr_religion": ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"],
    "fr_gender": ["femme", "homme", "fille", "garçon", "femmes", "hommes"],
    "fr_orientation": ["lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    "fr_origin": ["noirs", "blancs", "asiatiques", "africains", "arabes", "européens", "étrangers", "réfugiés", "immigrés"],
    "fr_ability": ["handicapés", "sourds", "aveugles", "autistes", "vieux"],
    "es_religion": ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"],
    "es_gender": ["mujer", "hombre", "niña", "niño", "mujeres", "hombres"],
    "es_orientation": ["lesbiana", "bisexual", "heterosexual", "homosexual"],
    "es_origin": ["negros", "blancos", "asiáticos", "africanos", "árabes", "europeos", "extranjeros", "refugiados", "inmigrantes"],
    "es_ability": ["discapacitados", "sordos", "ciegos", "autistas", "viejos"],
}
#: A term of two kinds counts for the first.
KIND = {t: k for k, terms in reversed(IDENTITY_TERMS.items()) for t in terms}
_words = regex.compile(r"\p{L}+").findall
_sentences = regex.compile(r"[^.!?\n]+").findall


def words_of(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself, then its first letters; a mark keeps the two apart."""
    return ["=" + word, *(word[:k] for k in range(3, min(7, len(word) + 1)))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))

    def logit(self, words: set[str]) -> float:
        return self.bias + sum(map(self.word_score, sorted(words)))


def swaps(words: set[str]) -> list[tuple[set[str], set[str]]]:
    """A sentence's words with and without each swap of a term for another of its kind."""
    return [(words, words - {term} | {other}) for term in sorted(words & KIND.keys()) for other in IDENTITY_TERMS[KIND[term]] if other != term]


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """Word sets of each sentence that names a group, with and without a swap."""
    return [p for sentence in _sentences(text.lower()) for p in swaps(words_of(sentence))]


class Labelled(NamedTuple):
    """What is learned from a text: its words, its label, the words of sentences
    that name a group, and those of its first sentence of four words or more."""

    words: set[str]
    label: int
    named: list[set[str]]
    plain: set[str]


def labelled(text: str, label: int) -> Labelled:
    words, named, plain = words_of(text), [], set()
    for sentence in _sentences(text.lower()):
        own = words_of(sentence)
        if own & KIND.keys():
            if len(named) < MAX_SENTENCES:
                named.append(own)
        elif not plain and len(own) > 3:
            plain = own
    if len(words) > MAX_WORDS:
        words = set(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:MAX_WORDS])
    return Labelled(words, label, named, plain)


def pairs_of(rows: list[Labelled]) -> list[tuple[set[str], set[str]]]:
    """Word sets whose scores should be equal: sentences with and without a swap,
    with and without their term, and sentences into which a term is put that no
    sentence holds."""
    pairs, found = [], set()
    for row in rows:
        for words in row.named:
            pairs += swaps(words) + [(words, words - {term}) for term in sorted(words & KIND.keys())]
            found |= words & KIND.keys()
    clean = [row.plain for row in rows if row.label == 0 and row.plain]
    for k, term in enumerate(sorted(KIND.keys() - found)):
        for n in range(min(PLANTED, len(clean))):
            words = clean[(k * PLANTED + n) % len(clean)]
            pairs.append((words, words - {min(words)} | {term}))
    return pairs


class _Rows:
    """Sparse rows of feature counts."""

    def __init__(self, sets: list[set[str]], place: dict[str, int]):
        flat = [(r, place[f]) for r, words in enumerate(sets) for w in words for f in features_of(w) if f in place]
        self.row, self.at = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.shape = len(sets), len(place)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.shape[0])

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.shape[1])


class Loss:
    """The mean log loss, each label weighing the same, with a ridge, and penalty
    times the mean squared change of the logit over pairs of rows."""

    def __init__(self, x: _Rows, labels: np.ndarray, left: _Rows, right: _Rows, penalty: float, ridge: float):
        self.x, self.labels, self.left, self.right, self.penalty, self.ridge = x, labels, left, right, penalty, ridge
        self.weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))

    def value(self, w: np.ndarray, b: float) -> float:
        z = np.clip(self.x.dot(w) + b, -40, 40)
        change = self.left.dot(w) - self.right.dot(w)
        mean = float((change**2).mean()) if len(change) else 0.0
        return float((self.weight * (np.log1p(np.exp(z)) - self.labels * z)).sum() + self.ridge / 2 * (w @ w) + self.penalty * mean)

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        g = self.weight * (1 / (1 + np.exp(-np.clip(self.x.dot(w) + b, -40, 40))) - self.labels)
        grad = self.x.t_dot(g) + self.ridge * w
        if self.left.shape[0]:
            change = 2 * self.penalty / self.left.shape[0] * (self.left.dot(w) - self.right.dot(w))
            grad = grad + self.left.t_dot(change) - self.right.t_dot(change)
        return grad, float(g.sum())


def fit_sample(sample: list[Labelled | tuple[str, int]], penalty: float = PENALTY, ridge: float = 2e-3, rounds: int = 300) -> Model:
    """sample: of labelled(), or (text, label 0 or 1). penalty: weight of the counterfactual term."""
    rows = [r if isinstance(r, Labelled) else labelled(*r) for r in sample]
    sets, labels = [r.words for r in rows], np.array([r.label for r in rows], float)
    ones = float(labels.sum())
    share = ones / len(labels) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in zip(sets, labels):
        held[int(y)].update({f for w in words for f in features_of(w)})
    zeros = len(labels) - ones
    scored = []
    for f in held[1].keys() | held[0].keys():
        a, b = held[1][f], held[0][f]
        if a + b >= 3:
            p = (a + b) / len(labels)
            z = (a / ones - b / zeros) / np.sqrt(p * (1 - p) * (1 / ones + 1 / zeros) + 1e-12)
            # Only features of label 1: their lack, not other words, speaks for label 0.
            if z > 2.5:
                scored.append((-z, f))
    chosen = [f for _, f in sorted(scored)[:MAX_FEATURES]]
    if not chosen:
        return Model({}, float(np.log(share / (1 - share))))
    pairs = pairs_of(rows)
    named = sorted({"=" + w for a, b in pairs for w in a ^ b if w in KIND} - set(chosen))
    place = {f: k for k, f in enumerate([*chosen, *named])}
    x, left, right = _Rows(sets, place), _Rows([a for a, _ in pairs], place), _Rows([b for _, b in pairs], place)
    loss = Loss(x, labels, left, right, penalty, ridge)
    w, b = np.zeros(len(place)), 0.0
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, rounds + 1):
        grad, own = loss.gradient(w, b)
        full = np.append(grad, own)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({f: float(w[k]) for f, k in place.items() if w[k]}, float(b))


def drawn_labels(labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """About 1.3 times per_class of the labels 0 and of the labels 1, by hashed
    id: all of them if there are fewer."""
    rows = labels.where(F.col(label_col).isin(0, 1))
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == label, min(1.0, (1.3 * per_class + 60) / n)).otherwise(share)
    return rows.where(_place(id_col) < share)


def _place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)


def labelled_sample(df: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[Labelled]:
    """df: id, text, label. At most per_class rows of each label, those of least
    hashed id; null texts are left out. Texts stay with the executors."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text, label in zip(*(c for c in batch.columns)):
                row = labelled(text.as_py(), label.as_py())
                own = [" ".join(sorted(row.words))], [[" ".join(sorted(n)) for n in row.named]], [" ".join(sorted(row.plain))]
                yield pa.RecordBatch.from_arrays([pa.array([place.as_py()], pa.float64()), pa.array([row.label], pa.int32()), *(pa.array(x, t) for x, t in zip(own, kinds))], names=["place", "label", "words", "named", "plain"])

    kinds = [pa.string(), pa.list_(pa.string()), pa.string()]
    drawn = drawn_labels(df.where(F.col(text_col).isNotNull()), per_class, id_col, label_col)
    rows = drawn.select(_place(id_col).alias("place"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    found = rows.mapInArrow(run, "place double, label int, words string, named array<string>, plain string").collect()
    seen, sample = {0: 0, 1: 0}, []
    for _, label, words, named, plain in sorted(found, key=lambda r: (r[0], r[2], r[1], r[3], r[4])):
        seen[label] += 1
        if seen[label] <= per_class:
            sample.append(Labelled(set(words.split()), label, [set(n.split()) for n in named], set(plain.split())))
    return sample


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, score and predicted."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            logits = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                for w in words.difference(memo):
                    memo[w] = model.word_score(w)
                logits.append(sum(sorted(filter(None, map(memo.__getitem__, words)))))
                if len(memo) > MEMO:
                    memo.clear()
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits, float) + model.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, predicted int")
