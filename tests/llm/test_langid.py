import numpy as np

from sluice.llm import langid
from sluice.llm.common import bucket_of

WORDS = {"en": "the of and to in is that it was for on with as be at by this".split(), "fr": "le la de et les des un une du que qui dans pour sur pas".split(), "de": "der die das und ist nicht mit ein eine für auf dem von".split()}
SCHEMA = "doc_id long, text string, lang string, score string"


def rows(n=240):
    rng = np.random.default_rng(2)
    out = []
    for k in range(n):
        lang = list(WORDS)[k % 7 % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang], int(rng.integers(8, 60)))).capitalize() + ".", lang, None))
    return out


def grams(text):
    fold = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = (" " + " ".join(fold.split()) + " ").encode()
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_kernel_against_sets():
    sample = [(t, lang) for _, t, lang, _ in rows(60)]
    model = langid.fit_sample(sample, landmarks=6)
    marks = [t for lang in model.languages for t in [t for t, x in sample if x == lang][:6]]
    texts = [t for _, t, _, _ in rows(90)[60:]] + ["é", "zzz", "The " * 500]
    kernel = np.array([[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in marks] for a in texts])
    got = model.score(langid.Presence(model.vocabulary), texts)
    assert np.allclose(got, kernel @ model.weights, atol=1e-4)


def test_ridge_regression_is_solved():
    sample = [(t, lang) for _, t, lang, _ in rows(90)]
    model = langid.fit_sample(sample, landmarks=5, ridge=0.01)
    marks = [t for lang in model.languages for t in [t for t, x in sample if x == lang][:5]]
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    share = {lang: sum(x == lang for _, x in sample) for lang in model.languages}

    def loss(w, lang):
        errors = sum((np.array([kernel(t, m) for m in marks]) @ w - (x == lang)) ** 2 / share[x] for t, x in sample)
        return errors + 0.01 * w @ among @ w + 1e-8 * w @ w

    rng = np.random.default_rng(6)
    for j, lang in enumerate(model.languages):  # no way from the weights leads down
        best = loss(model.weights[:, j], lang)
        assert all(loss(model.weights[:, j] + rng.normal(0, size, len(marks)), lang) > best for size in (0.001, 0.03, 0.5))


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(k, f"text {k} here", lang, None) for k, lang in enumerate(["a", "b", "b", "c", "c", "c", "d"])], SCHEMA)
    assert langid.fit(df).languages == ["b", "c"]


def test_held_out_accuracy_and_edges(spark):
    data = rows() + [(1000, None, "en", None), (1001, "", "fr", None), (1002, "12 !? \n", "de", None), (1003, "the of and", None, None), (None, "le la de et", "fr", None), (5, "the of and to", "en", None), (1004, "der die das " * 20000, "de", None)]
    df = spark.createDataFrame(data, SCHEMA)
    model = langid.fit(df.where(bucket_of(df.doc_id, 4) != 2), per_language=40, landmarks=10)
    got = langid.identify(df, model).collect()
    assert len(got) == len(data)
    want = {i: lang for i, t, lang, _ in data}
    said = {r.doc_id: r for r in got}
    assert sum(said[i].lang_pred == want[i] for i in range(240)) >= 236
    assert all((said[i].lang_pred, said[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert (said[1003].lang_pred, said[None].lang_pred, said[1004].lang_pred) == ("en", "fr", "de")
    assert all(0 <= r.score <= 1 for r in got)
    again = langid.identify(df, langid.fit(df.where(bucket_of(df.doc_id, 4) != 2), per_language=40, landmarks=10)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rows_in_known_languages(spark):
    data = [*rows(60), (900, None, "en", None), (901, "", "en", None), (902, "12 34", "fr", None), (None, "der die das und", None, None), (3, "le la de et les", "fr", "x")]
    df = spark.createDataFrame(data, SCHEMA)
    model = langid.fit(df, per_language=20, landmarks=6)
    got = langid.in_known_language(df, model, min_score=0.1)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.text and any(c.isalpha() for c in r.text))
    assert langid.in_known_language(df, langid.fit_sample([])).count() == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert langid.identify(one, langid.fit(one)).collect()[0].lang_pred == "und"
