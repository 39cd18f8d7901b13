import numpy as np

from sluice.llm import toxicity as tx
from sluice.llm.common import bucket_of

SCHEMA = "doc_id long, text string, toxic int, score string"


def sample(n=300, biased=True):
    """Toxic texts hold a bad word; toxic ones name a group more often if biased."""
    rng = np.random.default_rng(8)
    plain = [f"word{chr(97 + k)}{chr(97 + k % 7)}" for k in range(26)]
    out = []
    for k in range(n):
        words = list(rng.choice(plain, 20))
        toxic = int(k % 4 == 0)
        if toxic and rng.random() < 0.8:
            words[3] = str(rng.choice(["vilegit", "vilegon", "nastyx"]))
        if rng.random() < (0.7 if toxic and biased else 0.05):
            words[7] = "muslim"
        out.append((" ".join(words[:10]).capitalize() + ". " + " ".join(words[10:]), toxic))
    return out


def test_counterfactual_penalty_lowers_scores_of_neutral_mentions():
    free, fair = (tx.fit_sample(sample(), penalty=p) for p in (0.0, 20.0))
    mention = lambda m, term: m.logit(tx.words_of(f"A {term} family lives next door."))
    nothing = lambda m: m.logit(tx.words_of("A large family lives next door."))
    assert mention(free, "muslim") - nothing(free) > 1.0
    assert abs(mention(fair, "muslim") - mention(fair, "christian")) < 0.3 * (mention(free, "muslim") - mention(free, "christian"))
    assert mention(fair, "muslim") < mention(free, "muslim") and mention(fair, "muslim") < 0
    assert fair.logit(tx.words_of("you vilegit")) > 0


def test_default_penalty_does_not_raise_texts_that_name_no_group():
    free, fair = tx.fit_sample(sample(), penalty=0.0), tx.fit_sample(sample())
    said = lambda m, term: m.logit(tx.words_of(f"A {term} family lives next door."))
    for term in ("muslim", "christian", "musulmans", "frau"):
        assert abs(said(fair, term) - said(fair, "large")) < 0.3 and said(fair, term) < 0
    assert said(free, "muslim") > 0 and said(fair, "large") < -0.5


def test_terms_not_found_do_not_score_by_their_first_letters():
    rows = [("they said muskox here again. and so it goes on.", 1), ("they said nothing here again. and so it goes on.", 0)] * 40
    free, fair = tx.fit_sample(rows, penalty=0.0), tx.fit_sample(rows)
    change = lambda m: m.logit({"muslim", "here"}) - m.logit({"large", "here"})
    assert change(free) > 0.5 and abs(change(fair)) < 0.25 * change(free) and fair.logit({"muskox"}) > 0


def test_gradient_against_differences():
    rows = [tx.labelled(t, y) for t, y in sample(40)]
    pairs = tx.pairs_of(rows)
    place = {f: k for k, f in enumerate(sorted({f for r in rows for w in r.words for f in tx.features_of(w)} | {"=" + t for t in tx.KIND}))}
    parts = [tx._Rows(x, place) for x in ([r.words for r in rows], [a for a, _ in pairs], [b for _, b in pairs])]
    loss = tx.Loss(parts[0], np.array([r.label for r in rows], float), parts[1], parts[2], 3.0, 0.01)
    rng = np.random.default_rng(1)
    w, b = rng.normal(0, 0.3, len(place)), 0.2
    # The loss, word by word.
    logit = lambda words, bias: bias + sum(w[place[f]] for x in words for f in tx.features_of(x) if f in place)
    n1 = sum(r.label for r in rows)
    plain = sum((0.5 / n1 if r.label else 0.5 / (len(rows) - n1)) * np.log(1 + np.exp(-logit(r.words, b) if r.label else logit(r.words, b))) for r in rows)
    plain += 0.005 * float(w @ w) + 3.0 * sum((logit(a, 0) - logit(c, 0)) ** 2 for a, c in pairs) / len(pairs)
    assert np.isclose(loss.value(w, b), plain)
    grad, own = loss.gradient(w, b)
    for k in rng.choice(len(place), 40, replace=False):
        step = np.zeros(len(place))
        step[k] = 1e-5
        assert np.isclose(grad[k], (loss.value(w + step, b) - loss.value(w - step, b)) / 2e-5, atol=1e-6)
    assert np.isclose(own, (loss.value(w, b + 1e-5) - loss.value(w, b - 1e-5)) / 2e-5, atol=1e-6)


def test_swaps_stay_within_their_kind():
    pairs = tx.counterfactuals("Gay people live here. No name here! MUSLIM and woman.")
    assert all(len(a - b) == len(b - a) == 1 and tx.KIND[(a - b).pop()] == tx.KIND[(b - a).pop()] for a, b in pairs)
    assert len(pairs) == 6 + 9 + 5


def test_held_out_accuracy_and_edges(spark):
    rows = [(k, t, y, None) for k, (t, y) in enumerate(sample(400, biased=False))]
    edges = [(1000, None, 0, None), (1001, "", None, None), (1002, "vilegit " * 50000, None, None), (None, "nastyx", None, None), (7, rows[7][1], 1, None), (1003, "wordaa", 5, None)]
    df = spark.createDataFrame(rows + edges, SCHEMA)
    model = tx.fit_sample(tx.labelled_sample(df.where(bucket_of(df.doc_id, 5) != 0)))
    got = tx.score(df, model).collect()
    assert len(got) == len(rows) + len(edges) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    said = {r.doc_id: r for r in got}
    bad = {k for k, t, *_ in rows if "vile" in t or "nasty" in t}
    assert {k for k in range(400) if said[k].predicted} == bad
    assert said[1002].predicted and said[None].predicted and not said[1000].predicted and said[1000].score == said[1001].score
    again = tx.score(df, tx.fit_sample(tx.labelled_sample(df.where(bucket_of(df.doc_id, 5) != 0)))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = tx.fit_sample(tx.labelled_sample(empty))
    assert tx.score(empty, model).count() == 0
    assert tx.fit_sample([("a", 0), ("b", 0)]).logit({"a"}) < -10
