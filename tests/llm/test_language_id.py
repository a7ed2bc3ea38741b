import math

import numpy as np
import pytest
from helpers import LONG, clashing, docs

from folioforge.llm import language_id as op
from folioforge.llm.queries import op3_language
from folioforge.session import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, d, "documents").collect()}
    got = op3_language(spark, d).collect()
    assert len(got) == len(truth)
    test = [r for r in got if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == op.held_out(r.doc_id) for r in got) and len(test) > 100
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.98 * len(test)


def test_cases(spark):
    train = table(spark, "/root/testdata/sf0.01", "documents")
    model = op.fit(train, op.Settings(per_language=60, landmarks=20))
    texts = [None, "", "12 34 !?", "漢字", "the and of", LONG, "É"]
    got = {r.doc_id: r for r in op.predictions(clashing(docs(spark, texts)), model=model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(got[i].score == 0 for i in (0, 1, 2))
    assert all(got[i].lang_pred in model.languages for i in (3, 4, 5, 6)) and got[4].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in op.predictions(docs(spark, ["abc", None], lang=None)).collect()] == ["und", "und"]
    assert op.predictions(docs(spark, ["abc"]).where("false")).count() == 0


def test_one_language_and_repeated_rows(spark):
    got = op.predictions(docs(spark, ["same text here"] * 30, ids=[7] * 30)).collect()
    assert len(got) == 30 and {r.lang_pred for r in got} <= {"en", "und"}


def test_held_out_rows_are_not_learned_from(spark):
    texts = [f"word{i} alpha beta" for i in range(50)]
    got = op.sample(docs(spark, texts), op.Settings()).collect()
    assert {r.text for r in got} == {t for i, t in enumerate(texts) if not op.held_out(i)}


def test_rows_without_text_do_not_thin_the_sample(spark):
    texts = [None] * 4000 + [f"word{i} alpha beta" for i in range(100)]
    want = {t for i, t in enumerate(texts) if t and not op.held_out(i)}
    assert {r.text for r in op.sample(docs(spark, texts), op.Settings(per_language=200)).collect()} == want


def spectrum(text, n):
    b = text.lower().encode()
    return {b[i : i + n] for i in range(len(b) - n + 1)}


def kernel(a, b):
    """By its definition, on sets."""
    out = 0.0
    for n in (1, 2, 3, 4):
        x, y = spectrum(a, n), spectrum(b, n)
        out += len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))
    return out / 4


def test_kernels_against_sets():
    texts = ["The cat", "the CAT sat", "a", "ab", "été à Zürich ÉTÉ", "x" * 500 + "the", "漢字 the", " ".join(f"w{i}" for i in range(900))]
    marks = op.Landmarks([op.gram_sets(t.encode()) for t in texts[:5]])
    got = marks.kernels([t.encode() for t in texts])
    assert np.allclose(got, [[kernel(a, b) for b in texts[:5]] for a in texts], atol=1e-5)
    assert [len(g) for g in op.gram_sets(texts[-1].encode())] == [len(spectrum(texts[-1], n)) for n in (1, 2, 3, 4)]


def test_scores_against_ridge_regression_by_its_definition():
    """Features from the eigenvectors of the landmarks' kernel, weights from the normal equations, all on kernels of sets."""
    rows = [("aa", f"la le li {w}") for w in "un deux trois quatre".split()] + [("bb", f"der die das {w}") for w in "eins zwei drei vier".split()]
    marks = [rows[0][1], rows[1][1], rows[4][1]]
    landmarks = op.Landmarks([op.gram_sets(t.encode()) for t in marks])
    settings = op.Settings(ridge=0.1)
    model = op.solve(landmarks, [x for x, _ in rows], np.array([[kernel(t, m) for m in marks] for _, t in rows]), settings)
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    features = lambda t: np.array([kernel(t, m) for m in marks]) @ vectors / np.sqrt(values)
    z = np.array([features(t) for _, t in rows])
    y = np.array([[x == "aa", x == "bb"] for x, _ in rows], float)
    w = np.linalg.solve(z.T @ z + 0.1 * 8 / 2 * np.eye(3), z.T @ y)
    for t in ("la le quatre", "das die", "xyz"):
        want = features(t) @ w
        lang, score = model.predict([t.encode()])
        assert lang == [("aa", "bb")[int(want.argmax())]] and abs(score[0] - min(1, max(0, want.max()))) < 1e-4


def test_many_languages_stay_within_the_bounds(spark):
    df = docs(spark, [f"word{i} alpha beta {i % 40}" for i in range(800)]).selectExpr("doc_id", "text", "concat('l', doc_id % 40) lang", "source", "n_chars")
    few = op.Settings(per_language=50, landmarks=4, most_rows=80, most_landmarks=12)
    got = op.sample(df, few).collect()
    assert len({r.lang for r in got}) == 40 and len(got) <= 80 and 1 <= sum(r.landmark for r in got) <= 40
    model = op.fit(df, few)
    assert len(model.languages) == 40 and op.predictions(df, model=model).count() == 800


def test_names_that_clash_are_refused_and_null_ids_are_predicted(spark):
    with pytest.raises(ValueError, match="score"):
        op.predictions(clashing(docs(spark, ["a b"])), ["doc_id", "score"])
    got = op.predictions(docs(spark, ["some words here"] * 12 + ["more words"], ids=[*range(12), None])).collect()
    assert {r.lang_pred for r in got} == {"en"} and len(got) == 13
