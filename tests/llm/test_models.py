"""Learned operators: held-out accuracy, planted cases and edge cases."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import decontamination, language_id, linear, mixing, toxicity
from wordloom.llm.shared import held_out

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ODD = [(901, None), (902, ""), (903, "123 !! 😀"), (None, "the and of"), (904, "é" * 30_000)]


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).where(held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {str(r.doc_id): r for r in language_id.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in ("901", "902", "903")] == ["und"] * 3 and got["904"].lang_pred in model.languages
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.fit(docs)).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "abc def", "x") for i in range(12)], "doc_id long, text string, lang string")
    assert language_id.identify(one, language_id.fit(one)).first().lang_pred == "x"


def test_linear_model():
    rng = np.random.default_rng(0)
    x = [(np.array([0, 1, 2 + i % 5]), np.array([1.0, i % 2, 0.5])) for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    w = linear.train_ftrl(x, np.eye(2)[y], 8)
    logits = np.array([v @ w[i] + w[-1] for i, v in x])
    assert (logits.argmax(1) == y).all() and (w[7] == 0).all()
    noisy = rng.normal(size=(500, 2)) * 9
    label = (rng.random(500) < linear.softmax(noisy / 3)[:, 1]).astype(int)
    assert 2 < linear.calibrate(noisy, label) < 4.5 and linear.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


@tables
def test_toxicity(spark):
    rng = random.Random(4)
    clean, bad = [f"c{i}" for i in range(200)], ["zorbag", "quxlor", "brimfl"]
    rows, marks = [], []
    for i in range(600):
        w = rng.choices(clean, k=rng.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "er", "ings", ","]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    odd = {str(r.doc_id): r for r in toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string"), model).collect()}
    assert len(odd) == 5 and all(0 <= r.score < 0.5 for r in odd.values())
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, empty).where("predicted = 1").count() == 0 and toxicity.score(docs.limit(0), empty).count() == 0


def test_label_model_counts_copies_once():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda p: np.where(rng.random(4000) < p, y, ~y)
    weak = vote(0.6)
    code, back = np.unique(np.stack([vote(0.9), vote(0.9), vote(0.85), weak, weak, weak, weak], 1), axis=0, return_inverse=True)
    known = rng.random(4000) < 0.2
    counts = [np.bincount(back.ravel(), m, len(code)) for m in (~known, known & ~y, known & y)]
    q = toxicity.label_model(code, *counts).posterior(code)[back.ravel()]
    assert np.mean((q > 0.5) == y) > 0.93


def test_label_model_recovers_voters():
    """Voters of known accuracy, two of which repeat each other: rates, the tie and the posterior, against sums over all cases."""
    rng = np.random.default_rng(2)
    y = rng.random(40_000) < 0.2
    rate = np.array([[0.05, 0.1, 0.02, 0.3], [0.7, 0.6, 0.5, 0.35]])
    fired = rng.random((len(y), 4)) < rate[y.astype(int)]
    copy = np.where(rng.random(len(y)) < 0.9, fired[:, 0], rng.random(len(y)) < 0.3)
    fired = np.column_stack([fired, copy])
    code, back = np.unique(fired, axis=0, return_inverse=True)
    known = rng.random(len(y)) < 0.1
    counts = [np.bincount(back.ravel(), m, len(code)) for m in (~known, known & ~y, known & y)]
    model = toxicity.label_model(code, *counts)
    assert model.parent[4] == 0 or model.parent[0] == 4
    assert model.prior == pytest.approx(0.2, abs=0.02)
    for label in (0, 1):
        for j in range(4):
            cases = np.array([[b >> i & 1 for i in range(5)] for b in range(32)], bool)
            p = np.exp(model.likelihood(cases)[:, label])
            assert p.sum() == pytest.approx(1) and p[cases[:, j]].sum() == pytest.approx(rate[label, j], abs=0.05)
    joint = np.exp(model.likelihood(code)) * [1 - model.prior, model.prior]
    assert model.posterior(code) == pytest.approx(joint[:, 1] / joint.sum(1))
    truth = np.array([y[back.ravel() == i].mean() for i in range(len(code))])
    often = np.bincount(back.ravel()) > 300
    assert np.abs(model.posterior(code) - truth)[often].max() < 0.12
    blind = toxicity.label_model(code, np.bincount(back.ravel()).astype(float), np.zeros(len(code)), np.zeros(len(code)))
    good = lambda m: np.corrcoef(m.posterior(code)[back.ravel()], y)[0, 1]
    assert good(model) > 0.75 and good(blind) > 0.4


def test_votes(spark):
    lists = {"you are an idiot": {"stupidity", "insulted reader"}, "please thanks": {"no term", "polite"}, "IDIOT AND SCUM YOU FOOLISH MAN!!": {"stupidity", "worth", "several insults", "shouting", "exclamations"}, "a *** b": {"masked", "no term"}, "": {"no term"}}
    for text, want in lists.items():
        (f,) = toxicity._found(pa.array([text]), np.zeros(0, np.uint64))
        assert {toxicity.VOTERS[j] for j in np.flatnonzero(f.fired[0])} == want
    odd = spark.createDataFrame([(1, "you idiot", "x"), (1, "you idiot", "y"), (None, None, None)], "doc_id long, text string, score string").withColumn("held_out", F.lit(3)).withColumn("code", F.lit("c"))
    assert sorted(str((r.doc_id, r.code > 0)) for r in toxicity.votes(odd, np.zeros(0, np.uint64)).collect()) == ["(1, True)", "(1, True)", "(None, True)"]
    silent = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(odd, silent).collect()] == [0, 0, 0]


def test_mixing(spark):
    rng = random.Random(5)
    topics = {k: [f"{k}{i}" for i in range(60)] for k in ("low", "good", "tox")}
    rows, marks = [], []
    for i in range(500):
        k = rng.choice(["low", "good", "good", "tox"])
        rows.append((i, " ".join(rng.choices(topics[k], k=rng.randint(20, 60)))))
        marks.append((i, int(k == "good"), int(k == "tox")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, {"low": 0.2, "good": 0.7, "toxic": 0.1}, 1.5).collect()
    total = sum(r.tokens for r in got)
    for name, share in (("p_low", 0.2), ("p_good", 0.7), ("p_toxic", 0.1)):
        assert sum(r.tokens * r.rate * r[name] for r in got) / total / 1.5 == pytest.approx(share, abs=0.02)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    taken = mixing.mixed_documents(docs, labels, {"low": 0.2, "good": 0.7, "toxic": 0.1}, 1.5)
    assert taken.count() == sum(r.copies for r in got) and taken.columns == docs.columns
    odd = spark.createDataFrame([*ODD, ODD[0]], "doc_id long, text string")
    assert mixing.mix(odd, labels).count() == 6 and mixing.mix(odd.limit(0), labels).count() == 0
    assert mixing.mix(odd, labels.limit(0)).count() == 6


def test_rates_reach_the_least_squares_optimum(spark):
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.3] * 3, 300), rng.integers(1, 50, 300)
    soft = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    fitted = mixing.fit_rates(soft, [0.6, 0.3, 0.1], 1.0)
    assert fitted.met and fitted.reached == pytest.approx([0.6, 0.3, 0.1], abs=2e-3)
    assert (mixing._rates(p, fitted.history)[0] >= 0).all()


def test_rates_of_targets_out_of_reach(spark):
    """No domain of its own holds the third target: the totals are as near as those of a plain nonnegative least-squares solver."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([2, 2, 1], 200) * [1, 1, 0.3]
    p, t = np.repeat(p / p.sum(1, keepdims=True), 2, axis=0), rng.integers(1, 50, 400)
    soft = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    fitted = mixing.fit_rates(soft, [0.05, 0.05, 0.9], 1.0)
    target, a = np.array([0.05, 0.05, 0.9]) * t.sum(), (p * t[:, None]).T
    r = np.ones(len(t))
    for _ in range(20_000):
        r = np.maximum(0, r - a.T @ (a @ r - target) / np.linalg.norm(a, 2) ** 2)
    miss = lambda x: np.square(x - target / t.sum()).sum()
    assert not fitted.met and miss(fitted.reached) <= miss(a @ r / t.sum()) + 1e-4


def planted(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(30)]
    docs, leaks = [], set()
    for d in range(150):
        w = rng.choices(vocabulary, k=rng.randint(30, 400))
        if d % 3 == 0:
            i, t = rng.choice(items)
            t = t.split()
            for _ in range(len(t) // 10 if d % 6 else 0):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            at = rng.randrange(len(w))
            w[at:at] = t
            leaks.add((d, i))
        docs.append((d, " ".join(w)))
    return docs, items, leaks


def test_decontamination_recall(spark):
    docs, items, leaks = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("words", F.lit(2))
    b = spark.createDataFrame([*items, (99, "too short"), (98, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, b).collect()}
    assert len(found & leaks) >= 0.95 * len(leaks) and not found - leaks
    kept = decontamination.decontaminate(d, b)
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in found} and kept.columns == d.columns
    assert decontamination.find_leaks(d.limit(0), b).count() == 0 and decontamination.find_leaks(d, b.limit(0)).count() == 0
    odd = spark.createDataFrame([*ODD, (7, items[0][1]), (7, items[0][1]), (None, items[0][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(odd, b).collect()] == [(7, 0)]


def test_blocks_of_items(spark, monkeypatch):
    docs, items, leaks = planted(2)
    monkeypatch.setattr(decontamination, "PASS_WORDS", 300)
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found & leaks) >= 0.95 * len(leaks) and not found - leaks


def test_common_subsequence():
    a = np.array([1, 2, 3, 4], "<u4")
    assert decontamination.common_subsequence(a, np.array([9, 1, 9, 3, 4], "<u4")) == 3 and decontamination.common_subsequence(a, a[:0]) == 0
    assert pa.array([1]).null_count == 0
