"""Leaks of long and of brief benchmark items, and the latent space."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd

from wordloom.llm import decontamination as dc
from wordloom.llm.decontamination import COSINE, common_subsequence, find_leaks


def test_long_and_brief_items(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, fresh(n)) for i, n in enumerate((170, 240, 300, 700))] + [(8, "rare Brief words"), (9, " ")]
    docs = [(i, f"{fresh(90)} {t} {fresh(50)}") for i, t in items] + [(20, "a rare\nbrief  words b"), (21, "rare words brief"), (22, None)]
    leaks = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(0, 0), (1, 1), (2, 2), (3, 3), (8, 8), (20, 8)}
    assert all(r.common == 1.0 for r in leaks) and {r.start for r in leaks if r.doc_id == 20} == {1}


def test_paraphrase_that_words_alone_miss(spark):
    """Rare words are replaced by others of their subject; the frequent words between them stay in order."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    subjects = [([f"a{k}x{i}" for i in range(20)], [f"b{k}x{i}" for i in range(20)]) for k in range(8)]
    docs = []
    for i in range(640):
        one, other = subjects[i % 8]
        docs.append((i, " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice(rng.choice((one, other))) for _ in range(60))))
    items, leaks = [], set()
    for k, (one, other) in enumerate(subjects):
        frame = [rng.choice(common) if j % 12 not in (1, 3, 5, 8, 10) else None for j in range(24)]
        items.append((k, " ".join(w or rng.choice(one) for w in frame)))
        docs.append((1000 + k, " ".join(rng.choice(subjects[k][0]) for _ in range(4)) + " " + " ".join(w or rng.choice(other) for w in frame)))
        leaks.add((1000 + k, k))
    df: dict = {}
    for _, t in docs:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1

    def cosine(x, y):
        weigh = lambda t: {w: t.split().count(w) * math.log(len(docs) / df[w]) for w in set(t.split()) if w in df}
        a, b = weigh(x), weigh(y)
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    texts = dict(docs)
    assert all(cosine(items[i][1], texts[d]) < COSINE for d, i in leaks)
    got = {(r.doc_id, r.item_id): r.cosine for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rank=12).collect()}
    assert len(leaks & set(got)) >= 7 and all(d >= 1000 or got[d, i] >= COSINE for d, i in got)


def test_subsequence_in_numbers():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            last = 0
            for j, y in enumerate(b.tolist(), 1):
                row[j], last = last + 1 if x == y else max(row[j], row[j - 1]), row[j]
        assert common_subsequence(a, b) == row[-1]


def test_space_of_all_passages(spark):
    """The fit takes every passage of every text: its singular values are those of the whole matrix."""
    rng = random.Random(11)
    texts = [" ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.choice((0, 1, 63, 64, 65, 200, 400)))) for _ in range(300)] + [None]
    terms = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).mapInArrow(dc._terms, dc.TERMS).cache()
    idf, words = dc.inverse_frequencies(terms)
    passages = terms.where("part is null").select("terms", "counts", "sizes")
    assert words == sum(len((t or "").split()) for t in texts)
    rows = []
    for t in texts:
        hashes, _ = dc.word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len(t or "")]))
        rows += [np.bincount(dc._feature(hashes[k : k + dc.FIT_WORDS]), minlength=dc.WIDTH) * idf for k in range(0, len(hashes), dc.FIT_WORDS)]
    whole = np.stack(rows).astype(np.float64)
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    held = passages.toPandas()
    assert sum(map(len, held["sizes"])) == len(rows)
    _, weights, _ = dc._weighed(held, idf)
    assert np.isclose(np.square(weights, dtype=np.float64).sum(), len(rows))
    wanted = np.linalg.svd(whole, compute_uv=False)
    _, got = dc.latent_space(passages, idf, rank=390)
    got = np.sort(got)[::-1][:390]
    assert np.allclose(got[:20] / got[0], wanted[:20] / wanted[0], atol=1e-3)


def test_runs_of_passages_lose_no_leak():
    """Spans that share enough words are those that a plain count finds."""
    rng = np.random.default_rng(2)
    feature, item = rng.integers(0, 40, 500), rng.integers(0, 40, 16)
    known, count = np.unique(item, return_counts=True)
    slot = np.full(dc.WIDTH, -1, np.int16)
    slot[known] = np.arange(len(known))
    low = np.arange(0, 480, 4)
    high = np.minimum(low + 32, 500)
    got = dict(dc._sharing(feature, slot, low, high, count, 9))
    shared = [sum(min(c, int((feature[a:z] == k).sum())) for k, c in zip(known, count, strict=True)) for a, z in zip(low, high, strict=True)]
    assert 0 < len(got) < len(low) and set(got) == {i for i, n in enumerate(shared) if n >= 9}
    assert all(places.tolist() == [p for p in range(low[i], high[i]) if feature[p] in known] for i, places in got.items())


def test_fit_memory():
    """A task of the fit holds less than 110 MB besides what it reads, over more passages than it takes at once."""
    rng = np.random.default_rng(3)
    n = dc.FIT_ROW
    term = np.sort(rng.integers(0, dc.WIDTH // 60, (n, 60)) + np.arange(60) * (dc.WIDTH // 60), 1).astype("<u2").tobytes()
    row = pd.DataFrame({"terms": [term], "counts": [np.ones(60 * n, np.uint8).tobytes()], "sizes": [np.full(n, 60, np.uint8).tobytes()]})
    idf, basis = np.ones(dc.WIDTH, np.float32), rng.standard_normal((dc.WIDTH, dc.RANK + dc.OVERSAMPLE)).astype(np.float32)
    whole = np.zeros((n, dc.WIDTH), np.float32)
    whole[np.repeat(np.arange(n), 60), np.frombuffer(term, "<u2")] = 1 / np.sqrt(60)
    tracemalloc.start()
    out = list(dc._gathered((pd.concat([row] * 32) for _ in range(8)), idf, basis, False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.concatenate([np.frombuffer(x["data"].iloc[0], "<f4") for x in out]).reshape(dc.WIDTH, -1)
    assert np.allclose(got, 256 * (whole.T @ (whole @ basis)), rtol=1e-3, atol=1e-2)
    assert most < 110e6
