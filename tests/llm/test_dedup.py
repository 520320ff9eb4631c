"""Operators on shingles, lines and fingerprints, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import fingerprints as fp
from wordloom.llm import textkit
from wordloom.llm.graph import components
from wordloom.llm.line_dedup import dedup_lines
from wordloom.llm.ngram_join import bands, difference, jaccard_components, near_duplicate_representatives, segments

DOCS = "doc_id long, text string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = defaultdict(set)
    for k, t in rows:
        sets[k] |= shingle_set(t)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def corpus(seed, n=60):
    """Documents of all lengths with exact copies, near copies at every distance, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 6, 9, 20, 60, 200]))
            if kind > 0.75:
                w += passage
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(4))
def test_join_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_components(rows)
    assert got == {k: (len(shingle_set(t)), want[k]) for k, t in rows}


def test_join_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (3, "a b c"), (4, "A  b\nC"), (8, "x" * 50_000 + " y"), (None, "a b c"), (9, "é è"), (3, "a b c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit(7)).withColumn("n_shingles", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df).collect())
    assert got == sorted([("5", 0, "5"), ("6", 0, "6"), ("7", 0, "7"), ("3", 1, "3"), ("3", 1, "3"), ("4", 1, "3"), ("8", 1, "8"), ("None", 1, "None"), ("9", 1, "9")])
    assert sorted(str(r.doc_id) for r in near_duplicate_representatives(df).collect()) == sorted(["5", "6", "7", "3", "3", "8", "None", "9"])
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_join_of_repeated_ids(spark):
    """Rows of one id are linked, each with the set of its own text, in any order of the rows."""
    fresh = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [(5, fresh("a", 40)), (5, fresh("b", 30)), (5, fresh("b", 30)), (9, fresh("a", 41)), (3, fresh("b", 31)), (7, fresh("c", 20)), (None, fresh("c", 20)), (7, None)]
    want = sorted([(5, 36, 3), (5, 26, 3), (5, 26, 3), (9, 37, 3), (3, 27, 3), (7, 16, 7), (None, 16, None), (7, 0, 7)], key=str)
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(order, DOCS)).collect()]
        assert sorted(got, key=str) == want


def test_pigeonhole_bounds():
    low = bands(3000, 75)
    for n in range(1, 3000):
        band = int(np.searchsorted(low, n, "right")) - 1
        assert low[band] <= n < low[band + 1] and n * 100 // 75 < low[band + 2]
        assert segments(int(low[band + 1]), 75) > difference(2 * n, 75)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i % 10] + [(5, 5), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}
    assert components(links.limit(0)).count() == 0


def test_word_hashes_and_shingles():
    texts = ["Aa bB\tcc", None, "", "é", " x ", "aa bb cc dd ee ff"]
    for _, _, buf, offsets in textkit.rows(pa.array(texts)):
        h, at = textkit.word_hashes(buf, offsets)
        assert np.diff(at).tolist() == [3, 0, 0, 1, 1, 6] and h[0] == h[at[5]] and h[0] != h[1]
        grams, begin = textkit.shingles(h, at)
        assert np.diff(begin).tolist() == [1, 0, 0, 1, 1, 2]
    assert list(textkit.rows(pa.array([], pa.string()))) == []


def brute_sketch(text, k=fp.K):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text)]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        seed = 42
        for x in (h[i : i + 5] + [0] * 5)[:5]:
            seed = xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()
        out.add(seed - (1 << 64) if seed >> 63 else seed)
    return sorted(out)[:k]


def test_fingerprints(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:300])), (3, "é ß 日本"), (4, ""), (5, None), (6, "one two"), (7, " ".join(base)), (8, "abc" * 9), (8, "abc" * 9)]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit(1)).withColumn("s", F.lit("x"))
    got = fp.fingerprint_documents(df).collect()
    assert len(got) == len(rows)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: -r[0])
    import hashlib

    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = next(r for r in got if r.doc_id == k)
        if k != 8:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            a, b = brute_sketch(t), brute_sketch(edited)
            union = sorted({*a, *b})[: fp.K]
            assert r.near_edited == pytest.approx(len({*union} & {*a} & {*b}) / len(union) if union else 1.0)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[7].fingerprint and by[4].fingerprint == by[5].fingerprint == "" and by[1].near_next <= 1
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    two = spark.createDataFrame([(" ".join(base), " ".join(base[:300]))], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    true = len(shingle_set(" ".join(base[:300]))) / len(shingle_set(" ".join(base)))
    r = two.select(fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("b"), F.col("a")).alias("c"), fp.distinct_count(F.col("a")).alias("n"), (fp.merge(F.col("a"), F.col("b")) == F.col("a")).alias("same")).first()
    assert abs(r.j - true) < 0.15 and r.c > 0.8 and abs(r.n - len(shingle_set(" ".join(base)))) < 150 and r.same


def brute_lines(rows, least=20):
    seen, out = set(), {}
    for k, t in sorted(rows):
        units, spans, run = [], [], []
        at = 0
        for line in t.split("\n"):
            w = tuple(words(line))
            if w:
                units.append((w, at, at + len(line), w in seen))
            at += len(line) + 1
        fresh = set()
        flags = []
        for w, a, z, old in units:
            flags.append((old or w in fresh, len(w), a, z))
            fresh.add(w)
        seen |= fresh
        for f in [*flags, (False, 0, 0, 0)]:
            if f[0]:
                run.append(f)
            else:
                if sum(x[1] for x in run) >= least:
                    spans += run
                run = []
        out[k] = ",".join(f"{a}-{z}" for _, _, a, z in spans)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.choice([0, 1, 5, 12, 30]))) for _ in range(15)]
    rows = [(i, "\n".join(rng.choice([p, p.upper(), f"  {p}"]) for p in rng.choices(pool, k=rng.randint(1, 8)))) for i in range(30)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_lines(rows)
    assert {k: r.removed for k, r in got.items()} == want
    for k, t in rows:
        gone = {tuple(map(int, s.split("-"))) for s in want[k].split(",") if s}
        at, kept = 0, []
        for line in t.split("\n"):
            if (at, at + len(line)) not in gone:
                kept.append(line)
            at += len(line) + 1
        assert got[k].text == "\n".join(kept)


def test_line_edge_cases(spark):
    long = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, None), (2, ""), (3, long), (4, long + "\n\n" + "é" * 10_000), (None, long), (5, long), (5, long)]
    df = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit(1)).withColumn("h", F.lit(2))
    got = sorted((str(r.doc_id), r.removed, r.n_removed) for r in dedup_lines(df).collect())
    span = f"0-{len(long)}"
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "", 0), ("4", span, 1), ("None", span, 1), ("5", span, 1), ("5", span, 1)])
    assert dedup_lines(df.limit(0)).count() == 0
