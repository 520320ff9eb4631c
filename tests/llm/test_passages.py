"""Repeated passages inside lines, against plain Python."""

import random
import re

import pytest

from wordloom.llm.line_dedup import dedup_lines
from wordloom.llm.passage_dedup import dedup_passages
from wordloom.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_passages(rows, size=50):
    """Numbers of the words that lie in a window of ``size`` words seen before, not overlapping its first place."""
    seen, out = {}, {}
    for k, t in sorted(rows):
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            first = seen.setdefault(tuple(w[i : i + size]), (k, i))
            if first != (k, i) and not (first[0] == k and i < first[1] + size):
                gone |= set(range(i, i + size))
        out[k] = gone
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_inside_lines(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 70, 110)]
    rows = []
    for i in range(24):
        w = fresh(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w += [*rng.choice(passages), *fresh(rng.randint(0, 60))]
        rows.append((i, " ".join(x if rng.random() < 0.95 else x.upper() + rng.choice([" ", "\n", " é "]).rstrip("é ") for x in w)))
    rows += [(90, " ".join(["x"] * 160)), (91, "y " + " ".join(passages[3])), (92, None), (93, "")]
    got = {r.doc_id: r for r in dedup_passages(spark.createDataFrame(rows, DOCS), min_words=10**9).collect()}
    want = brute_passages(rows)
    assert any(want.values()) and len(got) == len(rows)
    for k, t in rows:
        w = words(t)
        assert words(got[k].text) == [x for i, x in enumerate(w) if i not in want[k]]
        spans = [tuple(map(int, s.split("-"))) for s in got[k].removed.split(",") if s]
        assert got[k].n_passages == sum(i - 1 not in want[k] for i in want[k])
        assert [x for a, z in spans for x in words(t[a:z])] == [w[i] for i in sorted(want[k])] and got[k].n_removed == len(spans)
    assert got[92].text is None and got[93].text == "" and dedup_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_and_lines(spark):
    line = " ".join(f"l{i}" for i in range(25))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{line}\na b {passage} é c"), (2, f"é\n{line}\n\nd {passage} e"), (None, f"f {passage}"), (2, f"é\n{line}\n\nd {passage} e")]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in dedup_passages(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("1", rows[0][1], 2, 0), ("2", "é\n\nd  e", 4, 2), ("2", "é\n\nd  e", 4, 2), ("None", "f ", 1, 1)])


def test_like_lines_stay(spark):
    """Lines whose words follow the Thue-Morse sequence and its complement differ, so both stay."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(a[:1024])), (2, " ".join(a[1024:]))]
    assert {r.n_removed for r in dedup_lines(spark.createDataFrame(rows, DOCS), 1).collect()} == {0}


def test_query_removes_every_later_line(spark, tmp_path):
    rows = [(1, "All rights reserved.\nfirst text"), (2, "second text\n all  rights RESERVED."), (3, "one\ntwo\none")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in QUERIES["op10_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("second text", 1), 3: ("one\ntwo", 1)}
