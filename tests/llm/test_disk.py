"""Disk: shuffle files go with the write that made them, and families are split before texts are sent."""

import os
import time

import numpy as np
import pyarrow as pa

from wordloom.llm import decontamination as dc
from wordloom.llm import graph
from wordloom.llm import ngram_join as nj
from wordloom.llm.shared import shared_root, written


def test_written_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "shuffle_" in x}
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    value = spark.conf.get(key)
    assert written(spark.range(1000).repartition(3, "id"), "swept").count() == 1000
    for _ in range(50):
        if not any("shuffle_" in x for x in held() - before if not x.endswith(".tmp")):
            break
        time.sleep(0.1)
    # The count after it has a shuffle of its own, of one row a task.
    kept = [x for x in held() - before if x.endswith(".data")]
    assert len(kept) <= 4 and spark.conf.get(key) == value


def test_sketches_part_a_family_and_lose_no_link():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    passage = draw(120)
    sets = [np.unique(np.concatenate([passage, draw(int(rng.integers(300, 900)))])) for _ in range(60)]
    for k in range(20):
        keep = sets[k][rng.random(len(sets[k])) < rng.uniform(0.6, 1)]
        sets.append(np.unique(np.concatenate([keep, draw(int(rng.integers(0, 60)))])))
    sketches = [nj._parities(x, 1, 6) for x in sets]
    assert sum(x.nbytes for x in sketches) * 30 < sum(x.nbytes for x in sets)
    ties = nj.block_ties(list(range(len(sets))), [0] * len(sets), [len(x) for x in sets], sketches, 75)
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in ties:
        root[find(a)] = find(b)
    links = 0
    for a, x in enumerate(sets):
        for b in range(a):
            common = len(np.intersect1d(x, sets[b]))
            if 100 * common >= 75 * (len(x) + len(sets[b]) - common):
                links += 1
                assert find(a) == find(b)
    # All sets share the passage, which tied them into one family; few stay together.
    assert links >= 3 and len(ties) <= 20


def test_edges_that_sketches_rule_out_are_no_links():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(200):
        whole = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64))
        other = np.unique(np.concatenate([whole[rng.random(len(whole)) < rng.uniform(0.5, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 200))).astype(np.uint64)]))
        if len(other):
            rows.append((k, whole, other))
    sketch = lambda x: nj._parities(x, 1, 6).tobytes()
    columns = {"a": [k for k, _, _ in rows], "b": [k for k, _, _ in rows], "n_a": [len(x) for _, x, _ in rows], "n_b": [len(y) for _, _, y in rows], "s_a": [sketch(x) for _, x, _ in rows], "s_b": [sketch(y) for _, _, y in rows]}
    kept = set(next(iter(nj._may_link([pa.RecordBatch.from_pydict(columns)], 75))).column("a").to_pylist())
    linked = {k for k, x, y in rows if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
    assert linked <= kept and len(kept) < len(rows)


def test_only_wanted_texts_are_sent(spark):
    """Of many texts, a join of few nodes gets all of theirs and few others."""
    docs = spark.range(-5000, 15000).selectExpr("if(id = 7, null, id) as doc_id", "if(id % 10 = 0, null, concat('text ', id)) as text")
    nodes = spark.range(0, 9000, 3).selectExpr("id as doc_id")
    got = {r.doc_id: r.text for r in nj._among(docs, nodes).collect()}
    want = set(range(0, 9000, 3))
    assert want <= set(got) and None not in got and len(set(got) - want) < 0.1 * 20000
    assert all(text == (None if d % 10 == 0 else f"text {d}") for d, text in got.items())
    assert nj._among(docs, nodes.limit(0)).count() == 0


def test_verified_edges_do_not_send_all_texts(spark):
    from pyspark.sql import Row

    rows = [Row(doc_id=i, text=" ".join(f"w{i}x{k}" for k in range(9))) for i in range(4000)] + [Row(doc_id=9000 + i, text=f"same words in this text of ten words {i % 2} so") for i in range(4)]
    docs = spark.createDataFrame(rows).repartition(4)
    edges = spark.createDataFrame([(9000, 9002), (9001, 9003), (9000, 9001), (5, 6)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = nj._checked(edges, docs, 5, 75)
        assert {(r.a, r.b): r.ok for r in found.collect()} == {(9000, 9002): True, (9001, 9003): True, (9000, 9001): False, (5, 6): False}
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The texts pass the filter before the exchange of the join.
    assert plan.count("MapInArrow filtered") >= 1


def _folder(spark) -> set[str]:
    root = shared_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def _named(before: set[str], spark) -> list[str]:
    return sorted(x.rsplit("-", 1)[0] for x in _folder(spark) - before if not x.startswith("."))


def test_few_links_take_no_rounds(spark, monkeypatch):
    """A chain takes rounds in the logarithm of its length; links that one task holds are contracted there, more of them are joined in rounds."""
    rng = np.random.default_rng(3)
    pairs = {(k, k + 1) for k in range(1, 200)} | {tuple(x) for x in rng.integers(1000, 3000, (1200, 2)).tolist()} | {(9_000, k) for k in range(5000, 5400)} | {(-4, 8), (7, 7)}
    links = spark.createDataFrame([(int(a), int(b)) for x in pairs for a, b in (x, x[::-1])], "a long, b long").repartition(4)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(root)}
    before = _folder(spark)
    assert {r.node: r.component for r in graph.components(links).collect()} == want
    assert _named(before, spark) == ["links", "links"]
    before = _folder(spark)
    monkeypatch.setattr(graph, "TASK_LINKS", 600)
    assert {r.node: r.component for r in graph.components(links).collect()} == want
    assert len(_named(before, spark)) > 2
    assert graph.components(links.limit(0)).count() == 0


def test_near_duplicates_and_leaks_leave_one_table(spark):
    """What an operator writes on its way to its result goes with it."""
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i, text(i % 30) + (" and more" if i % 2 else "")) for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, text(3)), (500, None)], "doc_id long, text string")
    before = _folder(spark)
    kept = nj.near_duplicate_representatives(docs)
    assert _named(before, spark) == ["gone"]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [*range(30), 500] and kept.count() == 32
    before = _folder(spark)
    clean = dc.decontaminate(docs, spark.createDataFrame([(1, text(4, 40))], "item_id long, text string"))
    assert _named(before, spark) == ["leaks"]
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.collect()} == {4, 34, 64}


def test_fit_leaves_no_shuffle_files(spark):
    """Each product of the fit sends a matrix a task, which goes with its job."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "shuffle_" in x and x.endswith(".data")}
    parts = spark.range(64).repartition(8).selectExpr("cast(id % 4 as int) as part", "unhex(repeat('0500000000000000', 1000)) as data")
    before = held()
    got = dc._sum_parts(parts, "<i8")
    assert sorted(got) == [0, 1, 2, 3] and all(len(x) == 1000 and (x == 80).all() for x in got.values())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
