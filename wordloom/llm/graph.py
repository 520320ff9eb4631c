"""Connected components of a link table: tasks contract what links they have, then large-star and small-star rounds alternate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import written

#: Links that a task contracts, about: 16 bytes each, and a few times that at work.
TASK_LINKS = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a < b; every b points to the least of its smaller neighbours."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _kept(edges: DataFrame) -> tuple[tuple, DataFrame]:
    """The written edges, and their number and two sums of hashes, which are taken while they are written."""
    seen = Observation()
    measured = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("y"))
    table = written(measured, "links")
    return tuple(seen.get[k] for k in "nxy"), table


def _contracted(batches):
    """The links of a task as stars: ``a`` is the smallest node that the task's links join ``b`` to."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
    held.clear()
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(x):
        # Roots go below the smallest root that a link joins them to, and all nodes below their roots' roots.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    inner = root != np.arange(len(root))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[inner]]), pa.array(nodes[inner])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links(a, b)``; the component is its smallest node.

    One task contracts about ``TASK_LINKS`` links to stars; with so few in all, these are the components.
    Otherwise rounds over the stars of all tasks follow. Every round writes its edges to the shared folder, so lineage stays short, and is one job. The number
    of rounds is logarithmic in the longest chain. Loops and repeated links are ignored; an empty table
    gives an empty table.
    """
    state, edges = _kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    tasks = -(-state[0] // TASK_LINKS)
    if tasks:
        stars = edges.coalesce(tasks).mapInArrow(_contracted, "a long, b long")
        state, edges = _kept(stars.distinct() if tasks > 1 else stars)
    while tasks > 1:
        before = state
        state, edges = _kept(_small_star(_large_star(edges)))
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found(node, component)`` after further ``links(a, b)``, of which there are few: only components that they touch are looked at."""
    known = found.toDF("node", "c")
    ends = links
    for side in ("a", "b"):
        ends = ends.join(known.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    ends = written(ends, "joins")
    merged = components(ends).toDF("component", "least")
    moved = found.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # Nodes without a link so far are components of their own.
    alone = merged.join(found.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return moved.union(alone)
