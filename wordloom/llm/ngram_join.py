"""Exact Jaccard self-join on word shingles by the universe-partition pigeonhole.

Scheme. Sets fall into size bands; a partner of at least the threshold lies in the same band or a
neighbouring one. For each band the universe of shingles is hashed into m segments, with m above
the largest possible symmetric difference H of a pair, so that a linked pair agrees on a whole
segment. A set indexes all its segments that hold something and, by cost, marks H + 1 of them as
probes: those with the most shingles that are not frequent in the corpus. Two sets are candidates
if they agree on a segment that one of them probes. A set with too few filled segments for that
takes one-deletion neighbourhoods (a segment without one of its shingles counts twice in the
pigeonhole) and, if that is still too little, its empty segments. Candidates are verified on the
exact sets of 64-bit shingle hashes.

Work per group. Signatures travel packed, by bucket, from each task. Sets that agree on a segment
give a star around one of them, not all pairs. Where verification breaks stars, members that ended
in different components may still be linked. Components that runs of signatures tie together are
compared as a family, in blocks: parities of hashed slots bound the differences of all pairs of a
block from below, the few pairs that pass are compared exactly, and only links that join components
leave the task. Before that, sketches (the parities of one to two slots a shingle, in all a few
hundredths of the texts) rule out star edges and split families, so that texts are sent only for what
may well be linked. What the sketches rule out is no link, whatever the sets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, joined
from .shared import only, partitions, settled, swept, written
from .textkit import U64, distinct, mix, rows, shingles, trim, word_hashes

#: Share of documents, and their count, at which a shingle counts as frequent in the cost model.
COST_SAMPLE, COST_COUNT, COST_MOST = 64, 4, 1 << 18
SPREAD = 1.4
#: Names of sets that a task remembers, to index equal sets once; all equal sets meet later anyway.
SEEN_MOST = 500_000
#: Rows of an Arrow batch of whole sets.
SET_ROWS = 64
#: Shingles and rows of a block of a family, about, and bytes of sets that a task gets.
BLOCK_SHINGLES, BLOCK_ROWS, TASK_BYTES = 1 << 22, 4096, 1 << 26
#: The same for blocks of sketches, and bytes of the name before a sketch.
TIE_SHINGLES, TIE_ROWS, NAME_BYTES = 1 << 26, 1 << 14, 24
#: Bits of the filter that texts meet before they are sent: about this many for each wanted node, within these powers of two.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 16, 16, 28
#: Characters of text whose signatures make a bucket, about.
BUCKET_CHARS = 1 << 23
CELLS = "kind int, bucket int, a long, b long, n int, data binary"


def bands(most: int, t: int) -> np.ndarray:
    """Least sizes of the bands up to ``most``."""
    low = [1]
    while low[-1] <= most:
        low.append(low[-1] * 100 // t + 1)
    return np.array([*low, low[-1] * 100 // t + 1, (low[-1] * 100 // t + 1) * 100 // t + 1], np.int64)


def difference(total: np.ndarray | int, t: int):
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return total * (100 - t) // (100 + t)


def segments(band_end: int, t: int) -> int:
    """Segments of the scheme whose sets are smaller than ``band_end``."""
    most = int(difference(2 * (band_end - 1), t))
    return int(np.ceil(SPREAD * (most + 1))) if most else 1


def signatures(tokens: np.ndarray, frequent: np.ndarray, low: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment signatures of one set and their roles: 1 probes, 2 from the next smaller band.

    ``tokens`` are distinct and sorted; ``frequent`` says which are frequent.
    """
    n = len(tokens)
    band = int(np.searchsorted(low, n, "right")) - 1
    out, roles = [], []
    for scheme, small in ((band, 0), (band + 1, 2)):
        top = min(int(low[scheme + 1]) - 1, n * 100 // t)
        if top < low[scheme]:
            continue
        need = int(difference(n + top, t)) + 1
        m = segments(int(low[scheme + 1]), t)
        where = (mix(tokens + U64(scheme + 1)) % U64(m)).astype(np.int64)
        load = mix(tokens ^ U64(0x5851F42D4C957F2D))
        order = np.argsort(where, kind="stable")
        at = where[order]
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        filled, size = at[begin], np.diff(np.append(begin, n))
        total = np.add.reduceat(load[order], begin)
        seed = mix(np.array([scheme + 7], U64))[0]
        key = mix(total + (filled.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + seed)
        if len(filled) >= need:
            rare = size - np.add.reduceat(frequent[order].astype(np.int64), begin)
            pick = np.argsort(-(rare * (n + 1) + size), kind="stable")[:need]
            if small:
                out.append(key[pick])
                roles.append(np.full(need, 3, np.uint8))
            else:
                role = np.zeros(len(key), np.uint8)
                role[pick] = 1
                out.append(key)
                roles.append(role)
            continue
        out.append(key)
        several = size > 1
        member = np.repeat(several, size)
        fewer = np.repeat(total, size)[member] - load[order][member]
        out.append(mix(fewer + (at[member].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + seed))
        if len(filled) + several.sum() < need:
            empty = np.setdiff1d(np.arange(m), filled)
            out.append(mix((empty.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + seed))
        roles.append(np.full(sum(map(len, out)) - sum(map(len, roles)), 1 | small, np.uint8))
    return np.concatenate(out), np.concatenate(roles)


def _cells(kind: int, count: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a kind, null but for these columns."""
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "data": pa.binary()}
    columns["kind"] = pa.array(np.full(count, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, k)) for c, k in kinds.items()], names=list(kinds))


def _pack(keys: np.ndarray, nodes: np.ndarray, roles: np.ndarray) -> bytes:
    """Signatures of one bucket, sorted: their upper 48 bits in bytes of one place each, so that they compress, then nodes and roles."""
    order = np.argsort(keys)
    held, index = np.unique(nodes, return_inverse=True)
    key = (keys[order] >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    index = index[order].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 2 if len(held) <= 1 << 16 else 4]
    head = np.array([len(keys), len(held), index.shape[1]], "<i8")
    return b"".join((head.tobytes(), held.astype("<i8").tobytes(), np.ascontiguousarray(key.T).tobytes(), np.ascontiguousarray(index.T).tobytes(), np.packbits(roles[order] & 1).tobytes(), np.packbits(roles[order] >> 1).tobytes()))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, held, width = np.frombuffer(data, "<i8", 3)
    at = 24 + 8 * held
    nodes = np.frombuffer(data, "<i8", held, 24)
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(6, n).T
    index = np.zeros((n, 4), np.uint8)
    index[:, :width] = np.frombuffer(data, np.uint8, width * n, at := at + 6 * n).reshape(width, n).T
    bits = -(-n // 8)
    probe = np.unpackbits(np.frombuffer(data, np.uint8, bits, at := at + width * n), count=n)
    small = np.unpackbits(np.frombuffer(data, np.uint8, bits, at + bits), count=n)
    return key.view("<u8").ravel(), nodes[index.view("<u4").ravel()], probe | small << 1


def _emit(batches, frequent: np.ndarray, buckets: int, size: int, t: int):
    """Rows of kind 0 (document, set size, name and sketch of its set) and 2 (packed signatures of the sets that are new in this task)."""
    low = bands(1, t)
    seen: set[bytes] = set()
    held: list[tuple[np.ndarray, int, np.ndarray]] = []
    weight = 0

    def flush():
        if not held:
            return
        keys = np.concatenate([k for k, _, _ in held])
        nodes = np.repeat(np.array([d for _, d, _ in held], np.int64), [len(k) for k, _, _ in held])
        roles = np.concatenate([r for _, _, r in held])
        held.clear()
        bucket = (keys % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(ends))
        for part in np.array_split(some, max(1, len(some) // 64)):
            data = [_pack(keys[i], nodes[i], roles[i]) for i in (order[ends[b] : ends[b + 1]] for b in part)]
            yield _cells(2, len(part), bucket=pa.array(part.astype(np.int32)), data=pa.array(data, pa.binary()))

    for batch in batches:
        ids = batch.column("doc_id")
        for first, last, buf, offsets in rows(batch.column("text")):
            words, at = word_hashes(buf, offsets)
            grams, begin = shingles(words, at, size)
            sizes = np.zeros(last - first, np.int32)
            names: list[bytes | None] = [None] * len(sizes)
            for i, doc in enumerate(ids.slice(first, last - first).to_pylist()):
                if begin[i] == begin[i + 1]:
                    continue
                tokens = distinct(grams[begin[i] : begin[i + 1]])
                sizes[i] = len(tokens)
                if doc is None:
                    continue
                name = np.array([len(tokens), np.bitwise_xor.reduce(tokens), tokens.sum()], U64).tobytes()
                names[i] = name + _parities(tokens, 1, 6).tobytes()
                if name in seen:
                    continue
                if len(seen) < SEEN_MOST:
                    seen.add(name)
                if low[-3] <= len(tokens):
                    low = bands(len(tokens), t)
                place = np.searchsorted(frequent, tokens)
                place[place == len(frequent)] = 0
                keys, roles = signatures(tokens, frequent[place] == tokens if len(frequent) else np.zeros(len(tokens), bool), low, t)
                held.append((keys, doc, roles))
                weight += len(keys)
            n = last - first
            yield _cells(0, n, a=ids.slice(first, n), n=pa.array(sizes), data=pa.array(names, pa.binary()))
            if weight > 1_000_000:
                yield from flush()
                weight = 0
                trim()
    yield from flush()
    trim()


def _stars(batches):
    """Distinct star edges of the signatures of a partition (kind 3), and the runs of three and more members (kind 4)."""
    cells = []
    for batch in batches:
        wide = pc.equal(batch.column("kind"), 2)
        cells += [_unpack(x) for x in batch.column("data").filter(wide).to_pylist()]
        yield batch.filter(pc.invert(wide))
    if not cells:
        return
    keys, nodes, roles = (np.concatenate(x) for x in zip(*cells, strict=True))
    cells.clear()
    order = np.lexsort((nodes, keys))
    keys, nodes, roles = keys[order], nodes[order], roles[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(begin, len(keys)))
    probes = np.add.reduceat((roles & 1).astype(np.int64), begin)
    large = np.add.reduceat((roles < 2).astype(np.int64), begin)
    edges, runs = [], {}
    good = (size > 1) & (probes > 0) & (large > 0)
    two = begin[good & (size == 2)]
    edges.append(np.stack([nodes[two], nodes[two + 1]], 1))
    for i, g in zip(begin[good & (size > 2)], size[good & (size > 2)], strict=True):
        member, role = nodes[i : i + g], roles[i : i + g]
        if (hub := np.flatnonzero(role == 1)).size:
            hub = member[hub[0]]
            rest = distinct(member[member != hub])
            edges.append(np.stack([np.full(len(rest), hub), rest], 1))
        else:
            probe, other = member[role == 3], member[role < 2]
            hub = other[0]
            edges += [np.stack([np.full(len(probe), hub), probe], 1), np.stack([other, np.full(len(other), probe[0])], 1)]
        member = distinct(member)
        if len(member) > 2:
            runs.setdefault(member.tobytes())
    pairs = np.unique(np.sort(np.concatenate(edges), 1), axis=0) if edges else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield _cells(3, len(pairs), a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))
    for part in np.array_split(np.arange(len(runs)), max(1, len(runs) // 5000)):
        if len(part):
            items = list(itertools.islice(runs, int(part[0]), int(part[-1]) + 1))
            yield _cells(4, len(items), data=pa.array(items, pa.binary()))
    del keys, nodes, roles, order, edges, runs
    trim()


def _sets(batches, size: int):
    """Sorted 64-bit shingle hashes of each text."""
    for batch in batches:
        for first, last, buf, offsets in rows(batch.column("text")):
            words, at = word_hashes(buf, offsets)
            grams, begin = shingles(words, at, size)
            data = [distinct(grams[begin[i] : begin[i + 1]]).tobytes() for i in range(last - first)]
            yield first, pa.array(data, pa.binary())


def _verify(batches, size: int, t: int):
    """Streams hub, then its leaves: rows sorted by hub and salt, the hub's own text first."""
    hub, own = None, None
    for batch in batches:
        good = []
        for first, sets in _sets([batch], size):
            ids = (batch.column(c).slice(first, len(sets)).to_pylist() for c in ("a", "salt", "b"))
            for a, salt, b, grams in zip(*ids, sets.to_pylist(), strict=True):
                grams = np.frombuffer(grams, U64)
                if b is None:
                    hub, own = (a, salt), grams
                    continue
                assert hub == (a, salt)
                both = np.concatenate([own, grams])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= t * (len(both) - common))
        leaf = batch.column("b").is_valid()
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(leaf), batch.column("b").filter(leaf), pa.array(good, pa.bool_())], names=["a", "b", "ok"])


def _among(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` whose doc_id is in ``nodes(doc_id)``, and a few in a hundred others: what a join with ``nodes`` needs of ``docs``.

    A bit stands for each hash of a node, so texts are dropped where they are read and a join doesn't send them all.
    """
    spark = docs.sparkSession
    with swept(spark):
        bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, (FILTER_EACH * nodes.count()).bit_length()))
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        words = nodes.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("set")).toArrow()
    wanted = np.zeros(bits // 64, np.int64)
    wanted[words.column("word").to_numpy()] = words.column("set").to_numpy()
    sent = spark.sparkContext.broadcast(wanted)

    def filtered(batches):
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((sent.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    return docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(filtered, "doc_id long, text string")


def _checked(edges: DataFrame, docs: DataFrame, size: int, t: int) -> DataFrame:
    """``a, b, ok`` of every edge: whether it is a link. Hubs with many leaves are split over tasks by a salt, each with a copy of the hub's text.

    Texts travel, which take less than half the bytes of their sets, and of these only the edges' own and a few more.
    """
    docs = _among(docs, edges.select(F.explode(F.array("a", "b")).alias("doc_id")))
    edges = edges.withColumn("salt", (F.xxhash64("b") % 1000).cast("int"))
    load = edges.groupBy("a").agg(F.count("*").alias("leaves"))
    edges = edges.join(load, "a").withColumn("salt", F.pmod("salt", F.ceil(F.col("leaves") / 256).cast("int"))).drop("leaves")
    place = lambda hub: F.struct("a", "salt", F.lit(hub).alias("hub")).alias("to")
    places = edges.select(F.col("b").alias("doc_id"), place(False)).union(edges.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), place(True)))
    places = places.groupBy("doc_id").agg(F.collect_list("to").alias("to"))
    rows_ = docs.join(places, "doc_id").select("doc_id", "text", F.explode("to").alias("to"))
    rows_ = rows_.select("to.a", "to.salt", F.when(~F.col("to.hub"), F.col("doc_id")).alias("b"), "text")
    rows_ = rows_.repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows_.mapInArrow(lambda it: _verify(it, size, t), "a long, b long, ok boolean")


def _members(batches):
    for pdf in batches:
        yield pd.DataFrame({"members": [np.frombuffer(x, "<i8") for x in pdf["data"]]})


def _sizes(table: DataFrame) -> DataFrame:
    """``node, n`` of every document."""
    return table.where("kind = 0 and a is not null").groupBy(F.col("a").alias("node")).agg(F.max("n").alias("n"))


def _sketches(table: DataFrame) -> DataFrame:
    """``node, n, sketch`` of every document with a set."""
    sketch = F.expr(f"substring(data, {NAME_BYTES + 1})")
    return table.where("kind = 0 and a is not null and n > 0").select(F.col("a").alias("node"), "n", sketch.alias("sketch"))


def _may_link(batches, t: int):
    """The edges ``a, b`` whose sketches don't rule a link out."""
    for batch in batches:
        good = []
        for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            left, right = _folded([x, y], min(len(x), len(y)))
            good.append(int(np.bitwise_count(left ^ right).sum(dtype=np.int64)) <= difference(n_a + n_b, t))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _classes(table: DataFrame) -> DataFrame:
    """``node, first`` of every document whose set an earlier one has too; ``first`` is the smallest of them."""
    named = table.where("kind = 0 and a is not null and n > 0").select(F.col("a").alias("node"), F.substring("data", 1, NAME_BYTES).alias("data"))
    firsts = named.groupBy("data").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").drop("last")
    return named.join(firsts, "data").where("node <> first").select("node", "first").distinct()


def _to_first(df: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Column ``name`` with every document as the first of its class."""
    known = classes.select(F.col("node").alias(name), "first")
    return df.join(known, name, "left").withColumn(name, F.coalesce("first", name)).drop("first")


def _families(table: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``node, component, family`` of the sets that broken stars leave open.

    A run whose members ended in different components leaves their pairs open. Components that such
    runs tie together are a family.
    """
    runs = table.where("kind = 4").select("data").mapInPandas(_members, "members array<long>").withColumn("run", F.xxhash64("members"))
    nodes = runs.groupBy("run").agg(F.first("members").alias("members")).select("run", F.explode("members").alias("node"))
    placed = _to_first(nodes, classes, "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("run").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("run", "least")
    placed = written(placed.join(mixed, "run").select("node", "component", "least").distinct(), "mixed")
    ties = components(placed.select(F.col("least").alias("a"), F.col("component").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("family"))
    return placed.select("node", "component").distinct().join(ties, "component")


def _parities(grams: np.ndarray, each: int = 4, least: int = 8) -> np.ndarray:
    """For each of at least ``each`` slots a shingle (2 to the power of ``least`` in all), whether it holds an odd number: packed in 64-bit words."""
    width = 1 << max(least, int(each * len(grams) - 1).bit_length())
    odd = np.bincount((grams & U64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U64)


def _folded(parities: list[np.ndarray], words: int) -> np.ndarray:
    """All at the same number of words: the halves of a larger one are added up modulo 2."""
    out = np.empty((len(parities), words), U64)
    for row, p in zip(out, parities, strict=True):
        np.bitwise_xor.reduce(p.reshape(-1, words), axis=0, out=row)
    return out


def block_links(nodes: list[int], parts: list[int], sides: list[int], sets: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """Links that join components of a pair of blocks (sides 0 and 1; one block alone has side 0).

    Two sets differ at least in as many shingles as their slots differ in parity, which rules out
    nearly all pairs by a count of bits. The others are compared exactly, the likeliest first, unless
    links joined them before.
    """

    def linked(p: int, q: int) -> bool:
        merged = np.sort(np.concatenate([sets[p], sets[q]]))
        common = int((merged[1:] == merged[:-1]).sum())
        return 100 * common >= t * (len(merged) - common)

    found = _joining([len(x) for x in sets], [_parities(g) for g in sets], parts, sides, linked, t)
    return [(nodes[p], nodes[q]) for p, q in found]


def block_ties(parts: list[int], sides: list[int], sizes: list[int], sketches: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """Pairs of components, as few as join the same, that hold a pair of sets whose sketches don't rule a link out."""
    return [(parts[p], parts[q]) for p, q in _joining(sizes, sketches, parts, sides, lambda p, q: True, t)]


def _joining(sizes: list[int], parities: list[np.ndarray], parts: list[int], sides: list[int], linked, t: int) -> list[tuple[int, int]]:
    """Pairs of places that pass the bound by parities and ``linked``, and join components not yet joined."""
    size, side = np.array(sizes), np.array(sides)
    roots = {p: p for p in parts}

    def root(p: int) -> int:
        while roots[p] != p:
            roots[p] = p = roots[roots[p]]
        return p

    order = np.argsort(size, kind="stable")
    rows_, cols = (order[side[order] == 0], order[side[order] == 1]) if side.any() else (order, order)
    links, k = [], 0
    while k < len(rows_):
        # Rows of like size, and the columns whose size allows a link.
        end = min(k + 64, int(np.searchsorted(size[rows_], max(size[rows_[k]] * 5 // 4, size[rows_[k]] + 1), "right")))
        mine, k = rows_[k:end], end
        near = cols[np.searchsorted(size[cols], -(-size[mine[0]] * t // 100)) : np.searchsorted(size[cols], size[mine[-1]] * 100 // t, "right")]
        if not len(near):
            continue
        words = min(len(parities[mine[0]]), len(parities[near[0]]))
        left = _folded([parities[i] for i in mine], words)
        now = {p: root(p) for p in set(parts)}
        now = np.array([now[p] for p in parts])
        step = max(1, (1 << 21) // (words * len(mine)))
        found = []
        for c in range(0, len(near), step):
            part = near[c : c + step]
            apart = np.bitwise_count(left[:, None, :] ^ _folded([parities[i] for i in part], words)[None]).sum(2, dtype=np.int64)
            a, b = np.nonzero((apart <= difference(size[mine][:, None] + size[part], t)) & (now[mine][:, None] != now[part]))
            found.append(np.stack([mine[a], part[b], apart[a, b]], 1))
        found = np.concatenate(found)
        for p, q, _ in found[np.argsort(found[:, 2] / (size[found[:, 0]] + size[found[:, 1]]), kind="stable")].tolist():
            x, y = root(parts[p]), root(parts[q])
            if x == y:
                continue
            if linked(p, q):
                roots[max(x, y)] = min(x, y)
                links.append((p, q))
    return links


def _compare_blocks(batches, size: int, t: int):
    """Streams rows sorted by family and pair of blocks; a group is worked on when the next one begins."""
    key, held = None, []

    def done():
        nodes, parts, sides, sets = zip(*held, strict=True)
        links = np.array(block_links(list(nodes), list(parts), list(sides), list(sets), t), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        for first, sets in _sets([batch], size):
            columns = (batch.column(c).slice(first, len(sets)).to_pylist() for c in ("family", "i", "j", "block", "component", "node"))
            for family, i, j, block, component, node, grams in zip(*columns, sets.to_pylist(), strict=True):
                if (family, i, j) != key:
                    if held:
                        yield done()
                        held.clear()
                        trim()
                    key = (family, i, j)
                held.append((node, component, int(block != i), np.frombuffer(grams, U64)))
    if held:
        yield done()


def _compare_sketches(batches, t: int):
    """Streams sketches sorted by family and pair of blocks, and gives ties between components."""
    key, held = None, []

    def done():
        parts, sides, sizes, sketches = zip(*held, strict=True)
        ties = np.array(block_ties(list(parts), list(sides), list(sizes), list(sketches), t), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("family", "i", "j", "block", "component", "n", "sketch"))
        for family, i, j, block, component, n, sketch in zip(*columns, strict=True):
            if (family, i, j) != key:
                if held:
                    yield done()
                    held.clear()
                    trim()
                key = (family, i, j)
            held.append((component, int(block != i), n, np.frombuffer(sketch, U64)))
    if held:
        yield done()


def _placed(members: DataFrame, shingles_: int, rows_: int) -> DataFrame:
    """``members`` of families once for each pair ``i, j`` of blocks that they are in; ``blocks``, ``block``.

    Large families are split into blocks by a hash, and tasks get pairs of blocks: a set of a family of
    k blocks is sent k times.
    """
    blocks = F.ceil(F.greatest(F.sum("n") / shingles_, F.count("*") / rows_)).cast("int")
    load = members.groupBy("family").agg(blocks.alias("blocks"))
    placed = members.join(load, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _split(families: DataFrame, table: DataFrame, t: int) -> DataFrame:
    """``node, component, family`` after families are split into those that the sketches of their sets tie together."""
    placed = _placed(families.join(_sketches(table), "node"), TIE_SHINGLES, TIE_ROWS)
    keys = ["family", "i", "j"]
    sent = placed.select(*keys, "block", "component", "n", "sketch").repartition(partitions(table.sparkSession), *keys).sortWithinPartitions(*keys)
    ties = components(sent.mapInArrow(lambda it: _compare_sketches(it, t), "a long, b long"))
    return families.drop("family").join(ties.toDF("component", "family"), "component").select("node", "component", "family")


def _within_families(families: DataFrame, table: DataFrame, docs: DataFrame, size: int, t: int) -> DataFrame | None:
    """All further links ``a, b`` that join components of a family; None if there is no family."""
    placed = written(_placed(families.join(_sizes(table), "node"), BLOCK_SHINGLES, BLOCK_ROWS), "placed")
    sent_bytes = placed.agg(F.sum(8 * F.col("n")).alias("x")).first().x
    if sent_bytes is None:
        return None
    to = F.struct("family", "i", "j", "block", "component")
    places = placed.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(to).alias("to"))
    sent = _among(docs, placed.select(F.col("node").alias("doc_id"))).join(places, "doc_id").select("doc_id", "text", F.explode("to").alias("to")).select("to.*", F.col("doc_id").alias("node"), "text")
    keys = ["family", "i", "j"]
    tasks = max(partitions(docs.sparkSession), int(sent_bytes // TASK_BYTES) + 1)
    return sent.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _compare_blocks(it, size, t), "a long, b long")


def _node_components(docs: DataFrame, chars: int, size: int, t: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``docs(doc_id, text)``, whose ids are distinct or null."""
    spark = docs.sparkSession
    # More buckets than other shuffles have tasks: a task unpacks its signatures into arrays.
    buckets = max(3 * partitions(spark), chars // BUCKET_CHARS + 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(COST_SAMPLE)) == 0).select("text")

    def hashes(it):
        for _, grams in _sets(it, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(grams.to_pylist()), np.int64))], names=["g"])

    often = sample.mapInArrow(hashes, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= COST_COUNT).orderBy(F.desc("n"), "g").limit(COST_MOST)
    frequent = spark.sparkContext.broadcast(np.sort(np.frombuffer(np.array([r.g for r in often.collect()], np.int64).tobytes(), U64)))
    cells = docs.mapInArrow(lambda it: _emit(it, frequent.value, buckets, size, t), CELLS)
    spread = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int"))
    table = written(cells.withColumn("bucket", spread).repartition(buckets, "bucket").mapInArrow(_stars, CELLS), "stars")
    frequent.destroy()
    trim()
    classes = written(_classes(table), "classes")
    equal = classes.select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = _to_first(_to_first(table.where("kind = 3").select("a", "b").distinct(), classes, "a"), classes, "b")
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Sets whose sizes alone rule a link out needn't meet.
    large = _sizes(table)
    edges = edges.join(large.toDF("a", "n_a"), "a").join(large.toDF("b", "n_b"), "b")
    edges = written(edges.where(100 * F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b")).select("a", "b"), "edges")
    # Nor those whose sketches do.
    sketch = _sketches(table)
    edges = edges.join(sketch.toDF("a", "n_a", "s_a"), "a").join(sketch.toDF("b", "n_b", "s_b"), "b")
    edges = written(edges.mapInArrow(lambda it: _may_link(it, t), "a long, b long"), "likely")
    checked = written(_checked(edges, docs, size, t), "checked", SET_ROWS)
    found = written(components(equal.union(checked.where("ok").select("a", "b"))), "found")
    families = written(_split(written(_families(table, classes, found), "runs"), table, t), "families")
    links = _within_families(families, table, docs, size, t)
    if links is not None:
        found = joined(found, written(links, "more", SET_ROWS))
    sizes = table.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = 5, t: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; a document's set
    holds its distinct shingles of ``size`` words, or its whole sequence if that is shorter. Two
    documents link if their Jaccard similarity is at least ``t`` hundredths. The component is the
    smallest doc_id that links reach.

    Null and blank texts have no shingle and no link. A null doc_id keeps its row with a null
    component and takes no part in links. Rows that share a doc_id are linked; each text has its own
    set. Other columns are ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    with swept(docs.sparkSession):
        whole = by_id.agg(F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("n"), F.sum("chars").alias("chars")).first()
    if (whole.n or 0) < 2:
        return _node_components(docs, whole.chars or 0, size, t)
    # One node a text; nodes of one id are linked.
    keyed = docs.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))
    sets = written(_node_components(keyed.where("node is not null").select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), whole.chars or 0, size, t), "sets")
    ids = written(keyed.select("doc_id", "node").distinct(), "ids")
    same = ids.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = ids.join(same, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").union(sets.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))
    parts = components(links)
    placed = ids.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.where("node is not null").join(least, "component").select(F.col("node").alias("key"), "component_id").distinct()
    sizes = sets.select(F.col("doc_id").alias("key"), "n_shingles")
    known = keyed.where("node is not null").select("doc_id", F.col("node").alias("key")).join(placed, "key").join(sizes, "key").select("doc_id", "n_shingles", "component_id")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return known
    return known.union(nameless.mapInArrow(lambda it: _nameless(it, size), "doc_id long, n_shingles long, component_id long"))


def _nameless(batches, size: int):
    """Set sizes of rows without an id."""
    for batch in batches:
        for _, grams in _sets([batch], size):
            none = pa.nulls(len(grams), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array([len(x) // 8 for x in grams.to_pylist()], pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])


def near_duplicate_representatives(docs: DataFrame, size: int = 5, t: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component: one document of each group stays.

    Repeats of one doc_id stay as they are; a null doc_id stays. All columns are kept.
    """
    gone = settled(docs.sparkSession, lambda: jaccard_components(only(docs, "doc_id", "text"), size, t).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
