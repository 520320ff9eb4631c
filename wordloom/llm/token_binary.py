"""Binary token files with Re-Pair grammar compression.

Format. A file is a Parquet table of blocks. A block holds whole documents in order: their ids and
lengths, the block's shard and first position in it, and the block's ids as a grammar. Rule r of a
block stands for the pair of symbols ``rules[2r], rules[2r + 1]`` and has the number ``base + r``;
``sizes[r]`` is the length of its expansion. ``sequence`` is the block in these symbols. With the
sizes, any range of ids is decoded without the rest (``decode_range``). All numbers are
little-endian unsigned 32-bit.

Rules come in rounds, until no pair occurs ``LEAST_COUNT`` times: each round counts all neighbouring
pairs exactly and replaces the frequent ones, a place of two overlapping pairs by the more frequent
of them. A pair that keeps fewer than ``LEAST_COUNT`` places waits for the next round; the most
frequent pair keeps all of them, so each round makes a rule.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, shared_path, small_batches
from .textkit import trim
from .tokens import encode

END_ID = 0
#: A block is closed at so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: A pair that occurs so often is replaced. A rule takes 12 bytes, a replaced pair saves 4.
LEAST_COUNT = 8
BLOCKS = "shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, base long, rules binary, sizes binary, sequence binary"


def _pairs(s: np.ndarray, most: int, look: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring pairs that occur ``LEAST_COUNT`` times without overlap: first and second symbol, count, and all places, pair after pair.

    No symbol is above ``most``; with ``look`` only the pairs at these places, in order, count.
    """
    wide, deep = most.bit_length(), max(1, len(s).bit_length())
    place = np.arange(len(s) - 1) if look is None else look
    key = s[place].astype(np.uint64) << np.uint64(wide) | s[place + 1]
    place = place.astype(np.uint64)
    if not len(key):
        return key, key, key, key
    if (same := np.flatnonzero((key[1:] == key[:-1]) & (place[1:] == place[:-1] + np.uint64(1)))).size:
        # A run of one symbol: every other pair of it counts.
        opens = np.concatenate([[True], np.diff(same) > 1])
        first = np.maximum.accumulate(np.where(opens, same, 0))
        odd = (same - first) % 2 == 0
        keep = np.ones(len(key), bool)
        keep[same[odd] + 1] = False
        key, place = key[keep], place[keep]
    if 2 * wide + deep <= 64:
        both = np.sort(key << np.uint64(deep) | place)
        key, place = both >> np.uint64(deep), (both & np.uint64((1 << deep) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(begin, len(key)))
    often = np.flatnonzero(count >= LEAST_COUNT)
    held = np.repeat(count >= LEAST_COUNT, count)
    found = key[begin[often]]
    return (found >> np.uint64(wide)).astype(np.uint32), (found & np.uint64((1 << wide) - 1)).astype(np.uint32), count[often], place[held]


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``base, rules, sizes, sequence`` of an array of ids: no pair of the sequence occurs ``LEAST_COUNT`` times."""
    base = int(ids.max()) + 1 if len(ids) else 1
    s = ids.astype(np.uint32)
    rules, sizes, made, look = [np.zeros((0, 2), np.uint32)], np.ones(base, np.uint32), 0, None
    while len(s) >= 2 * LEAST_COUNT:
        left, right, count, place = _pairs(s, base + made, look)
        if not len(count):
            if look is None:
                break
            look = None
            continue
        # Where two frequent pairs overlap, the more frequent one has the place.
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(count) + 1)
        at = np.zeros(len(s) + 2, np.int32)
        at[place + 1] = np.repeat(rank, count)
        own = at[place + 1]
        wins = place[(own > at[place]) & (own > at[place + 2])]
        used = np.bincount(at[wins + 1], minlength=len(count) + 1)[rank]
        chosen = np.flatnonzero(used >= LEAST_COUNT)
        number = np.full(len(count) + 1, -1, np.int64)
        number[rank[chosen]] = np.arange(len(chosen))
        changed = np.zeros(len(s), bool)
        changed[wins[number[at[wins + 1]] >= 0]] = True
        won = np.flatnonzero(changed)
        s[won] = (base + made + number[at[won + 1]]).astype(np.uint32)
        lost = won + 1
        changed[lost] = True
        rest = place[~(changed[place] | changed[place + 1])]
        s = np.delete(s, lost)
        sizes = np.concatenate([sizes, sizes[left[chosen]] + sizes[right[chosen]]])
        rules.append(np.stack([left[chosen], right[chosen]], 1))
        made += len(chosen)
        # Only pairs with a new symbol, and frequent ones that lost places, can be frequent now; a last round looks at all.
        fresh = won - np.arange(len(won))
        near = np.zeros(len(s), bool)
        near[fresh] = near[fresh[fresh > 0] - 1] = near[rest - np.searchsorted(lost, rest)] = True
        near[-1] = False
        look = np.flatnonzero(near)
    return base, np.concatenate(rules), sizes[base:], s


def expand(s: np.ndarray, base: int, rules: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids of a sequence of symbols. With the ``sizes`` of the rules' expansions, these are worked out once and copied."""
    rules = rules.reshape(-1, 2)
    if sizes is not None and 0 < len(rules) and sizes.sum(dtype=np.int64) < 4 * len(s):
        flat = np.concatenate([np.arange(base, dtype=np.uint32), expand(rules.ravel(), base, rules)])
        size = np.concatenate([np.ones(base, np.int64), sizes])
        begin = np.cumsum(size) - size
        count = size[s]
        at = np.cumsum(count) - count
        return flat[np.repeat(begin[s] - at, count) + np.arange(count.sum())]
    while (wide := s >= base).any():
        begin = np.concatenate([[0], np.cumsum(wide + 1)])
        out = np.empty(begin[-1], np.uint32)
        out[begin[:-1][~wide]] = s[~wide]
        pair = rules[s[wide] - base]
        out[begin[:-1][wide]], out[begin[:-1][wide] + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def decode_range(block, low: int, high: int) -> np.ndarray:
    """Ids ``low`` to ``high`` (exclusive) of a block row, from the symbols that cover them alone."""
    base, s = block["base"], np.frombuffer(block["sequence"], "<u4")
    size = np.concatenate([np.ones(base, np.int64), np.frombuffer(block["sizes"], "<u4")])[s]
    begin = np.concatenate([[0], np.cumsum(size)])
    a, b = np.searchsorted(begin, low, "right") - 1, np.searchsorted(begin, high)
    return expand(s[a:b], base, np.frombuffer(block["rules"], "<u4"))[low - begin[a] : high - begin[a]]


def _blocks(batches, tokenizer: str):
    shard, first = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    docs: list[int | None] = []

    def close():
        nonlocal first
        flat = np.concatenate(ids)
        base, rules, sizes, s = compress(flat)
        row = {"shard": shard, "first": first, "n_ids": len(flat), "doc_ids": list(docs), "lengths": [len(x) for x in ids], "base": base, "rules": rules.astype("<u4").tobytes(), "sizes": sizes.astype("<u4").tobytes(), "sequence": s.astype("<u4").tobytes()}
        first += len(flat)
        trim()
        ids.clear()
        docs.clear()
        return pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("base", pa.int64()), ("rules", pa.binary()), ("sizes", pa.binary()), ("sequence", pa.binary())])
    held = 0
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for at_row, flat, at, _, _ in encode(batch.column("text"), tokenizer):
            for i in range(len(at) - 1):
                n = at[i + 1] - at[i] + 1
                if held and held + n > BLOCK_IDS:
                    yield close()
                    held = 0
                ids.append(np.append(flat[at[i] : at[i + 1]], np.uint32(END_ID)))
                docs.append(names[at_row + i])
                held += n
    if ids:
        yield close()
    trim()


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encodes every text of ``docs(doc_id, text)`` and writes the token file in ascending order of doc_id.

    Every document ends with id 0. Null texts count as empty. Rows that share a doc_id follow each
    other by text hash and text; null ids come last. Other columns are ignored; an empty table gives
    a file without blocks. ``tokenizer`` is the path of a tokenizers file that the executors have.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    placed = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        placed.mapInArrow(lambda it: _blocks(it, tokenizer), BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a token file, from its decoded ids.

    ``start`` is the number of ids of all documents before it. Shards, of which there are as many as
    the writer had tasks, are added up on the driver; positions within a shard are in its blocks.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    base, bases = 0, []
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        bases += [F.lit(r.shard), F.lit(base)]
        base += r.n
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = expand(np.frombuffer(row["sequence"], "<u4"), row["base"], np.frombuffer(row["rules"], "<u4"), np.frombuffer(row["sizes"], "<u4"))
                ends = np.cumsum(row["lengths"])
                begins = ends - np.array(row["lengths"])
                data = s.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(begins + row["first"]), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    return found.select("doc_id", (F.col("at") + F.try_element_at(F.create_map(*bases), F.col("shard"))).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokenise(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as a token file, in the shared folder unless ``path`` is given, and reads it back."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
