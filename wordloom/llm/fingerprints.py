"""Bottom-k sketches of word shingles. DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles. The
sketch of a union is the k smallest values of the sketches, so parts merge in any order. Shingles
are five words (runs of characters other than space and \\x09-\\x0D, A-Z lower-cased); a shorter
text is one shingle, a text without words has the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import partitions

K = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 2**63: hashes are uniform over 2**64 values, the least is -2**63.
_HALF = 9223372036854775808.0


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row; as a plain argument it would be evaluated at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, size: int = 5) -> Column:
    """The bottom-k sketch of a text column as array<long>. Null counts as empty."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+"), "")
    grams = lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))),
        lambda i: F.xxhash64(*[F.coalesce(F.get(h, i + j), F.lit(0)) for j in range(size)]),
    )
    least = lambda h: F.slice(F.sort_array(F.array_distinct(grams(h))), 1, k)
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, h).otherwise(least(h)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    width = (F.element_at(s, -1).cast("double") + F.lit(_HALF)) / F.lit(2 * _HALF)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / width)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; exact if the union has up to k shingles. Two empty sketches are alike (1)."""
    shared = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared(u).cast("double") / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1; the empty set is contained in any."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def encode(s: Column) -> Column:
    """A sketch as text: base64 of its values in big-endian order."""
    return F.translate(F.base64(F.unhex(F.concat_ws("", F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0"))))), "\r\n", "")


def with_next(docs: DataFrame, slices: int, tasks: int) -> DataFrame:
    """Adds ``next_text`` and ``next_s``, of the row that follows by descending doc_id (after the last: the first).

    Ids are cut into ranges of about equal numbers of rows. Every range also gets the first row of
    the next range, so each is worked on by itself and no task sees all rows.
    """
    ids = docs.select("doc_id")
    cuts = [] if slices < 2 else ids.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    slot = F.size(F.filter(F.lit(cuts), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    slot = F.coalesce(slot, F.lit(len(cuts))).cast("int")
    firsts = {r.slot: r.first for r in ids.select(slot.alias("slot"), "doc_id").groupBy("slot").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    pairs = F.create_map(*[F.lit(x) for s in order for x in (s, before[s])]) if order else None
    heads = F.create_map(*[F.lit(x) for s in order for x in (s, firsts[s])]).cast("map<int,bigint>") if order else None
    placed = docs.withColumn("slot", slot)
    extra = F.when(F.col("doc_id").eqNullSafe(F.try_element_at(heads, F.col("slot"))), F.try_element_at(pairs, F.col("slot"))) if order else F.lit(None).cast("int")
    placed = placed.withColumn("extra", extra)
    own = F.struct(F.col("slot").alias("slot"), F.lit(0).alias("halo"))
    halo = F.struct(F.col("extra").alias("slot"), F.lit(1).alias("halo"))
    placed = placed.withColumn("p", F.explode(F.when(F.col("extra").isNull(), F.array(own)).otherwise(F.array(own, halo))))
    placed = placed.select("doc_id", "text", F.col("p.slot").alias("slot"), F.col("p.halo").alias("halo"))
    placed = placed.repartition(tasks, "slot").withColumn("s", sketch(F.col("text")))
    w = Window.partitionBy("slot").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return placed.select("doc_id", "text", "s", "halo", F.lead("text").over(w).alias("next_text"), F.lead("s").over(w).alias("next_s")).where("halo = 0").drop("halo")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last third is the beginning of the next document.

    Null texts count as empty. Rows that share a doc_id follow each other in text order; null ids
    come last. A table of one row is its own next. Other columns are ignored; an empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(next_text, 1, cut)"))
    tasks = partitions(spark)
    rows = with_next(docs, 4 * tasks, tasks).withColumn("n_chars", n).withColumn("cut", cut).withColumn("edited", edited)
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "s", "next_s", sketch(F.col("edited")).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encode(F.col("s")).alias("fingerprint"), encode(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e")).alias("near_edited"), resemblance(F.col("s"), F.col("next_s")).alias("near_next"), distinct_count(F.col("s")).alias("n_distinct"),
    )
