"""Places and small DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder, which is set for the session;
    on a cluster there is no such place to choose, so ValueError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch, so that batches of long texts stay small in the executors' Python.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """The session's ``key`` has this value for what runs meanwhile."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def swept(spark: SparkSession):
    """Shuffle files of what runs meanwhile go at the end of its job, not when the driver next collects its garbage."""
    return _setting(spark, _CLEANUP, "true")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows for what runs meanwhile."""
    before = int(spark.conf.get(_BATCH))
    return _setting(spark, _BATCH, str(min(rows, before) if before > 0 else rows))


#: Paths of the tables that were written since ``settled`` was called.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The table cuts the lineage and survives the loss of any executor. ``rows`` bounds Arrow batches.
    Spark drops the shuffle files of the write at its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    with small_batches(spark, rows), swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, ``written``; the tables that were written on the way to it are deleted."""
    outer = _MADE.get()
    token = _MADE.set(made := [])
    try:
        out = written(make(), name)
        kept = made.pop()
    finally:
        _MADE.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if outer is not None:
        outer.append(kept)
    return out


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to suit the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, taken by exact name, so that extra columns never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id) -> F.Column:
    """True for the documents that no model learns from: crc32 of the id as text, modulo 3, is 1.

    A null id counts as the empty text.
    """
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3) == 1


def sample_rows(rows: DataFrame, label: str, each: int, most: int, key: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list]:
    """About ``each`` rows of every value of ``label`` (its ``most`` commonest values), chosen by a hash of ``key``; the values."""
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most).collect()
    if not counts:
        return rows.limit(0), []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, each / r[1]))])
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(draw < F.try_element_at(share, F.col(label))).dropDuplicates(list(key)).limit(2 * each * len(counts)), sorted(r[0] for r in counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """``doc_id, text, label`` of about ``each`` labelled documents of every value, none of them held out.

    The ids are drawn from ``labels`` and, being at most twice ``each`` a value, broadcast to the
    documents, whose texts don't move. A document with several labels has the greatest.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias(label))
    drawn, _ = sample_rows(marked.where(F.col(label).isNotNull()), label, each, 16, ("doc_id",))
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    return found.dropDuplicates(["doc_id"])
