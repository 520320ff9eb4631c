"""Plan shapes that several operators share. All windows are partitioned; none is global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ordered_concat(value: str | Column, order: str | Column, separator: str) -> Column:
    """Aggregate: the group's values as one string, in the given order."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), separator)


def islands(df: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of each group: a row where ``starts`` holds begins the next run."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """Adds to each left row the ``take`` columns of the last right row at or before it, within ``by``; null if there is none.

    One shuffle on ``by``: both sides are sorted together and the last value is carried forward.
    Of right rows at the same place the one with the greatest values counts.
    """
    pack = F.struct(*[F.col(c) for c in take])
    a = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("_take"))
    b = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), pack.alias("_take"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_take").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", *[F.col("_last")[c].alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, bucket: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Joins points to the ranges that hold them (``start <= at < end``, or ``<= end`` if closed).

    Ranges are listed under every bucket of width ``bucket`` that they touch, which turns the range
    condition into an equi-join; pick about the usual length of a range.
    """
    slot = lambda c: F.floor(F.col(c) / bucket).cast("long")
    listed = ranges.withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    cond = [points[b] == listed[b] for b in by] + [slot_eq(points, at, bucket) == listed["_slot"], points[at] >= listed[start], points[at] <= listed[end] if closed else points[at] < listed[end]]
    joined = points.join(listed, cond, how)
    for b in by:
        joined = joined.drop(listed[b])
    return joined.drop("_slot")


def slot_eq(df: DataFrame, at: str, bucket: float) -> Column:
    return F.floor(df[at] / bucket).cast("long")
