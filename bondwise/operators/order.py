"""Exact ranks and medians of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.session import cut

# Rows a part of a merge holds at most, about, since a task sorts its part twice in memory.
PART_ROWS = 500_000


def in_parts(rows: DataFrame, keys: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` laid out by range of (keys, values), written with their part number, which fixes the layout.

    A part holds a slice of a large group. Rows with equal values are told apart by ``tie``, a hash of all their
    columns, so that ties spread over parts too. Without ``parts`` their number is Spark's.
    """
    # a map has no hash of its own, but its text does
    hashed = lambda f: F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    tie = F.xxhash64(*map(hashed, rows.schema))
    placed = rows.withColumn("tie", tie).repartitionByRange(*([parts] if parts else []), *keys, *values, "tie").withColumn("part", F.spark_partition_id())
    return cut(placed, "parts")


def _shifts(placed: DataFrame, keys: list[str], size) -> DataFrame:
    """(keys, part, shift, n): what the parts before hold of ``size`` and what all parts hold; one row per group and part."""
    sizes = placed.groupBy(*keys, "part").agg(size.alias("size"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(*keys, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), F.sum("size").over(whole).alias("n"))


def ranked(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Add ``rank`` (from 1 by values) and ``n`` per group: counted inside range parts and shifted by the parts before."""
    placed = in_parts(rows, keys, list(values))
    inside = placed.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*values, "tie")))
    met = inside.join(_shifts(placed, keys, F.count(F.lit(1))), [*keys, "part"])
    return met.withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "part", "tie")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], delta: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``delta`` over this row and those before it in its group."""
    placed = in_parts(rows, keys, order)
    fine = W.partitionBy(*keys, "part").orderBy(*order, "tie").rowsBetween(W.unboundedPreceding, 0)
    met = placed.withColumn("inside", F.sum(delta).over(fine)).join(_shifts(placed, keys, F.sum(delta)), [*keys, "part"])
    return met.withColumn(name, F.col("shift") + F.col("inside")).drop("shift", "n", "part", "tie", "inside")


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): exact medians of the values that are not null."""
    middle = F.col("rank").isin(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2"))
    few = ranked(rows.filter(F.col(value).isNotNull()), keys, value)
    return few.filter(middle).groupBy(*keys).agg(F.avg(value).alias(name))


def upper_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the element at place n / 2 counted from 0, the larger of the two middle ones for even n; nulls do not count."""
    few = ranked(rows.filter(F.col(value).isNotNull()), [], value)
    return few.filter(F.col("rank") == F.expr("n div 2 + 1")).agg(F.max(value).alias(name))


POINT = "struct<x:double,y:double>"


def between(rows: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """(row, at, before, after) per row: the last of the points (x, y) at or before ``at`` and the first one beyond it, else null.

    Rows and points are merged in range parts, whose bounds are quantiles of both together, so points may cluster as they like and
    many rows may share a value. What a part needs of its neighbours is one point at each end. Points have distinct x; a row whose
    ``at`` is null meets none. The number of parts follows the number of rows, which is counted first, so that a task's memory does not grow.
    """
    facts = rows.select(F.col(at).cast("double").alias("at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    value = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    marks = points.filter("x is not null").select(
        F.col("x").cast("double").alias("at"), F.lit(None).cast(facts.schema["row"].dataType).alias("row"), value.alias("point"), F.lit(0).alias("kind")
    )
    both = marks.unionByName(facts.select("at", "row", F.lit(None).cast(POINT).alias("point"), F.lit(1).alias("kind")))
    count = both.count() // PART_ROWS + 1
    placed = in_parts(both, [], ["at", "kind"], count if count > 1 else None).drop("tie")
    ends = placed.groupBy("part").agg(F.max("point").alias("high"), F.min("point").alias("low"))
    parts = W.orderBy("part")  # one row per part
    left = F.last("high", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("left")
    right = F.first("low", ignorenulls=True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("right")
    inside = W.partitionBy("part").orderBy("at", "kind")
    # by range, because hashes would put several parts into one task
    dealt = placed.repartitionByRange(count, "part") if count > 1 else placed
    seen = dealt.withColumn("before", F.last("point", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # the same order backwards, so that the nearest point beyond is a running value too
    back = W.partitionBy("part").orderBy(F.desc("at"), F.desc("kind"))
    seen = seen.withColumn("after", F.last("point", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    met = seen.filter("kind = 1").join(F.broadcast(ends.select("part", left, right)), "part")
    known = lambda c: F.when(F.col("at").isNotNull(), c)
    return met.select("row", "at", known(F.coalesce("before", "left")).alias("before"), known(F.coalesce("after", "right")).alias("after"))
