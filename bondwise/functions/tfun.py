"""Table functions: step or linear values over strictly increasing points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.operators.order import between


def point_errors(points: DataFrame, key: str = "name") -> DataFrame:
    """(name, error): tables with fewer than two points or with points that do not strictly increase.

    ``points`` is (name, idx, x, y); a table's neighbours meet by an equi-join on the index.
    """
    few = points.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n < 2")
    prev = points.select(key, (F.col("idx") + 1).alias("idx"), F.col("x").alias("before"))
    down = points.join(prev, [key, "idx"]).filter("x <= before").select(key).distinct()
    return few.select(key, F.lit("fewer than two points").alias("error")).unionByName(
        down.select(key, F.lit("x does not strictly increase").alias("error"))
    )


def apply_table(rows: DataFrame, points: DataFrame, at: str, method: str = "linear", out: str = "value") -> DataFrame:
    """Add ``out``, the table (x, y) read at column ``at``; flat outside, right-continuous steps inside.

    Rows and points meet in one ordered merge (``order.between``), the same for tables of any size and spread. A null ``at`` or an
    empty table gives null.
    """
    if method not in ("linear", "step"):
        raise ValueError("method is 'linear' or 'step'")
    met = between(rows, points, at)
    x0, y0, x1, y1 = (F.col(c) for c in ("before.x", "before.y", "after.x", "after.y"))
    mid = y0 if method == "step" else y0 + (y1 - y0) * ((F.col("at") - x0) / (x1 - x0))
    value = F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(mid)
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != out], value.alias(out))
