"""Value grids of sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_error() -> Column:
    """Why a grid row (values, par_min, par_max, n_points, log_scale) cannot be built, or null."""
    listed = F.coalesce(F.size("values"), F.lit(0)) > 0
    return (
        F.when(listed, None)
        .when(F.col("n_points") < 1, "n_points must be at least 1")
        .when((F.col("par_min") != F.col("par_max")) & (F.col("n_points") < 2), "n_points must exceed 1 over a range")
        .when(F.col("log_scale") & ((F.col("par_min") <= 0) | (F.col("par_max") <= 0)), "log scale needs positive ends")
    )


def value_grid(specs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point_idx, param_value, error): one row per point; a bad spec gives one row with its error.

    An explicit list wins over the range; a single point or an empty range repeats the lower end.
    """
    n = F.col("n_points").cast("int")
    flat = (n == 1) | (F.col("par_min") == F.col("par_max"))
    ok = specs.withColumn("error", grid_error())
    steps = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    span = F.nullif((n - 1).cast("double"), F.lit(0.0))

    def point(k: Column) -> Column:
        lin = F.col("par_min") + k * ((F.col("par_max") - F.col("par_min")) / span)
        lo, hi = F.ln("par_min"), F.ln("par_max")
        geo = F.exp(lo + k * ((hi - lo) / span))
        return F.when(flat, F.col("par_min")).when(F.col("log_scale"), geo).otherwise(lin)

    listed = F.coalesce(F.size("values"), F.lit(0)) > 0
    none = F.array(F.lit(None).cast("double"))
    values = F.when(F.col("error").isNotNull(), none).when(listed, F.col("values")).otherwise(F.transform(steps, point))
    rows = ok.select(*keys, "error", F.posexplode(values).alias("point_idx", "param_value"))
    return rows.select(*keys, "point_idx", "param_value", "error")
