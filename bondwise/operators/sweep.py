"""Parameter sweeps: scenario grids, endpoints, forward and backward branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.functions.params import derive_parameters
from bondwise.operators.ensemble import endpoints


def scan_scenarios(grid: DataFrame, parameter: str, params: list[tuple[str, str | None, float]]) -> DataFrame:
    """One scenario per grid point (…, point_idx, param_value) with every other parameter resolved for it."""
    if parameter not in {p[0] for p in params}:
        raise ValueError(f"unknown parameter {parameter!r}")
    return derive_parameters(grid.withColumn(parameter, F.col("param_value")), params)


def scan_endpoints(traj: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obs, value): the last sample of each scenario's run."""
    return endpoints(traj, [*keys, "obs"]).select(*keys, "obs", "value")


def bifurcation_sequence(grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run_idx, branch, point_idx, param_value): the ascending sweep, then the same values descending."""
    size = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = grid.join(size, keys)
    up = rows.select(*keys, F.col("point_idx").alias("run_idx"), F.lit("fwd").alias("branch"), "point_idx", "param_value")
    down = rows.select(
        *keys, (2 * F.col("n") - 1 - F.col("point_idx")).alias("run_idx"), F.lit("bwd").alias("branch"), "point_idx", "param_value"
    )
    return up.unionByName(down)


def align_branches(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point_idx, obs, fwd, bwd, gap) from endpoints (keys, run_idx, n, obs, value) of a continued run.

    Run index r of the backward half belongs to point 2n - 1 - r of the ascending axis. The two branches meet by
    a conditional aggregate, one shuffle and no join.
    """
    back = F.col("run_idx") >= F.col("n")
    point = F.when(back, 2 * F.col("n") - 1 - F.col("run_idx")).otherwise(F.col("run_idx"))
    rows = ends.withColumn("point_idx", point).withColumn("back", back)
    both = rows.groupBy(*keys, "point_idx", "obs").agg(
        F.max(F.when(~F.col("back"), F.col("value"))).alias("fwd"), F.max(F.when(F.col("back"), F.col("value"))).alias("bwd")
    )
    return both.withColumn("gap", F.col("fwd") - F.col("bwd"))
