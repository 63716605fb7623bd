"""Replicate statistics of long trajectories (model, rep, time, obs, value, with an optional step index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.operators.order import in_parts


def sample_std(value: str) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def ensemble_stats(traj: DataFrame, align: str = "shortest") -> DataFrame:
    """(model, obs, step, time, mean, std, sem, n) over replicates at each step.

    "shortest" stops at the last step that every replicate of the model reaches, "ragged" keeps all steps.
    """
    if align not in ("shortest", "ragged"):
        raise ValueError("align is 'shortest' or 'ragged'")
    stats = traj.groupBy("model", "obs", "step").agg(
        F.avg("time").alias("time"),
        F.avg("value").alias("mean"),
        sample_std("value").alias("std"),
        F.count(F.lit(1)).alias("n"),
    )
    if align == "shortest":
        # steps are cut after the aggregate, when a step is one row however many replicates there are
        last = traj.groupBy("model", "rep").agg(F.max("step").alias("last"))
        last = last.groupBy("model").agg(F.min("last").alias("last"))
        stats = stats.join(last, "model").filter("step <= last").drop("last")
    return stats.withColumn("sem", F.col("std") / F.sqrt("n"))


def integrals(traj: DataFrame) -> DataFrame:
    """(model, rep, obs, integral): trapezoid over each replicate's own times; fewer than two samples give 0.

    A series is integrated inside range parts of (key, time); the joints between parts are added from one row per part. Parts are even in rows, so
    neither a very long series nor a burst of samples at one instant sits in one task.
    """
    keys = ["model", "rep", "obs"]
    placed = in_parts(traj.select(*keys, "time", "value"), keys, ["time"])
    order = W.partitionBy(*keys, "part").orderBy("time", "tie")
    area = 0.5 * (F.col("value") + F.lag("value").over(order)) * (F.col("time") - F.lag("time").over(order))
    at = F.struct("time", "tie")
    slices = (
        placed.withColumn("area", area)
        .groupBy(*keys, "part")
        .agg(
            F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"),
            F.min("time").alias("t0"),
            F.min_by("value", at).alias("v0"),
            F.max("time").alias("t1"),
            F.max_by("value", at).alias("v1"),
        )
    )
    along = W.partitionBy(*keys).orderBy("part")
    joint = 0.5 * (F.col("v0") + F.lag("v1").over(along)) * (F.col("t0") - F.lag("t1").over(along))
    joined = slices.withColumn("joint", F.coalesce(joint, F.lit(0.0)))
    return joined.groupBy(*keys).agg(F.sum(F.col("area") + F.col("joint")).alias("integral"))


def integral_stats(per_rep: DataFrame) -> DataFrame:
    """(model, obs, i_mean, i_std, n_reps) of per-replicate integrals."""
    return per_rep.groupBy("model", "obs").agg(
        F.avg("integral").alias("i_mean"), sample_std("integral").alias("i_std"), F.count(F.lit(1)).alias("n_reps")
    )


def endpoints(traj: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_end, value): the last sample of each run."""
    return traj.groupBy(*keys).agg(F.max("time").alias("t_end"), F.max_by("value", "time").alias("value"))


def baselines(traj: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, initial): the first sample of each run."""
    return traj.groupBy(*keys).agg(F.min_by("value", "time").alias("initial"))
