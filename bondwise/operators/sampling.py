"""Event logs to states at chosen instants.

A key may own a large share of all events, so no operator here orders a whole key in one window. Events are first
reduced to one row per (key, interval); windows run over intervals only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.operators.order import between, running_sum


def time_grid(t_start: float, t_end: float, n: int, instants: list[float] | None = None) -> list[float]:
    """Explicit instants if given, else n + 1 even ones; n = 0 keeps the two ends. Descending instants are an error."""
    if instants:
        if any(b < a for a, b in zip(instants, instants[1:])):
            raise ValueError("sample instants must ascend")
        return [float(t) for t in instants]
    if n < 1:
        return [float(t_start), float(t_end)]
    return [t_start + k * (t_end - t_start) / n for k in range(n + 1)]


def grid_table(spark: SparkSession, t_start: float, t_end: float, n: int) -> DataFrame:
    """(step, time): the even grid as a distributed table, for grids too long for a literal."""
    step = F.col("id").cast("int").alias("step")
    if n < 1:
        return spark.range(2).select(step, F.when(F.col("id") == 0, F.lit(float(t_start))).otherwise(float(t_end)).alias("time"))
    return spark.range(n + 1).select(step, (F.lit(float(t_start)) + F.col("id") * ((t_end - t_start) / n)).alias("time"))


@dataclass(frozen=True)
class EvenGrid:
    """``n`` + 1 even instants from ``t_start`` to ``t_end``, held as a rule: plans and memory do not grow with ``n``."""

    t_start: float
    t_end: float
    n: int

    def time(self, step: Column) -> Column:
        return F.lit(float(self.t_start)) + step * F.lit(float(self.t_end) - float(self.t_start)) / F.lit(float(max(self.n, 1)))

    def step_after(self, time: Column) -> Column:
        """Index of the first instant strictly later than ``time``: the rule's inverse, set right where rounding moved it by one."""
        width = (self.t_end - self.t_start) / max(self.n, 1)
        if self.n < 1 or width == 0:
            return F.when(time < F.lit(float(self.t_start)), 0).otherwise(max(self.n, 0) + 1)
        near = F.floor(F.greatest(F.least((time - F.lit(float(self.t_start))) / F.lit(width), F.lit(float(self.n))), F.lit(-1.0))) + 1
        down = (near > 0) & (self.time(near - 1) > time)
        up = (near <= self.n) & (self.time(near) <= time)
        return F.when(down, near - 1).when(up, near + 1).otherwise(near).cast("int")


def _stepped(events: DataFrame, grid: EvenGrid | list[float]) -> DataFrame:
    """Events that have a time, with ``step``, the first instant they are seen at: an event at an instant is not seen by it."""
    events = events.filter("time is not null")
    if isinstance(grid, EvenGrid):
        return events.withColumn("step", grid.step_after(F.col("time")))
    listed = _listed(events.sparkSession, grid).groupBy(F.col("time").alias("x")).agg(F.min("step").alias("y"))
    met = between(events, listed, "time")
    return met.select("row.*", F.coalesce(F.col("after.y").cast("int"), F.lit(len(grid))).alias("step"))


def _listed(spark: SparkSession, grid: list[float]) -> DataFrame:
    return spark.createDataFrame([(k, float(t)) for k, t in enumerate(grid)], "step int, time double")


def _each_step(per_key: DataFrame, grid: EvenGrid | list[float]) -> DataFrame:
    """Every key at every instant. A list of instants came from the driver, which bounds what is broadcast."""
    last = grid.n if isinstance(grid, EvenGrid) else len(grid) - 1
    steps = per_key.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0)))))
    if isinstance(grid, EvenGrid):
        return steps.withColumn("time", grid.time(F.col("step")))
    return steps.join(F.broadcast(_listed(per_key.sparkSession, grid)), "step")


def sample_at(events: DataFrame, keys: list[str], grid: EvenGrid | list[float], initial: float | None = None) -> DataFrame:
    """(keys, step, time, value): the last value set strictly before each instant.

    Later instants carry the last state forward. Instants before a key's first event get ``initial``, or the
    key's first value when it is None. Events at equal times are ordered by ``seq`` if present; events without a time are left out.
    """
    order = F.struct("time", "seq") if "seq" in events.columns else F.col("time")
    per_step = (
        _stepped(events, grid)
        .groupBy(*keys, "step")
        .agg(F.max_by("value", order).alias("value"), F.min_by("value", order).alias("first"), F.min(order).alias("at"))
    )
    per_key = per_step.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("step", "value"))).alias("by_step"), F.min_by("first", "at").alias("first")
    )
    rows = _each_step(per_key, grid).withColumn("seen", F.try_element_at("by_step", F.col("step")))
    held = F.last("seen", ignorenulls=True).over(W.partitionBy(*keys).orderBy("step"))
    before = F.col("first") if initial is None else F.lit(float(initial))
    return rows.select(*keys, "step", "time", F.coalesce(held, before).alias("value"))


def sample_counts(events: DataFrame, keys: list[str], grid: EvenGrid | list[float], delta: str = "delta") -> DataFrame:
    """(keys, step, time, value): running sums of ``delta`` strictly before each instant, 0 before the first."""
    per_step = _stepped(events, grid).groupBy(*keys, "step").agg(F.sum(delta).alias("delta"))
    per_key = per_step.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "delta"))).alias("by_step"))
    rows = _each_step(per_key, grid).withColumn("delta", F.coalesce(F.try_element_at("by_step", F.col("step")), F.lit(0)))
    upto = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*keys, "step", "time", F.sum("delta").over(upto).cast("double").alias("value"))


def running_state(events: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """Add ``state``, the running sum of ``delta`` per key in time order (ties by ``seq`` if present).

    Sums run inside range parts of (key, time), so a burst of one key spreads like any other rows.
    """
    return running_sum(events, keys, ["time"] + (["seq"] if "seq" in events.columns else []), delta, "state")


def order_violations(instants: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows of (keys, idx, time) whose time is below the one before (or not above it when ``strict``)."""
    prev = instants.select(*keys, (F.col("idx") + 1).alias("idx"), F.col("time").alias("before"))
    bad = F.col("time") <= F.col("before") if strict else F.col("time") < F.col("before")
    return instants.join(prev, [*keys, "idx"]).filter(bad)


def segment_breaks(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, idx, t_start, t_end) that do not start where the previous one ended, or that run backwards."""
    prev = segments.select(*keys, (F.col("idx") + 1).alias("idx"), F.col("t_end").alias("now"))
    joined = segments.join(prev, [*keys, "idx"], "left").withColumn("now", F.coalesce("now", "t_start"))
    tol = 1e-9 * F.greatest(F.lit(1.0), F.abs("now"))
    why = F.when(F.abs(F.col("t_start") - F.col("now")) > tol, "start disagrees with current time").when(
        F.col("t_end") < F.col("now"), "end before current time"
    )
    return joined.withColumn("error", why).filter("error is not null")
