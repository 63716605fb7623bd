"""Summaries of benchmark runs, run-to-run differences and file manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.operators.order import medians, upper_median


def timing_per_model(runs: DataFrame) -> DataFrame:
    """(engine, suite, model, ok, median_s, min_s, max_s, error): one failed run voids the model for that engine."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    ok = F.count_if(failed) == 0
    keys = ["engine", "suite", "model"]
    per = runs.groupBy(*keys).agg(
        ok.alias("ok"),
        F.when(ok, F.min("wall_s")).alias("min_s"),
        F.when(ok, F.max("wall_s")).alias("max_s"),
        F.min_by("error", F.when(failed, F.col("rep"))).alias("error"),
    )
    mid = medians(runs, keys, "wall_s", "mid")
    return per.join(mid, keys, "left").select(*keys, "ok", F.when(F.col("ok"), F.col("mid")).alias("median_s"), "min_s", "max_s", "error")


def speedups(per_model: DataFrame, engine: str, other: str) -> DataFrame:
    """(suite, model, median_s, other_s, speedup): slow models first, failed ones last."""
    mine = per_model.filter(F.col("engine") == engine).select("suite", "model", F.col("ok"), "median_s")
    theirs = per_model.filter(F.col("engine") == other).select(
        "suite", "model", F.col("ok").alias("other_ok"), F.col("median_s").alias("other_s")
    )
    ratio = F.when(F.col("median_s") > 0, F.col("other_s") / F.col("median_s"))
    rows = mine.join(theirs, ["suite", "model"], "left").withColumn("speedup", ratio)
    return rows.orderBy(F.col("median_s").desc_nulls_last(), "suite", "model")


def timing_summary(per_model: DataFrame, engine: str, other: str) -> DataFrame:
    """One row of totals over the models both engines finished."""
    rows = speedups(per_model, engine, other)
    middle = medians(rows, [], "speedup", "median_speedup")
    return rows.agg(
        F.count(F.lit(1)).alias("models"),
        F.count("speedup").alias("scored"),
        F.count_if(F.col("ok") & ~F.coalesce("other_ok", F.lit(False))).alias("other_missing"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.exp(F.avg(F.ln(F.when(F.col("speedup") > 0, F.col("speedup"))))).alias("geo_mean_speedup"),
        F.count_if(F.col("speedup") > 1.0).alias("faster"),
        F.count_if(F.col("speedup") < 1.0).alias("slower"),
    ).crossJoin(middle)


def horizon_summary(runs: DataFrame) -> DataFrame:
    """(engine, model, t_end, wall_med, events_med, ns_per_event, n_ok, n_err) over runs that fired events."""
    fired = F.col("events") > 0
    good = fired & (F.col("wall_s") > 0)
    keys = ["engine", "model", "t_end"]
    per = runs.groupBy(*keys).agg(
        F.count_if(good).alias("n_ok"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("n_err"),
    )
    per = per.filter("n_ok > 0")
    per = per.join(medians(runs.filter(good), keys, "wall_s", "wall_med"), keys)
    per = per.join(medians(runs.filter(fired), keys, "events", "events_med"), keys)
    return per.withColumn("ns_per_event", F.col("wall_med") / F.col("events_med") * 1e9)


def horizon_drift(summary: DataFrame) -> DataFrame:
    """(engine, model, drift): cost per event at the longest horizon over that at the shortest."""
    long, short = F.max_by("ns_per_event", "t_end"), F.min_by("ns_per_event", "t_end")
    return summary.groupBy("engine", "model").agg((long / short).alias("drift"))


def footprint_shares(rows: DataFrame) -> DataFrame:
    """Footprint rows with ``share`` of the peak, largest first."""
    share = F.col("table_bytes") / F.col("peak_rss")
    return rows.withColumn("share", share).orderBy(F.desc("share"), "suite", "model")


def footprint_summary(shared: DataFrame) -> DataFrame:
    """One row: upper median and maximum share, counts at one and ten percent, totals and the reach ratio."""
    n = F.count(F.lit(1))
    reach = F.sum("reach_bytes") / F.nullif(F.sum("table_bytes"), F.lit(0))
    return shared.agg(
        n.alias("models"),
        F.max("share").alias("max_share"),
        F.count_if(F.col("share") >= 0.10).alias("over_10"),
        F.count_if(F.col("share") >= 0.01).alias("over_1"),
        F.max("arena").alias("max_arena"),
        F.sum("table_bytes").alias("table_bytes"),
        F.sum("reach_bytes").alias("reach_bytes"),
        reach.alias("reach_ratio"),
    ).crossJoin(upper_median(shared, "share", "median_share"))


def run_diff(base: DataFrame, head: DataFrame, limit_pct: float = 15.0) -> DataFrame:
    """(model, base_s, head_s, delta_s, pct, flag) of two (model, wall_s) tables; largest change first."""
    both = base.select("model", F.col("wall_s").alias("base_s")).join(
        head.select("model", F.col("wall_s").alias("head_s")), "model", "full"
    )
    met = F.col("base_s").isNotNull() & F.col("head_s").isNotNull()
    delta = F.col("head_s") - F.col("base_s")
    pct = F.when(met & (F.col("base_s") > 0), delta / F.nullif("base_s", F.lit(0.0)) * 100.0).when(met, 0.0)
    rows = both.withColumn("delta_s", delta).withColumn("pct", pct)
    flag = (
        F.when(F.col("base_s").isNull(), "NEW")
        .when(F.col("head_s").isNull(), "GONE")
        .when(F.col("pct") > limit_pct, "SLOWER")
        .when(F.col("pct") < -limit_pct, "FASTER")
        .otherwise("")
    )
    return rows.withColumn("flag", flag).orderBy(F.abs("pct").desc_nulls_last(), "model")


def manifest_problems(manifest: DataFrame, live: DataFrame, outside: Column | None = None) -> DataFrame:
    """(path, problem): missing, changed and untracked files, and manifest rows that should not be there."""
    skip = outside if outside is not None else F.lit(False)
    want = manifest.select("path", F.col("sha256").alias("want"))
    have = live.select("path", F.col("sha256").alias("have"))
    rows = want.join(have, "path", "full")
    problem = (
        F.when(F.col("want").isNotNull() & skip, "out of scope")
        .when(F.col("have").isNull(), "missing")
        .when(F.col("want").isNull(), "untracked")
        .when(F.col("have") != F.col("want"), "mismatch")
    )
    return rows.select("path", problem.alias("problem")).filter("problem is not null")


def first_per_kind(problems: DataFrame, k: int = 20) -> DataFrame:
    """The report's first ``k`` problems of each kind by path, with how many more there are.

    Smallest k per kind come from a bounded aggregate, so a frequent kind is never sorted in one task.
    """
    salted = problems.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64)))
    w = W.partitionBy("problem", "salt").orderBy("path")
    near = salted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    top = near.withColumn("r", F.row_number().over(W.partitionBy("problem").orderBy("path"))).filter(F.col("r") <= k)
    total = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("total"))
    shown = top.groupBy("problem").agg(F.count(F.lit(1)).alias("shown"))
    more = total.join(shown, "problem").select("problem", (F.col("total") - F.col("shown")).alias("more"))
    return top.select("problem", "path", "r").join(more, "problem")


def model_tier(model: Column, prefixes: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The tier of the first prefix a model name starts with."""
    return reduce(lambda acc, p: F.when(model.startswith(p[0]), p[1]).otherwise(acc), reversed(prefixes), F.lit(default))


def select_models(models: DataFrame, suites: list[str] | None = None, names: list[str] | None = None,
                  number_range: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Models (suite, model) by suite, list, range of the number in the name, and count."""
    if suites:
        models = models.filter(F.col("suite").isin(suites))
    if names:
        models = models.filter(F.col("model").isin(names))
    if number_range:
        number = F.regexp_extract("model", r"(\d+)", 1).try_cast("decimal(38,0)")
        models = models.filter(number.between(*number_range))
    return models.orderBy("suite", "model").limit(limit) if limit else models


def schedule_order(models: DataFrame, timeouts: DataFrame, walls: DataFrame, default_s: float) -> DataFrame:
    """Models with their timeout and known wall time; by timeout where set, else by wall time, unknown last."""
    rows = models.join(timeouts.select("model", F.col("seconds").alias("set_s")), "model", "left").join(
        walls.select("model", "wall_mean_s"), "model", "left"
    )
    rows = rows.withColumn("cost_s", F.coalesce("set_s", "wall_mean_s")).withColumn("timeout_s", F.coalesce("set_s", F.lit(default_s)))
    return rows.drop("set_s").orderBy(F.col("cost_s").asc_nulls_last(), "model")


def classify_error(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose pattern occurs in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda acc, r: F.when(low.rlike(r[0]), r[1]).otherwise(acc), reversed(rules), F.lit(default))
