"""An ensemble against its reference: z-scores, thresholds, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.operators.draw import unit_hash
from bondwise.operators.ensemble import sample_std
from bondwise.operators.order import ranked
from bondwise.session import cut

# Fixed values of the published scoring rules.
SCREEN_LIMIT = 5.0
TZ_FLOOR = 5.0
TZ_MARGIN = 1.2
TZ_DEFAULT = 5.0
REPS_CAP = 100
CALIBRATED_N = (2, 3, 10)
ZERO_EPS = 1e-9
TINT_REL_TOL = 1e-6
FEATURE_Z_LIMIT = 5.0
FEATURE_REL_LIMIT = 0.25
TWO_SAMPLE_LIMIT = 6.0


def _worst(score: str, name: str = "obs") -> tuple[Column, Column]:
    """(largest score, its name): ties go to the first name; a score of 0 has no name."""
    best = F.min(F.struct((-F.coalesce(score, F.lit(0.0))).alias("s"), F.col(name).alias("o")))
    top = F.coalesce(-best["s"], F.lit(0.0))
    return top, F.when(top > 0, best["o"]).otherwise("")


def match_times(times: DataFrame, grid: DataFrame) -> DataFrame:
    """(model, time, step, ref_time): the nearest reference row within max(1e-9 |t_end|, 1e-12), later on ties.

    Times fall into buckets as wide as the tolerance, so a candidate is in the same bucket or the next to it.
    """
    ends = grid.groupBy("model").agg(F.max_by("ref_time", "step").alias("t_end"))
    tol = F.greatest(1e-9 * F.abs("t_end"), F.lit(1e-12))
    ends = ends.select("model", tol.alias("tol"))
    near = (
        grid.join(ends, "model")
        .withColumn("home", F.floor(F.col("ref_time") / F.col("tol")))
        .withColumn("bucket", F.explode(F.array(*[F.col("home") + d for d in (-1, 0, 1)])))
        .select("model", "bucket", "step", "ref_time", "tol")
    )
    mine = times.join(ends, "model").select("model", "time", F.floor(F.col("time") / F.col("tol")).alias("bucket"))
    dist = F.abs(F.col("time") - F.col("ref_time"))
    met = mine.join(near, ["model", "bucket"]).filter(dist <= F.col("tol"))
    best = met.groupBy("model", "time").agg(F.min(F.struct(dist.alias("d"), (-F.col("step")).alias("back"), "ref_time")).alias("r"))
    return best.select("model", "time", (-F.col("r.back")).alias("step"), F.col("r.ref_time").alias("ref_time"))


def _shared(traj: DataFrame, ref_stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trajectory rows on the reference steps that the first replicate meets, and those steps with trapezoid weights."""
    grid = ref_stats.groupBy("model", "step").agg(F.max("time").alias("ref_time"))
    # one row per (model, time) from here on; replicates meet the result once, at the end
    times = traj.groupBy("model", "time").agg(F.min("rep").alias("rep"))
    hit = match_times(times.select("model", "time"), grid)
    rep0 = times.groupBy("model").agg(F.min("rep").alias("rep0"))
    first = times.join(rep0, "model").filter("rep = rep0").select("model", "time")
    steps = first.join(hit, ["model", "time"]).select("model", "step", "ref_time").distinct()
    along = W.partitionBy("model").orderBy("step")
    left = F.coalesce(F.lag("ref_time").over(along), F.col("ref_time"))
    right = F.coalesce(F.lead("ref_time").over(along), F.col("ref_time"))
    steps = steps.select("model", "step", "ref_time", ((right - left) / 2).alias("w"))
    names = F.trim("obs").alias("obs")
    rows = traj.select("model", "rep", "obs", "time", "value")
    on_steps = rows.join(hit.select("model", "time", "step").join(steps, ["model", "step"]), ["model", "time"])
    return on_steps.select("model", "rep", names, "step", "ref_time", "w", "value"), steps


def step_scores(on_steps: DataFrame, ref_stats: DataFrame) -> DataFrame:
    """(model, obs, step, n, mean, std, ref_mean, ref_std, z, std_ratio, deviation) per shared step."""
    stats = on_steps.groupBy("model", "obs", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), sample_std("value").alias("std")
    )
    ref = ref_stats.select(
        "model", F.trim("obs").alias("obs"), "step", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std")
    )
    gap = F.abs(F.col("mean") - F.col("ref_mean"))
    z = (
        F.when(F.col("ref_std") > 0, gap / (F.col("ref_std") / F.sqrt("n")))
        .when(gap < ZERO_EPS, 0.0)
        .otherwise(gap)
    )
    ratio = F.when((F.col("ref_std") > 1e-6) & (F.col("ref_mean") > 1.0), F.col("std") / F.col("ref_std"))
    joined = stats.join(ref, ["model", "obs", "step"])
    return joined.withColumn("z", z).withColumn("std_ratio", ratio).withColumn("deviation", F.abs(F.col("std_ratio") - 1.0))


def rep_integrals(on_steps: DataFrame, steps: DataFrame) -> DataFrame:
    """(model, rep, obs, integral, complete): weighted sums over shared steps; a replicate missing a step is not complete."""
    need = steps.groupBy("model").agg(F.count(F.lit(1)).alias("need"))
    per = on_steps.groupBy("model", "rep", "obs").agg(
        F.sum(F.col("value") * F.col("w")).alias("integral"), F.countDistinct("step").alias("have")
    )
    return per.join(need, "model").select("model", "rep", "obs", "integral", (F.col("have") == F.col("need")).alias("complete"))


def integral_scores(per_rep: DataFrame, ref_tint: DataFrame) -> DataFrame:
    """(model, obs, n_used, dropped, tz): the integral z with its ladder; tz null where the rule skips it."""
    mine = per_rep.groupBy("model", "obs").agg(
        F.avg(F.when(F.col("complete"), F.col("integral"))).alias("mean"),
        F.coalesce(F.stddev_samp(F.when(F.col("complete"), F.col("integral"))), F.lit(0.0)).alias("std"),
        F.count_if("complete").alias("n_used"),
        F.count_if(~F.col("complete")).alias("dropped"),
    )
    ref = ref_tint.select("model", F.trim("obs").alias("obs"), "i_mean", "i_std", F.col("n_reps").alias("ref_n"))
    joined = mine.join(ref, ["model", "obs"])
    gap = F.abs(F.col("mean") - F.col("i_mean"))
    se = F.col("std") / F.sqrt("n_used")
    se_ref = F.when(F.col("ref_n") > 0, F.col("i_std") / F.sqrt("ref_n")).otherwise(0.0)
    flat_ref, flat = F.col("i_std") < ZERO_EPS, F.col("std") < ZERO_EPS
    spread = F.when(flat_ref, se).otherwise(F.sqrt(se * se + se_ref * se_ref))
    tz = (
        F.when(F.col("n_used") < 1, None)
        .when(flat_ref & flat & (gap < TINT_REL_TOL * (F.abs("i_mean") + 1.0)), None)
        .when(flat_ref & flat, F.lit(float("inf")))
        .when(spread < ZERO_EPS, None)
        .otherwise(gap / F.nullif(spread, F.lit(0.0)))
    )
    return joined.select("model", "obs", "n_used", "dropped", tz.alias("tz"))


def nearest_calibrated(n_reps: Column) -> Column:
    """The calibrated replicate count nearest to ``n_reps``; the smaller one on ties."""
    options = F.array(*[F.struct(F.abs(n_reps - c).alias("d"), F.lit(c).alias("c")) for c in CALIBRATED_N])
    return F.array_min(options)["c"]


def noise_stat(metric: str, n_reps: Column) -> Column:
    """Column ``{metric}_n{c}`` of a noise-floor row for the calibrated count nearest to ``n_reps``."""
    out = F.lit(None).cast("double")
    for c in CALIBRATED_N:
        out = F.when(nearest_calibrated(n_reps) == c, F.col(f"{metric}_n{c}")).otherwise(out)
    return out


def threshold(tz_p99: Column) -> Column:
    """Verdict limit from the null distribution's p99; the default where no calibration exists."""
    return F.when(tz_p99.isNull(), TZ_DEFAULT).otherwise(F.greatest(F.lit(TZ_FLOOR), TZ_MARGIN * tz_p99))


def adaptive_reps(tz_p99_n10: Column, base: Column) -> Column:
    """Replicates needed for the limit to come down to its floor, between ``base`` and the cap."""
    target = TZ_FLOOR / TZ_MARGIN
    need = F.ceil(10 * F.pow(tz_p99_n10 / target, F.lit(2)))
    return F.when(tz_p99_n10.isNull() | (tz_p99_n10 <= target), base).otherwise(
        F.greatest(base, F.least(need, F.lit(REPS_CAP)))
    )


def compare(traj: DataFrame, ref_stats: DataFrame, ref_tint: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """One verdict row per model of ``traj``.

    ``screen_z`` is a diagnostic; the verdict compares the largest integral z with the model's limit and falls
    back to the screen, flagged ``weak``, where no integrals can be compared.
    """
    on_steps, steps = _shared(traj, ref_stats)
    scored = step_scores(on_steps, ref_stats)
    screen_z, worst_screen = _worst("z")
    dev, _ = _worst("deviation")
    by_dev = F.min(F.struct((-F.coalesce("deviation", F.lit(0.0))).alias("s"), "obs", "std_ratio"))
    screens = scored.groupBy("model").agg(
        screen_z.alias("screen_z"),
        worst_screen.alias("worst_screen"),
        (F.lit(1.0) + dev).alias("std_ratio"),
        F.when(dev > 0, F.concat(by_dev["obs"], F.format_string(" (%.2f)", by_dev["std_ratio"]))).otherwise("").alias(
            "worst_obs_var"
        ),
        F.count(F.lit(1)).alias("n_compared"),
    )
    ints = integral_scores(rep_integrals(on_steps, steps), ref_tint)
    tz, worst_tz = _worst("tz")
    star = F.when(F.isnan(tz) | (tz == float("inf")), "*").otherwise("")
    tops = ints.groupBy("model").agg(tz.alias("tz"), F.concat(worst_tz, star).alias("worst"), F.sum("dropped").alias("dropped"))
    has_tint = ref_tint.select("model").distinct().withColumn("has_tint", F.lit(True))
    n_steps = steps.groupBy("model").agg(F.count(F.lit(1)).alias("n_steps"))
    reps = traj.select("model", "rep").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("n_reps"))
    has_ref = ref_stats.select("model").distinct().withColumn("has_ref", F.lit(True))
    out = reps
    for part in (has_ref, screens, n_steps, has_tint, tops):
        out = out.join(part, "model", "left")
    if noise is None:
        limit = F.lit(TZ_DEFAULT)
    else:
        out = out.join(noise, "model", "left")
        limit = threshold(noise_stat("tz_p99", F.col("n_reps")))
    usable = F.coalesce("has_tint", F.lit(False)) & (F.coalesce("n_steps", F.lit(0)) >= 2)
    out = out.withColumn("tz_max", F.when(usable, F.coalesce("tz", F.lit(0.0)))).withColumn("t_model", F.when(usable, limit))
    verdict = (
        F.when(F.col("has_ref").isNull(), "NO_REF")
        .when(F.col("n_compared").isNull(), "NO_MATCH")
        .when(F.col("tz_max").isNull(), F.when(F.col("screen_z") >= SCREEN_LIMIT, "FAIL").otherwise("PASS"))
        .when(F.col("tz_max") >= F.col("t_model"), "FAIL")
        .otherwise("PASS")
    )
    return out.select(
        "model",
        "n_reps",
        "n_compared",
        "screen_z",
        "worst_screen",
        "std_ratio",
        "worst_obs_var",
        "tz_max",
        F.when(F.col("tz_max").isNotNull(), F.coalesce("worst", F.lit(""))).alias("worst_tz"),
        "t_model",
        F.coalesce("dropped", F.lit(0)).alias("dropped"),
        verdict.alias("verdict"),
        (F.col("tz_max").isNull() & F.col("n_compared").isNotNull()).alias("weak"),
    )


def compare_feature(traj: DataFrame, ref: DataFrame, label: str) -> DataFrame:
    """The feature-suite variant: times meet when equal at six decimals; ``ref.std`` null marks a deterministic reference.

    With spread, the verdict is on the integral z against the integral of the reference mean; without, on the
    largest absolute gap relative to the largest reference value.
    """
    key = F.round("time", 6)
    ref = ref.select("model", F.trim("obs").alias("obs"), key.alias("t"), F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))
    mine = traj.select("model", "rep", F.trim("obs").alias("obs"), key.alias("t"), "value")
    reps = mine.select("model", "rep").distinct().groupBy("model").agg(
        F.count(F.lit(1)).alias("n_reps"), F.min("rep").alias("rep0")
    )
    times = mine.groupBy("model", "t").agg(F.min("rep").alias("rep"))
    first = times.join(reps, "model").filter("rep = rep0").select("model", "t")
    steps = first.join(ref.select("model", "t").distinct(), ["model", "t"])
    along = W.partitionBy("model").orderBy("t")
    left = F.coalesce(F.lag("t").over(along), F.col("t"))
    right = F.coalesce(F.lead("t").over(along), F.col("t"))
    steps = steps.select("model", "t", ((right - left) / 2).alias("w"))
    met = mine.join(steps, ["model", "t"]).join(ref, ["model", "obs", "t"])
    points = met.groupBy("model", "obs", "t").agg(
        F.avg("value").alias("mean"), F.max("ref_mean").alias("ref_mean"), F.max("ref_std").alias("ref_std")
    ).join(reps, "model")
    gap = F.abs(F.col("mean") - F.col("ref_mean"))
    z = (
        F.when(F.col("ref_std").isNull(), 0.0)
        .when(F.col("ref_std") > ZERO_EPS, gap / (F.col("ref_std") / F.sqrt("n_reps")))
        .when(gap < F.greatest(F.lit(1.0), 0.05 * (F.abs("ref_mean") + 1.0)), 0.0)
        .otherwise(100.0)
    )
    points = points.withColumn("gap", gap).withColumn("z", z)
    max_z, worst = _worst("z")
    tops = points.groupBy("model").agg(
        max_z.alias("max_z"), worst.alias("worst_obs"), F.max("gap").alias("max_abs_diff"), F.count(F.lit(1)).alias("n_compared")
    )
    need = steps.groupBy("model").agg(F.count(F.lit(1)).alias("need"))
    per = met.groupBy("model", "rep", "obs").agg(
        F.sum(F.col("value") * F.col("w")).alias("integral"),
        F.sum(F.col("ref_mean") * F.col("w")).alias("ref_integral"),
        F.countDistinct("t").alias("have"),
    ).join(need, "model").filter("have = need and need >= 2")
    ints = per.groupBy("model", "obs").agg(
        F.avg("integral").alias("mean"), (sample_std("integral") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.max("ref_integral").alias("ref_integral"),
    )
    ints = ints.withColumn(
        "tz", F.abs(F.col("mean") - F.col("ref_integral")) / F.when(F.col("se") > ZERO_EPS, F.col("se")).otherwise(1.0)
    )
    tz, worst_tz = _worst("tz")
    tz_tops = ints.groupBy("model").agg(tz.alias("tz"), worst_tz.alias("worst"))
    scale = ref.groupBy("model").agg(
        F.max(F.abs("ref_mean")).alias("top"), F.max(F.col("ref_std").isNotNull()).alias("has_std")
    )
    out = reps.join(scale, "model", "left").join(tops, "model", "left").join(tz_tops, "model", "left")
    has_std = F.coalesce("has_std", F.lit(False))
    tz_max = F.when(has_std, F.coalesce("tz", F.lit(0.0))).otherwise(0.0)
    rel = F.coalesce("max_abs_diff", F.lit(0.0)) / (F.col("top") + 1.0)
    verdict = (
        F.when(F.col("top").isNull(), "NO_REF")
        .when(has_std, F.when(tz_max < FEATURE_Z_LIMIT, "PASS").otherwise("FAIL"))
        .otherwise(F.when(rel < FEATURE_REL_LIMIT, "PASS").otherwise("FAIL"))
    )
    return out.select(
        "model",
        F.lit(label).alias("label"),
        F.coalesce("max_z", F.lit(0.0)).alias("max_z"),
        F.coalesce("worst_obs", F.lit("")).alias("worst_obs"),
        tz_max.alias("tz_max"),
        F.when(has_std, F.coalesce("worst", F.lit(""))).otherwise("").alias("worst_tz"),
        F.coalesce("max_abs_diff", F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce("n_compared", F.lit(0)).alias("n_compared"),
        verdict.alias("verdict"),
    )


def single_run_scores(run: DataFrame, ref_stats: DataFrame) -> DataFrame:
    """(model, obs, z): one run against the reference spread, largest over shared times.

    A reference without spread scores the raw gap; a gap above one half is lifted by 1e6 so that it always fails.
    """
    gap = F.abs(F.col("value") - F.col("mean"))
    z = (
        F.when(F.col("std") > 0, gap / F.col("std"))
        .when(gap < ZERO_EPS, 0.0)
        .when(gap > 0.5, F.lit(1e6) + gap)
        .otherwise(gap)
    )
    ref = ref_stats.select("model", "obs", F.round("time", 6).alias("t"), "mean", "std")
    met = run.withColumn("t", F.round("time", 6)).join(ref, ["model", "obs", "t"])
    return met.groupBy("model", "obs").agg(F.max(z).alias("z"))


def two_sample_scores(stats: DataFrame, ref: DataFrame, limit: float = TWO_SAMPLE_LIMIT) -> DataFrame:
    """(model, z, worst_obs, verdict): means with their standard errors on both sides, paired by step after the first."""
    other = ref.select("model", "obs", "step", F.col("mean").alias("ref_mean"), F.col("sem").alias("ref_sem"))
    err = F.sqrt(F.col("sem") * F.col("sem") + F.col("ref_sem") * F.col("ref_sem"))
    gap = F.abs(F.col("mean") - F.col("ref_mean"))
    z = F.when((err <= 0) & (gap <= 1e-9), 0.0).when(err <= 0, F.lit(float("inf"))).otherwise(gap / F.nullif(err, F.lit(0.0)))
    met = stats.filter("step > 0").join(other, ["model", "obs", "step"]).withColumn("z", z)
    top, worst = _worst("z")
    per = met.groupBy("model").agg(top.alias("z"), worst.alias("worst_obs"))
    return per.withColumn("verdict", F.when(F.col("z") <= limit, "PASS").otherwise("FAIL"))


def random_parts(sizes: DataFrame, n: int, splits: int, seed: int) -> DataFrame:
    """(model, split, rank): ``n`` different ranks from 1 to the model's ``reps`` for each split, all choices alike likely (Floyd's method).

    The draws come from MD5 digits. A split is a row with its n members, whatever the number of replicates; models with n replicates or fewer have none.
    """
    rows = sizes.filter(F.col("reps") > n).crossJoin(sizes.sparkSession.range(splits).withColumnRenamed("id", "split"))

    def draw(members, j):
        t = F.floor(unit_hash(F.lit(seed), F.col("model"), F.col("split"), F.lit(n), j) * j) + 1
        return F.concat(members, F.array(F.when(F.array_contains(members, t), j).otherwise(t)))

    chosen = F.aggregate(F.sequence(F.col("reps") - n + 1, F.col("reps")), F.array().cast("array<bigint>"), draw)
    return rows.select("model", "split", F.explode(chosen).alias("rank"))


def noise_floor(per_rep: DataFrame, sizes: tuple[int, ...] = CALIBRATED_N, splits: int = 500, seed: int = 7) -> DataFrame:
    """(model, tz_p95_n*, tz_p99_n*, tz_max_n*): integral z between random parts of one ensemble.

    ``per_rep`` has integrals per (model, rep, obs). In each split n replicates form the sample and the rest the reference; the largest z over observables of
    each split gives the null distribution. Only the sample is gathered: the rest has what it lacks of the ensemble's own sums, taken about the mean.
    """
    reps = cut(ranked(per_rep.select("model", "rep").distinct(), ["model"], "rep").select("model", "rep", "rank", F.col("n").alias("reps")), "replicates")
    mean = per_rep.groupBy("model", "obs").agg(F.avg("integral").alias("mean"))
    rows = cut(per_rep.join(mean, ["model", "obs"]).join(reps.select("model", "rep", "rank"), ["model", "rep"]).select("model", "rank", "obs", (F.col("integral") - F.col("mean")).alias("x")), "centred")
    sums = [F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("k")]
    whole = rows.groupBy("model", "obs").agg(*[c.alias(f"all_{n}") for c, n in zip(sums, "sqk")])
    models = reps.groupBy("model").agg(F.max("reps").alias("reps"))
    out = models.select("model")
    for n in sizes:
        members = random_parts(models, n, splits, seed)
        parts = rows.join(members, ["model", "rank"]).groupBy("model", "split", "obs").agg(*sums).join(whole, ["model", "obs"]).filter("k > 0 and all_k > k")
        rest = {c: F.col(f"all_{c}") - F.col(c) for c in "sqk"}
        spread = lambda s, q, k: F.when(k > 1, F.greatest((q - s * s / k) / F.nullif(k - 1, F.lit(0)), F.lit(0.0))).otherwise(0.0) / k
        se = F.sqrt(spread(F.col("s"), F.col("q"), F.col("k")) + spread(rest["s"], rest["q"], rest["k"]))
        gap = F.abs(F.col("s") / F.col("k") - rest["s"] / rest["k"])
        tz = F.when(se >= ZERO_EPS, gap / F.nullif(se, F.lit(0.0)))
        tops = parts.groupBy("model", "split").agg(F.coalesce(F.max(tz), F.lit(0.0)).alias("tz"))
        stats = tops.groupBy("model").agg(
            F.percentile("tz", 0.95).alias(f"tz_p95_n{n}"), F.percentile("tz", 0.99).alias(f"tz_p99_n{n}"), F.max("tz").alias(f"tz_max_n{n}"),
        )
        out = out.join(stats, "model", "left")
    return out


def overall_verdict(
    models: DataFrame, comparisons: DataFrame, violations: DataFrame, deterministic: list[str], ensemble: str, exact: str
) -> DataFrame:
    """(model, verdict): models (model, self_only) with comparison rows (model, label, verdict).

    A self-only model passes; models named in ``deterministic`` take the ``exact`` reference's verdict, all
    others the ``ensemble`` one; without it any FAIL fails. A violated invariant fails in every case.
    """
    real = F.col("verdict") != "NO_REF"
    per = comparisons.groupBy("model").agg(
        F.max(F.when(real & (F.col("label") == exact), F.col("verdict"))).alias("exact_v"),
        F.max(F.when(real & (F.col("label") == ensemble), F.col("verdict"))).alias("ensemble_v"),
        F.bool_or(F.col("verdict") == "FAIL").alias("any_fail"),
        F.bool_or(real).alias("any_real"),
    )
    broken = violations.select("model").distinct().withColumn("broken", F.lit(True))
    fallback = F.when(F.col("any_fail"), "FAIL").when(F.col("any_real"), "PASS").otherwise("NO_REF")
    listed = F.col("model").isin(deterministic) if deterministic else F.lit(False)
    verdict = (
        F.when(F.coalesce("broken", F.lit(False)), "FAIL")
        .when(F.col("self_only"), "PASS")
        .when(listed & F.col("exact_v").isNotNull(), F.col("exact_v"))
        .when(F.col("ensemble_v").isNotNull(), F.col("ensemble_v"))
        .otherwise(fallback)
    )
    joined = models.join(per, "model", "left").join(broken, "model", "left")
    return joined.select("model", verdict.alias("verdict"))


def tallies(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("models"))
