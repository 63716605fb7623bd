"""Queries over event logs, trajectories, ensembles, sweeps and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.functions.expressions import duration_text
from bondwise.operators import bench, draw, ensemble, order, quality, sampling, scores, sweep
from bondwise.plans.registry import query
from bondwise.plans.tables import daily_counts, day_grid, halves, table, timed_events
from bondwise.session import cut

EV = """
    WITH ev AS (SELECT *, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t FROM events),
    grid AS (SELECT CAST(d AS INTEGER) AS step, d * 86400.0 AS time FROM (SELECT unnest(range(CAST(ceil(max(t) / 86400) AS BIGINT) + 1)) AS d FROM ev)),
"""
DAILY = (
    EV
    + """
    keys AS (SELECT DISTINCT user_id, event_type FROM ev),
    traj AS (
      SELECT 'cohort' || (user_id % 5) AS model, CAST(user_id AS INTEGER) AS rep, event_type AS obs, step, time,
             CAST((SELECT count(*) FROM ev e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.t < g.time) AS DOUBLE) AS value
      FROM keys k CROSS JOIN grid g),
"""
)


@query(
    EV
    + """
    keys AS (SELECT user_id, event_type, arg_min(value, t) AS first FROM ev GROUP BY 1, 2)
    SELECT k.user_id, k.event_type, step, CAST(time AS DOUBLE) AS time,
           coalesce((SELECT arg_max(value, t) FROM ev e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.t < g.time), first) AS value
    FROM keys k CROSS JOIN grid g
    """
)
def sample_at_day(spark, sf):
    """State strictly before each day boundary, first state where there is none yet."""
    return sampling.sample_at(timed_events(spark, sf), ["user_id", "event_type"], day_grid(spark, sf))


@query(
    EV
    + """
    d AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN -1 ELSE 1 END AS delta, t FROM ev)
    SELECT event_id, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM d
    """
)
def running_state(spark, sf):
    ev = timed_events(spark, sf).withColumn("delta", F.when(F.col("event_type") == "purchase", -1).otherwise(1))
    return sampling.running_state(ev, ["user_id"]).select("event_id", "state")


@query(DAILY + "z AS (SELECT 1) SELECT * FROM traj")
def daily_event_counts(spark, sf):
    return daily_counts(spark, sf)


@query(
    DAILY
    + """
    z AS (SELECT 1)
    SELECT model, obs, CAST(step AS INTEGER) AS step, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std,
           round(coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS sem, CAST(count(*) AS BIGINT) AS n
    FROM traj GROUP BY 1, 2, 3
    """
)
def ensemble_stats(spark, sf):
    s = ensemble.ensemble_stats(daily_counts(spark, sf))
    return s.select("model", "obs", "step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("sem", 6).alias("sem"), "n")


@query(
    EV
    + """
    s AS (SELECT user_id, event_type, 0.5 * (value + lag(value) OVER w) * (t - lag(t) OVER w) AS a FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)),
    i AS (SELECT user_id, event_type, coalesce(sum(a), 0) AS integral FROM s GROUP BY 1, 2)
    SELECT event_type AS obs, round(avg(integral), 2) AS i_mean, round(coalesce(stddev_samp(integral), 0), 2) AS i_std, CAST(count(*) AS BIGINT) AS n_reps
    FROM i GROUP BY 1
    """
)
def trapezoid_stats(spark, sf):
    traj = timed_events(spark, sf).select(
        F.lit("all").alias("model"), F.col("user_id").alias("rep"), F.col("event_type").alias("obs"), "time", "value"
    )
    s = ensemble.integral_stats(ensemble.integrals(traj))
    return s.select("obs", F.round("i_mean", 2).alias("i_mean"), F.round("i_std", 2).alias("i_std"), "n_reps")


@query(
    EV
    + """
    z AS (SELECT 1)
    SELECT user_id, event_type, max(t) AS t_end, arg_max(value, t) AS value, arg_min(value, t) AS initial FROM ev GROUP BY 1, 2
    """
)
def run_ends(spark, sf):
    ev = timed_events(spark, sf)
    keys = ["user_id", "event_type"]
    return ensemble.endpoints(ev, keys).join(ensemble.baselines(ev, keys), keys)


HALVES = (
    DAILY
    + """
    cand AS (SELECT * FROM traj WHERE (rep // 5) % 2 = 0),
    ref AS (SELECT * FROM traj WHERE (rep // 5) % 2 = 1),
    rs AS (SELECT model, obs, step, time, avg(value) m, coalesce(stddev_samp(value), 0) s, coalesce(stddev_samp(value), 0) / sqrt(count(*)) se FROM ref GROUP BY ALL),
    cs AS (SELECT model, obs, step, avg(value) m, coalesce(stddev_samp(value), 0) s, count(*) n, coalesce(stddev_samp(value), 0) / sqrt(count(*)) se FROM cand GROUP BY ALL),
    w AS (SELECT step, (coalesce(lead(time) OVER (ORDER BY step), time) - coalesce(lag(time) OVER (ORDER BY step), time)) / 2 AS w FROM grid),
    ri AS (SELECT model, obs, rep, sum(value * w) i FROM ref JOIN w USING (step) GROUP BY ALL),
    ci AS (SELECT model, obs, rep, sum(value * w) i FROM cand JOIN w USING (step) GROUP BY ALL),
    rt AS (SELECT model, obs, avg(i) m, coalesce(stddev_samp(i), 0) s, count(*) n FROM ri GROUP BY ALL),
    ct AS (SELECT model, obs, avg(i) m, coalesce(stddev_samp(i), 0) s, count(*) n FROM ci GROUP BY ALL),
    """
)


def _reference(spark, sf):
    cand, ref = halves(cut(daily_counts(spark, sf), "daily"))
    return cand, ensemble.ensemble_stats(ref), ensemble.integral_stats(ensemble.integrals(ref))


@query(
    HALVES
    + """
    z AS (SELECT cs.model, obs, CASE WHEN rs.s > 0 THEN abs(cs.m - rs.m) / (rs.s / sqrt(n)) WHEN abs(cs.m - rs.m) < 1e-9 THEN 0 ELSE abs(cs.m - rs.m) END AS z,
                 CASE WHEN rs.s > 1e-6 AND rs.m > 1 THEN abs(cs.s / rs.s - 1) END AS dev
          FROM cs JOIN rs USING (model, obs, step)),
    za AS (SELECT model, max(z) screen_z, 1 + coalesce(max(dev), 0) std_ratio, count(*) n_compared FROM z GROUP BY 1),
    t AS (SELECT model, obs, abs(ct.m - rt.m) AS gap, ct.s AS s, rt.s AS rs, sqrt(ct.s * ct.s / ct.n + CASE WHEN rt.s < 1e-9 THEN 0 ELSE rt.s * rt.s / rt.n END) AS d, rt.m AS rm
          FROM ct JOIN rt USING (model, obs)),
    tz AS (SELECT model, obs, CASE WHEN rs < 1e-9 AND s < 1e-9 AND gap < 1e-6 * (abs(rm) + 1) THEN NULL WHEN rs < 1e-9 AND s < 1e-9 THEN 'inf'::DOUBLE
                                   WHEN d < 1e-9 THEN NULL ELSE gap / d END AS tz FROM t),
    ta AS (SELECT model, coalesce(max(tz), 0) tz_max, arg_max(obs, tz) AS worst_tz FROM tz GROUP BY 1)
    SELECT model, CAST((SELECT count(DISTINCT rep) FROM cand c WHERE c.model = za.model) AS BIGINT) AS n_reps, CAST(n_compared AS BIGINT) AS n_compared,
           round(screen_z, 6) AS screen_z, round(std_ratio, 6) AS std_ratio, round(tz_max, 6) AS tz_max, worst_tz, 5.0::DOUBLE AS t_model,
           CASE WHEN tz_max >= 5 THEN 'FAIL' ELSE 'PASS' END AS verdict
    FROM za JOIN ta USING (model)
    """
)
def tz_verdict(spark, sf):
    """Candidate times drift by less than the matching tolerance, as accumulated times do."""
    cand, ref, tint = _reference(spark, sf)
    cand = cand.withColumn("time", F.col("time") * (1 + 1e-10))
    v = scores.compare(cand, ref, tint)
    return v.select(
        "model", "n_reps", "n_compared", F.round("screen_z", 6).alias("screen_z"), F.round("std_ratio", 6).alias("std_ratio"),
        F.round("tz_max", 6).alias("tz_max"), "worst_tz", "t_model", "verdict",
    )


@query(
    HALVES
    + """
    r AS (SELECT model, count(DISTINCT rep) n FROM cand GROUP BY 1),
    z AS (SELECT cs.model, abs(cs.m - rs.m) gap, CASE WHEN rs.s > 1e-9 THEN abs(cs.m - rs.m) / (rs.s / sqrt(r.n)) WHEN abs(cs.m - rs.m) < greatest(1.0, 0.05 * (abs(rs.m) + 1)) THEN 0 ELSE 100 END z
          FROM cs JOIN rs USING (model, obs, step) JOIN r ON r.model = cs.model),
    za AS (SELECT model, max(z) max_z, max(gap) max_abs_diff, count(*) n_compared FROM z GROUP BY 1),
    ra AS (SELECT model, obs, sum(m * w) i FROM rs JOIN w USING (step) GROUP BY 1, 2),
    ta AS (SELECT model, max(abs(ct.m - ra.i) / CASE WHEN ct.s / sqrt(ct.n) > 1e-9 THEN ct.s / sqrt(ct.n) ELSE 1 END) tz FROM ct JOIN ra USING (model, obs) GROUP BY 1),
    top AS (SELECT model, max(abs(m)) top FROM rs GROUP BY 1)
    SELECT model, 'spread' AS label, round(max_z, 6) AS max_z, round(tz, 6) AS tz_max, round(max_abs_diff, 6) AS max_abs_diff, CAST(n_compared AS BIGINT) AS n_compared,
           CASE WHEN tz < 5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM za JOIN ta USING (model)
    UNION ALL
    SELECT model, 'exact', 0.0, 0.0, round(max_abs_diff, 6), CAST(n_compared AS BIGINT), CASE WHEN max_abs_diff / (top + 1) < 0.25 THEN 'PASS' ELSE 'FAIL' END
    FROM za JOIN top USING (model)
    """
)
def feature_verdict(spark, sf):
    """The feature-suite rules against a reference with spread and against its mean alone."""
    cand, ref, _ = _reference(spark, sf)
    bare = ref.withColumn("std", F.lit(None).cast("double"))
    v = scores.compare_feature(cand, ref, "spread").unionByName(scores.compare_feature(cand, bare, "exact"))
    return v.select(
        "model", "label", F.round("max_z", 6).alias("max_z"), F.round("tz_max", 6).alias("tz_max"),
        F.round("max_abs_diff", 6).alias("max_abs_diff"), "n_compared", "verdict",
    )


@query(
    HALVES
    + """
    z AS (SELECT c.model, c.rep, c.obs, abs(value - m) gap, s FROM cand c JOIN rs USING (model, obs, step)),
    q AS (SELECT model, rep, obs, max(CASE WHEN s > 0 THEN gap / s WHEN gap < 1e-9 THEN 0 WHEN gap > 0.5 THEN 1e6 + gap ELSE gap END) AS z FROM z GROUP BY ALL)
    SELECT model || '/' || rep AS model, obs, round(z, 6) AS z FROM q
    """
)
def single_run_scores(spark, sf):
    """Every candidate replicate as a run of its own."""
    cand, ref, _ = _reference(spark, sf)
    label = F.concat_ws("/", "model", F.col("rep").cast("string"))
    reps = cand.select("model", "rep").distinct()
    refs = reps.join(ref, "model").withColumn("model", label)
    runs = cand.withColumn("model", label)
    return scores.single_run_scores(runs, refs).select("model", "obs", F.round("z", 6).alias("z"))


@query(
    HALVES
    + """
    z AS (SELECT cs.model, abs(cs.m - rs.m) gap, sqrt(cs.se * cs.se + rs.se * rs.se) err FROM cs JOIN rs USING (model, obs, step) WHERE step > 0),
    q AS (SELECT model, max(CASE WHEN err <= 0 AND gap <= 1e-9 THEN 0 WHEN err <= 0 THEN 'inf'::DOUBLE ELSE gap / err END) z FROM z GROUP BY 1)
    SELECT model, round(z, 6) AS z, CASE WHEN z <= 6 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q
    """
)
def two_sample_verdict(spark, sf):
    cand, ref, _ = _reference(spark, sf)
    v = scores.two_sample_scores(ensemble.ensemble_stats(cand), ref)
    return v.select("model", F.round("z", 6).alias("z"), "verdict")


UNIT = "((('0x' || substr(md5(concat_ws('|', {})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


@query(
    DAILY
    + f"""
    ints AS (SELECT model, rep, obs, sum(0.5 * (value + prev) * (time - before)) AS x FROM (
        SELECT *, lag(value) OVER w AS prev, lag(time) OVER w AS before FROM traj WINDOW w AS (PARTITION BY model, rep, obs ORDER BY step)) GROUP BY ALL),
    ranks AS (SELECT model, rep, row_number() OVER (PARTITION BY model ORDER BY rep) AS r, count(*) OVER (PARTITION BY model) AS reps FROM (SELECT DISTINCT model, rep FROM ints)),
    models AS (SELECT model, max(reps) AS reps FROM ranks GROUP BY 1),
    splits AS (SELECT model, reps, n, split FROM models, (SELECT unnest([2, 3, 10]) AS n), (SELECT unnest(range(500)) AS split) WHERE reps > n),
    chosen AS (SELECT model, n, split, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(reps - n + 1, reps + 1), lambda j: [j])), lambda acc, j: CASE
          WHEN list_contains(acc, CAST(floor({UNIT.format("7, model, split, n, j[1]")} * j[1]) AS BIGINT) + 1) THEN list_append(acc, j[1])
          ELSE list_append(acc, CAST(floor({UNIT.format("7, model, split, n, j[1]")} * j[1]) AS BIGINT) + 1) END) AS members FROM splits),
    cells AS (SELECT c.model, n, split, obs, x, list_contains(members, r) AS mine FROM chosen c JOIN ranks USING (model) JOIN ints USING (model, rep)),
    parts AS (SELECT model, n, split, obs, avg(x) FILTER (mine) m1, avg(x) FILTER (NOT mine) m2, coalesce(var_samp(x) FILTER (mine), 0) v1, coalesce(var_samp(x) FILTER (NOT mine), 0) v2,
          count(*) FILTER (mine) k1, count(*) FILTER (NOT mine) k2 FROM cells GROUP BY ALL),
    zs AS (SELECT model, n, split, CASE WHEN sqrt(v1 / k1 + v2 / k2) >= 1e-9 THEN abs(m1 - m2) / sqrt(v1 / k1 + v2 / k2) END AS z FROM parts WHERE k1 > 0 AND k2 > 0),
    tops AS (SELECT model, n, split, coalesce(max(z), 0) AS z FROM zs GROUP BY ALL),
    stats AS (SELECT model, {", ".join(f"quantile_cont(z, 0.95) FILTER (n = {n}) tz_p95_n{n}, quantile_cont(z, 0.99) FILTER (n = {n}) tz_p99_n{n}, max(z) FILTER (n = {n}) tz_max_n{n}" for n in (2, 3, 10))} FROM tops GROUP BY 1)
    SELECT models.model, {", ".join(f"round(tz_p95_n{n}, 4) AS tz_p95_n{n}, round(tz_p99_n{n}, 4) AS tz_p99_n{n}, round(tz_max_n{n}, 4) AS tz_max_n{n}" for n in (2, 3, 10))},
        round(greatest(5.0, 1.2 * coalesce(tz_p99_n10, 0)), 4) AS t_model,
        CAST(CASE WHEN coalesce(tz_p99_n10, 0) <= 5.0 / 1.2 THEN 10 ELSE greatest(10, least(ceil(10 * pow(tz_p99_n10 / (5.0 / 1.2), 2)), 100)) END AS BIGINT) AS reps
    FROM models LEFT JOIN stats USING (model)
    """
)
def noise_floor(spark, sf):
    """Null distribution of the integral z by 500 random splits into 2, 3 or 10 replicates and the rest, with the limits it implies."""
    daily = cut(daily_counts(spark, sf), "daily")
    floor = scores.noise_floor(ensemble.integrals(daily))
    n = F.lit(10)
    stats = [f"tz_{s}_n{k}" for k in scores.CALIBRATED_N for s in ("p95", "p99", "max")]
    return floor.select(
        "model", *[F.round(c, 4).alias(c) for c in stats], F.round(scores.threshold(scores.noise_stat("tz_p99", n)), 4).alias("t_model"),
        scores.adaptive_reps(F.col("tz_p99_n10"), n).cast("long").alias("reps"),
    )


@query(
    """
    WITH p AS (SELECT p_type, p_brand, avg(p_size) / 10 AS p99, 1 + (count(*) % 12) AS n FROM part GROUP BY 1, 2)
    SELECT p_type, p_brand, CAST(CASE WHEN abs(2 - n) <= abs(3 - n) AND abs(2 - n) <= abs(10 - n) THEN 2 WHEN abs(3 - n) <= abs(10 - n) THEN 3 ELSE 10 END AS BIGINT) AS nearest,
           round(greatest(5.0, 1.2 * p99), 6) AS t_model,
           CAST(CASE WHEN p99 <= 5.0 / 1.2 THEN n ELSE greatest(n, least(ceil(10 * pow(p99 / (5.0 / 1.2), 2)), 100)) END AS BIGINT) AS reps
    FROM p
    """
)
def verdict_limits(spark, sf):
    p = table(spark, sf, "part").groupBy("p_type", "p_brand").agg((F.avg("p_size") / 10).alias("p99"), (1 + F.count(F.lit(1)) % 12).alias("n"))
    return p.select(
        "p_type", "p_brand", scores.nearest_calibrated(F.col("n")).cast("long").alias("nearest"), F.round(scores.threshold(F.col("p99")), 6).alias("t_model"),
        scores.adaptive_reps(F.col("p99"), F.col("n")).cast("long").alias("reps"),
    )


@query(
    """
    WITH m AS (SELECT c_custkey AS model, c_mktsegment = 'BUILDING' AS self_only FROM customer),
    c AS (SELECT o_custkey AS model, CASE WHEN o_orderpriority < '3' THEN 'ensemble' WHEN o_orderpriority < '5' THEN 'exact' ELSE 'other' END AS label,
                 CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'NO_REF' END AS v FROM orders),
    p AS (SELECT model, max(v) FILTER (label = 'ensemble' AND v <> 'NO_REF') ens, bool_or(v = 'FAIL') any_fail, bool_or(v <> 'NO_REF') any_real FROM c GROUP BY 1),
    b AS (SELECT DISTINCT o_custkey AS model FROM orders WHERE o_totalprice > 495000)
    SELECT CASE WHEN b.model IS NOT NULL THEN 'FAIL' WHEN self_only THEN 'PASS' WHEN ens IS NOT NULL THEN ens WHEN any_fail THEN 'FAIL' WHEN any_real THEN 'PASS' ELSE 'NO_REF' END AS verdict,
           CAST(count(*) AS BIGINT) AS models
    FROM m LEFT JOIN p USING (model) LEFT JOIN b USING (model) GROUP BY 1
    """
)
def overall_verdicts(spark, sf):
    orders = table(spark, sf, "orders")
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model"), (F.col("c_mktsegment") == "BUILDING").alias("self_only"))
    label = F.when(F.col("o_orderpriority") < "3", "ensemble").when(F.col("o_orderpriority") < "5", "exact").otherwise("other")
    v = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("NO_REF")
    comps = orders.select(F.col("o_custkey").alias("model"), label.alias("label"), v.alias("verdict"))
    broken = orders.filter("o_totalprice > 495000").select(F.col("o_custkey").alias("model"))
    return scores.tallies(scores.overall_verdict(models, comps, broken, [], "ensemble", "exact"))


@query(
    DAILY
    + """
    wide AS (SELECT model, rep, time, sum(value) FILTER (obs = 'view') v, sum(value) FILTER (obs = 'click') c FROM traj WHERE obs IN ('view', 'click') GROUP BY ALL),
    net AS (SELECT model, rep, time, c - v AS d FROM wide WHERE c IS NOT NULL AND v IS NOT NULL),
    start AS (SELECT model, rep, obs, arg_min(value, time) s FROM traj WHERE obs = 'view' GROUP BY ALL),
    bad AS (
      SELECT model, rep, 'nonneg' AS kind, 'net' AS obs, time, d AS value FROM net WHERE d < -1e-9
      UNION ALL SELECT t.model, t.rep, 'conserved', t.obs, t.time, value FROM traj t JOIN start USING (model, rep, obs) WHERE abs(value - s) > greatest(0.5, 0.01 * abs(s))
      UNION ALL SELECT model, rep, 'balance', 'view=click', time, v FROM wide WHERE v IS NOT NULL AND c IS NOT NULL AND abs(v - c) > greatest(0.5, 0.01 * greatest(abs(v), abs(c))))
    SELECT model, CAST(rep AS VARCHAR) AS rep, kind, obs, CAST(min(time) AS DOUBLE) AS time, arg_min(value, time) AS value FROM bad GROUP BY model, rep, kind, obs
    UNION ALL SELECT DISTINCT model, NULL::VARCHAR, 'missing', 'refund', NULL::DOUBLE, NULL::DOUBLE FROM traj
    """
)
def invariant_first_violation(spark, sf):
    """Views declared constant and equal to clicks, net clicks declared non-negative, refunds declared but absent."""
    daily = cut(daily_counts(spark, sf), "daily")
    models = daily.select("model").distinct()
    v, c = (daily.filter(F.col("obs") == o).select("model", "rep", "time", F.col("value").alias(o)) for o in ("view", "click"))
    net = v.join(c.hint("merge"), ["model", "rep", "time"]).select("model", "rep", F.lit("net").alias("obs"), "time", (F.col("click") - F.col("view")).alias("value"))
    traj = daily.select("model", "rep", "obs", "time", "value").unionByName(net)
    none = F.lit(None).cast("double").alias("expected")
    conserved = models.select("model", F.explode(F.array(F.lit("view"), F.lit("refund"))).alias("obs"), none)
    balance = models.select("model", F.lit("view").alias("lhs"), F.lit("click").alias("rhs"))
    found = quality.check_invariants(traj, conserved, balance)
    return found.select("model", F.col("rep").cast("string").alias("rep"), "kind", "obs", "time", "value")


@query(
    """
    WITH s AS (SELECT o_custkey k, o_orderkey o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i, epoch(o_orderdate) t FROM orders)
    SELECT CAST(count(*) FILTER (b.t < a.t) AS BIGINT) AS descending FROM s a JOIN s b ON a.k = b.k AND b.i = a.i + 1
    """
)
def out_of_order_instants(spark, sf):
    """Orders of a customer in key order whose dates go back."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.unix_timestamp("o_orderdate").alias("time"))
    rows = order.ranked(rows, ["k"], "o_orderkey").withColumnRenamed("rank", "idx").drop("n", "o_orderkey")
    return sampling.order_violations(rows, ["k"]).agg(F.count(F.lit(1)).alias("descending"))


@query(
    """
    WITH s AS (SELECT conv_id, turn, CAST(turn AS DOUBLE) + CASE WHEN role = 'system' THEN 0.25 ELSE 0 END AS t0, CAST(turn + 1 AS DOUBLE) - CASE WHEN length(text) % 7 = 0 THEN 2 ELSE 0 END AS t1 FROM conversations)
    SELECT b.conv_id, b.turn AS idx, CASE WHEN abs(b.t0 - coalesce(a.t1, b.t0)) > 1e-9 * greatest(1.0, abs(coalesce(a.t1, b.t0))) THEN 'start disagrees with current time' ELSE 'end before current time' END AS error
    FROM s b LEFT JOIN s a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
    WHERE abs(b.t0 - coalesce(a.t1, b.t0)) > 1e-9 * greatest(1.0, abs(coalesce(a.t1, b.t0))) OR b.t1 < coalesce(a.t1, b.t0)
    """
)
def segment_breaks(spark, sf):
    c = table(spark, sf, "conversations")
    t0 = F.col("turn").cast("double") + F.when(F.col("role") == "system", 0.25).otherwise(0.0)
    t1 = (F.col("turn") + 1).cast("double") - F.when(F.length("text") % 7 == 0, 2.0).otherwise(0.0)
    segs = c.select("conv_id", F.col("turn").alias("idx"), t0.alias("t_start"), t1.alias("t_end"))
    return sampling.segment_breaks(segs, ["conv_id"]).select("conv_id", "idx", "error")


@query(
    """
    WITH s AS (SELECT c_mktsegment m, count(*) n, max(c_acctbal) hi FROM customer GROUP BY 1)
    SELECT m, CAST(g AS INTEGER) AS step, round(g * (hi / n), 6) AS time FROM s, range(n + 1) r(g)
    """
)
def time_grids(spark, sf):
    """An even grid per segment with as many steps as it has customers."""
    s = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("hi"))
    steps = s.select("m", "n", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("step"))
    return steps.select("m", F.col("step").cast("int").alias("step"), F.round(F.col("step") * (F.col("hi") / F.col("n")), 6).alias("time"))


@query(
    EV
    + """
    d AS (SELECT user_id, event_type AS obs, CAST(floor(t / 86400) AS INTEGER) AS run_idx, arg_max(value, t) AS value FROM ev GROUP BY 1, 2, 3),
    h AS (SELECT (max(run_idx) + 2) // 2 AS n FROM d),
    p AS (SELECT user_id, obs, CASE WHEN run_idx >= n THEN 2 * n - 1 - run_idx ELSE run_idx END AS point_idx, max(value) FILTER (run_idx < n) fwd, max(value) FILTER (run_idx >= n) bwd FROM d, h GROUP BY 1, 2, 3)
    SELECT *, fwd - bwd AS gap FROM p
    """
)
def bifurcate_align(spark, sf):
    """The days as a sweep up in their first half and down in the second: endpoints per day, backward days on the ascending axis."""
    day = F.floor(F.col("time") / 86400).cast("int")
    ev = timed_events(spark, sf).withColumn("run_idx", day).withColumn("obs", F.col("event_type"))
    half = ev.agg(F.expr("(max(run_idx) + 2) div 2").cast("int").alias("n"))
    ends = sweep.scan_endpoints(ev, ["user_id", "run_idx"]).crossJoin(F.broadcast(half))
    return sweep.align_branches(ends, ["user_id"])


@query(
    """
    WITH s AS (SELECT count(*) n, max(c_acctbal) hi FROM customer)
    SELECT CAST(g AS INTEGER) AS step, round(g * (hi / n), 6) AS time FROM s, range(n + 1) r(g)
    """
)
def even_grid(spark, sf):
    """One even grid with as many steps as there are customers, as a distributed table."""
    row = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("hi")).first()
    return sampling.grid_table(spark, 0.0, row["hi"], row["n"]).select("step", F.round("time", 6).alias("time"))


@query(
    """
    WITH a AS (SELECT s_suppkey AS point_idx, s_acctbal AS a FROM supplier),
    b AS (SELECT *, CASE WHEN a / 4 + 0.5 = 100.0 / 4 + 0.5 THEN 25.001 ELSE a / 4 + 0.5 END AS b FROM a),
    c AS (SELECT *, CASE WHEN 2 * b + a * a = 2 * 25.001 + 100.0 * 100.0 THEN 40000.5 ELSE 2 * b + a * a END AS c FROM b)
    SELECT CAST(point_idx AS BIGINT) AS point_idx, a AS param_value, round(b, 9) AS "B", round(c, 6) AS "C", 0.5::DOUBLE AS "D" FROM c
    """
)
def sweep_scenarios(spark, sf):
    """A point per supplier that sets A to its balance; every other parameter follows."""
    from bondwise.plans.rate_queries import PARAMS

    grid = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("point_idx"), F.col("s_acctbal").alias("param_value"))
    rows = sweep.scan_scenarios(grid, "A", PARAMS)
    return rows.select("point_idx", "param_value", F.round("B", 9).alias("B"), F.round("C", 6).alias("C"), "D")


@query(
    """
    WITH s AS (SELECT p_type, p_brand, min(p_retailprice) lo, max(p_retailprice) hi, count(*) n, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) % 2 = 0 AS lg FROM part GROUP BY 1, 2)
    SELECT p_type, p_brand, CAST(k AS INTEGER) AS point_idx,
           round(CASE WHEN n = 1 OR lo = hi THEN lo WHEN lg THEN exp(ln(lo) + k * (ln(hi) - ln(lo)) / (n - 1)) ELSE lo + k * (hi - lo) / (n - 1) END, 6) AS param_value
    FROM s, range(n) r(k)
    """
)
def scan_grid(spark, sf):
    """Linear and geometric grids over each brand's prices, one point per part."""
    from bondwise.functions.grids import value_grid

    s = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(
        F.min("p_retailprice").alias("par_min"), F.max("p_retailprice").alias("par_max"), F.count(F.lit(1)).alias("n_points")
    )
    lg = F.row_number().over(W.partitionBy("p_type").orderBy("p_brand")) % 2 == 0
    specs = s.withColumn("log_scale", lg).withColumn("values", F.lit(None).cast("array<double>"))
    return value_grid(specs, ["p_type", "p_brand"]).select("p_type", "p_brand", "point_idx", F.round("param_value", 6).alias("param_value"))


@query(
    """
    WITH g AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS point_idx, p_retailprice AS v FROM part),
    n AS (SELECT p_brand, count(*) n FROM part GROUP BY 1)
    SELECT p_brand, CAST(point_idx AS INTEGER) AS run_idx, 'fwd' AS branch, v AS param_value FROM g
    UNION ALL SELECT p_brand, CAST(2 * n - 1 - point_idx AS INTEGER), 'bwd', v FROM g JOIN n USING (p_brand)
    """
)
def bifurcation_sequence(spark, sf):
    part = order.ranked(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_partkey")
    g = part.select("p_brand", (F.col("rank") - 1).alias("point_idx"), F.col("p_retailprice").alias("param_value"))
    return sweep.bifurcation_sequence(g, ["p_brand"]).select("p_brand", F.col("run_idx").cast("int").alias("run_idx"), "branch", "param_value")


RUNS = """
    WITH runs AS (SELECT event_type AS engine, 's' || (user_id % 3) AS suite, 'm' || user_id AS model, event_id AS rep, value AS wall_s,
                         CASE WHEN value > 200 THEN 'timeout' ELSE '' END AS error FROM events),
    per AS (SELECT engine, suite, model, count(*) FILTER (error <> '') = 0 AS ok, median(wall_s) med, min(wall_s) lo, max(wall_s) hi FROM runs GROUP BY 1, 2, 3),
    sp AS (SELECT a.suite, a.model, a.ok, coalesce(b.ok, false) AS bok, CASE WHEN a.ok AND a.med > 0 AND b.ok THEN b.med / a.med END AS s
           FROM per a LEFT JOIN per b ON a.suite = b.suite AND a.model = b.model AND b.engine = 'view' WHERE a.engine = 'click')
"""


def _runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("engine"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("suite"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), F.col("event_id").alias("rep"), F.col("value").alias("wall_s"),
        F.when(F.col("value") > 200, "timeout").otherwise("").alias("error"),
    )


@query(
    RUNS + "SELECT engine, suite, model, ok, CASE WHEN ok THEN round(med, 6) END AS median_s, CASE WHEN ok THEN lo END AS min_s, CASE WHEN ok THEN hi END AS max_s FROM per"
)
def timing_per_model(spark, sf):
    t = bench.timing_per_model(_runs(spark, sf))
    return t.select("engine", "suite", "model", "ok", F.round("median_s", 6).alias("median_s"), "min_s", "max_s")


@query(
    RUNS
    + """
    SELECT CAST(count(*) AS BIGINT) AS models, CAST(count(s) AS BIGINT) AS scored, CAST(count(*) FILTER (ok AND NOT bok) AS BIGINT) AS other_missing,
           CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed, round(median(s), 6) AS median_speedup, round(exp(avg(ln(s))), 6) AS geo_mean_speedup,
           CAST(count(*) FILTER (s > 1) AS BIGINT) AS faster, CAST(count(*) FILTER (s < 1) AS BIGINT) AS slower FROM sp
    """
)
def timing_summary(spark, sf):
    t = bench.timing_summary(bench.timing_per_model(_runs(spark, sf)), "click", "view")
    return t.withColumn("median_speedup", F.round("median_speedup", 6)).withColumn("geo_mean_speedup", F.round("geo_mean_speedup", 6))


HORIZON = """
    WITH r AS (SELECT 'e' || (l_suppkey % 2) AS engine, l_suppkey AS model, CAST(l_linenumber AS DOUBLE) AS t_end, l_extendedprice / 1000 AS wall_s, CAST(l_quantity AS BIGINT) - 1 AS events FROM lineitem),
    h AS (SELECT engine, model, t_end, median(wall_s) FILTER (events > 0 AND wall_s > 0) w, median(events) FILTER (events > 0) e, count(*) FILTER (events > 0 AND wall_s > 0) n_ok,
                 count(*) FILTER (NOT (events > 0 AND wall_s > 0)) n_err FROM r GROUP BY 1, 2, 3)
"""


def _horizon(spark, sf):
    runs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("e"), (F.col("l_suppkey") % 2).cast("string")).alias("engine"), F.col("l_suppkey").alias("model"), F.col("l_linenumber").cast("double").alias("t_end"),
        (F.col("l_extendedprice") / 1000).alias("wall_s"), (F.col("l_quantity").cast("long") - 1).alias("events"),
    )
    return bench.horizon_summary(runs)


@query(
    HORIZON
    + "SELECT engine, model, t_end, round(w, 6) AS wall_med, CAST(e AS DOUBLE) AS events_med, CAST(n_ok AS BIGINT) AS n_ok, CAST(n_err AS BIGINT) AS n_err, round(w / e * 1e9, 0) AS ns_per_event FROM h WHERE n_ok > 0"
)
def horizon_summary(spark, sf):
    h = _horizon(spark, sf)
    return h.select("engine", "model", "t_end", F.round("wall_med", 6).alias("wall_med"), "events_med", "n_ok", "n_err", F.round("ns_per_event", 0).alias("ns_per_event"))


@query(HORIZON + "SELECT engine, model, round(arg_max(w / e, t_end) / arg_min(w / e, t_end), 6) AS drift FROM h WHERE n_ok > 0 GROUP BY 1, 2")
def horizon_drift(spark, sf):
    return bench.horizon_drift(_horizon(spark, sf)).select("engine", "model", F.round("drift", 6).alias("drift"))


@query(
    """
    WITH f AS (SELECT p_size * 1000 AS tb, p_size * 700 AS rb, p_retailprice * 40 AS peak, p_partkey AS arena FROM part), s AS (SELECT *, tb / peak AS share FROM f)
    SELECT CAST(count(*) AS BIGINT) AS models, round((SELECT share FROM s ORDER BY share LIMIT 1 OFFSET (SELECT count(*) // 2 FROM s)), 9) AS median_share, round(max(share), 9) AS max_share,
           CAST(count(*) FILTER (share >= 0.1) AS BIGINT) AS over_10, CAST(count(*) FILTER (share >= 0.01) AS BIGINT) AS over_1, CAST(max(arena) AS BIGINT) AS max_arena,
           CAST(sum(tb) AS BIGINT) AS table_bytes, CAST(sum(rb) AS BIGINT) AS reach_bytes, round(sum(rb) / sum(tb), 9) AS reach_ratio FROM s
    """
)
def footprint_summary(spark, sf):
    rows = table(spark, sf, "part").select(
        F.lit("s").alias("suite"), F.col("p_partkey").alias("model"), F.col("p_partkey").alias("arena"), (F.col("p_size").cast("long") * 1000).alias("table_bytes"),
        (F.col("p_size").cast("long") * 700).alias("reach_bytes"), (F.col("p_retailprice") * 40).alias("peak_rss"),
    )
    s = bench.footprint_summary(bench.footprint_shares(rows))
    return s.select("models", *[F.round(c, 9).alias(c) for c in ("median_share", "max_share")], "over_10", "over_1", "max_arena", "table_bytes", "reach_bytes", F.round("reach_ratio", 9).alias("reach_ratio"))


@query(
    """
    WITH b AS (SELECT user_id || event_type AS model, avg(value) AS w FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
    h AS (SELECT user_id || event_type AS model, avg(value) AS w FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT model, round(b.w, 6) AS base_s, round(h.w, 6) AS head_s, round((h.w - b.w) / b.w * 100, 4) AS pct,
           CASE WHEN b.w IS NULL THEN 'NEW' WHEN h.w IS NULL THEN 'GONE' WHEN (h.w - b.w) / b.w * 100 > 15 THEN 'SLOWER' WHEN (h.w - b.w) / b.w * 100 < -15 THEN 'FASTER' ELSE '' END AS flag
    FROM b FULL JOIN h USING (model)
    """
)
def run_diff(spark, sf):
    """Mean value per user and type, second half of the month against the first."""
    ev = table(spark, sf, "events").withColumn("model", F.concat(F.col("user_id").cast("string"), "event_type"))
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    half = lambda keep: ev.filter(keep).groupBy("model").agg(F.avg("value").alias("wall_s"))
    d = bench.run_diff(half(~late), half(late))
    return d.select("model", F.round("base_s", 6).alias("base_s"), F.round("head_s", 6).alias("head_s"), F.round("pct", 4).alias("pct"), "flag")


MANIFEST = """
    WITH m AS (SELECT 'd/' || doc_id AS path, sha256(text) AS want FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'b/' || item_id, sha256(text) FROM benchmark),
    l AS (SELECT 'd/' || doc_id AS path, sha256(CASE WHEN lang = 'en' THEN text ELSE text || ' ' END) AS have FROM documents UNION ALL SELECT 'p/' || page_id, sha256(html) FROM pages),
    p AS (SELECT path, CASE WHEN want IS NOT NULL AND path LIKE 'b/1%' THEN 'out of scope' WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'untracked' WHEN want <> have THEN 'mismatch' END AS problem
          FROM m FULL JOIN l USING (path))
"""


def _problems(spark, sf):
    docs, marks, pages = (table(spark, sf, t) for t in ("documents", "benchmark", "pages"))
    row = lambda df, kind, key, text: df.select(F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"))
    manifest = row(docs.filter("source is not null"), "d", "doc_id", F.col("text")).unionByName(row(marks, "b", "item_id", F.col("text")))
    changed = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    live = row(docs, "d", "doc_id", changed).unionByName(row(pages, "p", "page_id", F.col("html")))
    return bench.manifest_problems(manifest, live, F.col("path").startswith("b/1"))


@query(MANIFEST + "SELECT path, problem FROM p WHERE problem IS NOT NULL")
def manifest_problems(spark, sf):
    """Whole texts hashed and compared between two file lists built from documents, benchmark and pages."""
    return _problems(spark, sf)


@query(
    MANIFEST
    + """
    , q AS (SELECT problem, path, CAST(row_number() OVER (PARTITION BY problem ORDER BY path) AS INTEGER) AS r, count(*) OVER (PARTITION BY problem) AS n FROM p WHERE problem IS NOT NULL)
    SELECT problem, path, r, CAST(n - least(n, 20) AS BIGINT) AS more FROM q WHERE r <= 20
    """
)
def manifest_report(spark, sf):
    return bench.first_per_kind(_problems(spark, sf), 20)


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'base' WHEN o_orderpriority LIKE '2%' THEN 'stress' ELSE 'unknown' END AS tier,
           CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'refused' WHEN lower(o_orderpriority) LIKE '%not spec%' THEN 'unsupported' ELSE 'no output' END AS error FROM orders
    """
)
def tiers_and_errors(spark, sf):
    o = table(spark, sf, "orders")
    tier = bench.model_tier(F.col("o_orderpriority"), [("1", "base"), ("2", "stress")])
    error = bench.classify_error(F.col("o_orderpriority"), [("urgent", "refused"), ("not spec", "unsupported")], "no output")
    return o.select("o_orderkey", tier.alias("tier"), error.alias("error"))


@query(
    """
    WITH m AS (SELECT c_mktsegment AS suite, c_custkey AS model FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    t AS (SELECT o_custkey AS model, CAST(count(*) AS INTEGER) AS seconds FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), w AS (SELECT o_custkey AS model, avg(o_totalprice) / 1000 AS w FROM orders GROUP BY 1)
    SELECT suite, model, round(coalesce(seconds, w), 6) AS cost_s, CAST(coalesce(seconds, 30) AS DOUBLE) AS timeout_s FROM m LEFT JOIN t USING (model) LEFT JOIN w USING (model)
    """
)
def schedule_order(spark, sf):
    orders = table(spark, sf, "orders")
    models = bench.select_models(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("suite"), F.col("c_custkey").alias("model")), ["BUILDING", "MACHINERY"])
    timeouts = orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("model")).agg(F.count(F.lit(1)).cast("int").alias("seconds"))
    walls = orders.groupBy(F.col("o_custkey").alias("model")).agg((F.avg("o_totalprice") / 1000).alias("wall_mean_s"))
    s = bench.schedule_order(models, timeouts, walls, 30.0)
    return s.select("suite", "model", F.round("cost_s", 6).alias("cost_s"), "timeout_s")


@query(
    """
    WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_extendedprice / power(10.0, l_linenumber) AS s FROM lineitem)
    SELECT CASE WHEN s * 1000 < 1 THEN 'sub' WHEN s * 1000 < 100 THEN printf('%.1f ms', s * 1000) WHEN s * 1000 < 10000 THEN 'ms' ELSE 's' END AS text, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1
    """
)
def duration_texts(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.pow(F.lit(10.0), F.col("l_linenumber"))).alias("s"))
    t = s.select(duration_text("s").alias("t"), (F.col("s") * 1000).alias("ms"))
    kind = F.when(F.col("ms") < 1, "sub").when(F.col("ms") < 100, F.col("t")).when(F.col("ms") < 10000, F.substring_index("t", " ", -1)).otherwise(F.substring_index("t", " ", -1))
    return t.groupBy(kind.alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 0
    ORDER BY -ln((('0x' || substr(md5(concat_ws('|', 7, l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) / l_quantity,
             l_orderkey, l_partkey, l_suppkey, l_linenumber
    LIMIT 100
    """
)
def weighted_sample(spark, sf):
    """A hundred lines drawn by quantity, from the MD5 digits of their keys."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return draw.weighted_sample(lines, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "l_quantity", 100, 7).drop("key")


@query(
    f"""
    WITH o AS (SELECT o_custkey c, o_orderkey + 1 AS site, substr(o_orderpriority, 1, 1) AS p FROM orders),
    e AS (SELECT a.c, a.site AS s0, b.site AS s1, d.site AS s2, row_number() OVER (PARTITION BY a.c ORDER BY a.site, b.site, d.site) - 1 AS place, count(*) OVER (PARTITION BY a.c) AS total
          FROM o a JOIN o b ON a.c = b.c AND a.site <> b.site JOIN o d ON a.c = d.c AND d.site <> a.site AND d.site <> b.site WHERE a.p = '1' AND d.p = '2')
    SELECT c AS draw_id, s0, s1, s2 FROM e WHERE place = CAST(floor({UNIT.format("'pick', c")} * total) AS BIGINT)
    """
)
def drawn_embeddings(spark, sf):
    """For every customer one of the ways to place an urgent order, any order and a high order, all different; none is listed but the one drawn."""
    from bondwise.model import Slot, mol
    from bondwise.plans.tables import CUSTOMER, customer_graph, node_key

    m = mol("Customer", Slot("order", "1"), Slot("order"), Slot("order", "2"))
    draws = table(spark, sf, "customer").select(F.col("c_custkey").alias("draw_id"), node_key("c_custkey", CUSTOMER).alias("node_id"), draw.unit_hash(F.lit("pick"), F.col("c_custkey")).alias("u"))
    return draw.draw_embeddings(customer_graph(spark, sf), m, draws).drop("node_id")
