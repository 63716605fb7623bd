import math

import pytest
from pyspark.sql import functions as F

from bondwise.operators import bench, ensemble, quality, sampling, scores, sweep

TRAJ = "model string, rep int, step int, time double, obs string, value double"


def traj(spark, rows):
    return spark.createDataFrame(rows, TRAJ)


def test_event_at_instant_is_not_seen(spark):
    ev = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("b", 5.0, 7.0)], "k string, time double, value double")
    rows = sampling.sample_at(ev, ["k"], [0.0, 1.0, 1.5, 2.0, 9.0], initial=0.0).collect()
    got = {(r.k, r.time): r.value for r in rows}
    assert [got["a", t] for t in (0.0, 1.0, 1.5, 2.0, 9.0)] == [0.0, 0.0, 10.0, 10.0, 20.0]
    assert got["b", 2.0] == 0.0 and got["b", 9.0] == 7.0
    first = {(r.k, r.time): r.value for r in sampling.sample_at(ev, ["k"], [0.0, 9.0]).collect()}
    assert first["a", 0.0] == 10.0


def test_grids(spark):
    assert sampling.time_grid(0, 10, 2) == [0.0, 5.0, 10.0]


@pytest.mark.parametrize("t_end, n", [(1.0, 10), (0.7, 7), (86400.0 * 3, 3), (0.0, 4), (5.0, 0)])
def test_even_grids_agree_with_listed_instants(spark, t_end, n):
    """Events on the instants themselves, where rounding could move a step, between them, outside, and without a time."""
    from bondwise.operators.sampling import EvenGrid

    grid = EvenGrid(0.0, t_end, n)
    listed = [k * t_end / max(n, 1) for k in range(n + 1)]
    times = [*listed, *[(a + b) / 2 for a, b in zip(listed, listed[1:])], -1.0, t_end + 1, float("nan"), float("inf"), None]
    ev = spark.createDataFrame([("k", t, float(i), i, 1) for i, t in enumerate(times)], "k string, time double, value double, seq int, delta int")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(sampling.sample_at(ev, ["k"], grid)) == plain(sampling.sample_at(ev, ["k"], listed))
    counts = plain(sampling.sample_counts(ev, ["k"], grid))
    assert counts == plain(sampling.sample_counts(ev, ["k"], listed))
    assert [c[3] for c in counts] == [sum(t is not None and t < g for t in times) for g in listed]
    assert sampling.time_grid(0, 10, 0) == [0.0, 10.0]
    assert sampling.time_grid(0, 10, 2, [1, 4]) == [1.0, 4.0]
    with pytest.raises(ValueError):
        sampling.time_grid(0, 10, 2, [4, 1])
    assert [r.time for r in sampling.grid_table(spark, 0, 10, 2).orderBy("step").collect()] == [0.0, 5.0, 10.0]


def test_running_state_across_slices(spark):
    ev = spark.createDataFrame([("a", float(t), t % 3 - 1) for t in range(50)], "k string, time double, delta int")
    got = [r.state for r in sampling.running_state(ev, ["k"]).orderBy("time").collect()]
    want, acc = [], 0
    for t in range(50):
        acc += t % 3 - 1
        want.append(acc)
    assert got == want


def test_integrals(spark):
    rows = [("m", r, k, float(k), "x", float(k * k + r)) for r in (1, 2) for k in range(11)] + [("m", 3, 0, 0.0, "x", 4.0)]
    got = {r.rep: r.integral for r in ensemble.integrals(traj(spark, rows)).collect()}
    area = lambda r: sum(0.5 * (k * k + (k + 1) ** 2 + 2 * r) for k in range(10))
    assert got == pytest.approx({1: area(1), 2: area(2), 3: 0.0})


def test_a_burst_at_one_instant_spreads_over_parts(spark):
    """Nine tenths of a key at one time: parts stay even, and the area does not change."""
    from bondwise.operators.order import in_parts

    names = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rows = traj(spark, [("m", 1, 0, 5.0, "x", 2.0 + k * 1e-6) for k in range(9000)] + [("m", 1, 0, k / 100, "x", 2.0) for k in range(1000)])
        sizes = [r["count"] for r in in_parts(rows, ["model", "rep", "obs"], ["time"]).groupBy("part").count().collect()]
        assert len(sizes) >= 6 and max(sizes) <= 2 * sum(sizes) / len(sizes)
        assert ensemble.integrals(rows).first().integral == pytest.approx(2.0 * 9.99, abs=0.05)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_alignment(spark):
    rows = [("m", 1, k, float(k), "x", 1.0) for k in range(3)] + [("m", 2, k, float(k), "x", 3.0) for k in range(2)]
    short = ensemble.ensemble_stats(traj(spark, rows)).orderBy("step").collect()
    ragged = ensemble.ensemble_stats(traj(spark, rows), "ragged").orderBy("step").collect()
    assert [(r.step, r.mean, r.n) for r in short] == [(0, 2.0, 2), (1, 2.0, 2)]
    assert short[0].std == pytest.approx(math.sqrt(2)) and short[0].sem == pytest.approx(1.0)
    assert (ragged[2].mean, ragged[2].std, ragged[2].n) == (1.0, 0.0, 1)


def ref(spark, rows):
    return spark.createDataFrame(rows, "model string, obs string, step int, time double, mean double, std double")


def tint(spark, rows):
    return spark.createDataFrame(rows, "model string, obs string, i_mean double, i_std double, n_reps int")


def test_nearest_time_takes_the_later_row_on_ties(spark):
    grid = spark.createDataFrame([("m", 0, 0.0), ("m", 1, 1e-12), ("m", 2, 2e-12), ("m", 3, 1.0)], "model string, step int, ref_time double")
    times = spark.createDataFrame([("m", 5e-13), ("m", 1.0 - 5e-10), ("m", 0.5)], "model string, time double")
    got = {r.time: r.step for r in scores.match_times(times, grid).collect()}
    assert got == {5e-13: 1, 1.0 - 5e-10: 3}


def test_verdict_ladder(spark):
    cand, stats, tints = [], [], []
    for model in ("same", "off", "flat", "zero", "weak", "noref", "nomatch"):
        for rep in (0, 1, 2):
            for k in range(3):
                base = 10.0 * k + (rep if model in ("same", "off", "weak", "noref", "nomatch") else 0.0)
                cand.append((model, rep, k, float(k), " x ", base))
        if model == "noref":
            continue
        for k in range(3):
            shift = {"off": 100.0, "flat": 1.0}.get(model, 1.0 if model not in ("zero",) else 0.0)
            std = 1.0 if model in ("same", "off", "weak") else 0.0
            stats.append((model, "x" if model != "nomatch" else "y", k, float(k), 10.0 * k + shift, std))
        if model != "weak":
            i = {"same": 22.0, "off": 220.0, "flat": 25.0, "zero": 20.0, "nomatch": 0.0}[model]
            tints.append((model, "x", i, 2.0 if model in ("same", "off") else 0.0, 3))
    got = {r.model: r for r in scores.compare(traj(spark, cand), ref(spark, stats), tint(spark, tints)).collect()}
    assert {m: r.verdict for m, r in got.items()} == {
        "same": "PASS", "off": "FAIL", "flat": "FAIL", "zero": "PASS", "weak": "PASS", "noref": "NO_REF", "nomatch": "NO_MATCH"}
    assert got["flat"].tz_max == float("inf") and got["flat"].worst_tz == "x*"
    assert got["zero"].tz_max == 0.0 and got["zero"].worst_tz == ""
    assert got["weak"].weak and got["weak"].tz_max is None
    assert got["same"].screen_z == pytest.approx(0.0) and got["same"].n_compared == 3


def test_incomplete_replicates_are_dropped_and_counted(spark):
    rows = [("m", r, k, float(k), "x", 1.0 + r) for r in (0, 1, 2) for k in range(3) if not (r == 2 and k == 1)]
    v = scores.compare(traj(spark, rows), ref(spark, [("m", "x", k, float(k), 1.5, 1.0) for k in range(3)]), tint(spark, [("m", "x", 3.0, 1.0, 4)])).first()
    assert v.dropped == 1 and v.n_reps == 3


def test_single_run_and_two_sample_ladders(spark):
    r = ref(spark, [("m", "a", 0, 0.0, 1.0, 0.0), ("m", "b", 0, 0.0, 1.0, 0.0), ("m", "c", 0, 0.0, 1.0, 2.0)])
    run = spark.createDataFrame([("m", "a", 0.0, 1.25), ("m", "b", 0.0, 2.0), ("m", "c", 0.0, 5.0)], "model string, obs string, time double, value double")
    assert {x.obs: x.z for x in scores.single_run_scores(run, r).collect()} == {"a": 0.25, "b": 1e6 + 1.0, "c": 2.0}
    cols = "model string, obs string, step int, mean double, sem double"
    a = spark.createDataFrame([("p", "x", 1, 1.0, 0.0), ("q", "x", 1, 1.0, 0.0), ("r", "x", 1, 4.0, 0.3), ("r", "x", 0, 400.0, 0.3)], cols)
    b = spark.createDataFrame([("p", "x", 1, 1.0, 0.0), ("q", "x", 1, 2.0, 0.0), ("r", "x", 1, 2.0, 0.4), ("r", "x", 0, 1.0, 0.4)], cols)
    got = {x.model: (x.z, x.verdict) for x in scores.two_sample_scores(a, b).collect()}
    assert got["p"] == (0.0, "PASS") and got["q"] == (float("inf"), "FAIL") and got["r"][0] == pytest.approx(4.0)


def test_invariants(spark):
    rows = []
    for k in range(4):
        rows += [("m", 1, k, float(k), "a", 100.0 + k), ("m", 1, k, float(k), "b", 100.0), ("m", 1, k, float(k), "c", 1.0 - k)]
    t = traj(spark, rows)
    cons = spark.createDataFrame([("m", "a", None), ("m", "b", 50.0), ("m", "zz", None)], "model string, obs string, expected double")
    bal = spark.createDataFrame([("m", "a", "b")], "model string, lhs string, rhs string")
    got = {(r.kind, r.obs): r.time for r in quality.check_invariants(t, cons, bal).collect()}
    assert got == {("nonneg", "c"): 2.0, ("conserved", "a"): 2.0, ("conserved", "b"): 0.0, ("missing", "zz"): None, ("balance", "a=b"): 2.0}


def test_branches(spark):
    ends = spark.createDataFrame([("x", i, 3, float(i)) for i in range(6)], "obs string, run_idx int, n int, value double")
    got = sorted((r.point_idx, r.fwd, r.bwd, r.gap) for r in sweep.align_branches(ends, []).collect())
    assert got == [(0, 0.0, 5.0, -5.0), (1, 1.0, 4.0, -3.0), (2, 2.0, 3.0, -1.0)]


def test_run_diff_and_timing(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "model string, wall_s double")
    head = spark.createDataFrame([("a", 1.5), ("c", 3.0), ("d", 1.0)], "model string, wall_s double")
    got = {r.model: (r.pct, r.flag) for r in bench.run_diff(base, head).collect()}
    assert got == {"a": (50.0, "SLOWER"), "b": (None, "GONE"), "c": (0.0, ""), "d": (None, "NEW")}
    cols = "engine string, suite string, model string, rep int, wall_s double, error string"
    runs = [("x", "s", "m", r, w, "") for r, w in enumerate((1.0, 3.0, 2.0))] + [("y", "s", "m", 0, 8.0, ""), ("x", "s", "n", 0, 1.0, "boom"), ("x", "s", "n", 1, 1.0, "")]
    per = bench.timing_per_model(spark.createDataFrame(runs, cols))
    s = bench.timing_summary(per, "x", "y").first()
    assert (s.models, s.scored, s.failed, s.median_speedup, s.faster) == (2, 1, 1, 4.0, 1)


def test_overall_verdict(spark):
    models = spark.createDataFrame([("self", True), ("exact", False), ("ens", False), ("any", False), ("none", False), ("broken", False)], "model string, self_only boolean")
    comps = spark.createDataFrame(
        [("exact", "E", "PASS"), ("exact", "N", "FAIL"), ("ens", "E", "FAIL"), ("ens", "N", "PASS"), ("any", "S", "FAIL"), ("any", "N", "NO_REF"),
         ("none", "N", "NO_REF"), ("broken", "N", "PASS")], "model string, label string, verdict string")
    bad = spark.createDataFrame([("broken",)], "model string")
    got = {r.model: r.verdict for r in scores.overall_verdict(models, comps, bad, ["exact"], "N", "E").collect()}
    assert got == {"self": "PASS", "exact": "PASS", "ens": "PASS", "any": "FAIL", "none": "NO_REF", "broken": "FAIL"}


def test_limits(spark):
    rows = spark.createDataFrame([(None, 10), (1.0, 10), (10.0, 4)], "p double, n int")
    got = [(r.t, r.c, r.k) for r in rows.select(scores.threshold(F.col("p")).alias("t"), scores.nearest_calibrated(F.col("n")).alias("c"),
                                                scores.adaptive_reps(F.col("p"), F.col("n")).alias("k")).collect()]
    assert got == [(5.0, 10, 10), (5.0, 10, 10), (12.0, 3, 58)]


def test_samples_are_not_broadcast_for_small_files(spark, tmp_path):
    """well packed files look small however many samples they hold, so only the declarations may be broadcast."""
    rows = [("m", r, s, float(s), o, 1.0) for r in range(3) for s in range(4) for o in ("A", "B")]
    traj(spark, rows).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    cons = spark.createDataFrame([("m", "A", None)], "model string, obs string, expected double")
    bal = spark.createDataFrame([("m", "A", "B")], "model string, lhs string, rhs string")
    for found, rules in ((quality.balance_violations(t, bal), 1), (quality.conserved_violations(t, cons), 2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("BuildRight") == rules and plan.count("SortMergeJoin") == 1, plan
