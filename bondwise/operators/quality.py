"""Declared invariants of trajectories, and whole-table checks of a site graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.operators.skew import hub_join

NEG_TOL = 1e-9


def nonneg_violations(traj: DataFrame) -> DataFrame:
    """(model, rep, kind, obs, time, value, expected): the first negative sample of each replicate.

    One row per replicate, the first observable by name where several turn negative at once.
    """
    bad = traj.filter(F.col("value") < -NEG_TOL)
    first = bad.groupBy("model", "rep").agg(F.min(F.struct("time", "obs", "value")).alias("r"))
    return first.select(
        "model", "rep", F.lit("nonneg").alias("kind"), "r.obs", "r.time", "r.value", F.lit(0.0).alias("expected")
    )


def conserved_violations(traj: DataFrame, rules: DataFrame) -> DataFrame:
    """First sample per (replicate, rule) away from ``expected``, or from the replicate's first value where null.

    ``rules`` is (model, obs, expected), a table of declarations that is broadcast; samples and starts are not, however
    small their files look. The tolerance is one half or one percent, whichever is larger.
    """
    rows = traj.join(F.broadcast(rules), ["model", "obs"])
    keys = ["model", "rep", "obs"]
    start = rows.groupBy(*keys).agg(F.min_by("value", "time").alias("start"), F.count(F.lit(1)).alias("deg"))
    rows = hub_join(rows, start.hint("merge"), keys, traj.count()).withColumn("expected", F.coalesce("expected", "start"))
    tol = F.greatest(F.lit(0.5), 0.01 * F.abs("expected"))
    bad = rows.filter(F.abs(F.col("value") - F.col("expected")) > tol)
    first = bad.groupBy("model", "rep", "obs").agg(F.min(F.struct("time", "value", "expected")).alias("r"))
    return first.select("model", "rep", F.lit("conserved").alias("kind"), "obs", "r.time", "r.value", "r.expected")


def balance_violations(traj: DataFrame, rules: DataFrame) -> DataFrame:
    """First time per (replicate, rule) at which two observables differ; ``rules`` is (model, lhs, rhs), broadcast as above."""
    left = traj.join(F.broadcast(rules.withColumnRenamed("lhs", "obs")), ["model", "obs"])
    right = traj.select("model", "rep", "time", F.col("obs").alias("rhs"), F.col("value").alias("expected"))
    met = left.join(right.hint("merge"), ["model", "rep", "time", "rhs"])
    tol = F.greatest(F.lit(0.5), 0.01 * F.greatest(F.abs("value"), F.abs("expected")))
    bad = met.filter(F.abs(F.col("value") - F.col("expected")) > tol)
    first = bad.groupBy("model", "rep", "obs", "rhs").agg(F.min(F.struct("time", "value", "expected")).alias("r"))
    name = F.concat_ws("=", "obs", "rhs")
    return first.select("model", "rep", F.lit("balance").alias("kind"), name.alias("obs"), "r.time", "r.value", "r.expected")


def missing_observables(traj: DataFrame, rules: DataFrame) -> DataFrame:
    """(model, rep, kind, obs, ...): rule observables (model, obs) that a model's trajectories lack."""
    have = traj.select("model", "obs").distinct()
    run = traj.select("model").distinct()
    gone = rules.select("model", "obs").distinct().join(run, "model", "left_semi").join(have, ["model", "obs"], "left_anti")
    nothing = F.lit(None).cast("double")
    rep = F.lit(None).cast(traj.schema["rep"].dataType)
    return gone.select(
        "model", rep.alias("rep"), F.lit("missing").alias("kind"), "obs", nothing.alias("time"), nothing.alias("value"),
        nothing.alias("expected"),
    )


def check_invariants(traj: DataFrame, conserved: DataFrame | None = None, balance: DataFrame | None = None) -> DataFrame:
    """All violations; non-negativity is always on."""
    found = [nonneg_violations(traj)]
    if conserved is not None:
        found += [conserved_violations(traj, conserved), missing_observables(traj, conserved)]
    if balance is not None:
        found.append(balance_violations(traj, balance))
        both = balance.select("model", F.explode(F.array("lhs", "rhs")).alias("obs"))
        found.append(missing_observables(traj, both))
    return reduce(DataFrame.unionByName, found)


def mass_check(census: DataFrame, nodes: DataFrame) -> DataFrame:
    """(census_nodes, total_nodes, ok): nodes summed over species against the node table."""
    counted = census.agg(F.coalesce(F.sum(F.col("n_nodes") * F.col("complexes")), F.lit(0)).alias("census_nodes"))
    total = nodes.agg(F.count(F.lit(1)).alias("total_nodes"))
    return counted.crossJoin(total).withColumn("ok", F.col("census_nodes") == F.col("total_nodes"))


def tracked_differences(tracked: DataFrame, recount: DataFrame) -> DataFrame:
    """(obs, tracked, recount) where incrementally kept values differ from a full recount; none is right."""
    a = tracked.select("obs", F.col("value").alias("tracked"))
    b = recount.select("obs", F.col("value").alias("recount"))
    return a.join(b, "obs", "full").filter(~F.col("tracked").eqNullSafe(F.col("recount")))


def link_errors(sites: DataFrame) -> DataFrame:
    """(node_id, site_idx, error): links that their other end does not confirm, and repeated sites."""
    far = sites.select(
        F.col("node_id").alias("partner_node"),
        F.col("site_idx").alias("partner_site"),
        F.col("partner_node").alias("back_node"),
        F.col("partner_site").alias("back_site"),
    )
    bonded = sites.filter("partner_node is not null").join(far, ["partner_node", "partner_site"], "left")
    ok = (F.col("back_node") == F.col("node_id")) & (F.col("back_site") == F.col("site_idx"))
    one_way = bonded.filter(~F.coalesce(ok, F.lit(False))).select("node_id", "site_idx", F.lit("unconfirmed link").alias("error"))
    twice = sites.groupBy("node_id", "site_idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return one_way.unionByName(twice.select("node_id", "site_idx", F.lit("repeated site").alias("error")))
