"""Derived parameters and seed amounts over a table of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.functions.expressions import names_in, to_sql


def evaluation_order(params: list[tuple[str, str | None, float]]) -> tuple[list[str], list[str]]:
    """(order, stuck): names so that each follows what it reads, and those on or behind a cycle."""
    reads = {name: [n for n in names_in(expr or "") if n in {p[0] for p in params}] for name, expr, _ in params}
    order: list[str] = []
    left = [p[0] for p in params]
    while True:
        ready = [n for n in left if all(r in order for r in reads[n])]
        if not ready:
            return order, left
        order += ready
        left = [n for n in left if n not in ready]


def derive_parameters(scenarios: DataFrame, params: list[tuple[str, str | None, float]]) -> DataFrame:
    """Resolve every parameter in every scenario.

    ``params`` lists (name, expression or None, loaded value). A scenario column named like a parameter
    overrides it where not null. A derived parameter takes its expression's value only if the overrides move
    that value off its baseline, which is the expression on the loaded values; otherwise it keeps the loaded
    value unchanged. Parameters on a cycle keep loaded values and are listed in ``unresolved``.
    """
    order, stuck = evaluation_order(params)
    by_name = {p[0]: p for p in params}
    given = [c for c in scenarios.columns if c in by_name]
    rest = [F.col(c) for c in scenarios.columns if c not in by_name]
    # one projection for loaded values, one for baselines, then one per derived parameter
    loaded = scenarios.sparkSession.range(1).select(*[F.lit(float(p[2])).alias(p[0]) for p in params])
    bases = [F.expr(to_sql(by_name[n][1])).cast("double").alias(f"base_{n}") for n in order if by_name[n][1]]
    bases = loaded.select(*bases) if bases else None
    df = scenarios.select(*rest, *[F.col(c).cast("double").alias(f"set_{c}") for c in given])
    if bases is not None:
        df = df.crossJoin(F.broadcast(bases))
    df = df.select("*", *[F.lit(float(by_name[n][2])).alias(n) for n in stuck])
    for n in order:
        _, expr, value = by_name[n]
        own = F.lit(float(value))
        if expr:
            fresh = F.expr(to_sql(expr)).cast("double")
            own = F.when(fresh == F.col(f"base_{n}"), own).otherwise(F.coalesce(fresh, own))
        df = df.withColumn(n, F.coalesce(F.col(f"set_{n}"), own) if n in given else own)
    for n in stuck:
        if n in given:
            df = df.withColumn(n, F.coalesce(F.col(f"set_{n}"), F.col(n)))
    unresolved = F.array(*[F.lit(n) for n in stuck]) if stuck else F.array().cast("array<string>")
    return df.select(*rest, *[F.col(p[0]) for p in params], unresolved.alias("unresolved"))


def long_parameters(scenarios: DataFrame, keys: list[str], params: list[tuple[str, str | None, float]]) -> DataFrame:
    """(keys, name, value) form of the resolved parameters."""
    wide = derive_parameters(scenarios, params).select(*keys, *[p[0] for p in params])
    return wide.unpivot(keys, [p[0] for p in params], "name", "value")


def seed_table(scenarios: DataFrame, seeds: list[tuple[str, str, str]], params: list[tuple[str, str | None, float]],
               pins: DataFrame | None = None) -> DataFrame:
    """(scenario_id, seed_id, seed_name, amount, copies): amounts of seed species in every scenario.

    ``seeds`` lists (seed_id, name, amount expression). A pin (scenario_id, seed_id, amount) outranks the
    expression; copies are the amount cut towards zero.
    """
    wide = derive_parameters(scenarios, params)
    entries = [
        F.struct(F.lit(i).alias("seed_id"), F.lit(n).alias("seed_name"), F.expr(to_sql(e)).cast("double").alias("amount"))
        for i, n, e in seeds
    ]
    rows = wide.select("scenario_id", F.explode(F.array(*entries)).alias("s")).select("scenario_id", "s.*")
    if pins is not None:
        fixed = pins.select("scenario_id", "seed_id", F.col("amount").alias("pin"))
        rows = rows.join(fixed, ["scenario_id", "seed_id"], "left").withColumn("amount", F.coalesce("pin", "amount")).drop("pin")
    return rows.withColumn("copies", F.col("amount").cast("bigint"))


def resolve_keys(keys: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, seed_id, error): look seeds up by name first, then by id; unknown and ambiguous keys are errors."""
    named = keys.join(seeds.select(F.col("seed_name").alias("key"), "seed_id"), "key").groupBy("key").agg(
        F.min("seed_id").alias("by_name"), F.count(F.lit(1)).alias("n_named")
    )
    ids = seeds.select(F.col("seed_id").alias("key"), F.col("seed_id").alias("by_id")).distinct()
    joined = keys.join(named, "key", "left").join(ids, "key", "left")
    error = F.when(F.col("n_named") > 1, "ambiguous name").when(F.coalesce("by_name", "by_id").isNull(), "unknown seed")
    found = F.when(error.isNull(), F.coalesce("by_name", "by_id"))
    return joined.select("key", found.alias("seed_id"), error.alias("error"))
