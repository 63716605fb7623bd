"""Rate laws as columns over match counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondwise.functions.combinatorics import MAX_SLOTS, distinct_sum, subsets


def guarded(rate: Column) -> tuple[Column, Column]:
    """(rate, clamped): a rate that is negative or not a number becomes 0 and raises the flag."""
    ok = F.coalesce((rate >= 0) & ~F.isnan(rate), F.lit(False))
    return F.when(ok, rate).otherwise(0.0), ~ok


def unimolecular(count: Column, k: Column, symmetry: Column | float = 1.0) -> Column:
    return count * k * symmetry


def heterodimer(a: Column, b: Column, k: Column, symmetry: Column | float = 1.0, same_complex: Column | float = 0.0) -> Column:
    """Pairs of A and B matches; ``same_complex`` is the total of per-complex products when those do not react."""
    return (a * b - same_complex) * k * symmetry


def homodimer(a_only: Column, b_total: Column, both: Column, b_only: Column, both_sq: Column, k: Column) -> Column:
    """Unordered pairs of like nodes; each node's pair with itself leaves by the sum of squares."""
    return (a_only * b_total + both * b_only + (both * both - both_sq) / 2.0) * k


def total_rate(rate: Column, counts: list[Column]) -> Column:
    """The law is the whole rate unless a reactant is absent."""
    absent = reduce(lambda x, y: x | y, (c <= 0 for c in counts), F.lit(False))
    return F.when(absent, 0.0).otherwise(rate)


def michaelis_menten(kcat: Column, km: Column, substrate: Column, enzyme: Column) -> Column:
    """Turnover with quasi-steady free substrate.

    The free substrate is the positive root of f^2 + (km + E - S) f - km S = 0, taken in whichever form adds
    numbers of one sign. km = 0 is the limit of tight binding; km < 0 has no meaning and gives NaN.
    """
    b = substrate - km - enzyme
    root = F.sqrt(b * b + 4.0 * km * substrate)
    free = F.when(b >= 0, 0.5 * (b + root)).otherwise(2.0 * km * substrate / F.nullif(root - b, F.lit(0.0)))
    return (
        F.when((substrate <= 0) | (enzyme <= 0), 0.0)
        .when(km < 0, F.lit(float("nan")))
        .when(km == 0, kcat * F.least(substrate, enzyme))
        .when(km + free <= 0, 0.0)
        .otherwise(kcat * free * enzyme / F.nullif(km + free, F.lit(0.0)))
    )


def with_symmetry(substrate: Column, enzyme: Column, symmetry: Column | float, substrate_is_context: bool,
                  enzyme_is_context: bool) -> tuple[Column, Column]:
    """The symmetry factor belongs to the count the rule changes; to the substrate when both or neither change."""
    if substrate_is_context and not enzyme_is_context:
        return substrate, enzyme * symmetry
    return substrate * symmetry, enzyme


def distinct_tuple_sum(weights: DataFrame, slots: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, total): sum over tuples of distinct rows of the product of one weight per slot, at least 0.

    One aggregate with partial sums; tuples are never formed. Up to six slots.
    """
    n = len(slots)
    if not 1 <= n <= MAX_SLOTS:
        raise ValueError(f"between 1 and {MAX_SLOTS} slots")
    name = {b: "t_" + "_".join(map(str, b)) for b in subsets(n)}
    sums = [
        F.coalesce(F.sum(reduce(lambda x, y: x * y, (F.col(slots[i]).cast("double") for i in b))), F.lit(0.0)).alias(name[b])
        for b in subsets(n)
    ]
    grouped = weights.groupBy(*keys).agg(*sums) if keys else weights.agg(*sums)
    total = distinct_sum(tuple(range(n)), lambda b: F.col(name[b]))
    return grouped.select(*keys, F.greatest(total, F.lit(0.0)).alias("total"))


def energy_rates(matches: DataFrame, contexts: DataFrame, terms: DataFrame, phi: float, ea0: float, rt: float) -> DataFrame:
    """(columns of ``matches``, dg, rate, reverse): Arrhenius rates of each match, both ways, from the energy terms its context switches on.

    ``contexts`` is (match_id, context) with a row for each context present; ``terms`` is (term, energy,
    context), with null context where the term always applies and several rows where any of several contexts
    will do. Scoring matches needs no expansion of a rule into one variant per context combination. Terms are
    declarations and broadcast; contexts are dealt out once, by match, and matches once.
    """
    always = terms.filter("context is null").select("term", "energy").distinct()
    base = always.agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("base"))
    gated = contexts.join(F.broadcast(terms.filter("context is not null")), "context").select("match_id", "term", "energy")
    # a term counts once however many of its contexts are there
    once = gated.repartition("match_id").groupBy("match_id", "term").agg(F.max("energy").alias("energy"))
    extra = once.groupBy("match_id").agg(F.sum("energy").alias("extra"))
    dg = F.col("base") + F.coalesce("extra", F.lit(0.0))
    arrhenius = lambda share: F.exp(-(F.lit(ea0) + share * F.col("dg")) / rt)
    rows = matches.join(extra, "match_id", "left").crossJoin(F.broadcast(base)).withColumn("dg", dg)
    return rows.select(*matches.columns, "dg", arrhenius(phi).alias("rate"), arrhenius(phi - 1.0).alias("reverse"))
