"""Rates of rules on a snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.functions import rates
from bondwise.functions.expressions import to_sql
from bondwise.model import Mol, Observable, Pattern, Snapshot
from bondwise.operators.match import local_values, pinned_counts, seed_counts
from bondwise.session import cut

KINDS = ("elementary", "total", "michaelis_menten", "local", "product")


@dataclass(frozen=True)
class Rule:
    """A rule as far as pricing it needs.

    ``law`` is an expression over parameters, observables, ``time`` and ``reactant_1`` and so on; for
    Michaelis-Menten it is the turnover number and ``km`` the half-saturation. ``context`` marks reactants the
    rule leaves as they are, which count once per complex. ``same_site`` names the reacting slots of two like
    reactants. ``same_complex_ok`` lets two reactants of one complex meet.

    A "local" rule of one reactant sums its law over the matches; a "product" rule of two sums ``law`` at the first times ``law_b`` at the second over
    pairs of matches, where a law that is None is 1. Names of ``local`` observables are read at the matched node, or at its complex where ``scopes`` says so.
    A context reactant of such a rule is priced at the canonically first match of its complex.
    """

    name: str
    reactants: tuple[Pattern, ...]
    law: str | None
    kind: str = "elementary"
    symmetry: float = 1.0
    context: tuple[bool, ...] = ()
    same_site: tuple[int, int] | None = None
    same_complex_ok: bool = True
    km: str | None = None
    law_b: str | None = None
    local: tuple[Observable, ...] = ()
    scopes: tuple[str, ...] = ()

    def is_context(self, i: int) -> bool:
        return i < len(self.context) and self.context[i]


def context_tally(counts: DataFrame, complexes: DataFrame, colours: DataFrame | None = None) -> DataFrame:
    """(node_id, c): one match per complex, held by its lowest node or, with ``colours``, by its canonically first one.

    ``colours`` are those of ``canonical.classes``, which copies of a complex share however they were built. The first match has the least colour; matches of
    equal colour can be mapped on each other, so it makes no difference which of them is taken, and no node needs a number.
    """
    rows = counts.join(complexes, "node_id")
    first = F.min("node_id")
    if colours is not None:
        rows = rows.join(colours.select("node_id", "c1", "c2"), "node_id")
        first = F.min_by("node_id", F.struct("c1", "c2", "node_id"))
    return rows.groupBy("complex_id").agg(first.alias("node_id")).select("node_id", F.lit(1).cast("long").alias("c"))


def reactant_counts(snap: Snapshot, rule: Rule, complexes: DataFrame | None, colours: DataFrame | None = None, known: dict[Pattern, DataFrame] | None = None) -> list[DataFrame]:
    """Match counts of each reactant; ``known`` keeps those of patterns seen before, also under other rules."""
    found, known = [], {} if known is None else known
    for i, p in enumerate(rule.reactants):
        if p not in known:
            known[p] = cut(seed_counts(snap, p, complexes), "reactants")
        counts = known[p]
        if rule.is_context(i):
            # only a law read at the node itself tells the matches of one complex apart
            by_node = rule.kind in ("local", "product") and rule.local and (rule.scopes[i] if i < len(rule.scopes) else "node") == "node"
            if by_node and colours is None:
                raise ValueError(f"rule {rule.name!r} prices a context reactant by node and needs colours")
            counts = context_tally(counts, complexes, colours if by_node else None)
        found.append(counts)
    return found


def shared_sites(snap: Snapshot, a: Mol, at_a: int, b: Mol, at_b: int) -> DataFrame:
    """(node_id, a_only, b_only, both): sites that serve only one reactant's reacting slot, or either."""
    mine = pinned_counts(snap, a, at_a).select("node_id", "site_idx", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    theirs = pinned_counts(snap, b, at_b).select("node_id", "site_idx", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    per_site = mine.unionByName(theirs).groupBy("node_id", "site_idx").agg(F.max("in_a").alias("a"), F.max("in_b").alias("b"))
    return per_site.groupBy("node_id").agg(
        F.sum(F.col("a") * (1 - F.col("b"))).alias("a_only"),
        F.sum(F.col("b") * (1 - F.col("a"))).alias("b_only"),
        F.sum(F.col("a") * F.col("b")).alias("both"),
    )


def homodimer_sums(shared: DataFrame) -> DataFrame:
    """One row (a_only, b_only, both, both_sq, b_total) of whole-table sums."""
    return shared.agg(
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in ("a_only", "b_only", "both")],
        F.coalesce(F.sum(F.col("both") * F.col("both")).cast("double"), F.lit(0.0)).alias("both_sq"),
        F.coalesce(F.sum(F.col("b_only") + F.col("both")).cast("double"), F.lit(0.0)).alias("b_total"),
    )


def same_complex_pairs(a: DataFrame, b: DataFrame, complexes: DataFrame) -> DataFrame:
    """(pairs): sum over complexes of the product of both match counts; the pairs themselves are never formed."""
    rows = a.select("node_id", F.col("c").alias("a"), F.lit(0).alias("b")).unionByName(
        b.select("node_id", F.lit(0).alias("a"), F.col("c").alias("b"))
    )
    per = rows.join(complexes, "node_id").groupBy("complex_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.agg(F.coalesce(F.sum(F.col("a") * F.col("b")).cast("double"), F.lit(0.0)).alias("pairs"))


def _weights(counts: list[DataFrame]) -> DataFrame:
    n = len(counts)
    rows = [
        c.select("node_id", *[(F.col("c") if i == k else F.lit(0)).alias(f"c{i}") for i in range(n)])
        for k, c in enumerate(counts)
    ]
    merged = reduce(DataFrame.unionByName, rows)
    return merged.groupBy("node_id").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)])


def score_rules(snap: Snapshot, rules: list[Rule], symbols: DataFrame, complexes: DataFrame | None = None, colours: DataFrame | None = None) -> DataFrame:
    """(rule, n_1 .. n_k, rate, clamped, share): the price of every rule on the snapshot.

    ``symbols`` is one wide row with parameters, observables and ``time``. A rule's table never holds more than
    one row, so putting rules side by side costs nothing.
    """
    width = max([len(r.reactants) for r in rules] + [1])
    priced, known = [], {}
    for rule in rules:
        if rule.kind not in KINDS:
            raise ValueError(f"unknown kind {rule.kind!r}")
        k = len(rule.reactants)
        counts = reactant_counts(snap, rule, complexes, colours, known)
        row = symbols
        for i, c in enumerate(counts):
            row = row.crossJoin(c.agg(F.coalesce(F.sum("c").cast("double"), F.lit(0.0)).alias(f"reactant_{i + 1}")))
        n = [F.col(f"reactant_{i + 1}") for i in range(k)]
        law = F.lit(1.0) if rule.law is None or rule.kind in ("local", "product") else F.expr(to_sql(rule.law)).cast("double")
        if rule.kind in ("local", "product"):
            row = row.crossJoin(factor_sums(snap, rule, counts, symbols, complexes))
            rate = (F.col("sum_1") * (F.col("sum_2") if k == 2 else 1.0) - F.col("pairs")) * rule.symmetry
        elif rule.kind == "total":
            rate = rates.total_rate(law, n)
        elif rule.kind == "michaelis_menten":
            s, e = rates.with_symmetry(n[0], n[1], rule.symmetry, rule.is_context(0), rule.is_context(1))
            rate = rates.michaelis_menten(law, F.expr(to_sql(rule.km)).cast("double"), s, e)
        elif k == 0:
            rate = law
        elif k == 1:
            rate = rates.unimolecular(n[0], law, rule.symmetry)
        elif k == 2 and rule.same_site:
            shared = shared_sites(snap, rule.reactants[0].mols[0], rule.same_site[0], rule.reactants[1].mols[0], rule.same_site[1])
            row = row.crossJoin(homodimer_sums(shared))
            rate = rates.homodimer(*[F.col(c) for c in ("a_only", "b_total", "both", "b_only", "both_sq")], law)
        elif k == 2:
            if rule.same_complex_ok:
                row = row.withColumn("pairs", F.lit(0.0))
            else:
                row = row.crossJoin(same_complex_pairs(counts[0], counts[1], complexes))
            rate = rates.heterodimer(n[0], n[1], law, rule.symmetry, F.col("pairs"))
        else:
            row = row.crossJoin(rates.distinct_tuple_sum(_weights(counts), [f"c{i}" for i in range(k)]))
            rate = F.col("total") * law * rule.symmetry
        value, clamped = rates.guarded(rate)
        absent = F.lit(None).cast("double")
        cols = [(n[i] if i < k else absent).alias(f"n_{i + 1}") for i in range(width)]
        priced.append(row.select(F.lit(rule.name).alias("rule"), *cols, value.alias("rate"), clamped.alias("clamped")))
    every = reduce(DataFrame.unionByName, priced)
    total = every.agg(F.sum("rate").alias("total"))
    share = F.when(F.col("total") > 0, F.col("rate") / F.nullif("total", F.lit(0.0))).otherwise(0.0)
    return every.crossJoin(F.broadcast(total)).withColumn("share", share).drop("total")


def local_weights(snap: Snapshot, weights: DataFrame, local: tuple[Observable, ...] | list[Observable], law: str | None, symbols: DataFrame,
                  complexes: DataFrame | None = None, scope: str = "node") -> DataFrame:
    """(node_id, c): each match weight times the law at the matched node; a law that is None is 1.

    Observables listed in ``local`` are read at the node, or its complex for scope "complex"; all other names
    come from the one-row ``symbols`` table and keep their global value.
    """
    if law is None:
        return weights.select("node_id", F.col("c").cast("double").alias("c"))
    names = [o.name for o in local]
    rows = weights
    for o in local:
        values = local_values(snap, o, complexes, scope).withColumnRenamed("value", o.name)
        rows = rows.join(values, "node_id", "left").withColumn(o.name, F.coalesce(o.name, F.lit(0)))
    rest = [c for c in symbols.columns if c not in names]
    rows = rows.crossJoin(F.broadcast(symbols.select(*rest)))
    return rows.select("node_id", (F.col("c") * F.expr(to_sql(law)).cast("double")).alias("c"))


def local_rate_sum(snap: Snapshot, weights: DataFrame, local: list[Observable], law: str, symbols: DataFrame,
                   complexes: DataFrame | None = None, scope: str = "node") -> DataFrame:
    """(total): sum over matches of weight times the law at the matched node, as in ``local_weights``."""
    rows = local_weights(snap, weights, local, law, symbols, complexes, scope)
    return rows.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("total"))


def factor_sums(snap: Snapshot, rule: Rule, counts: list[DataFrame], symbols: DataFrame, complexes: DataFrame | None) -> DataFrame:
    """(sum_1, sum_2, pairs): factor sums of both sides, and what pairs that may not meet add to their product.

    The sum over pairs is bilinear, so it is the product of the sides' sums; pairs in one complex, or of a node with itself, leave as sums of per-complex or
    per-node products. No pair is formed.
    """
    if rule.kind == "local" and len(counts) != 1 or rule.kind == "product" and len(counts) != 2:
        raise ValueError(f"rule {rule.name!r}: a local law takes one reactant, a product law two")
    scope = lambda i: rule.scopes[i] if i < len(rule.scopes) else "node"
    sides = [local_weights(snap, c, rule.local, law, symbols, complexes, scope(i)) for i, (c, law) in enumerate(zip(counts, (rule.law, rule.law_b)))]
    total = lambda rows, name: rows.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias(name))
    row = total(sides[0], "sum_1")
    if len(sides) == 1:
        return row.withColumns({"sum_2": F.lit(1.0), "pairs": F.lit(0.0)})
    row = row.crossJoin(total(sides[1], "sum_2"))
    if not rule.same_complex_ok:
        return row.crossJoin(same_complex_pairs(*sides, complexes))
    if rule.same_site:
        own = sides[0].select("node_id", F.col("node_id").alias("complex_id")).unionByName(sides[1].select("node_id", F.col("node_id").alias("complex_id"))).distinct()
        return row.crossJoin(same_complex_pairs(*sides, own))
    return row.withColumn("pairs", F.lit(0.0))


def first_clamps(rates_over_time: DataFrame) -> DataFrame:
    """(rule, time, value): where each rule (rule, time, value) first went negative or not a number."""
    bad = rates_over_time.filter(~F.coalesce((F.col("value") >= 0) & ~F.isnan("value"), F.lit(False)))
    return bad.groupBy("rule").agg(F.min("time").alias("time"), F.min_by("value", "time").alias("value"))


def reactant_roles(patterns: DataFrame, ops: DataFrame) -> DataFrame:
    """(rule, reactant, transformed): whether a rule changes a reactant; an operation that names no site counts as yes.

    ``patterns`` is (rule, reactant, site_id), ``ops`` (rule, site_id) with null where the target is unresolved.
    """
    vague = ops.filter("site_id is null").select("rule").distinct().withColumn("vague", F.lit(True))
    hit = ops.filter("site_id is not null").select("rule", "site_id").distinct().withColumn("hit", F.lit(True))
    rows = patterns.join(hit, ["rule", "site_id"], "left").join(vague, "rule", "left")
    touched = F.coalesce("hit", F.lit(False)) | F.coalesce("vague", F.lit(False))
    return rows.groupBy("rule", "reactant").agg(F.bool_or(touched).alias("transformed"))
