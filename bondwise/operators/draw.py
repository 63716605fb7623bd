"""Deterministic draws from large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.functions.combinatorics import distinct_sum, subsets
from bondwise.model import Mol, Snapshot
from bondwise.operators.order import running_sum
from bondwise.session import cut

BUCKETS = 4096


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) from the MD5 digits of the columns' texts, joined by bars: the same in any task and any system."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(matches: DataFrame, ids: list[str], weight: str, k: int, seed: int) -> DataFrame:
    """``k`` matches without replacement, chance proportional to weight (Efraimidis and Spirakis, 2006).

    Each row gets the key -ln(u) / w and the least k win, so tasks keep k rows each and nothing is sorted whole.
    """
    key = -F.ln(unit_hash(F.lit(seed), *[F.col(c) for c in ids])) / F.col(weight)
    return matches.filter(F.col(weight) > 0).withColumn("key", key).orderBy("key", *ids).limit(k)


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Any ``n`` rows of a large table, the same on every run, without ordering it in one task.

    Rows fall into hash buckets; whole buckets are taken while they fit and only the bucket that overflows is
    ranked.
    """
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    # at most BUCKETS rows, so one task can add them up
    upto = F.sum("size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    room = sizes.withColumn("room", F.lit(n) - (upto - F.col("size"))).filter("room > 0")
    kept = spread.join(F.broadcast(room), "bucket")
    whole = kept.filter("room >= size")
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(key))
    part = kept.filter("room < size").withColumn("rank", rank).filter("rank <= room").drop("rank")
    return whole.unionByName(part).select(*rows.columns)


def draw_embeddings(snap: Snapshot, m: Mol, draws: DataFrame) -> DataFrame:
    """(draw_id, node_id, s0, s1, …): one embedding of a pattern node for each draw (draw_id, node_id, u), u in [0, 1).

    The embeddings of a node stand in order of their sites, slot by slot; the draw takes the one at place floor(u * number). It is found without listing them:
    at each slot the sites are weighted by how many ways the slots after it can still be placed, which inclusion and exclusion over the node's
    condition counts tells, and the site in whose running sum the place falls is taken. Running sums are spread over range parts, so a hub's sites
    never meet in one task. Draws on nodes without an embedding give no row.
    """
    slots = m.slots
    fits = [s.predicate() for s in slots]
    names = {n: [i for i, s in enumerate(slots) if s.family == n] for n in dict.fromkeys(s.family for s in slots)}
    blocks = [tuple(own[i] for i in b) for own in names.values() for b in subsets(len(own))]
    label = {b: "b_" + "_".join(map(str, b)) for b in blocks}
    both = lambda b: [fits[i] for i in b]

    def every(conds):
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    of_type = snap.sites.filter(F.col("type") == m.type).join(draws.select("node_id").distinct(), "node_id", "left_semi")
    counts = of_type.groupBy("node_id").agg(*[F.count_if(every(both(b))).alias(label[b]) for b in blocks])

    def completions(after: int, taken: list[str]):
        """Ways to place the slots from ``after`` on, with the sites whose fits are in the arrays ``taken`` in use."""
        total = F.lit(1).cast("long")
        for own in names.values():
            left = tuple(i for i in own if i >= after)
            used = lambda b: sum((F.when(every([F.get(t, i) for i in b]), 1).otherwise(0) for t in taken), F.lit(0))
            total = total * distinct_sum(left, lambda b: F.col(label[tuple(b)]) - used(b))
        return total

    state = draws.join(counts, "node_id").withColumn("left", F.floor(F.col("u") * completions(0, [])))
    state = cut(state.filter(completions(0, []) > 0).drop("u"), "draws")
    held = of_type.select("node_id", "site_idx", F.array(*fits).alias("fit"), F.col("site_name").alias("own_name"))
    for i, slot in enumerate(slots):
        same = [j for j in range(i) if slots[j].family == slot.family]
        near = state.join(held.filter(F.get("fit", i)).drop("own_name"), "node_id")
        for j in same:
            near = near.filter(F.col("site_idx") != F.col(f"s{j}"))
        near = near.withColumn("w", completions(i + 1, [f"fit{j}" for j in range(i)] + ["fit"]).cast("long")).filter("w > 0")
        summed = running_sum(near.select("draw_id", "site_idx", "w"), ["draw_id"], ["site_idx"], "w", "upto")
        hit = near.join(summed.select("draw_id", "site_idx", "upto"), ["draw_id", "site_idx"]).filter("upto > left and upto - w <= left")
        state = cut(hit.withColumn("left", F.col("left") - (F.col("upto") - F.col("w"))).drop("w", "upto").withColumnsRenamed({"site_idx": f"s{i}", "fit": f"fit{i}"}), "draws")
    return state.select("draw_id", "node_id", *[f"s{i}" for i in range(len(slots))])
