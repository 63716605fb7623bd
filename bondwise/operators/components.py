"""Connected components and what is counted per complex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.model import Snapshot
from bondwise.operators import skew
from bondwise.session import cut, cut_measured, forget


def _roots(edges: DataFrame, n_edges: int) -> DataFrame:
    """(u, root, deg) for every node with an edge: where the hooks lead when each node hooks on to the smallest of itself and its neighbours.

    Hooks lead to ever smaller ids, so there are no cycles. Pointers are doubled only for nodes that others hook on to, which are few; all
    others look up their neighbour's root once. ``deg`` counts a node's edges, which bounds how many hook on to it.
    """
    floor = max(skew.HUB_ROWS, 2 * n_edges // skew.MAX_HUBS)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("deg"))
    hooks = cut(low.select("u", F.least("u", "low").alias("up"), "deg"), "hooks")
    # a hub stays in the list even when it leads nowhere, so that its rows are told from those of other keys
    led = hooks.filter(f"up <> u or deg >= {floor}")
    met = hooks.filter("up <> u").select(F.col("up").alias("u")).distinct()
    inner, state = cut_measured(led.join(met, "u", "left_semi").select("u", "up", "deg"), "inner-hooks", moving=F.count_if(F.expr("up <> u")))
    if not state["n_rows"]:
        return hooks.withColumnRenamed("up", "root")
    ahead = lambda: inner.select(F.col("u").alias("up"), F.col("up").alias("next"), "deg")
    while state["moving"]:
        jumped = skew.hub_join(inner.withColumnRenamed("deg", "own"), ahead(), "up", 2 * n_edges, "left")
        moved = F.coalesce(F.col("next") != F.col("up"), F.lit(False))
        before, (inner, state) = inner, cut_measured(jumped.select("u", F.coalesce("next", "up").alias("up"), F.col("own").alias("deg"), moved.alias("moved")), "inner-hooks", moving=F.count_if("moved"))
        forget(before)
    found = skew.hub_join(hooks.withColumnRenamed("deg", "own"), ahead(), "up", 2 * n_edges, "left")
    roots = cut(found.select("u", F.coalesce("next", "up").alias("root"), F.col("own").alias("deg")), "roots")
    forget(hooks)
    forget(inner)
    return roots


def _through(roots: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """(u, root): roots of one round followed to the labels of the next; a root without a label is one. A root may hold most rows."""
    last = labels.select(F.col("u").alias("root"), F.col("root").alias("label"))
    if n_rows < skew.HUB_ROWS:
        met = roots.join(last, "root", "left")
    else:
        held = roots.groupBy("root").agg(F.count(F.lit(1)).alias("deg")).join(last, "root", "left")
        met = skew.hub_join(roots.select("u", "root"), held, "root", n_rows)
    return met.select("u", F.coalesce("label", "root").alias("root"))


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, complex_id), the complex named by its smallest node id; a node without links is its own.

    Each round contracts every tree of hooks (see ``_roots``) to its root and keeps the different links between roots, so rounds shrink
    fast, whatever the diameter. The smallest node of a complex never hooks on and is the root that is left. Labels are found from the last round back.
    """
    edges = links.filter("node_a <> node_b").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    edges, seen = cut_measured(edges, "links")
    rounds = []
    while seen["n_rows"]:
        roots = _roots(edges, seen["n_rows"])
        rounds.append((roots, 2 * seen["n_rows"]))
        at = lambda name: roots.select(F.col("u").alias(name), F.col("root").alias(f"{name}_root"), "deg")
        met = skew.hub_join(edges, at("u"), "u", 2 * seen["n_rows"]).select(F.col("u_root").alias("u"), "v")
        met = skew.hub_join(met, at("v"), "v", 2 * seen["n_rows"]).filter("u <> v_root")
        left = met.select(F.greatest("u", "v_root").alias("u"), F.least("u", "v_root").alias("v")).distinct()
        before, (edges, seen) = edges, cut_measured(left, "contracted")
        forget(before)
    out = nodes.select("node_id")
    if not rounds:
        return out.withColumn("complex_id", F.col("node_id"))
    labels = rounds[-1][0].select("u", "root")
    for roots, n_rows in reversed(rounds[:-1]):
        labels = cut(_through(roots, labels, n_rows), "labels")
    out = out.join(labels.select(F.col("u").alias("node_id"), F.col("root").alias("complex_id")), "node_id", "left")
    return out.select("node_id", F.coalesce("complex_id", "node_id").alias("complex_id"))


def complexes_of(snap: Snapshot, keep: bool = True) -> DataFrame:
    """Components of a snapshot, written out when several operators will read them."""
    found = connected_components(snap.nodes, snap.links())
    return cut(found, "complexes") if keep else found


def complex_count(complexes: DataFrame) -> DataFrame:
    """Every complex holds exactly one node that carries its name, so no distinct count is needed."""
    return complexes.agg(F.count_if(F.col("node_id") == F.col("complex_id")).alias("complexes"))


def size_distribution(complexes: DataFrame) -> DataFrame:
    """(n_nodes, complexes)."""
    sizes = complexes.groupBy("complex_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("complexes"))


def type_size_distribution(snap: Snapshot, complexes: DataFrame, type_name: str) -> DataFrame:
    """(n_nodes, complexes): complexes by how many nodes of one type they hold, none included."""
    typed = complexes.join(snap.nodes, "node_id")
    sizes = typed.groupBy("complex_id").agg(F.count_if(F.col("type") == type_name).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("complexes"))


def cycle_counts(snap: Snapshot, complexes: DataFrame) -> DataFrame:
    """(complex_id, n_nodes, n_links, cycles): independent cycles, links - nodes + 1.

    A link has two ends, each on a site row, so per-node end counts suffice and links need no join of their own.
    """
    ends = snap.sites.filter("partner_node is not null").groupBy("node_id").agg(F.count(F.lit(1)).alias("ends"))
    per = (
        complexes.join(ends, "node_id", "left")
        .groupBy("complex_id")
        .agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("ends"), F.lit(0)).alias("ends"))
    )
    links = F.expr("ends div 2")
    return per.select("complex_id", "n_nodes", links.alias("n_links"), (links - F.col("n_nodes") + 1).alias("cycles"))


def members(snap: Snapshot, complexes: DataFrame, complex_ids: DataFrame) -> Snapshot:
    """The subgraph made of the listed complexes."""
    inside = complexes.join(complex_ids, "complex_id", "left_semi").select("node_id")
    return Snapshot(
        snap.nodes.join(inside, "node_id", "left_semi"), snap.sites.join(inside, "node_id", "left_semi")
    )
