"""Spanning forests, their Euler tours, and which sets of links cut a complex.

A forest is grown by contraction: in each round every component hooks on to the neighbour that comes first in an order drawn anew by hash, and the
link it hooks by joins the forest. A tour walks each tree along both sides of its links; its places come from pointer doubling, so a
tree of any depth takes about log(n) rounds, and a hub's links are put in order by ranks that spread over tasks.

Links outside the forest get random 64-bit labels, and a link of the forest the XOR of the labels whose cycles pass it (Pritchard and
Thurimella, 2011). Then a set of links is a cut just when its labels XOR to 0, but for a chance of 2^-64 a set: a link with label 0 is a bridge,
two links with equal labels cut together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.operators.order import in_parts, ranked
from bondwise.session import cut, cut_measured, forget

LINK = ["node_a", "site_a", "node_b", "site_b"]


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links of one spanning forest of ``links``. Of parallel links at most one is taken; a link from a node to itself never is."""
    link = F.struct(*LINK).alias("link")
    left, seen = cut_measured(links.filter("node_a <> node_b").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"), link), "uncontracted")
    taken, turn = [], 0
    while seen["n_rows"]:
        turn += 1
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("c"))
        ends = F.explode(F.array(F.struct("u", "v", "link"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("link"))))
        both = left.select(ends.alias("e")).select("e.*")
        best = both.groupBy("u").agg(F.min(F.struct(place("v").alias("p"), "link")).alias("best")).filter(F.col("best.p") < place("u"))
        hooks = cut(best.select("u", F.col("best.p.c").alias("up"), "best.link"), "hooks")
        taken.append(hooks.select("link.*"))
        # a hook leads to a component that comes earlier, so there are no cycles, and chains are short on average
        up = hooks.select("u", "up")
        while True:
            ahead = up.select(F.col("u").alias("up"), F.col("up").alias("next"))
            jumped, state = cut_measured(up.join(ahead, "up", "left").select("u", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "hook-roots", moving=F.count_if("moved"))
            up = jumped.select("u", "up")
            if not state["moving"]:
                break
        at = lambda side: up.select(F.col("u").alias(side), F.col("up").alias(f"{side}_up"))
        met = left.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("u_up", "u").alias("u"), F.coalesce("v_up", "v").alias("v"), "link")
        before, (left, seen) = left, cut_measured(met.filter("u <> v"), "uncontracted")
        forget(before)
    if not taken:
        return links.limit(0).select(*LINK)
    return reduce(DataFrame.unionByName, taken)


def tours(forest: DataFrame, complexes: DataFrame) -> DataFrame:
    """(u, v, complex_id, place): each link of the forest from both sides, placed along the tour of its tree that starts at the node
    which names the complex. Places count from 0 in each complex."""
    ends = F.explode(F.array(F.struct(F.col("node_a").alias("v"), F.col("node_b").alias("w")), F.struct(F.col("node_b").alias("v"), F.col("node_a").alias("w"))))
    arms = cut(ranked(forest.select(ends.alias("e")).select("e.*"), ["v"], "w"), "arms")
    # after coming from w to v the tour goes on to the arm of v that follows w
    follow = arms.select("v", F.col("rank").alias("at"), F.col("w").alias("on"))
    steps = arms.withColumn("at", F.col("rank") % F.col("n") + 1).join(follow, ["v", "at"]).join(complexes.select(F.col("node_id").alias("v"), "complex_id"), "v")
    ends_here = (F.col("v") == F.col("complex_id")) & (F.col("at") == 1)
    arc = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    todo = cut(steps.select(arc("w", "v").alias("arc"), "complex_id", F.when(~ends_here, arc("v", "on")).alias("next"), F.lit(1).cast("long").alias("left")), "tour-steps")
    while True:
        ahead = todo.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        jumped = todo.join(ahead, "next", "left").select("arc", "complex_id", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        before, (todo, seen) = todo, cut_measured(jumped, "tour-steps", moving=F.count("next"))
        forget(before)
        if not seen["moving"]:
            break
    size = todo.groupBy("complex_id").agg(F.max("left").alias("size"))
    placed = todo.join(size, "complex_id")
    return placed.select(F.col("arc.a").alias("u"), F.col("arc.b").alias("v"), "complex_id", (F.col("size") - F.col("left")).alias("place"))


def cut_labels(links: DataFrame, complexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with label, child, first, last; places of nodes).

    ``label`` is the link's cut label. A link of the forest has its far end from the root as ``child``; the nodes beyond it are those with
    places from first to last. The second table has (node_id, place); the node that names a complex is at -1.
    """
    proper = links.filter("node_a <> node_b").select(*LINK)
    forest = cut(spanning_forest(proper), "forest")
    own = F.xxhash64(*LINK, F.lit("cut label"))
    others = proper.join(forest, LINK, "left_anti").withColumn("label", own)
    at_node = F.explode(F.array("node_a", "node_b"))
    values = others.select(at_node.alias("v"), "label").groupBy("v").agg(F.bit_xor("label").alias("value"))
    arcs = cut(tours(forest, complexes), "tours")
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("place").alias("back"))
    down = arcs.join(back, ["u", "v"]).withColumn("down", F.col("place") < F.col("back"))
    # running XOR along the tour, in range parts: a node counts where it is first met
    rows = down.join(values, "v", "left").withColumn("value", F.when(F.col("down"), F.coalesce("value", F.lit(0))).otherwise(F.lit(0)))
    parts = in_parts(rows.select("u", "v", "complex_id", "place", "back", "down", "value"), ["complex_id"], ["place"])
    inside = parts.withColumn("run", F.bit_xor("value").over(W.partitionBy("complex_id", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    sums = parts.groupBy("complex_id", "part").agg(F.bit_xor("value").alias("whole"))
    before = W.partitionBy("complex_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select("complex_id", "part", F.coalesce(F.bit_xor("whole").over(before), F.lit(0)).alias("shift"))
    run = cut(inside.join(shift, ["complex_id", "part"]).withColumn("run", F.col("run").bitwiseXOR(F.col("shift"))), "tour-labels")
    ups = run.filter("not down").select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("run").alias("after"))
    # beyond the link lie the nodes met after it was walked down and before it was walked up
    tree = run.filter("down").join(ups, ["u", "v"]).select(
        F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), F.col("v").alias("child"), F.col("place").alias("first"), F.col("back").alias("last"),
        F.col("after").bitwiseXOR(F.col("run")).bitwiseXOR(F.col("value")).alias("label"),
    )
    in_tree = forest.withColumns({"lo": F.least("node_a", "node_b"), "hi": F.greatest("node_a", "node_b")}).join(tree, ["lo", "hi"]).drop("lo", "hi")
    labelled = in_tree.unionByName(others, allowMissingColumns=True)
    places = run.filter("down").select(F.col("v").alias("node_id"), "place")
    return labelled, complexes.select("node_id", "complex_id").join(places, "node_id", "left").select("node_id", "complex_id", F.coalesce("place", F.lit(-1)).alias("place"))


def _cuts(labels: list[int]) -> list[int]:
    """A basis of the sets (as bits) of links whose labels XOR to 0."""
    pivots: dict[int, tuple[int, int]] = {}
    out = []
    for k, label in enumerate(labels):
        held = 1 << k
        while label:
            top = label.bit_length()
            if top not in pivots:
                pivots[top] = (label, held)
                break
            label, held = label ^ pivots[top][0], held ^ pivots[top][1]
        if not label:
            out.append(held)
    return out


def judge(deleted: list[dict], added: list[dict]) -> list[bool]:
    """Whether the ends of each deleted link stay connected when the ``deleted`` links go and the ``added`` ones come.

    Two nodes are connected without the deleted links just when no cut made of them has the nodes on different sides. A node is on the far side of a
    cut if it lies beyond an odd number of the cut's links in the forest. Pieces that an added link joins are merged.
    """
    cuts = _cuts([d["label"] & 0xFFFFFFFFFFFFFFFF for d in deleted])

    def piece(complex_id: int, place: int) -> tuple:
        beyond = [d["complex_id"] == complex_id and d["first"] is not None and d["first"] <= place <= d["last"] for d in deleted]
        return complex_id, *[sum(b for k, b in enumerate(beyond) if c >> k & 1) % 2 for c in cuts]

    up: dict[tuple, tuple] = {}

    def root(p: tuple) -> tuple:
        while p in up:
            p = up[p]
        return p

    for a in added:
        one, two = root(piece(a["complex_id"], a["place"])), root(piece(a["far_complex"], a["far_place"]))
        if one != two:
            up[one] = two
    return [root(piece(d["complex_id"], d["place"])) == root(piece(d["complex_id"], d["far_place"])) for d in deleted]
