"""Counts of ring-shaped patterns without listing pairs of a node's sites.

All links between two nodes become one weighted row first, so parallel links never meet pairwise. Triangles and squares are then
built from the side of nodes with few neighbours: ordered by number of neighbours, a node has at most sqrt(2 m) neighbours above
itself in a graph of m weighted rows, so m^1.5 rows bound what is joined, hubs included (Chiba and Nishizeki 1985).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondwise.functions.combinatorics import distinct_sum, subsets
from bondwise.model import Mol, Pattern, Slot, Snapshot
from bondwise.operators.skew import hub_join
from bondwise.session import cut, cut_measured

# Nodes of more neighbours are ordered by their number; up to MAX_HEAVY of them are broadcast, 16 bytes each.
FEW = 100
MAX_HEAVY = 1_000_000


def ring_length(p: Pattern) -> int | None:
    """2 for two nodes with several bonds, 3 or 4 for a ring of single bonds, None for other shapes.

    A node whose further slots share a site name with its bonded ones is left to listing, as are longer rings.
    """
    k, bonds = len(p.mols), p.bonds()
    for m in p.mols:
        bonded = {s.family for s in m.slots if isinstance(s.bond, int)}
        if bonded & {s.family for s in m.slots if not isinstance(s.bond, int)}:
            return None
    if any(a == b for (a, _), (b, _) in bonds):
        return None
    if k == 2 and len(bonds) >= 2:
        return 2
    ring = k in (3, 4) and len(bonds) == k and len(p.fragments()) == 1 and all(len(near) == 2 for near in p.neighbours().values())
    return k if ring else None


def link_weights(snap: Snapshot, near: Mol, far: Mol, bonds: list[tuple[Slot, Slot]]) -> DataFrame:
    """(u, v, w): in how many ways the bonds (slot of ``near``, slot of ``far``) fall on different links from node u to node v."""
    flags = lambda side, name: [b[side].predicate().alias(f"{name}{i}") for i, b in enumerate(bonds)]
    any_of = lambda side: reduce(lambda a, b: a | b, (b[side].predicate() for b in bonds))
    fits = lambda block: reduce(lambda a, b: a & b, (F.col(f"a{i}") & F.col(f"b{i}") for i in block))
    label = {b: "k_" + "_".join(map(str, b)) for b in subsets(len(bonds))}
    links = _links(snap, near, far, flags, any_of)
    sums = links.groupBy("u", "v").agg(*[F.count_if(fits(b)).alias(n) for b, n in label.items()])
    w = distinct_sum(tuple(range(len(bonds))), lambda b: F.col(label[b]))
    return sums.select("u", "v", w.cast("long").alias("w")).filter("w > 0")


def _links(snap: Snapshot, near: Mol, far: Mol, flags, any_of) -> DataFrame:
    """(u, v, flags of both ends) of the links whose ends fit any bond; both ends stand in one row where the snapshot knows them."""
    if snap.ends is not None:
        here = snap.ends.filter((F.col("type") == near.type) & any_of(0) & (F.col("node_id") != F.col("partner_node"))).select(
            F.col("node_id").alias("u"), F.col("partner_node").alias("v"), F.col("node_id").alias("partner_node"), F.col("far_type").alias("type"),
            F.col("far_name").alias("site_name"), F.col("far_state").alias("state"), *flags(0, "a"),
        )
        return here.filter((F.col("type") == far.type) & any_of(1)).select("*", *flags(1, "b")).drop("partner_node", "type", "site_name", "state")
    here = snap.sites.filter((F.col("type") == near.type) & any_of(0) & (F.col("node_id") != F.col("partner_node"))).select(
        F.col("node_id").alias("u"), F.col("partner_node").alias("v"), F.col("partner_site").alias("at"), *flags(0, "a")
    )
    there = snap.sites.filter((F.col("type") == far.type) & any_of(1)).select(F.col("node_id").alias("v"), F.col("site_idx").alias("at"), *flags(1, "b"))
    return here.join(there, ["v", "at"])


def _further_slots(snap: Snapshot, p: Pattern, rows: DataFrame, weight: str, places: list[int]) -> DataFrame:
    """Multiply ``weight`` by the ways to place the unbonded slots of the pattern nodes that columns ``n{i}`` hold."""
    from bondwise.operators.match import node_counts

    for i in places:
        other = tuple(s for s in p.mols[i].slots if not isinstance(s.bond, int))
        if other:
            side = node_counts(snap, Mol(p.mols[i].type, other)).select(F.col("node_id").alias(f"n{i}"), F.col("c").alias("ways"))
            rows = rows.join(side, f"n{i}").withColumn(weight, F.col(weight) * F.col("ways")).drop("ways")
    return rows


def pair_counts(snap: Snapshot, p: Pattern) -> DataFrame:
    """(n0, n1, c) for two pattern nodes with several bonds; a pair of nodes with d links costs d rows."""
    ends = [((a, sa), (b, sb)) if a == 0 else ((b, sb), (a, sa)) for (a, sa), (b, sb) in p.bonds()]
    slots = [(p.mols[0].slots[sa], p.mols[1].slots[sb]) for (_, sa), (_, sb) in ends]
    rows = link_weights(snap, p.mols[0], p.mols[1], slots).select(F.col("u").alias("n0"), F.col("v").alias("n1"), F.col("w").alias("c"))
    return _further_slots(snap, p, rows, "c", [0, 1])


class _Sides:
    """The weighted rows of each bond of a ring, every end with its number of neighbours where these are more than ``FEW``.

    Nodes of up to ``FEW`` neighbours are not looked up: they come first in the order, by the average of their type, and take part
    in at most ``FEW`` pairs a neighbour, so the bound becomes m times the greater of ``FEW`` and m^0.5.
    """

    def __init__(self, snap: Snapshot, p: Pattern):
        self.rows, self.seen, made, same = {}, {}, {}, {}
        n_rows, touching = {}, {}
        for (a, sa), (b, sb) in p.bonds():
            # further slots thin out the rows before anything is joined; a node's share enters with its first bond only
            own = [i for i in (a, b) if i not in {x for pair in self.rows for x in pair} and any(not isinstance(s.bond, int) for s in p.mols[i].slots)]
            ends = [(p.mols[i].type, str(p.mols[i].slots[s].predicate())) for i, s in ((a, sa), (b, sb))]
            # bonds that fall on the same links, in either direction, share their rows
            kind = (a, b) if own else tuple(sorted(ends))
            turned = not own and ends != sorted(ends)
            if kind not in made:
                weights = link_weights(snap, p.mols[a], p.mols[b], [(p.mols[a].slots[sa], p.mols[b].slots[sb])])
                named = _further_slots(snap, p, weights.select(F.col("u").alias(f"n{a}"), F.col("v").alias(f"n{b}"), "w"), "w", own)
                x, y = (b, a) if turned else (a, b)
                made[kind] = cut(named.select(F.col(f"n{x}").alias("u"), F.col(f"n{y}").alias("v"), "w"), "link-weights")
                n_rows[kind] = made[kind].count()
                for i in (x, y):
                    touching[p.mols[i].type] = touching.get(p.mols[i].type, 0) + n_rows[kind]
            same[a, b] = kind
            self.rows[(b, a) if turned else (a, b)] = made[kind]
        ends = reduce(DataFrame.unionByName, (r.select(F.col(c).alias("node")) for r in made.values() for c in "uv"))
        degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
        heavy, seen = cut_measured(degree.filter(F.col("deg") > FEW), "heavy-nodes")
        for kind, rows in made.items():
            for c in "uv":
                per = heavy.select(F.col("node").alias(c), "deg", F.col("deg").alias(f"d{c}"))
                rows = rows.join(F.broadcast(per.drop("deg")), c, "left") if seen["n_rows"] <= MAX_HEAVY else hub_join(rows, per, c, n_rows[kind], "left")
            made[kind] = cut(rows, "ranked-weights")
        nodes = {r[0]: r[1] for r in snap.nodes.filter(F.col("type").isin(list(touching))).groupBy("type").count().collect()}
        order = sorted(touching, key=lambda t: (touching[t] / max(nodes.get(t, 0), 1), t))
        self.place = [order.index(m.type) for m in p.mols]
        self.rows = {pair: made[same.get(pair) or same[pair[1], pair[0]]] for pair in self.rows}

    def between(self, a: int, b: int, weight: str) -> DataFrame:
        """(n{a}, n{b}, weight, r{a}, r{b}): ``r`` orders nodes by neighbours, then by type and id."""
        rows, (x, y) = (self.rows[a, b], "uv") if (a, b) in self.rows else (self.rows[b, a], "vu")
        rank = lambda c, i: F.struct(F.coalesce(f"d{c}", F.lit(0)).alias("deg"), F.lit(self.place[i]).alias("type"), F.col(c).alias("id"))
        end = lambda c, i: [F.col(c).alias(f"n{i}"), rank(c, i).alias(f"r{i}")]
        return rows.select(*end(x, a), *end(y, b), F.col("w").alias(weight))

    def any_below(self, a: int, b: int) -> bool:
        """Whether some row of the bond between a and b has its lower end at a."""
        if (a, b) not in self.seen:
            self.seen[a, b] = not self.between(a, b, "w").filter(_below(a, b)).isEmpty()
        return self.seen[a, b]


def _below(a: int, b: int) -> Column:
    return F.col(f"r{a}") < F.col(f"r{b}")


def triangle_counts(snap: Snapshot, p: Pattern) -> DataFrame:
    """(n0, n1, n2, c) for a ring of three: open pairs start at the corner with the fewest neighbours."""
    sides, parts = _Sides(snap, p), []
    for low in range(3):
        i, j = (low + 1) % 3, (low + 2) % 3
        if (parts or low < 2) and not (sides.any_below(low, i) and sides.any_below(low, j)):
            continue  # no pairs start here, so the rows that would close them need not be shuffled
        one = sides.between(low, i, "w1").filter(_below(low, i)).select(f"n{low}", f"n{i}", "w1")
        two = sides.between(low, j, "w2").filter(_below(low, j)).select(f"n{low}", f"n{j}", "w2")
        closing = sides.between(i, j, "w3").select(f"n{i}", f"n{j}", "w3")
        open_pairs = one.join(two, f"n{low}").select("n0", "n1", "n2", (F.col("w1") * F.col("w2")).alias("w"))
        met = open_pairs.join(closing, [f"n{i}", f"n{j}"])
        parts.append(met.select("n0", "n1", "n2", (F.col("w") * F.col("w3")).alias("c")))
    return reduce(DataFrame.unionByName, parts)


def square_counts(snap: Snapshot, p: Pattern) -> DataFrame:
    """(top, opposite, c) for a ring of four: ``top`` is the corner with the most neighbours, ``opposite`` the one across.

    Paths top - corner - opposite are summed per corner, so two corners of one node leave the sum without pairs being formed.
    """
    sides, near, parts = _Sides(snap, p), p.neighbours(), []
    for top in range(4):
        across = next(i for i in range(4) if i != top and i not in near[top])
        legs = []
        for n, mid in enumerate(sorted(near[top])):
            upper = sides.between(top, mid, "w1").filter(_below(mid, top))
            lower = sides.between(mid, across, "w2").select(f"n{mid}", f"n{across}", f"r{across}", "w2")
            paths = upper.join(lower, f"n{mid}").filter(_below(across, top))
            w = F.col("w1") * F.col("w2")
            legs.append(paths.select(
                F.col(f"n{top}").alias("top"), F.col(f"n{across}").alias("opposite"), F.col(f"n{mid}").alias("mid"),
                *[(w if k == n else F.lit(0).cast("long")).alias(f"p{k}") for k in range(2)],
            ))
        per_mid = legs[0].unionByName(legs[1]).groupBy("top", "opposite", "mid").agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1"))
        sums = per_mid.groupBy("top", "opposite").agg(F.sum("p0").alias("s0"), F.sum("p1").alias("s1"), F.sum(F.col("p0") * F.col("p1")).alias("same"))
        parts.append(sums.select("top", "opposite", (F.col("s0") * F.col("s1") - F.col("same")).alias("c")).filter("c > 0"))
    return reduce(DataFrame.unionByName, parts)
