"""Pattern embeddings on a site graph.

Counting never lists the embeddings of one node: the number of ways to put k pattern sites on distinct sites
of a node follows from at most 2^k - 1 conditional counts, which Spark pre-aggregates before its shuffle.
Listing builds a join chain along the pattern's bonds and serves shapes that counting does not cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bondwise.functions.combinatorics import distinct_sum, subsets
from bondwise.model import Mol, Observable, Pattern, Slot, Snapshot
from bondwise.operators import rings
from bondwise.operators.skew import hub_join


def _by_name(slots: tuple[Slot, ...]) -> dict[str, list[Slot]]:
    groups: dict[str, list[Slot]] = {}
    for s in slots:
        groups.setdefault(s.family, []).append(s)
    return groups


def _both(slots: list[Slot]) -> Column:
    return reduce(lambda a, b: a & b, (s.predicate() for s in slots))


def _block_counts(groups: dict[str, list[Slot]]) -> tuple[list[Column], dict]:
    """Aggregates that count the sites fulfilling every slot of each block, and their column names."""
    aggs, names = [], {}
    for g, (name, slots) in enumerate(sorted(groups.items())):
        for block in subsets(len(slots)):
            label = f"k{g}_" + "_".join(map(str, block))
            names[name, block] = label
            aggs.append(F.count_if(_both([slots[i] for i in block])).alias(label))
    return aggs, names


def _group_factor(name: str, slots: list[Slot], names: dict) -> Column:
    return distinct_sum(tuple(range(len(slots))), lambda b: F.col(names[name, b]))


def node_counts(snap: Snapshot, m: Mol) -> DataFrame:
    """(node_id, c): embeddings of one pattern node on each node, c > 0 only. Bond labels act as "bound"."""
    if not m.slots:
        return snap.nodes.filter(F.col("type") == m.type).select("node_id", F.lit(1).cast("long").alias("c"))
    groups = _by_name(m.slots)
    aggs, names = _block_counts(groups)
    wanted = reduce(lambda a, b: a | b, (s.predicate() for s in m.slots))
    counted = snap.sites.filter((F.col("type") == m.type) & wanted).groupBy("node_id").agg(*aggs)
    c = reduce(lambda a, b: a * b, (_group_factor(n, s, names) for n, s in groups.items()))
    return counted.select("node_id", c.cast("long").alias("c")).filter("c > 0")


def pinned_counts(snap: Snapshot, m: Mol, at: int) -> DataFrame:
    """(node_id, site_idx, partner_node, partner_site, w): embeddings of ``m`` whose slot ``at`` is that site."""
    pin = m.slots[at]
    rest = m.slots[:at] + m.slots[at + 1 :]
    hits = snap.sites.filter((F.col("type") == m.type) & pin.predicate())
    keep = ["node_id", "site_idx", "partner_node", "partner_site"]
    if not rest:
        return hits.select(*keep, F.lit(1).cast("long").alias("w"))
    groups = _by_name(rest)
    aggs, names = _block_counts(groups)
    of_type = snap.sites.filter(F.col("type") == m.type)
    per_node = of_type.groupBy("node_id").agg(*aggs, F.count(F.lit(1)).alias("deg"))

    def factor(name: str, slots: list[Slot]) -> Column:
        if name != pin.family:
            return _group_factor(name, slots, names)
        # the pinned site is taken, so it leaves every block it would have counted in
        return distinct_sum(
            tuple(range(len(slots))),
            lambda b: F.col(names[name, b]) - F.col("own_" + names[name, b]),
        )

    own = [
        _both([slots[i] for i in block]).cast("long").alias("own_" + names[name, block])
        for name, slots in groups.items()
        if name == pin.family
        for block in subsets(len(slots))
    ]
    joined = hub_join(hits.select(*keep, *own), per_node, "node_id", snap.n_sites())
    w = reduce(lambda a, b: a * b, (factor(n, s) for n, s in groups.items()))
    return joined.select(*keep, w.cast("long").alias("w")).filter("w > 0")


def reacting_counts(snap: Snapshot, m: Mol, at: int) -> DataFrame:
    """(node_id, c): embeddings that differ in the reacting site only once, i.e. distinct images of slot ``at``."""
    return pinned_counts(snap, m, at).groupBy("node_id").agg(F.count(F.lit(1)).alias("c"))


def _pair_rows(snap: Snapshot, p: Pattern) -> DataFrame:
    """(n0, n1, c) for a pattern of two nodes and one bond: one equi-join on the link's far end."""
    ((a, sa), (b, sb)) = sorted(p.bonds()[0])
    left = pinned_counts(snap, p.mols[a], sa).filter("node_id <> partner_node")
    right = pinned_counts(snap, p.mols[b], sb).select(
        F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"), F.col("w").alias("w2")
    )
    return left.join(right, ["partner_node", "partner_site"]).select(
        F.col("node_id").alias("n0"), F.col("partner_node").alias("n1"), (F.col("w") * F.col("w2")).alias("c")
    )


def _star_centre(p: Pattern) -> int | None:
    """The node all others hang on by one bond each, if its bonded and other slots share no site name."""
    k = len(p.mols)
    if k < 3 or len(p.bonds()) != k - 1:
        return None
    for i, near in p.neighbours().items():
        if len(near) == k - 1:
            bonded = {s.family for s in p.mols[i].slots if isinstance(s.bond, int)}
            other = {s.family for s in p.mols[i].slots if not isinstance(s.bond, int)}
            return None if bonded & other else i
    return None


def _star_rows(snap: Snapshot, p: Pattern, centre: int) -> DataFrame:
    """(node, c): embeddings of a star per centre node, without listing pairs of its neighbours.

    Leaf weights are summed per (centre, neighbour); the sum over distinct neighbours then comes from products
    of those sums, so a hub with d neighbours costs d rows and not d^k.
    """
    hub = p.mols[centre]
    legs = []
    for (i, si), (j, sj) in p.bonds():
        (c_slot, leaf, l_slot) = (si, j, sj) if i == centre else (sj, i, si)
        legs.append((c_slot, leaf, l_slot))
    weights = None
    for n, (c_slot, leaf, l_slot) in enumerate(legs):
        ends = snap.sites.filter((F.col("type") == hub.type) & hub.slots[c_slot].predicate()).filter(
            "node_id <> partner_node"
        )
        far = pinned_counts(snap, p.mols[leaf], l_slot).select(
            F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"), "w"
        )
        leg = ends.join(far, ["partner_node", "partner_site"]).select(
            "node_id", "partner_node", *[(F.col("w") if i == n else F.lit(0)).alias(f"w{i}") for i in range(len(legs))]
        )
        weights = leg if weights is None else weights.unionByName(leg)
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(legs))]
    per_pair = weights.groupBy("node_id", "partner_node").agg(*sums)
    blocks = subsets(len(legs))
    label = {b: "b_" + "_".join(map(str, b)) for b in blocks}
    power = [F.sum(reduce(lambda x, y: x * y, (F.col(f"w{i}") for i in b))).alias(label[b]) for b in blocks]
    per_centre = per_pair.groupBy("node_id").agg(*power)
    c = distinct_sum(tuple(range(len(legs))), lambda b: F.col(label[b]))
    out = per_centre.select("node_id", c.cast("long").alias("c")).filter("c > 0")
    other = tuple(s for s in hub.slots if not isinstance(s.bond, int))
    if other:
        side = node_counts(snap, Mol(hub.type, other)).withColumnRenamed("c", "c2")
        out = out.join(side, "node_id").select("node_id", (F.col("c") * F.col("c2")).alias("c"))
    return out


def embeddings(snap: Snapshot, p: Pattern, complexes: DataFrame | None = None) -> DataFrame:
    """One row per embedding: ``n{i}`` the image of pattern node i, ``s{i}_{j}`` that of its slot j.

    Nodes are injective, sites of a node are injective, ring closures become extra join keys. Fragments not
    joined by a pattern bond must lie in one complex, which needs ``complexes`` (node_id, complex_id).
    """
    partner = {}
    for a, b in p.bonds():
        partner[a], partner[b] = b, a
    df, placed, done = None, [], set()

    def add_slot(df: DataFrame, i: int, j: int, keys: dict[str, str]) -> DataFrame:
        slot = p.mols[i].slots[j]
        side = snap.sites.filter((F.col("type") == p.mols[i].type) & slot.predicate()).select(
            F.col("node_id").alias(f"n{i}"),
            F.col("site_idx").alias(f"s{i}_{j}"),
            *([F.col("partner_node").alias(f"p{i}_{j}"), F.col("partner_site").alias(f"q{i}_{j}")]
              if (i, j) in partner else []),
        )
        out = side if df is None else df.join(side, [side[mine] == df[theirs] for mine, theirs in keys.items()])
        if df is not None:
            out = out.drop(*[df[theirs] for mine, theirs in keys.items() if mine == theirs])
        for (i2, j2) in done:
            if i2 == i and p.mols[i].slots[j2].family == slot.family:
                out = out.filter(F.col(f"s{i}_{j}") != F.col(f"s{i}_{j2}"))
        if (i, j) in partner and partner[i, j] in done:
            pi, pj = partner[i, j]
            out = out.filter((F.col(f"p{i}_{j}") == F.col(f"n{pi}")) & (F.col(f"q{i}_{j}") == F.col(f"s{pi}_{pj}")))
        done.add((i, j))
        return out

    def distinct_nodes(df: DataFrame, i: int) -> DataFrame:
        for other in placed:
            if p.mols[other].type == p.mols[i].type:
                df = df.filter(F.col(f"n{i}") != F.col(f"n{other}"))
        placed.append(i)
        return df

    for frag in p.fragments():
        if placed and complexes is None:
            raise ValueError("a pattern with unbonded parts needs the complexes table")
        for i in frag:
            slots = list(range(len(p.mols[i].slots)))
            via = next((j for j in slots if (i, j) in partner and partner[i, j] in done), None)
            if via is not None:
                pi, pj = partner[i, via]
                df = add_slot(df, i, via, {f"n{i}": f"p{pi}_{pj}", f"s{i}_{via}": f"q{pi}_{pj}"})
                slots.remove(via)
            else:
                start = snap.nodes.filter(F.col("type") == p.mols[i].type).select(F.col("node_id").alias(f"n{i}"))
                if df is None:
                    df = start
                else:
                    home = complexes.select(F.col("node_id").alias(f"n{i}"), F.col("complex_id").alias(f"x{i}"))
                    seed = complexes.select(
                        F.col("node_id").alias(f"n{placed[0]}"), F.col("complex_id").alias(f"x{i}")
                    )
                    df = df.join(seed, f"n{placed[0]}").join(start.join(home, f"n{i}"), f"x{i}").drop(f"x{i}")
            df = distinct_nodes(df, i)
            for j in slots:
                df = add_slot(df, i, j, {f"n{i}": f"n{i}"})
    cols = [f"n{i}" for i in range(len(p.mols))]
    cols += [f"s{i}_{j}" for i, m in enumerate(p.mols) for j in range(len(m.slots))]
    return df.select(*cols)


def distinct_reacting(matches: DataFrame, reacting: list[tuple[int, int]]) -> DataFrame:
    """Keep one embedding per image of the reacting (pattern node, slot) pairs and the nodes that hold them."""
    nodes = sorted({f"n{i}" for i, _ in reacting})
    return matches.dropDuplicates([*nodes, *[f"s{i}_{j}" for i, j in reacting]])


def _fragment_counts(snap: Snapshot, p: Pattern) -> DataFrame:
    """(node_id, c): embeddings of a connected pattern, each attributed to one node of its complex."""
    if len(p.mols) == 1 and not p.bonds():
        return node_counts(snap, p.mols[0])
    if len(p.mols) == 2 and len(p.bonds()) == 1:
        return _pair_rows(snap, p).select(F.col("n0").alias("node_id"), "c")
    centre = _star_centre(p)
    if centre is not None:
        return _star_rows(snap, p, centre)
    if rings.ring_length(p) == 4:
        return rings.square_counts(snap, p).select(F.col("top").alias("node_id"), "c")
    if rings.ring_length(p) is not None:
        return _ring_rows(snap, p).select(F.col("n0").alias("node_id"), "c")
    return embeddings(snap, p).select(F.col("n0").alias("node_id"), F.lit(1).cast("long").alias("c"))


def _ring_rows(snap: Snapshot, p: Pattern) -> DataFrame:
    return rings.pair_counts(snap, p) if len(p.mols) == 2 else rings.triangle_counts(snap, p)


def _sub(p: Pattern, frag: list[int]) -> Pattern:
    return Pattern(tuple(p.mols[i] for i in frag))


def attributed_counts(snap: Snapshot, p: Pattern, complexes: DataFrame | None = None) -> DataFrame:
    """(node_id, c) rows whose total is the number of embeddings and whose node lies in the matched complex.

    Parts without a bond between them are counted per complex: the sum over distinct nodes of one complex when
    all parts are single nodes, the plain product when they share no node type, and by listing otherwise.
    """
    frags = p.fragments()
    if len(frags) == 1:
        return _fragment_counts(snap, p)
    if complexes is None:
        raise ValueError("a pattern with unbonded parts needs the complexes table")
    parts = [_sub(p, f) for f in frags]
    types = [{m.type for m in q.mols} for q in parts]
    single = all(len(q.mols) == 1 for q in parts)
    disjoint = sum(map(len, types)) == len(set().union(*types))
    if not (single or disjoint):
        listed = embeddings(snap, p, complexes)
        return listed.select(F.col("n0").alias("node_id"), F.lit(1).cast("long").alias("c"))
    n = len(parts)
    rows = None
    for k, q in enumerate(parts):
        part = _fragment_counts(snap, q).select(
            "node_id", *[(F.col("c") if i == k else F.lit(0)).alias(f"c{i}") for i in range(n)]
        )
        rows = part if rows is None else rows.unionByName(part)
    per_node = rows.groupBy("node_id").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n)])
    label = {b: "t_" + "_".join(map(str, b)) for b in subsets(n)}
    totals = [F.sum(reduce(lambda x, y: x * y, (F.col(f"c{i}") for i in b))).alias(label[b]) for b in subsets(n)]
    # complex_id is itself the id of a node of the complex, so the rows can be attributed to it
    per_complex = per_node.join(complexes, "node_id").groupBy("complex_id").agg(*totals)
    c = distinct_sum(tuple(range(n)), lambda b: F.col(label[b]))
    return per_complex.select(F.col("complex_id").alias("node_id"), c.cast("long").alias("c")).filter("c > 0")


def seed_counts(snap: Snapshot, p: Pattern, complexes: DataFrame | None = None) -> DataFrame:
    """(node_id, c): embeddings of the whole pattern whose first pattern node lands on node_id."""
    if len(p.mols) == 1 and not p.bonds():
        return node_counts(snap, p.mols[0])
    if len(p.mols) == 2 and len(p.bonds()) == 1:
        return _pair_rows(snap, p).groupBy(F.col("n0").alias("node_id")).agg(F.sum("c").alias("c"))
    if _star_centre(p) == 0:
        return _star_rows(snap, p, 0)
    if rings.ring_length(p) in (2, 3):
        return _ring_rows(snap, p).groupBy(F.col("n0").alias("node_id")).agg(F.sum("c").alias("c"))
    listed = embeddings(snap, p, complexes)
    return listed.groupBy(F.col("n0").alias("node_id")).agg(F.count(F.lit(1)).alias("c"))


def constrained(
    snap: Snapshot,
    counts: DataFrame,
    include: tuple[Pattern, ...] = (),
    exclude: tuple[Pattern, ...] = (),
    complexes: DataFrame | None = None,
) -> DataFrame:
    """Matches on nodes that fit at least one ``include`` pattern and none of the ``exclude`` patterns."""
    if include:
        fits = reduce(DataFrame.unionByName, (seed_counts(snap, q, complexes).select("node_id") for q in include))
        counts = counts.join(fits, "node_id", "left_semi")
    for q in exclude:
        counts = counts.join(seed_counts(snap, q, complexes).select("node_id"), "node_id", "left_anti")
    return counts


def relation_holds(count: Column, relation: str | None, quantity: int) -> Column:
    """The match-count condition; a complex without any match never passes."""
    if relation is None:
        return count > 0
    compare = {
        "==": count == quantity,
        ">=": count >= quantity,
        "<=": count <= quantity,
        ">": count > quantity,
        "<": count < quantity,
    }
    if relation not in compare:
        raise ValueError(f"unknown relation {relation!r}")
    return (count > 0) & compare[relation]


def _family_of(p: Pattern) -> tuple | None:
    """What patterns must share to be counted in one pass: the node types, and for a pair the bonded site names."""
    if len(p.mols) == 1 and p.mols[0].slots and not p.bonds():
        return ("node", p.mols[0].type)
    if len(p.mols) == 2 and len(p.bonds()) == 1:
        ((a, sa), (b, sb)) = sorted(p.bonds()[0])
        ends = [(p.mols[i].type, p.mols[i].slots[j].name, p.mols[i].slots[j].loose) for i, j in ((a, sa), (b, sb))]
        return ("pair", *ends[0], *ends[1])
    return None


def _shared_blocks(members: list[dict[str, list[Slot]]]) -> tuple[list[Column], list[dict]]:
    """Conditional counts for several slot groups, equal conditions counted once."""
    aggs: dict[tuple, Column] = {}
    labels = []
    for groups in members:
        names = {}
        for name, slots in groups.items():
            for block in subsets(len(slots)):
                key = tuple(sorted({(slots[i].name, slots[i].loose, slots[i].state or "", "bound" if isinstance(slots[i].bond, int) else slots[i].bond) for i in block}))
                if key not in aggs:
                    aggs[key] = F.count_if(_both([slots[i] for i in block])).alias(f"f{len(aggs)}")
                names[name, block] = f"f{list(aggs).index(key)}"
        labels.append(names)
    return list(aggs.values()), labels


def _node_family(snap: Snapshot, patterns: list[Pattern]) -> DataFrame:
    """(node_id, c0, c1, …): several one-node patterns of one type from one aggregate."""
    mols = [p.mols[0] for p in patterns]
    groups = [_by_name(m.slots) for m in mols]
    aggs, labels = _shared_blocks(groups)
    per = snap.sites.filter(F.col("type") == mols[0].type).groupBy("node_id").agg(*aggs)
    return per.select("node_id", *[
        reduce(lambda a, b: a * b, (_group_factor(n, s, names) for n, s in g.items())).cast("long").alias(f"c{i}")
        for i, (g, names) in enumerate(zip(groups, labels))
    ])


def _pinned_family(snap: Snapshot, pins: list[tuple[Mol, int]]) -> DataFrame:
    """(node_id, site_idx, partner_node, partner_site, w0, w1, …): ``pinned_counts`` of several patterns at once."""
    first, at0 = pins[0]
    rests = [_by_name(m.slots[:at] + m.slots[at + 1 :]) for m, at in pins]
    aggs, labels = _shared_blocks(rests)
    name = first.slots[at0].family
    of_type = snap.sites.filter(F.col("type") == first.type)
    ends = of_type.filter(first.slots[at0].named() & F.col("partner_node").isNotNull())
    own, weights = {}, []
    for i, ((m, at), groups, names) in enumerate(zip(pins, rests, labels)):
        own[f"fits{i}"] = m.slots[at].predicate().cast("long")
        w = F.col(f"fits{i}")
        for g, slots in groups.items():
            if g != name:
                w = w * _group_factor(g, slots, names)
                continue
            # the pinned site is taken, so it leaves every block it would have counted in
            for block in subsets(len(slots)):
                own[f"own{i}_{names[g, block]}"] = _both([slots[k] for k in block]).cast("long")
            left = {b: F.col(names[g, b]) - F.col(f"own{i}_{names[g, b]}") for b in subsets(len(slots))}
            w = w * distinct_sum(tuple(range(len(slots))), left.__getitem__)
        weights.append(w.cast("long").alias(f"w{i}"))
    keep = ["node_id", "site_idx", "partner_node", "partner_site"]
    rows = ends.select(*keep, *[c.alias(n) for n, c in own.items()])
    if aggs:
        per_node = of_type.groupBy("node_id").agg(*aggs, F.count(F.lit(1)).alias("deg"))
        rows = hub_join(rows, per_node, "node_id", snap.n_sites())
    rows = rows.select(*keep, *weights)
    return rows.filter(F.greatest(*[F.col(f"w{i}") for i in range(len(pins))], F.lit(0)) > 0)


def _pair_family(snap: Snapshot, patterns: list[Pattern]) -> DataFrame:
    """(node_id, c0, c1, …): several two-node patterns over the same kind of link from one join."""
    left, right = [], []
    for p in patterns:
        ((a, sa), (b, sb)) = sorted(p.bonds()[0])
        left.append((p.mols[a], sa))
        right.append((p.mols[b], sb))
    k = len(patterns)
    near = _pinned_family(snap, left).filter("node_id <> partner_node")
    far = _pinned_family(snap, right).select(
        F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"), *[F.col(f"w{i}").alias(f"v{i}") for i in range(k)]
    )
    met = near.join(far, ["partner_node", "partner_site"])
    return met.select("node_id", *[(F.col(f"w{i}") * F.col(f"v{i}")).alias(f"c{i}") for i in range(k)])


def observe(snap: Snapshot, observables: list[Observable], complexes: DataFrame | None = None) -> DataFrame:
    """(obs, value): every observable on the snapshot, zero included.

    "Molecules" sums embeddings over nodes and patterns. "Species" counts complexes that pass each pattern's
    condition; a complex passing two patterns of one observable counts twice. Patterns that differ only in their
    conditions are counted in one pass over the sites.
    """
    spark = snap.nodes.sparkSession
    if complexes is None and any(o.kind == "Species" for o in observables):
        raise ValueError("Species observables need the complexes table")
    families: dict[tuple, list[tuple[Observable, Pattern]]] = {}
    for n, (o, p) in enumerate((o, p) for o in observables for p in o.patterns):
        families.setdefault((o.kind, *(_family_of(p) or ("alone", n))), []).append((o, p))
    parts = [spark.createDataFrame([(o.name, 0) for o in observables], "obs string, value long")]
    for (kind, shape, *_), group in families.items():
        patterns = [p for _, p in group]
        if shape == "node":
            counts = _node_family(snap, patterns)
        elif shape == "pair":
            counts = _pair_family(snap, patterns)
        else:
            counts = attributed_counts(snap, patterns[0], complexes).withColumnRenamed("c", "c0")
        cols = [f"c{i}" for i in range(len(group))]
        if kind == "Species":
            per = counts.join(complexes, "node_id").groupBy("complex_id").agg(*[F.sum(c).alias(c) for c in cols])
            row = per.agg(*[F.count_if(relation_holds(F.col(c), p.relation, p.quantity)).alias(c) for c, p in zip(cols, patterns)])
        else:
            row = counts.agg(*[F.sum(c).alias(c) for c in cols])
        cells = F.array(*[F.struct(F.lit(o.name).alias("obs"), F.col(c).alias("value")) for c, (o, _) in zip(cols, group)])
        parts.append(row.select(F.explode(cells).alias("x")).select("x.*"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("obs").agg(F.sum("value").alias("value"))


def local_values(snap: Snapshot, o: Observable, complexes: DataFrame | None = None, scope: str = "node") -> DataFrame:
    """(node_id, value): an observable at single nodes, or summed over the node's complex for scope "complex"."""
    per_node = reduce(DataFrame.unionByName, (seed_counts(snap, p, complexes) for p in o.patterns))
    per_node = per_node.groupBy("node_id").agg(F.sum("c").alias("value"))
    if scope == "node":
        return snap.nodes.select("node_id").join(per_node, "node_id", "left").select(
            "node_id", F.coalesce("value", F.lit(0)).alias("value")
        )
    whole = (
        complexes.join(per_node, "node_id", "left")
        .groupBy("complex_id")
        .agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("deg"))
    )
    return hub_join(complexes, whole, "complex_id", snap.n_sites()).select("node_id", "value")


def free_singletons(snap: Snapshot, type_name: str, states: dict[str, str]) -> DataFrame:
    """Nodes of a type that have no link at all and hold the required states."""
    sites = snap.sites.filter(F.col("type") == type_name)
    ok = [
        F.count_if((F.col("site_name") == name) & (F.col("state") == state)).alias(f"ok{i}")
        for i, (name, state) in enumerate(states.items())
    ]
    per_node = sites.groupBy("node_id").agg(F.count("partner_node").alias("links"), *ok)
    keep = reduce(lambda a, b: a & b, (F.col(f"ok{i}") > 0 for i in range(len(states))), F.col("links") == 0)
    if not states:
        bare = snap.nodes.filter(F.col("type") == type_name).select("node_id")
        return bare.join(per_node.filter("links > 0"), "node_id", "left_anti")
    return per_node.filter(keep).select("node_id")


def count_by_type(snap: Snapshot) -> DataFrame:
    return snap.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))
