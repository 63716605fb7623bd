import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from bondwise.model import SITE_COLS, Mol, Slot, Snapshot, mol, pattern
from bondwise.operators import rings
from tests.graphs import graph

TRIANGLE = pattern(mol("A", Slot("s", "u", 1), Slot("t", None, 3)), mol("A", Slot("s", None, 1), Slot("t", None, 2)), mol("B", Slot("s", None, 2), Slot("t", None, 3)))
SQUARE = pattern(*[mol("A", Slot("s", None, i + 1), Slot("t", None, (i + 1) % 4 + 1)) for i in range(4)])


def dense(seed, n=9, m=400):
    """Few nodes with many sites each, so that links run in parallel and rings close."""
    rng = random.Random(seed)
    nodes, sites, links = {k: "B" if k % 3 == 2 else "A" for k in range(n)}, [], []
    for _ in range(m):
        pair = []
        for k in rng.sample([0, 0, 0, *range(n)], 2):
            sites.append((k, len(sites), rng.choice("st"), rng.choice("up")))
            pair.append(sites[-1][:2])
        links.append(tuple(pair))
    return nodes, sites, links


def by_links(nodes, sites, links, p):
    """Embeddings of a ring by its images: the bonded slots of a node differ in name, so those of different bonds are different sites."""
    at, found = {s[:2]: s for s in sites}, Counter()
    w = Counter((a[0], b[0], at[a][2:], at[b][2:]) for x, y in links for a, b in ((x, y), (y, x)))
    fits = lambda slot, site: site[0] == slot.name and slot.state in (None, site[1])
    for image in permutations(nodes, len(p.mols)):
        if all(nodes[n] == m.type for n, m in zip(image, p.mols)):
            ways = 1
            for (a, i), (b, j) in p.bonds():
                near, far = p.mols[a].slots[i], p.mols[b].slots[j]
                ways *= sum(c for (u, v, x, y), c in w.items() if (u, v) == (image[a], image[b]) and fits(near, x) and fits(far, y))
            if ways:
                found[image] = ways
    return found


def with_ends(snap):
    far = snap.sites.select(F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"), F.col("type").alias("far_type"), F.col("site_name").alias("far_name"), F.col("state").alias("far_state"))
    return Snapshot(snap.nodes, snap.sites, ends=snap.sites.join(far, ["partner_node", "partner_site"]).select(*SITE_COLS, "far_type", "far_name", "far_state"))


@pytest.mark.parametrize("few, most", [(100, 1_000_000), (3, 1_000_000), (3, 0)])
def test_rings_under_every_order_of_nodes(spark, monkeypatch, few, most):
    """nodes of few neighbours are not looked up, heavy ones are broadcast or joined."""
    monkeypatch.setattr(rings, "FEW", few, raising=False)
    monkeypatch.setattr(rings, "MAX_HEAVY", most, raising=False)
    made = dense(4)
    snap, want = with_ends(graph(spark, *made)), by_links(*made, TRIANGLE)
    assert len(want) > 20
    for s in (snap, Snapshot(snap.nodes, snap.sites)):
        rows = rings.triangle_counts(s, TRIANGLE).collect()
        assert {(r.n0, r.n1, r.n2): r.c for r in rows} == want and len(rows) == len(want)
    squares = sum(by_links(*made, SQUARE).values())
    assert rings.square_counts(snap, SQUARE).agg(F.sum("c")).first()[0] == squares > 20


def test_no_ring_is_no_row(spark):
    snap = graph(spark, {0: "A", 1: "B"}, [(0, 0, "s", "u"), (1, 0, "t", "u")], [])
    assert rings.triangle_counts(snap, TRIANGLE).collect() == []


def test_known_far_ends_are_not_joined(spark):
    """where a row holds both ends of a link, weights take one shuffle and no join."""
    snap = with_ends(graph(spark, *dense(4)))
    flat = Snapshot(snap.nodes, snap.sites, ends=spark.createDataFrame(snap.ends.collect(), snap.ends.schema))
    w = lambda s: rings.link_weights(s, Mol("A", ()), Mol("B", ()), [(Slot("s", "u", 1), Slot("t", None, 1)), (Slot("s", None, 2), Slot("s", "p", 2))])
    assert "Join" not in w(flat)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, w(flat).collect())) == sorted(map(tuple, w(Snapshot(snap.nodes, snap.sites)).collect()))
