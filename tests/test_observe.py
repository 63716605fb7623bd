import random

from bondwise.model import Slot, mol, observable, pattern
from bondwise.operators import match
from bondwise.operators.components import complexes_of
from tests.graphs import graph, random_graph
from tests.test_match import PATTERNS, brute


def test_families_match_single_counts(spark):
    g = random_graph(spark, random.Random(9), 9, fill=0.9)
    snap = graph(spark, *g)
    cx = complexes_of(snap)
    home = {r.node_id: r.complex_id for r in cx.collect()}
    pairs = [
        pattern(mol("A", Slot("s", None, 1), Slot("s")), mol("B", Slot("s", None, 1))),
        pattern(mol("A", Slot("s", "u", 1), Slot("s", "u"), Slot("t", "p", "free")), mol("B", Slot("s", "p", 1), Slot("s"))),
        pattern(mol("A", Slot("s", "p", 1)), mol("B", Slot("s", None, 1), Slot("t", None, "bound"))),
    ]
    nodes = [PATTERNS["sites"], pattern(mol("A", Slot("s"), Slot("s"))), pattern(mol("A", Slot("t", None, "free")))]
    every = [*pairs, *nodes, PATTERNS["one"], PATTERNS["star"], PATTERNS["free"]]
    obs = [observable(f"m{i}", "Molecules", p) for i, p in enumerate(every)]
    obs += [observable(f"s{i}", "Species", p) for i, p in enumerate(every)]
    obs.append(observable("both", "Molecules", *pairs))
    got = {r.obs: r.value for r in match.observe(snap, obs, cx).collect()}
    for i, p in enumerate(every):
        found = brute(*g, p)
        assert got[f"m{i}"] == len(found), i
        assert got[f"s{i}"] == len({home[img[0]] for img, _ in found}), i
    assert got["both"] == sum(got[f"m{i}"] for i in range(3))
