import random
from itertools import permutations, product

import pytest

from bondwise.model import Slot, Snapshot, mol, observable, pattern
from bondwise.operators import match, rings, skew
from bondwise.operators.components import complexes_of
from tests.graphs import graph, random_graph


def brute(nodes, sites, links, p, home=None):
    """All embeddings by trying every injective assignment."""
    far = {}
    for a, b in links:
        far[a], far[b] = b, a
    by_node = {n: [s for s in sites if s[0] == n] for n in nodes}

    def fits(slot, s):
        bonded = (s[0], s[1]) in far
        return (
            s[2] == slot.name
            and (slot.state is None or s[3] == slot.state)
            and not (slot.bond == "free" and bonded)
            and (slot.bond in ("any", "free") or bonded)
        )

    out = []
    for image in permutations(nodes, len(p.mols)):
        if any(nodes[n] != m.type for n, m in zip(image, p.mols)):
            continue
        if home and len({home[n] for n in image}) > 1:
            continue
        options = []
        for n, m in zip(image, p.mols):
            options.append(
                [c for c in permutations(by_node[n], len(m.slots)) if all(fits(s, x) for s, x in zip(m.slots, c))]
            )
        for choice in product(*options):
            ok = True
            for (a, sa), (b, sb) in p.bonds():
                x, y = choice[a][sa], choice[b][sb]
                ok &= far.get((x[0], x[1])) == (y[0], y[1])
            if ok:
                out.append((image, choice))
    return out


PATTERNS = {
    "one": pattern(mol("A")),
    "sites": pattern(mol("A", Slot("s"), Slot("s", "u"), Slot("t", None, "bound"))),
    "free": pattern(mol("B", Slot("s", "p", "free"), Slot("s"))),
    "pair": pattern(mol("A", Slot("s", None, 1), Slot("s")), mol("B", Slot("s", None, 1), Slot("t", "u"))),
    "twins": pattern(mol("A", Slot("s", None, 1)), mol("A", Slot("s", None, 1))),
    "star": pattern(
        mol("A", Slot("s", None, 1), Slot("s", None, 2), Slot("t", "u")),
        mol("B", Slot("s", None, 1)),
        mol("B", Slot("s", None, 2), Slot("t")),
    ),
    "leaf_seed": pattern(
        mol("B", Slot("s", None, 1)), mol("A", Slot("s", None, 1), Slot("s", None, 2)), mol("B", Slot("s", None, 2))
    ),
    "mixed": pattern(mol("A", Slot("s", None, 1), Slot("s", None, 2), Slot("t", None, 3)),
                     mol("B", Slot("s", None, 1)), mol("A", Slot("s", None, 2)), mol("B", Slot("t", None, 3))),
    "double": pattern(mol("A", Slot("s", None, 1), Slot("s", None, 2)), mol("B", Slot("s", None, 1), Slot("s", None, 2))),
    "triple": pattern(mol("A", Slot("s", "u", 1), Slot("s", None, 2), Slot("s", None, 3)), mol("B", Slot("s", None, 1), Slot("s", None, 2), Slot("s", "p", 3), Slot("t", "u"))),
    "triangle": pattern(mol("A", Slot("s", None, 1), Slot("s", None, 2), Slot("t", "u")), mol("A", Slot("s", None, 2), Slot("s", "u", 3)),
                        mol("B", Slot("s", None, 3), Slot("s", None, 1))),
    "square": pattern(mol("A", Slot("s", None, 1), Slot("s", "u", 2)), mol("B", Slot("s", None, 2), Slot("s", None, 3)),
                      mol("A", Slot("s", None, 3), Slot("s", None, 4), Slot("t")), mol("B", Slot("s", None, 4), Slot("s", None, 1))),
    "chain": pattern(
        mol("A", Slot("t", None, 1)),
        mol("B", Slot("t", None, 1), Slot("s", None, 2)),
        mol("A", Slot("s", None, 2), Slot("s", None, 3)),
        mol("B", Slot("s", None, 3)),
    ),
}


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_and_listings_match_brute_force(spark, seed):
    rng = random.Random(seed)
    g = random_graph(spark, rng, 9, fill=0.9)
    snap = graph(spark, *g)
    for name, p in PATTERNS.items():
        want = brute(*g, p)
        got = match.attributed_counts(snap, p).agg({"c": "sum"}).first()[0] or 0
        assert got == len(want), name
        listed = match.embeddings(snap, p)
        cols = [f"n{i}" for i in range(len(p.mols))]
        cols += [f"s{i}_{j}" for i, m in enumerate(p.mols) for j in range(len(m.slots))]
        rows = sorted(tuple(r) for r in listed.select(*cols).collect())
        assert rows == sorted(img + tuple(s[1] for c in ch for s in c) for img, ch in want), name
        seeds = {r.node_id: r.c for r in match.seed_counts(snap, p).collect()}
        expect = {}
        for img, _ in want:
            expect[img[0]] = expect.get(img[0], 0) + 1
        assert seeds == expect, name


def test_unbonded_parts_must_share_a_complex(spark):
    g = random_graph(spark, random.Random(5), 9, fill=0.5)
    snap = graph(spark, *g)
    cx = complexes_of(snap)
    home = {r.node_id: r.complex_id for r in cx.collect()}
    cases = [
        pattern(mol("A"), mol("B")),
        pattern(mol("A", Slot("s", "u")), mol("A", Slot("s"))),
        pattern(mol("A", Slot("s", None, 1)), mol("A", Slot("s", None, 1)), mol("B")),
        pattern(mol("A", Slot("s", None, 1)), mol("B", Slot("s", None, 1)), mol("B")),
    ]
    for p in cases:
        want = len(brute(*g, p, home))
        got = match.attributed_counts(snap, p, cx).agg({"c": "sum"}).first()[0] or 0
        assert got == want
        assert match.embeddings(snap, p, cx).count() == want


def test_hub_path_gives_the_same_counts(spark, monkeypatch):
    g = random_graph(spark, random.Random(7), 9, fill=0.9)
    snap = graph(spark, *g)
    monkeypatch.setattr(skew, "HUB_ROWS", 2)
    for name in ("sites", "pair", "star"):
        got = match.attributed_counts(snap, PATTERNS[name]).agg({"c": "sum"}).first()[0] or 0
        assert got == len(brute(*g, PATTERNS[name])), name


def test_species_and_molecules_of_a_dimer(spark):
    snap = graph(spark, {1: "A", 2: "A", 3: "A"}, [(n, 0, "s", None) for n in (1, 2, 3)], [((1, 0), (2, 0))])
    cx = complexes_of(snap)
    obs = [
        observable("mols", "Molecules", pattern(mol("A"))),
        observable("species", "Species", pattern(mol("A"))),
        observable("pairs", "Species", pattern(mol("A"), relation="==", quantity=2)),
        observable("below", "Species", pattern(mol("A"), relation="<", quantity=2)),
        observable("none", "Species", pattern(mol("Z"), relation="<=", quantity=2)),
        observable("twice", "Species", pattern(mol("A")), pattern(mol("A", Slot("s", None, "bound")))),
    ]
    got = {r.obs: r.value for r in match.observe(snap, obs, cx).collect()}
    assert got == {"mols": 3, "species": 2, "pairs": 1, "below": 1, "none": 0, "twice": 3}


def test_self_link_never_matches_two_nodes(spark):
    snap = graph(spark, {1: "A"}, [(1, 0, "s", None), (1, 1, "s", None)], [((1, 0), (1, 1))])
    p = PATTERNS["twins"]
    assert match.attributed_counts(snap, p).count() == 0 and match.embeddings(snap, p).count() == 0


def test_reacting_sites_and_constraints(spark):
    nodes = {1: "A", 2: "A", 3: "B"}
    sites = [(1, 0, "s", "u"), (1, 1, "s", "p"), (1, 2, "t", None), (2, 0, "s", "u"), (2, 1, "s", "u"), (2, 2, "t", None),
             (3, 0, "s", "u")]
    snap = graph(spark, nodes, sites, [((1, 2), (3, 0))])
    m = mol("A", Slot("s", "u"), Slot("s"))
    counts = {r.node_id: r.c for r in match.reacting_counts(snap, m, 0).collect()}
    listed = match.distinct_reacting(match.embeddings(snap, pattern(m)), [(0, 0)])
    assert counts == {1: 1, 2: 2} and listed.count() == 3
    base = match.node_counts(snap, mol("A"))
    bound = pattern(mol("A", Slot("t", None, "bound")))
    assert [r.node_id for r in match.constrained(snap, base, include=(bound,)).collect()] == [1]
    assert [r.node_id for r in match.constrained(snap, base, exclude=(bound,)).collect()] == [2]
    assert [r.node_id for r in match.free_singletons(snap, "A", {"s": "u"}).collect()] == [2]


def test_local_values(spark):
    snap = graph(spark, {1: "A", 2: "B", 3: "A"}, [(1, 0, "s", "p"), (2, 0, "s", "u"), (3, 0, "s", "u")], [((1, 0), (2, 0))])
    cx = complexes_of(snap)
    o = observable("phos", "Molecules", pattern(mol("A", Slot("s", "p"))))
    node = {r.node_id: r.value for r in match.local_values(snap, o).collect()}
    whole = {r.node_id: r.value for r in match.local_values(snap, o, cx, "complex").collect()}
    assert node == {1: 1, 2: 0, 3: 0} and whole == {1: 1, 2: 1, 3: 0}


def test_rings_among_parallel_links_match_brute_force(spark):
    """Four nodes, each linked with all others, some of them twice or three times."""
    rng, ends = random.Random(3), [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (0, 2), (0, 2), (1, 3)]
    used, links = dict.fromkeys(range(4), 0), []
    for a, b in ends:
        links.append(((a, used[a]), (b, used[b])))
        used[a], used[b] = used[a] + 1, used[b] + 1
    sites = [(n, i, "s", rng.choice("uup")) for n in used for i in range(5)] + [(n, 5, "t", "u") for n in used]
    g = ({0: "A", 1: "A", 2: "B", 3: "B"}, sites, links)
    for name in ("double", "triple", "triangle", "square"):
        want = len(brute(*g, PATTERNS[name]))
        got = match.attributed_counts(graph(spark, *g), PATTERNS[name]).agg({"c": "sum"}).first()[0] or 0
        assert got == want > 0, name


def test_parallel_links_of_a_hub_are_counted_not_paired(spark):
    """A pair with 100,000 links costs as many rows: the number of pairs would be 10^10."""
    n = 100_000
    end = lambda node, far, kind: spark.range(n).selectExpr(
        f"{node}L AS node_id", f"'{kind}' AS type", "id AS site_idx", "'s' AS site_name", "CAST(null AS string) AS state", f"{far}L AS partner_node", "id AS partner_site"
    )
    nodes = spark.createDataFrame([(1, "A"), (2, "B")], "node_id long, type string")
    snap = Snapshot(nodes, end(1, 2, "A").unionByName(end(2, 1, "B")))
    assert [tuple(r) for r in rings.pair_counts(snap, PATTERNS["double"]).collect()] == [(1, 2, n * (n - 1))]


def test_wheel_with_a_hub_joins_few_rows(spark):
    """Triangles of a hub with its rim: the hub is never the corner that open pairs start from."""
    n = 2_000
    nodes = {0: "A"} | {k: "A" for k in range(1, n + 1)}
    sites = [(0, k, "s", None) for k in range(1, n + 1)] + [(k, j, "s", None) for k in range(1, n + 1) for j in range(3)]
    links = [((0, k), (k, 0)) for k in range(1, n + 1)] + [((k, 1), (k % n + 1, 2)) for k in range(1, n + 1)]
    three = pattern(*[mol("A", Slot("s", None, k), Slot("s", None, k % 3 + 1)) for k in (1, 2, 3)])
    got = match.attributed_counts(graph(spark, nodes, sites, links), three).agg({"c": "sum"}).first()[0]
    assert got == 6 * n


def test_loose_names_fit_numbered_and_plain_sites(spark):
    """arm1 fits arm1 and arm, arm2 only arm here; slots of one family never share a site."""
    nodes = {0: "A", 1: "A", 2: "B", 3: "B"}
    sites = [(n, i, name, "u") for n in (0, 1) for i, name in enumerate(["arm", "arm1", "arm", "leg"])] + [(n, i, "arm", "u") for n in (2, 3) for i in range(2)]
    links = [((0, 0), (2, 0)), ((0, 1), (2, 1)), ((0, 2), (3, 0)), ((1, 1), (3, 1))]
    snap = graph(spark, nodes, sites, links)
    loose = lambda name, bond="any": Slot(name, None, bond, loose=True)
    one = {r.node_id: r.c for r in match.node_counts(snap, mol("A", loose("arm1"), loose("arm2"))).collect()}
    assert one == {0: 4, 1: 4} and match.embeddings(snap, pattern(mol("A", loose("arm1"), loose("arm2")))).count() == 8
    pair = pattern(mol("A", loose("arm2", 1), loose("arm1")), mol("B", Slot("arm", None, 1)))
    want = match.embeddings(snap, pair).count()
    assert match.attributed_counts(snap, pair).agg({"c": "sum"}).first()[0] == want == 4
    strict = pattern(mol("A", Slot("arm2", None, 1)), mol("B", Slot("arm", None, 1)))
    obs = [observable("loose", "Molecules", pair), observable("strict", "Molecules", strict)]
    assert {r.obs: r.value for r in match.observe(snap, obs).collect()} == {"loose": 4, "strict": 0}
    double = pattern(mol("A", loose("arm1", 1), loose("arm2", 2)), mol("B", Slot("arm", None, 1), Slot("arm", None, 2)))
    assert [tuple(r) for r in rings.pair_counts(snap, double).collect()] == [(0, 2, 1)]
    with pytest.raises(ValueError):
        mol("A", loose("arm1"), Slot("arm"))


def test_like_bonds_of_a_ring_are_weighed_once(spark, monkeypatch):
    """a square with one marked bond has two kinds of bonds, whichever way round they stand."""
    tags = []
    keep = rings.cut
    monkeypatch.setattr(rings, "cut", lambda df, tag, *more: tags.append(tag) or keep(df, tag, *more))
    links = [("P", o, q) for o in (1, 2, 3) for q in (11, 12)]
    ends = [(o, "O", q, "i", "A" if o == 1 else "N", q, o) for _, o, q in links] + [(q, "P", o, "l", None, o, q) for _, o, q in links]
    sites = spark.createDataFrame(ends, "node_id long, type string, site_idx long, site_name string, state string, partner_node long, partner_site long")
    snap = Snapshot(sites.select("node_id", "type").distinct(), sites)
    square = pattern(
        mol("O", Slot("i", "A", 1), Slot("i", None, 4)), mol("P", Slot("l", None, 1), Slot("l", None, 2)),
        mol("O", Slot("i", None, 2), Slot("i", None, 3)), mol("P", Slot("l", None, 3), Slot("l", None, 4)),
    )
    # order 1 with either other order, and the two parts in either order
    assert match.observe(snap, [observable("s", "Molecules", square)]).first().value == 4
    assert tags.count("link-weights") == tags.count("ranked-weights") == 2
