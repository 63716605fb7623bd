import random

from bondwise.operators import components, skew
from tests.graphs import graph, random_graph


def naive(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for (a, _), (b, _) in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components(spark, monkeypatch):
    for seed, floor in ((1, 10**6), (2, 3)):
        monkeypatch.setattr(skew, "HUB_ROWS", floor)
        g = random_graph(spark, random.Random(seed), 40, fill=0.45)
        snap = graph(spark, *g)
        got = {r.node_id: r.complex_id for r in components.complexes_of(snap).collect()}
        assert got == naive(g[0], g[2])


def test_rounds_shrink(spark, monkeypatch):
    """Nodes that have met their root leave the rounds: after two of them a dense graph has few links left, not one a node."""
    rng, seen, plain = random.Random(5), [], components.cut_measured

    def counted(df, tag, *rest, **metrics):
        back, state = plain(df, tag, *rest, **metrics)
        seen.append((tag, state["n_rows"]))
        return back, state

    monkeypatch.setattr(components, "cut_measured", counted)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(1500)]
    links = spark.createDataFrame(pairs, "node_a long, node_b long")
    got = components.connected_components(spark.range(300).withColumnRenamed("id", "node_id"), links)
    assert got.filter("complex_id <> 0").count() == 0
    assert [n for tag, n in seen if tag != "inner-hooks"][2] < 100


def test_chain_of_one_thousand(spark):
    nodes = {n: "A" for n in range(300)}
    order = list(nodes)
    random.Random(3).shuffle(order)
    sites = [(n, i, "s", None) for n in nodes for i in (0, 1)]
    links = [((order[k], 1), (order[k + 1], 0)) for k in range(299)]
    snap = graph(spark, nodes, sites, links)
    cx = components.complexes_of(snap)
    assert cx.filter("complex_id <> 0").count() == 0
    assert components.complex_count(cx).first()[0] == 1
    row = components.cycle_counts(snap, cx).first()
    assert (row.n_nodes, row.n_links, row.cycles) == (300, 299, 0)


def test_sizes(spark):
    snap = graph(spark, {1: "A", 2: "B", 3: "A", 4: "A"}, [(n, 0, "s", None) for n in (1, 2, 3, 4)], [((1, 0), (2, 0))])
    cx = components.complexes_of(snap)
    assert sorted(map(tuple, components.size_distribution(cx).collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, components.type_size_distribution(snap, cx, "B").collect())) == [(0, 2), (1, 1)]
