"""Small hand-made site graphs for tests."""

from bondwise.model import NODE, SITE, Snapshot


def graph(spark, nodes, sites, links):
    """nodes {id: type}; sites [(node, idx, name, state)]; links [((node, idx), (node, idx))]."""
    far = {}
    for a, b in links:
        far[a], far[b] = b, a
    rows = [(n, nodes[n], i, name, state, *far.get((n, i), (None, None))) for n, i, name, state in sites]
    return Snapshot(
        spark.createDataFrame(sorted(nodes.items()), NODE),
        spark.createDataFrame(rows, SITE),
    )


def random_graph(spark, rng, n_nodes=8, types=("A", "B"), names=("s", "s", "t"), states=("u", "p"), fill=0.7):
    nodes = {n: rng.choice(types) for n in range(n_nodes)}
    sites = [(n, i, names[i], rng.choice(states)) for n in nodes for i in range(len(names))]
    ends = [(n, i) for n, i, _, _ in sites]
    rng.shuffle(ends)
    take = int(len(ends) * fill) // 2
    links = [(ends[2 * k], ends[2 * k + 1]) for k in range(take)]
    return nodes, sites, links
