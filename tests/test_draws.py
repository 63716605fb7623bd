from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from bondwise.model import Slot, mol
from bondwise.operators import draw, scores
from tests.graphs import graph

# one node with sites of two names in different states, bound and free, and a second node of the same type
SITES = [(1, i, "s", st) for i, st in enumerate("uupqu")] + [(1, 10 + i, "t", st) for i, st in enumerate("ab")] + [(2, 0, "s", "u"), (2, 1, "t", "a"), (3, 0, "s", "u")]
LINKS = [((1, 0), (2, 0)), ((1, 11), (3, 0))]
M = mol("A", Slot("s", "u"), Slot("t"), Slot("s"), Slot("s", None, "free"))


def all_embeddings(node):
    bound = {(a, b) for link in LINKS for a, b in link}
    own = [s for s in SITES if s[0] == node]
    fits = lambda slot, s: s[2] == slot.name and slot.state in (None, s[3]) and not (slot.bond == "free" and (s[0], s[1]) in bound)
    return sorted(tuple(s[1] for s in c) for c in permutations(own, len(M.slots)) if all(fits(a, b) for a, b in zip(M.slots, c)))


def test_places_are_unranked_in_order(spark):
    snap = graph(spark, {1: "A", 2: "A", 3: "B"}, SITES, LINKS)
    want = all_embeddings(1)
    assert len(want) > 30 and all_embeddings(2) == []
    n = len(want)
    draws = spark.range(n).select(F.col("id").alias("draw_id"), F.lit(1).cast("long").alias("node_id"), ((F.col("id") + 0.5) / n).alias("u"))
    draws = draws.unionByName(spark.createDataFrame([(900, 2, 0.3), (901, 3, 0.3), (902, 77, 0.3)], "draw_id long, node_id long, u double"))
    got = {r.draw_id: (r.s0, r.s1, r.s2, r.s3) for r in draw.draw_embeddings(snap, M, draws).collect()}
    assert got == dict(enumerate(want))


def test_draws_are_uniform(spark):
    """Chi-square over all embeddings of a node from MD5 digits."""
    snap = graph(spark, {1: "A", 2: "A", 3: "B"}, SITES, LINKS)
    want, n = all_embeddings(1), 6000
    draws = spark.range(n).select(F.col("id").alias("draw_id"), F.lit(1).cast("long").alias("node_id"), draw.unit_hash(F.lit("x"), F.col("id")).alias("u"))
    seen = Counter((r.s0, r.s1, r.s2, r.s3) for r in draw.draw_embeddings(snap, M, draws).collect())
    assert set(seen) == set(want) and sum(seen.values()) == n
    expected = n / len(want)
    chi2 = sum((seen[e] - expected) ** 2 / expected for e in want)
    # mean len - 1, deviation sqrt(2 (len - 1)); five deviations
    assert chi2 < len(want) - 1 + 5 * (2 * (len(want) - 1)) ** 0.5


def test_random_parts_choose_every_replicate_alike(spark):
    sizes = spark.createDataFrame([("m", 12), ("small", 3)], "model string, reps long")
    rows = scores.random_parts(sizes, 3, 4000, 7).collect()
    assert {r.model for r in rows} == {"m"}
    by = {}
    for r in rows:
        by.setdefault(r.split, set()).add(r.rank)
    assert all(len(s) == 3 and s <= set(range(1, 13)) for s in by.values()) and len(by) == 4000
    seen = Counter(r.rank for r in rows)
    assert all(abs(seen[k] - 1000) < 5 * (4000 * 0.25 * 0.75) ** 0.5 for k in range(1, 13))
