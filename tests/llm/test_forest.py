import numpy as np
from pyspark.sql import functions as F

from bondwise.llm import forest

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    """Exact answers over (id, vector), ids and vectors distinct pairs."""
    out = {}
    for q, v in queries:
        found = {(float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in rows if i != q}
        out[q] = sorted(found)[:k]
    return out


def test_recall_and_scores_on_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    got = forest.search(table, F.col("vec_id") % 20 == 0, leaf=50).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert set(got.query_id) == set(want)
    hits = 0
    by_id = dict(rows)
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11))
        assert list(zip(part.score, part.vec_id)) == sorted(zip(part.score, part.vec_id))
        exact = [np.sqrt(((np.array(by_id[q], float) - np.array(by_id[v], float)) ** 2).sum()) for v in part.vec_id]
        assert np.allclose(part.score, exact, rtol=0, atol=1e-12)
        hits += len({v for _, v in want[q]} & set(part.vec_id))
    assert hits / (10 * len(want)) >= 0.9


def test_ties_copies_and_invalid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [0.0, 0.0]), (902, [1.0, None]), (903, [nan, 1.0]), (904, [inf, 1.0]), (905, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (906, [])]
    good = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(1, 30)] + [(3, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, v string, rank int")
    got = forest.search(table, F.col("vec_id") % 10 == 0, leaf=5, trees=3, chunk=7, share=1.0).collect()
    rows = list({(i, tuple(v)) for i, v in good})
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 10)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert found == want
    few = table.filter("vec_id in (0, 1, 2)")
    assert sorted((r["query_id"], r["vec_id"]) for r in forest.search(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]
    assert forest.search(table.limit(0), F.col("vec_id") == 0).collect() == []
