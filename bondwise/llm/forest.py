"""Nearest neighbours by a forest of random-projection trees with one priority queue over all trees.

Each inner node of a tree splits its vectors at the median of their projection on the difference of two of them. Trees are fitted on
at most ``SAMPLE`` distinct vectors (those with the smallest hash) and index every vector: it goes down each tree to one leaf. A
query walks all trees at once: the queue holds the branches not taken, by the smallest distance to a plane on their path, and leaves are
opened in that order until they are expected to hold ``SHARE`` of all vectors, and those of one tree hold ``LEAST``. Vectors and queries meet by leaf; each leaf gives a
query its nearest by exact distance, and the best over all leaves are the answer.

Equal vectors are one entry with the k + 1 smallest ids, which is all that ties to the smaller id can ask for. Leaves are dealt
in chunks of about ``CHUNK`` vectors, so a group in one task stays small. The trees (2^depth - 1 planes each) and the leaf counts are all that
is broadcast; their size depends on SAMPLE only.

Nulls and edges: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or with
another length than most of the sample; rows with the same id and vector are one; a query never finds its own id; with k candidates or
fewer, all are found; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.session import cut

TREES, SAMPLE, LEAF, SHARE, LEAST, CHUNK, SEED = 12, 20_000, 250, 0.66, 1000, 4096, 7


@dataclass(frozen=True)
class Forest:
    """Planes of all trees: normal[t, node], offset[t, node], nodes in heap order from 1; leaves are numbered from the left."""

    depth: int
    dim: int
    normal: np.ndarray
    offset: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` in each tree."""
        out = np.zeros((len(x), len(self.normal)), np.int64)
        for t in range(len(self.normal)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                side = (x * self.normal[t, node]).sum(1) > self.offset[t, node]
                node = 2 * node + side
            out[:, t] = node - (1 << self.depth)
        return out

    def opened(self, q: np.ndarray, held: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order in which the queue opens them, until they should hold ``share`` of all vectors."""
        trees, total = len(self.normal), held[0].sum() if len(held) else 0
        margin = (self.normal @ q) - self.offset
        queue: list[tuple[float, int, int]] = [(-np.inf, t, 1) for t in range(trees)]
        missing, seen, out = np.ones(trees), np.zeros(trees), []
        while queue:
            near, t, node = heapq.heappop(queue)
            room = -near
            while node < 1 << self.depth:
                gap = margin[t, node]
                heapq.heappush(queue, (-min(room, -abs(gap)), t, 2 * node + (gap <= 0)))
                room = min(room, abs(gap))
                node = 2 * node + (gap > 0)
            leaf = node - (1 << self.depth)
            if held[t, leaf]:
                out.append((t, leaf))
                seen[t] += held[t, leaf]
                missing[t] = 1 - seen[t] / total
                if 1 - missing.prod() >= share and seen.max() >= min(least, total):
                    break
        return out


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    depth = max(0, int(np.log2(max(1, len(sample) / leaf))))
    dim = sample.shape[1]
    normal, offset = np.zeros((trees, 1 << depth, dim)), np.zeros((trees, 1 << depth))
    rng = np.random.default_rng(seed)
    for t in range(trees):
        held = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                normal[t, node] = (a - b) / max(np.linalg.norm(a - b), 1e-300)
            else:
                normal[t, node] = rng.standard_normal(dim) / np.sqrt(dim)
            along = (sample[own] * normal[t, node]).sum(1)
            offset[t, node] = np.median(along) if len(own) else 0.0
            held[2 * node], held[2 * node + 1] = own[along <= offset[t, node]], own[along > offset[t, node]]
    return Forest(depth, dim, normal, offset)


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(h1, h2, v, ids): each distinct vector with its k + 1 smallest ids. Surplus ids are dropped before the exchange."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second half"), "v")})
    first = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.withColumn("r", first).filter(F.col("r") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float = SHARE, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query. ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    every = cut(entries(vectors, k), "vectors")
    taken = np.array([r["v"] for r in _commonest(every.orderBy("h1", "h2").limit(sample).select("v").collect())], np.float64)
    dim = taken.shape[1] if len(taken) else 1
    forest = spark.sparkContext.broadcast(fit(taken.reshape(-1, dim), trees, leaf))
    every = every.filter(F.size("v") == dim)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.value.leaves(_matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    kind = every.schema["v"].dataType.simpleString()
    placed = cut(every.mapInArrow(down, f"h1 long, h2 long, v {kind}, ids array<long>, leaves array<long>"), "leaves")
    counts = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    held = np.zeros((trees, 1 << forest.value.depth), np.int64)
    for r in counts:
        held[r["tree"], r["leaf"]] = r["n"]
    shared = spark.sparkContext.broadcast(held)

    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(is_query & F.col("vec_id").isNotNull() & valid(F.col("v")))
    asked = ids.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second half"), "v").alias("h2")).distinct()
    queries = placed.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = [forest.value.opened(q, shared.value, share, least) for q in _matrix(batch.column(2), dim)]
            at = np.repeat(np.arange(batch.num_rows), [len(o) for o in opened])
            flat = [x for o in opened for x in o]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array([t for t, _ in flat], pa.int32()), pa.array([x for _, x in flat], pa.int64())],
                ["h1", "h2", "v", "tree", "leaf"],
            )

    probes = queries.mapInArrow(walk, f"h1 long, h2 long, v {kind}, tree int, leaf long")
    # a leaf of many vectors is dealt in chunks, each of which every query of the leaf visits
    pieces = spark.createDataFrame([(int(t), int(x), int(-(-held[t, x] // chunk))) for t, x in zip(*np.nonzero(held), strict=True)] or [(0, 0, 1)], "tree int, leaf long, pieces long")
    spread = placed.select("v", "ids", "h1", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(pieces), ["tree", "leaf"])
    index = spread.select("tree", "leaf", F.pmod("h1", "pieces").alias("part"), "v", "ids")
    visits = probes.join(F.broadcast(pieces), ["tree", "leaf"]).select("tree", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("part"), "h1", "h2", "v")

    def nearest(there: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if there.num_rows and asking.num_rows:
            x, names = _matrix(there.column("v"), dim), there.column("ids").to_pylist()
            lowest = np.array([n[0] for n in names])
            for h1, h2, q in zip(asking.column("h1").to_pylist(), asking.column("h2").to_pylist(), _matrix(asking.column("v"), dim), strict=True):
                d = np.sqrt(((x - q) ** 2).sum(1))
                if len(d) > k + 1:
                    some = np.flatnonzero(d <= np.partition(d, k)[k])
                    some = some[np.lexsort((lowest[some], d[some]))][: k + 1]
                else:
                    some = np.arange(len(d))
                best = sorted((float(d[i]), n) for i in some for n in names[i])[: k + 1]
                out += [(h1, h2, n, s) for s, n in best]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()], strict=True)], names=["h1", "h2", "vec_id", "score"])

    keys = ["tree", "leaf", "part"]
    met = index.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(nearest, "h1 long, h2 long, vec_id long, score double")
    once = met.groupBy("h1", "h2", "vec_id").agg(F.min("score").alias("score"))
    near = once.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    pairs = asked.join(near, ["h1", "h2"]).filter("query_id <> vec_id")
    order = F.row_number().over(W.partitionBy("query_id", "h1", "h2").orderBy("score", "vec_id"))
    return pairs.select("query_id", order.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _commonest(rows: list) -> list:
    """The rows whose vectors have the commonest length, the smaller one at a tie."""
    sizes = Counter(len(r["v"]) for r in rows)
    best = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    return [r for r in rows if len(r["v"]) == best]
