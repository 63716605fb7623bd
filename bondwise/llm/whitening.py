"""Embedding whitening by contour integration.

An entry c becomes the integer floor(64 * c) + 1000000. The fit list holds each distinct integer vector once; its count, sums and centred
second moments are summed over partitions. The leading eigenpairs of the covariance V are found by spectrum slicing:

1. inertia counts (signs of the pivots of the tridiagonal form of V - s) tell how many eigenvalues lie below any shift s; bisection by them cuts
   the upper end of the spectrum into intervals of at most ``WIDTH`` eigenvalues whose ends keep clear of every eigenvalue;
2. each interval is one row of a DataFrame and solved by itself: a circle around it is integrated by quadrature, that is, shifted systems
   (z - V) Q = Y are solved at complex points z, which projects Y on the eigenvectors inside; Rayleigh-Ritz extracts them, and both steps repeat
   until residuals are at rounding level;
3. the number found in each interval must equal its inertia count, or the fit fails.

What is broadcast or sent to the driver is V and the eigenvectors: d x d numbers for vectors of d entries, at most ``MAX_DIM`` squared.

Nulls and edges: rows whose vector is null or empty or holds null or non-finite entries take no part, nor do rows of another length than most
(ties: the shorter). Entries beyond 2^53 in size count as 2^53. Repeated rows are one entry of the fit list and all get results; null vec_ids are kept.
Components of no variance (eigenvalue at rounding level) cannot be scaled to 1 and are left out, so equal vectors give no rows. The sign of a component
makes its largest entry positive. ``deviation`` is null beyond the range of a long. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.session import cut

COMPONENTS, WIDTH, NODES, MAX_DIM, ROUNDS = 16, 8, 8, 4096, 40
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0**53
SPLITS = (0.5, 0.43, 0.57, 0.36, 0.64, 0.29, 0.71)


@dataclass(frozen=True)
class Whitening:
    """Exact count and sums of the fit list, leading eigenvalues (falling) and unit eigenvectors as rows."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): rows that take part, each with its integer vector."""
    v = F.col(f"`{vector}`").cast("array<double>")
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    sound = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd)).select(F.col(f"`{key}`").alias(key), v.alias("v"))
    length = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first()["d"]
    bounded = lambda e: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(e * SCALE).cast("double")))
    x = F.transform("v", lambda e: F.when(F.abs(e) < LARGEST / SCALE, F.floor(e * SCALE)).otherwise(bounded(F.signum(e) * LARGEST).cast("long")) + SHIFT)
    return sound.filter(F.size("v") == F.lit(length)).select(key, x.alias("x"))


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column(column)
            yield batch, x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sums_of(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Exact count and sums per dimension; halves of the numbers are added apart, so that no partial sum overflows."""

    def part(batches):
        n, high, low = 0, None, None
        for _, x in _batches(batches, "x"):
            n += len(x)
            h, w = (x >> 26).sum(0).astype(object), (x & ((1 << 26) - 1)).sum(0).astype(object)
            high, low = (h, w) if high is None else (high + h, low + w)
        if n:
            sums = [str(int(h) * (1 << 26) + int(w)) for h, w in zip(high, low)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "n": pa.array([n] * len(sums), pa.int64()), "s": pa.array(sums, pa.string())})

    parts = fit_list.select("x").mapInArrow(part, "i int, n long, s string")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off in integers, so large means cost no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def _matrix_of(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of partial matrices that come as rows (i, values)."""
    each = parts.select("i", F.posexplode("values").alias("j", "value"))
    rows = each.groupBy("i", "j").agg(F.sum("value").alias("value")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("row"))
    out = np.zeros((size, size))
    for r in rows.select("i", F.col("row.value").alias("row")).toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def covariance(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list, divisor n, centred before multiplying."""

    def part(batches):
        total = None
        for _, x in _batches(batches, "x"):
            z = _centred(x, n, sums)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "values": pa.array(list(total), pa.list_(pa.float64()))})

    v = _matrix_of(fit_list.select("x").mapInArrow(part, "i int, values array<double>"), len(sums)) / n
    return (v + v.T) / 2


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by Householder reflections."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u[0] += np.copysign(size, u[0])
        u /= np.linalg.norm(u)
        p = a[k + 1 :, k + 1 :] @ u
        p -= u * (u @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1, k], a[k + 2 :, k] = -np.copysign(size, a[k + 1, k]), 0
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues lie below ``shift``: the negative pivots of the shifted matrix."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    below, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        below += pivot < 0
    return int(below)


def intervals(tri: tuple[np.ndarray, np.ndarray], floor: float, top: float, wanted: int, width: int = WIDTH) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the upper end of the spectrum down, until ``wanted`` are covered.

    An interval is cut at a point that no eigenvalue comes near; one that cannot be cut so stays whole, whatever it holds.
    """
    below = lambda s: inertia(tri, s)
    out, todo, found = [], [(floor, top, below(floor), below(top))], 0
    while todo and found < wanted:
        low, high, n_low, n_high = todo.pop()
        n = n_high - n_low
        if n == 0:
            continue
        if n > width and high - low > 1e-9 * top:
            gap = 1e-4 * (high - low)
            for at in (low + share * (high - low) for share in SPLITS):
                middle = below(at)
                if below(at - gap) == below(at + gap):
                    todo += [(low, at, n_low, middle), (at, high, middle, n_high)]
                    break
            else:
                out.append((low, high, n))
                found += n
            continue
        out.append((low, high, n))
        found += n
    return out


def solve_interval(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``v`` between low and high (rising) and their unit eigenvectors as columns."""
    d = len(v)
    scale, centre, radius = np.abs(v).sum(1).max(), (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    y = np.random.default_rng(5).standard_normal((d, min(d, 2 * count + 4)))
    values, vectors = np.zeros(0), np.zeros((d, 0))
    for _ in range(rounds):
        q = np.zeros_like(y)
        # the lower half of the circle mirrors the upper one, so twice the real part stands for both
        for w, t in zip(weights, turn):
            z = centre + radius * t
            q += w / 2 * (radius * t * np.linalg.solve(z * np.eye(d) - v, y.astype(complex))).real
        q, _ = np.linalg.qr(q)
        ritz, mixed = np.linalg.eigh(q.T @ v @ q)
        y = q @ mixed
        inside = (ritz > low) & (ritz <= high)
        values, vectors = ritz[inside], y[:, inside]
        wrong = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        if len(values) == count and (wrong <= 50 * d * np.finfo(float).eps * scale).all():
            break
    return values, vectors


def eigenpairs(spark, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding level, falling, and their eigenvectors as rows. One task solves one interval."""
    d = len(v)
    size = np.abs(v).sum(1).max()
    floor, top = float(4 * d * np.finfo(float).eps * size), float(1.01 * size)
    tri = tridiagonal(v)
    wanted = min(wanted, d - inertia(tri, floor)) if size > 0 else 0
    if wanted == 0:
        return np.zeros(0), np.zeros((0, d))
    slices = intervals(tri, floor, top, wanted)
    shared = spark.sparkContext.broadcast(v)

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "count"))):
                values, vectors = solve_interval(shared.value, low, high, count)
                found = {"low": [low] * len(values), "value": list(values), "vector": list(vectors.T)}
                yield pa.RecordBatch.from_arrays([pa.array(found["low"], pa.float64()), pa.array(found["value"], pa.float64()), pa.array(found["vector"], pa.list_(pa.float64()))], names=["low", "value", "vector"])

    rows = spark.createDataFrame(slices, "low double, high double, count int").repartition(len(slices), "low")
    got = rows.mapInArrow(solve, "low double, value double, vector array<double>").collect()
    for low, high, count in slices:
        found = sum(r["low"] == low for r in got)
        if found != count:
            raise ArithmeticError(f"{found} eigenvalues found between {low} and {high}, inertia counts tell {count}")
    got.sort(key=lambda r: -r["value"])
    vectors = np.array([r["vector"] for r in got[:wanted]])
    largest = vectors[np.arange(wanted), np.abs(vectors).argmax(1)]
    return np.array([r["value"] for r in got[:wanted]]), vectors * np.sign(largest)[:, None]


def fit(fit_list: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Fit on a list of distinct integer vectors; None when it is empty."""
    n, sums = sums_of(fit_list)
    if n == 0:
        return None
    if len(sums) > MAX_DIM:
        raise ValueError(f"vectors of {len(sums)} entries; at most {MAX_DIM} can be whitened")
    v = covariance(fit_list, n, sums)
    values, vectors = eigenpairs(fit_list.sparkSession, v, wanted)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(v)))


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    return _centred(x, model.n, list(model.sums)) @ model.vectors.T / np.sqrt(model.values)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured on the data."""
    k = len(model.values)
    if k == 0:
        return 0.0

    def part(batches):
        total = np.zeros((k + 1, k + 1))
        for _, x in _batches(batches, "x"):
            w = np.hstack([_projected(model, x), np.ones((len(x), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k + 1), pa.int32()), "values": pa.array(list(total), pa.list_(pa.float64()))})

    moments = _matrix_of(fit_list.select("x").mapInArrow(part, "i int, values array<double>"), k + 1) / model.n
    mean = moments[k, :k]
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, in machine integers where they hold it."""
    reach = max(abs(float(n) * float(x.max())), abs(float(n) * float(x.min()))) + max(abs(float(s)) for s in sums)
    if reach < 2.0**62:
        t = n * x - np.array(sums, np.int64)
        if x.shape[1] * float(np.abs(t).max()) ** 2 < 2.0**62:
            return (t * t).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, deviation, whitened, explained): one row per integer vector and component."""
    k = len(model.values)
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, deviation long, whitened double, explained double"

    def each(batches):
        for batch, x in _batches(batches, "x"):
            whitened = _projected(model, x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(whitened.ravel()), pa.array(np.tile(model.values / model.trace, len(x))),
                ],
                names=[key, "component", "deviation", "whitened", "explained"],
            )

    return rows.select(key, "x").mapInArrow(each, schema)


def whitened_table(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten all of them, with the measured identity error."""
    placed = cut(integers(rows, vector, key), "integer-vectors")
    fit_list = cut(placed.select("x").distinct(), "fit-list")
    model = fit(fit_list, components)
    kind = placed.schema[key].dataType.simpleString()
    if model is None or len(model.values) == 0:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit_list, model)
    found = whiten(placed, model, key)
    return found.select(key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
