"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Two fingerprints that differ in at most
``radius`` bits agree on one of radius + 1 blocks of their bits at least; fingerprints meet by block and are verified by their
Hamming distance. A block value that more than ``max_bucket`` fingerprints share is split again: within it the free bits are cut
into radius + 1 blocks, and so on, until buckets are small or at most ``radius`` free bits are left, when all members link to the
smallest. So no bucket pairs all its members, however many there are, and no link is lost.

Equal fingerprints are one node with the smallest doc_id; components of the links are found by star contraction.

``near_duplicates`` is for similarities that few differing bits cannot express (0.8 on five-word shingles differ in 10 of 64 bits
on average). It takes ``lanes`` fingerprints of 64 bits and blocks of ``block_bits`` over all of them, sifts pairs that share a block
by Hamming distance, and verifies each by the exact Jaccard similarity of the shingle sets. The sift leaves what a pair of just that similarity
may differ in, with ties of even shingle counts, plus ``SIFT_SIGMA`` deviations. Texts of fewer than ``SHORT`` shingles, whose bits say less, do
not depend on blocks: they also meet by shingle. Two sets of n shingles or more that are alike share one of the first n - ceil(similarity * n) + 1
of each in any common order.

Nulls and edges: a text that is null, empty or white space has fingerprint 0 and links like any other; a text with fewer words than a shingle is
one shingle; null doc_ids get a component but never name one (it is null if no member has an id); repeated rows share a fingerprint; an
empty table gives no rows; other columns are ignored (``components``) or pass through (``near_duplicates``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.operators.components import connected_components
from bondwise.session import cut, cut_measured

RADIUS, SHINGLE, SEED, MAX_BUCKET = 2, 3, 42, 1000
LANES, BLOCK_BITS, SIMILARITY, SIFT_SIGMA, LARGE = 24, 16, 0.8, 4.0, 4
SHORT, SHORT_SIGMA = 32, 6.0

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SHORT = 512


def shingle_hashes(data: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words, joined by blanks. Bytes lower-case A-Z and split at ASCII white space alone."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*[words[i:] for i in range(width)], strict=False) if len(words) > width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(run), seed) for run in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of one lane of hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < _SHORT:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """Lane 0 is the hash itself, the others are mixed from it."""
    if not k:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def majorities(hashes: np.ndarray, lanes: int) -> list[int]:
    """The fingerprint of each lane. Bits are added eight at a time, one byte each, over runs of 255 hashes, so no byte overflows."""
    n, run = len(hashes), 255
    ones = np.zeros((lanes, 8, 8), np.int64)
    for at in range(0, n, run * 256):
        part = hashes[at : at + run * 256]
        runs = -(-len(part) // run)
        x = np.zeros((lanes, runs * run), np.uint64)
        for k in range(lanes):
            x[k, : len(part)] = lane(part, k)
        x = x.reshape(lanes, runs, run)
        for j in range(8):
            sums = ((x >> np.uint64(j)) & np.uint64(0x0101010101010101)).sum(2)
            ones[:, :, j] += sums.astype("<u8").view(np.uint8).reshape(lanes, runs, 8).sum(1, dtype=np.int64)
    return np.packbits(2 * ones.reshape(lanes, 64) > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [_signed(majority(shingle_hashes((v.as_py() or "").encode(), shingle, seed))) for v in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _cuts(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bits in ``parts`` runs of nearly equal length, without empty ones."""
    edge = [len(free) * k // parts for k in range(parts + 1)]
    return [free[a:b] for a, b in zip(edge, edge[1:], strict=False) if b > a]


def _masked(rows: DataFrame, paths: list[tuple[int, int, list[int], list[int]]]) -> DataFrame:
    """Each row once per path below its own: (path, key, fp). ``paths``: (parent, path, fixed bits, free bits)."""
    kinds = "parent int, path int, mask long"
    mask = [(parent, path, _signed(sum(1 << b for b in fixed))) for parent, path, fixed, _ in paths]
    table = rows.sparkSession.createDataFrame(mask, kinds)
    return rows.join(F.broadcast(table), rows["path"] == table["parent"]).select(table["path"], F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _meet(max_bucket: int, radius: int, done: frozenset):
    """Over rows sorted by (path, key): the close pairs of small buckets, and the rows of large ones, which come out as (path, fp, null).
    Members of a bucket on a path in ``done`` are all close; each is linked to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[int] = []
        over = False
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1 and not over:
                x = np.unique(np.array(held, np.int64)).view(np.uint64)
                for k in range(len(x) - 1):
                    other = x[k + 1 :]
                    near = other[np.bitwise_count(other ^ x[k]) <= radius]
                    out.extend((None, _signed(int(x[k])), _signed(int(y))) for y in near)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int64()], strict=True)], ["path", "a", "b"])

        for batch in batches:
            for path, key, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, key) != at:
                    close()
                    at, held, over = (path, key), [], False
                if path in done:
                    if held:
                        out.append((None, held[0], fp))
                    else:
                        held, over = [fp], True
                elif over:
                    out.append((path, fp, None))
                else:
                    held.append(fp)
                    if len(held) > max_bucket:
                        out.extend((path, x, None) for x in held)
                        held, over = [], True
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    return run


def close_pairs(fps: DataFrame, radius: int = RADIUS, bits: int = 64, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits.

    Pairs are complete but where at most ``radius`` bits of a bucket are free; there every member is linked to one. A pair may come
    more than once. A task holds one bucket of ``max_bucket`` fingerprints at most.
    """
    paths = [(0, k + 1, part, sorted(set(range(bits)) - set(part))) for k, part in enumerate(_cuts(list(range(bits)), radius + 1))]
    rows = _masked(fps.select(F.lit(0).alias("path"), "fp"), paths)
    found: DataFrame | None = None
    while True:
        done = frozenset(path for _, path, _, free in paths if len(free) <= radius)
        sorted_rows = rows.repartition("path", "key").sortWithinPartitions("path", "key")
        met, seen = cut_measured(sorted_rows.mapInArrow(_meet(max_bucket, radius, done), "path int, a long, b long"), "close-pairs", large=F.count("path"))
        pairs = met.filter("path is null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        deeper, number = [], 0
        for _, path, fixed, free in paths:
            if path not in done:
                for part in _cuts(free, radius + 1):
                    number += 1
                    deeper.append((path, number, fixed + part, [b for b in free if b not in part]))
        if not seen["large"]:
            return found
        paths = deeper
        rows = _masked(met.filter("path is not null").select("path", F.col("a").alias("fp")), paths)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one input split, about a million at a time, as (node, smallest node it is linked with): what a task can settle by itself."""
    parts: list[np.ndarray] = []

    def settle() -> pa.RecordBatch:
        ends = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        names, at = np.unique(ends, return_inverse=True)
        at = at.reshape(-1, 2)
        low = np.arange(len(names))
        while True:
            new = low.copy()
            np.minimum.at(new, at[:, 0], low[at[:, 1]])
            np.minimum.at(new, at[:, 1], low[at[:, 0]])
            new = new[new]
            if (new == low).all():
                break
            low = new
        own = low != np.arange(len(names))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[low[own]])], ["node_a", "node_b"])

    for batch in batches:
        parts.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
        if sum(map(len, parts)) >= 1_000_000:
            yield settle()
    yield settle()


def grouped(links: DataFrame) -> DataFrame:
    """(node_id, complex_id) for every node that has a link; ``links`` (node_a, node_b) is a written table."""
    few = links.mapInArrow(_forest, "node_a long, node_b long")
    few = cut(few, "forest")
    nodes = few.select(F.explode(F.array("node_a", "node_b")).alias("node_id")).distinct()
    return connected_components(nodes, few)


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = cut(fingerprints(docs, shingle, seed), "fingerprints")
    # equal fingerprints meet here already, so that a group of copies is one row from now on
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    pairs = close_pairs(nodes, radius, 64, max_bucket)
    groups = grouped(pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))).withColumnRenamed("node_id", "fp")
    # only linked fingerprints take part in naming components; the others name themselves
    linked = cut(groups.join(nodes, "fp"), "linked")
    lowest = linked.groupBy("complex_id").agg(F.min("low").alias("lowest"))
    label = linked.join(lowest, "complex_id").select("fp", "lowest")
    own = nodes.join(label, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    return rows.join(own, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2): each row with a 128-bit hash of its id and text. The row's own columns are kept apart, so no name can clash."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit("second half"), doc, text).alias("k2"))


PROFILE = "k1 long, k2 long, doc_id long, _id long, _n int, _s array<long>, _w array<long>"


def _first_shingles(hashes: np.ndarray, similarity: float) -> list[int]:
    """Of a text that is short, or as long as one alike to a short one can be: the shingles of which any text alike to it has one among its own.
    They are negative, so as not to be taken for blocks."""
    n = len(hashes)
    if n * similarity >= SHORT:
        return []
    return [_signed(int(h) | (1 << 63)) for h in hashes[: n - math.ceil(similarity * n - 1e-9) + 1]]


def _profiles(docs: DataFrame, shingle: int, lanes: int, similarity: float) -> DataFrame:
    """Per row ``_id`` (a hash of the lower-cased words), ``_n`` (its number of shingles), ``_s`` (the shingles by which it meets others, if it
    is short) and ``_w`` (a fingerprint of 64 bits in each lane). A shingle counts once, as in the similarity, however often it stands in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, firsts, wide = [], [], [], []
            for value in batch.column(3):
                data = (value.as_py() or "").encode()
                h = np.unique(shingle_hashes(data, shingle))
                ids.append(_signed(xxhash.xxh64_intdigest(b" ".join(data.lower().split()), SEED)))
                counts.append(len(h))
                firsts.append(_first_shingles(h, similarity))
                wide.append([_signed(x) for x in majorities(h, lanes)])
            new = [pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + new, [x.split()[0] for x in PROFILE.split(", ")])

    own = _keyed(docs).select("k1", "k2", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return own.mapInArrow(run, PROFILE)


def _binomial(n: int) -> np.ndarray:
    return np.array([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(n + 1)])


def unequal(n_a: int, n_b: int, common: int) -> float:
    """The probability that a fingerprint bit differs between sets of ``n_a`` and ``n_b`` shingles with ``common`` in both. Ties give 0."""
    ones = np.arange(common + 1)

    def is_set(n: int) -> np.ndarray:
        least = np.append(np.cumsum(_binomial(n - common)[::-1])[::-1], 0.0)
        return least[np.clip(n // 2 + 1 - ones, 0, n - common + 1)]

    a, b = is_set(n_a), is_set(n_b)
    return float(_binomial(common) @ (a * (1 - b) + b * (1 - a)))


def differing(similarity: float, bits: int, sigma: float, sizes: range) -> int:
    """Bits in which a pair that is just similar differs, plus ``sigma`` deviations: the most for any smaller set of ``sizes``."""
    p = 0.0
    for small in sizes:
        for large in range(small, math.floor(small / similarity + 1e-9) + 1):
            common = math.ceil(similarity * (small + large) / (1 + similarity) - 1e-9)
            if common <= small:
                p = max(p, unequal(small, large, common))
    return math.ceil(bits * p + sigma * math.sqrt(bits * p * (1 - p)))


def _may_be_alike(similarity: float, columns: list[tuple]):
    """Whether a pair can be similar by its shingle counts and by the bits of some lanes. The more shingles, the fewer bits differ, but for ties
    of even counts, so that the limit of ``SHORT`` to four times that holds for all that are longer."""
    low, high = F.least("_na", "_nb"), F.greatest("_na", "_nb")
    short = differing(similarity, 64 * len(columns), SHORT_SIGMA, range(1, SHORT))
    long = differing(similarity, 64 * len(columns), SIFT_SIGMA, range(SHORT, 4 * SHORT))
    return (low >= F.lit(similarity) * high) & (_bits_apart(columns) <= F.when(low < SHORT, short).otherwise(long))


def _block_rows(nodes: DataFrame, block_bits: int, *also: str) -> DataFrame:
    """One row per text and block: ``key`` holds the block's place and its bits; and one per shingle by which a short text meets others."""
    per, mask = 64 // block_bits, (1 << block_bits) - 1
    lanes = nodes.select("_id", *also, F.posexplode("_w").alias("_k", "_lane"))
    place = lambda j: F.shiftleft((F.col("_k") * per + j).cast("long"), block_bits)
    keys = [place(j).bitwiseOR(F.shiftrightunsigned("_lane", block_bits * j).bitwiseAND(F.lit(mask))) for j in range(per)]
    return lanes.select("_id", *also, F.explode(F.array(*keys)).alias("key")).unionByName(nodes.select("_id", *also, F.explode("_s").alias("key")))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(f"{c}{s}") for c in df.columns if c != "key"])


def _bits_apart(columns: list[tuple]):
    out = F.lit(0)
    for a, b in columns:
        out = out + F.bit_count(a.bitwiseXOR(b))
    return out


def _candidates(nodes: DataFrame, similarity: float, lanes: int, block_bits: int, large: int, verify) -> DataFrame:
    """Verified links (node_a, node_b) between texts that share a block, or one of the shingles of short texts.

    In ordinary buckets all members meet and are sifted by two lanes. Crowded ones hold more than ``large`` members above four times what chance
    puts there; in them every member first meets the smallest, and then members of different components meet, but for two of the component that the
    bucket holds most. They are sifted by all lanes, so a crowd of texts that are alike, but not enough, is told apart before pairs are written.
    """
    two = lambda df: df.withColumns({"_p0": F.get("_w", F.lit(0)), "_p1": F.get("_w", F.lit(1))})
    rows = _block_rows(two(nodes), block_bits, "_n", "_p0", "_p1")
    few = _may_be_alike(similarity, [(F.col("_p0a"), F.col("_p0b")), (F.col("_p1a"), F.col("_p1b"))])
    ids = [F.least("_ida", "_idb").alias("node_a"), F.greatest("_ida", "_idb").alias("node_b")]
    chance = F.broadcast(nodes.agg((F.count(F.lit(1)) * (4.0 / (1 << block_bits)) + large).alias("chance")))
    sizes = _block_rows(nodes, block_bits).groupBy("key").agg(F.count(F.lit(1)).alias("n")).crossJoin(chance)
    big, seen = cut_measured(sizes.filter("n > chance").select("key"), "crowded-blocks")
    small = rows.join(big, "key", "left_anti") if seen["n_rows"] else rows
    pairs = _side(small, "a").join(_side(small, "b"), "key").filter((F.col("_ida") < F.col("_idb")) & few).select(*ids)
    if not seen["n_rows"]:
        return verify(pairs.distinct())
    hot = _block_rows(nodes, block_bits).join(big, "key", "left_semi").join(nodes.select("_id", "_n", "_w"), "_id")
    hot = cut(hot.select("key", "_id", "_n", *[F.get("_w", F.lit(k)).alias(f"_w{k}") for k in range(lanes)]), "crowded-rows")
    near = _may_be_alike(similarity, [(F.col(f"_w{k}a"), F.col(f"_w{k}b")) for k in range(lanes)])
    first = hot.groupBy("key").agg(F.min(F.struct("_id", "_n", *[f"_w{k}" for k in range(lanes)])).alias("f")).select("key", "f.*")
    stars = _side(first, "a").join(_side(hot, "b"), "key").filter((F.col("_ida") < F.col("_idb")) & near).select(*ids)
    links = cut(verify(pairs.unionByName(stars).distinct()), "links")
    placed = hot.join(grouped(links).withColumnRenamed("node_id", "_id"), "_id", "left").withColumn("_c", F.coalesce("complex_id", "_id")).drop("complex_id")
    placed = cut(placed, "crowded-components")
    held = placed.groupBy("key", "_c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("_c", F.struct("n", "_c")).alias("main"))
    told = placed.join(held, "key").withColumn("_main", F.col("_c") == F.col("main")).drop("main")
    apart = (F.col("_ca") != F.col("_cb")) & (F.col("_mainb") | (F.col("_ida") < F.col("_idb")))
    cross = _side(told.filter("not _main"), "a").join(_side(told, "b"), "key").filter(apart & near).select(*ids).distinct()
    return links.unionByName(verify(cross))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, lanes: int = LANES, block_bits: int = BLOCK_BITS, large: int = LARGE) -> DataFrame:
    """(k1, k2, doc_id, _id, group_id) of every row: rows with the same words share ``_id``, rows linked by ``similarity`` or more share
    ``group_id``; k1 and k2 name the row, as in ``_keyed``."""
    rows = cut(_profiles(docs, shingle, lanes, similarity), "profiles")
    own = [F.first(c).alias(c) for c in ("_n", "_s", "_w")]
    nodes = cut(rows.groupBy("_id").agg(F.min(F.struct("k1", "k2")).alias("k"), *own), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "candidates")
        asked = pairs.select(F.explode(F.array("node_a", "node_b")).alias("_id")).distinct()
        keys = nodes.join(asked, "_id", "left_semi").select("_id", "k.k1", "k.k2")
        texts = _keyed(docs.select("doc_id", "text")).join(keys, ["k1", "k2"]).select("_id", F.col("row.text").cast("string").alias("text"))
        sets = cut(texts.dropDuplicates(["_id"]).mapInArrow(_shingle_sets(shingle), "_id long, held array<long>"), "shingle-sets")
        side = lambda s: sets.select(F.col("_id").alias(f"node_{s}"), F.col("held").alias(f"held_{s}"), F.size("held").alias(f"n_{s}"))
        both = pairs.join(side("a"), "node_a").join(side("b"), "node_b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
        common = F.size(F.array_intersect("held_a", "held_b"))
        return both.withColumn("common", common).filter(F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("node_a", "node_b")

    links = cut(_candidates(nodes, similarity, lanes, block_bits, large, verify), "links")
    groups = grouped(links)
    named = rows.select("k1", "k2", "doc_id", "_id").join(groups.withColumnRenamed("node_id", "_id"), "_id", "left")
    return named.select("k1", "k2", "doc_id", "_id", F.coalesce("complex_id", "_id").alias("group_id"))


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((t.as_py() or "").encode(), shingle)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "held"])

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, null last."""
    named = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")
    stay = named.groupBy("group_id").agg(F.min(order).alias("best")).select("best.k1", "best.k2")
    kept = _keyed(docs).join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select("row.*")
