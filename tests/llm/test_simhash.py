import itertools
import random

import numpy as np
import xxhash

from bondwise.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or [words]
    hs = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(keys, linked):
    low = {k: k for k in keys}

    def top(k):
        while low[k] != k:
            k = low[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            low[y] = x
    return {k: top(k) for k in keys}


def test_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900, None), (901, " \t"), (902, "One two"), (903, "one  TWO"), (904, "a b c d " * 9000), (None, "one two"), (902, "One two")], "doc_id long, text string")
    rows = docs.unionByName(extra).collect()
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in rows if r["doc_id"] is not None}
    want = brute_groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = simhash.components(spark.createDataFrame(rows, docs.schema)).select("doc_id", simhash.hex_of("fp").alias("h"), "component_id").collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] == 902
        else:
            assert (r["h"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.components(docs.limit(0)).collect() == []


def test_lanes_are_majorities():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 254, 255, 256, 700, 70_000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert simhash.majorities(h, 5) == [simhash.majority(simhash.lane(h, k)) for k in range(5)]


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(220)} | {rng.getrandbits(64) for _ in range(40)}
    fps |= {base ^ (x << 5) for x in range(4)}
    fps = sorted(simhash._signed(x) for x in fps)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    want = brute_groups(fps, near)
    pairs = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), max_bucket=8).collect()
    assert all(near(r["a"], r["b"]) for r in pairs)
    links = {frozenset((r["a"], r["b"])) for r in pairs}
    assert brute_groups(fps, lambda a, b: frozenset((a, b)) in links) == want


def test_near_duplicates_match_exact_similarity(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, base = [], words(150)
    for _ in range(40):  # a crowd of near copies
        own = list(base)
        own[rng.randrange(150)] = "other"
        texts.append(" ".join(own))
    for n in (30, 80, 200):
        for cut_at in (0, 1, 2, 6):
            own = words(n) if cut_at == 0 else own
            texts.append(" ".join(own[cut_at:]))
    texts += ["", " ", "Same  words", "same words", texts[0].upper()]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "lone text here", "x", 0), (3, texts[3], "x", 3)], "doc_id long, text string, _id string, k1 int")
    sets = {k: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for k, t in enumerate(texts)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = sorted(set(brute_groups(range(len(texts)), alike).values()))
    for large in (1000, 1):
        got = simhash.keep_one(docs, large=large)
        assert got.columns == docs.columns
        assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want
        assert got.filter("doc_id is null").count() == 1
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_repeated_lines_do_not_part_near_duplicates(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = []
    for k in range(20):
        own, line = words(300), words(6)
        rows += [(2 * k, f"{own}\n{line}"), (2 * k + 1, own + f"\n{line}" * (20 + 4 * k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for large in (1000, 1):
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, large=large).collect()) == list(range(0, 40, 2))


def test_short_texts_just_similar_are_found(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(150):  # 4 shingles against 5, and 12 against 15: exactly 0.8
        own = words(19)
        rows += [(4 * k, " ".join(own[:8])), (4 * k + 1, " ".join(own[:9]))]
        own = words(19)
        rows += [(4 * k + 2, " ".join(own[:16])), (4 * k + 3, " ".join(own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for large in (1000, 1):
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, large=large).collect()) == list(range(0, 600, 2))


def test_crowd_of_short_texts_matches_exact_similarity(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(14)]
    texts = [" ".join(base[: rng.randint(5, 12)] + [f"v{rng.randrange(4)}" for _ in range(rng.randint(0, 3))]) for _ in range(150)]
    texts += [" ".join(base[a:b]) for a in range(5) for b in range(a + 1, 15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for k, t in enumerate(texts)}
    want = brute_groups(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for large in (1000, 0):
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, large=large).collect()) == sorted(set(want.values()))


def test_sift_leaves_just_similar_sets():
    rng = np.random.default_rng(8)
    for n_a, n_b, common in ((4, 5, 4), (22, 23, 20), (40, 40, 36), (45, 36, 36), (300, 302, 268)):
        limit = simhash.differing(0.8, 1536, 4.0, range(min(n_a, n_b), min(n_a, n_b) + 1))
        apart = []
        for _ in range(300):
            h = rng.integers(0, 2**64, n_a + n_b - common, dtype=np.uint64)
            a, b = simhash.majorities(h[:n_a], 24), simhash.majorities(h[n_a - common :], 24)
            apart.append(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)))
        assert max(apart) <= limit
        assert abs(np.mean(apart) / 1536 - simhash.unequal(n_a, n_b, common)) < 0.005
