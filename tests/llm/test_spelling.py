import random
import re
import zlib
from collections import Counter

import pytest

from bondwise.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(docs, min_length, min_count, slip):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % slip == 0 else low] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    form, met = {}, {}
    for w in n:
        found = sorted((-n[o], o) for o in n if near(w, o))
        met[w], form[w] = len(found), found[0][1] if found and -found[0][0] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], met[w], form[w], n.get(form[w]), root(w)) for w in n}


@pytest.mark.parametrize("alphabet, slip", [("ab", 5), ("abAé", 97), ("abcdefgÿ×", 3)])
def test_variants_match_all_pairs(spark, alphabet, slip):
    rng = random.Random(len(alphabet))
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(70)]
    docs = [(k, " ".join(words[min(int(rng.expovariate(0.06)), 69)] for _ in range(60))) for k in range(30)] + [(None, " ".join(words[:9])), (4, None), (5, ""), (6, "12 34 $ -")]
    docs += docs[:2]
    table = spark.createDataFrame([(*d, "w", 1, "r") for d in docs], "doc_id long, text string, word string, n int, root string")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(table, 2, 2, slip=slip).collect()}
    assert got == by_hand(docs, 2, 2, slip) and len(got) > 20


def test_long_chains_runs_and_ties(spark):
    # counts double along a chain of edits; runs of equal letters; two forms of equal count
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbb"]
    counts = {w: 3 * 2**k for k, w in enumerate(chain)} | {"zzzzzz": 4, "zzzzz": 9, "zzzzzzz": 9, "zzzzzy": 9}
    docs = [(k, f"{w} " * c) for k, (w, c) in enumerate(counts.items())]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), slip=10**12).collect()}
    assert all(got[w]["root"] == "bbbbb" for w in chain) and got["bbbbb"]["form"] is None
    assert (got["zzzzzz"]["n_near"], got["zzzzzz"]["form"], got["zzzzzz"]["form_n"]) == (3, "zzzzz", 9)
    assert (got["zzzzzy"]["n_near"], got["zzzzzy"]["form"]) == (2, None)


def test_empty_tables_and_very_long_texts(spark):
    schema = "doc_id long, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    docs = [(1, "lorem " * 300_000 + "x" * 500_000), (2, "lorum lorum lorum")]
    got = {r["word"]: (r["n"], r["form"]) for r in spelling.variants(spark.createDataFrame(docs, schema), slip=10**12).collect()}
    assert got == {"lorem": (300_000, None), "lorum": (3, "lorem")}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], schema), ratio=1)
