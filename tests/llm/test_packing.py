from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from bondwise.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def checked(rows, texts, window):
    """Every id of every document lies in one piece; sequences are gapless; padding is none."""
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts)
    for doc, text in texts.items():
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        got = [i for r in sorted(by_doc[doc], key=lambda r: r["start"]) for i in r["ids"]]
        assert got == want and {r["doc_tokens"] for r in by_doc[doc]} == {len(want)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] == len(r["ids"]) > 0
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)


def test_round_trip_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, queries.vocabulary()).collect()
    checked(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)


def test_edges_and_small_windows(spark):
    texts = {1: None, 2: "", 3: "a  b \n c\n\n  d ", 4: " x", 5: "x " * 3000, 6: "é" * 5000, 7: "tail\t here", 8: "a <|endoftext|> z", 9: " " * 300_000 + "x", 10: "ab" * 60_000, 11: "\u00a0 \u3000x\u2028 y"}
    docs = spark.createDataFrame([(k, v, "s", 1) for k, v in texts.items()], "doc_id long, text string, length string, start int")
    for window, max_open in ((8, 2), (64, 1024)):
        checked(packing.pack(docs, queries.vocabulary(), window=window, max_open=max_open).collect(), texts, window)
    assert packing.pack(docs.limit(0), queries.vocabulary()).collect() == []
    assert packing.pack(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string"), queries.vocabulary()).count() >= 3


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    levels = packing.Levels(16, 10_000)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        before = {h: len(w) for h, w in levels.open.items() if w}
        total = sum(n * n for n in before.values())
        best = None
        for h in [0, *before]:
            if h + size <= 16:
                after = dict(before)
                if h:
                    after[h] -= 1
                if h + size < 16:
                    after[h + size] = after.get(h + size, 0) + 1
                value = sum(n * n for n in after.values()) - total
                best = value if best is None else min(best, value)
        list(levels.place((None, 0, np.zeros(size, "<u4"))))
        assert sum(len(w) ** 2 for w in levels.open.values()) - total == best
