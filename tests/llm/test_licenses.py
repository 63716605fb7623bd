import re
from collections import Counter

from bondwise.llm import licenses
from bondwise.llm.text import LOWER, UPPER, WORD

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))
    places = []
    for label, phrase in licenses.PHRASES:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def test_spans_bridge_small_changes(spark):
    mit = dict(licenses.TEMPLATES)["mit"]
    texts = [
        "x y " + mit, mit.replace("free of charge", "free of any charge"), mit.replace("obtaining a copy", "obtaining"),
        " ".join(mit.split()[:8]), "Permission to copy " * 5, "cc by CC-BY, cc\nby general general public license", None, "", "ÀLL rights reserved All Rights Reserved Key", "w " * 60000 + "all rights reserved",
    ]
    docs = spark.createDataFrame([(k, t, "l", 0) for k, t in enumerate(texts)] + [(None, "cc by", "l", 0), (1, "cc by", "l", 0), (1, "cc by", "l", 0)], "doc_id long, text string, label string, row int")
    rows = licenses.scan(docs).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["n_words"] != 2}
    assert got[0]["labels"] == got[1]["labels"] == got[2]["labels"] == "mit" and got[3]["labels"] == got[4]["labels"] == ""
    assert got[0]["spans"][0]["first"] == 2 and got[0]["score"] == 1.0
    for k, t in enumerate(texts):
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"], got[k]["base_labels"]) == brute(t)
    assert Counter(r["n_base"] for r in rows if r["n_words"] == 2) == {1: 3}
    assert licenses.scan(docs.limit(0)).collect() == []
