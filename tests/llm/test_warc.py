import random

from pyspark.sql import functions as F

from bondwise.llm import warc

SCHEMA = "record_id string, url string, ts long, kind string, headers map<string,string>, canonical_url string, full int"


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/A/b/?utm_source=x&b=2&a=1#top": "example.com/A/b?a=1&b=2", "https://example.com:443": "example.com", "https://example.com/": "example.com",
        "example.com/x?": "example.com/x", "http://www2.example.com:8080/": "www2.example.com:8080", " ": "", "https://e.com?q=1": "e.com?q=1",
    }
    rows = spark.createDataFrame(list(cases.items()), "u string, w string").select(warc.canonical_url(F.col("u")).alias("c"), "w").collect()
    assert all(r["c"] == r["w"] for r in rows), rows


def test_outcomes_and_merged_headers(spark):
    full = {"etag": '"a"', "last-modified": "d1", "content-type": "text/html", "expires": "e1"}
    rows = [
        ("r1", "http://x.com/", 1, "response", full), ("v1", "https://www.x.com", 2, "revisit", {"etag": 'W/"a"', "expires": "e2", "content-type": "none", "vary": "*"}),
        ("v2", "http://x.com", 3, "revisit", {"last-modified": "d1"}), ("v3", "http://x.com", 3, "revisit", {"etag": '"b"', "last-modified": "d1"}), ("v4", "http://x.com", 4, "revisit", {}),
        ("v5", "http://x.com", 4, "revisit", None), ("v6", "http://x.com", 0, "revisit", {"etag": '"a"'}), ("v7", None, 5, "revisit", {"etag": '"a"'}), ("v8", "http://x.com", None, "revisit", {"etag": '"a"'}),
        ("r2", "http://x.com", 7, "response", {"etag": '"c"'}), ("v9", "http://x.com", 8, "revisit", {"etag": '"a"'}), ("va", "http://x.com", 9, "revisit", {"etag": '"c"', "date": "x"}),
        ("va", "http://x.com", 9, "revisit", {"etag": '"c"', "date": "x"}),
    ]
    got = warc.resolve(spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA)).collect()
    by = {r["record_id"]: r for r in got}
    assert len(got) == 11
    assert by["v1"]["refers_to"] == "r1" and by["v1"]["headers"] == {"etag": 'W/"a"', "last-modified": "d1", "content-type": "text/html", "expires": "e2", "vary": "*"}
    assert {k: r["outcome"] for k, r in by.items()} == {
        "v1": "resolved", "v2": "resolved", "v3": "validator mismatch", "v4": "no validator", "v5": "no validator", "v6": "no earlier response", "v7": "no earlier response",
        "v8": "no earlier response", "v9": "validator mismatch", "va": "resolved",
    }
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_url_spreads_and_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"i{k:04}", "http://hot.com" if rng.random() < 0.9 else f"http://c{k % 9}.com", rng.randrange(300), rng.choice(("response", "revisit", "revisit", "revisit")), {"etag": str(rng.randrange(3))}) for k in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, url, ts, kind, headers in rows:
        if kind == "revisit":
            before = max(((r[2], r[0], r[4]) for r in rows if r[3] == "response" and r[1] == url and (r[2], r[0]) < (ts, i)), default=None)
            ok = before is not None and before[2] == headers
            assert got[i]["refers_to"] == (before[1] if ok else None), i
