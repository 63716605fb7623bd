import duckdb
import pandas as pd
import pytest

from bondwise.llm.queries import QUERIES, SQL
from bondwise.llm import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    # a column of whole numbers with nulls comes as floats from one side
    cell = lambda x: "~" if pd.isna(x) else str(int(x) if isinstance(x, float) and x.is_integer() else x)
    plain = lambda frame: sorted(tuple(cell(x) for x in row) for row in frame[cols].itertuples(index=False))
    assert cols == sorted(want.columns) and plain(got) == plain(want)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def windows_by_hand(text, items, n=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, ids = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    ids.add(item)
    return len(own), len(hit), sorted(i for i in ids if i is not None)


def test_decontamination_edges_slices_and_removal(spark):
    long_item = " ".join(f"item{k}" for k in range(14))
    items = [(7, long_item), (8, "Short ÉTÉ item"), (9, None), (None, "no number here"), (10, "!!"), (7, long_item)]
    texts = [
        None, "", "clean words only", f"before {long_item.upper()} after", "x short ÉTÉ ITEM y", "short été item", "no number, here!", " ".join(long_item.split()[2:11]),
        "w " * 400_000 + long_item, "a" * 1_500_000 + " " + long_item, long_item + ". " + long_item,
    ]
    rows = [(k, t, "c", 5) for k, t in enumerate(texts)] + [(None, long_item, "c", 5), (3, texts[3], "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, hit_spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (1 << 20, 10):
        got = decontaminate.report(decontaminate.scan(docs, bench, slice_bytes=slice_bytes)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] not in (None, 8, 9):
                n_words, n_hit, ids = windows_by_hand(texts[r["doc_id"]], items)
                assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n_words, n_hit, len(ids), n_hit > 0), r
        by = {r["doc_id"]: r for r in got}
        assert by[8]["n_words"] == 400_014 and by[8]["n_hit"] == 14 and by[9]["n_words"] == 15 and by[9]["n_hit"] == 14
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [0, 1, 2, 5, 7]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean_spans(docs, bench).collect()}
    assert cut[3] == "before  after" and cut[2] == texts[2] and cut[10] == ""
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.clean_documents(docs.limit(0), bench).collect() == []
