from collections import Counter

from bondwise.llm import lines

STRIP = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, h1 int"


def brute(rows, least):
    key = lambda x: x.strip(STRIP).translate(LOW)
    held = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for doc, text, *_ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if held[key(x)] < least]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_drop_matches_brute_force(spark):
    texts = ["Menu\none\n\n", " menu \t\nÉtat\ntwo", "MENU\nétat", "a\na\na", "A\r\nb", "b\x0b\nmenu", "", None, "menu", "x\n" * 4000 + "menu", "a \nb"]
    rows = [(k if k % 4 else None, t, "z", k) for k, t in enumerate(texts)] + [(1, texts[1], "z", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for least in (1, 2, 3):
        got = lines.dedup(docs, least, batches=3, fanout=2)
        assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute(rows, least)
    assert lines.dedup(docs.limit(0)).collect() == []
    copies = spark.createDataFrame([(k, "once\nmore", "z", 0) for k in range(5)] + [(9, "more", "z", 0)], SCHEMA)
    assert {r["text"] for r in lines.dedup(copies, 2, by_text=True).collect()} == {"once", ""}


def test_runs_settle_keys_and_merge_by_level(spark):
    docs = spark.createDataFrame([(k, f"l{k % 3}\nm{k}\nall", "z", 0) for k in range(35)], SCHEMA)
    runs = lines.LineRuns.fresh(spark, min_docs=10, fanout=2)
    added = []
    for k in range(7):
        dealt = spark.table(runs.deal(lines.key_counts(docs.filter(f"doc_id % 7 = {k}")))).drop("batch")
        left = runs.unsettled(dealt)
        # batch and runs lie in equal buckets: every join merges without a shuffle
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == sum(len(level) for level in runs.levels)
        added.append(left.count())
        runs.add(dealt)
        assert all(len(level) < 2 for level in runs.levels)
    # 5 lines of their own and 3 or 4 shared ones a batch: the line of all is settled after two batches, the three others after six
    assert added == [9, 9, 8, 8, 8, 8, 5]
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    docs_of = sorted(r["docs"] for r in runs.totals().collect())
    assert docs_of[:35] == [1] * 35 and all(n >= 10 for n in docs_of[35:]) and len(docs_of) == 39
    top = spark.table(runs.levels[2][0])
    for part in top.rdd.glom().collect():
        assert [(r["h1"], r["h2"]) for r in part] == sorted((r["h1"], r["h2"]) for r in part)
    assert sum(docs_of) == runs.totals().agg({"docs": "sum"}).first()[0] and runs.totals().select("h1", "h2").distinct().count() == 39


def test_the_query_builds_three_levels(spark, monkeypatch):
    seen = []
    whole = lines.LineRuns.totals
    monkeypatch.setattr(lines.LineRuns, "totals", lambda self: seen.append([len(level) for level in self.levels]) or whole(self))
    lines.dedup(spark.createDataFrame([(k, f"a\nb{k}", "z", 0) for k in range(30)], SCHEMA)).count()
    assert seen == [[1, 1, 1]]


def test_a_line_of_most_documents_is_met_by_broadcast(spark):
    docs = spark.createDataFrame([(k, f"Menu\nown {k}\n" + "pair" * (k % 3), "z", 0) for k in range(40)], SCHEMA)
    out = lines.dedup(docs)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["n_dropped"] for r in out.collect()} == {1, 2}
