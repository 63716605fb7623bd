from bondwise.llm.token_rollup import TokenRollup

KINDS = "doc_id long, version string, source string, lang string, tokens long, op string, seq long, docs int"


def test_signed_batches_match_a_ledger_in_memory(spark):
    rollup = TokenRollup.fresh(spark)
    batches = {
        "a": [(1, "x", "s", "en", 10, "insert", 0), (2, "x", "s", "en", 5, "insert", 0), (2, "x", "s", "en", 5, "insert", 0), (3, "y", None, None, None, "insert", 0), (None, "x", "t", "en", 1, "insert", 0)],
        "b": [(1, "x", "t", "en", 12, "revise", 0), (2, "x", "s", "en", 0, "delete", 1), (2, "x", "s", "en", 7, "insert", 2), (9, "x", "s", "en", 0, "delete", 0), (None, "x", "t", "en", 3, "revise", 0)],
        "c": [(3, "y", None, None, 4, "revise", 0), (1, "x", "t", "en", 0, "delete", 0)],
        "d": [],
    }
    held = {}
    for name in ("a", "b", "a", "c", "b", "d"):
        done = rollup.commit(name, spark.createDataFrame([(*r, 0) for r in batches[name]], KINDS))
        if done:
            last = {}
            for r in sorted(batches[name], key=lambda r: r[6]):
                last[r[0], r[1]] = r
            for key, r in last.items():
                held.pop(key, None)
                if r[5] != "delete":
                    held[key] = (r[2], r[3], r[1], r[4] or 0)
        want = {}
        for s, l, v, n in held.values():
            docs, tokens = want.get((s, l, v), (0, 0))
            want[s, l, v] = (docs + 1, tokens + n)
        got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
        assert got == want
    assert rollup.committed() == ["a", "b", "c", "d"]


def test_an_interrupted_batch_is_written_again(spark):
    rollup = TokenRollup.fresh(spark)
    one = spark.createDataFrame([(1, "x", "s", "en", 10, "insert", 0, 0)], KINDS)
    other = spark.createDataFrame([(8, "x", "s", "en", 99, "insert", 0, 0)], KINDS)
    other.select("doc_id", "version", "source", "lang", "tokens").write.parquet(f"{rollup.folder}/ledger/k")  # left by a run that ended before its marker
    assert rollup.totals().collect() == [] and rollup.commit("k", one) and not rollup.commit("k", other)
    assert [(r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [(1, 10)]
