import random

import corpus_pipeline
from bondwise.llm import simhash
from tests.llm.test_lines import brute

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(rng):
    rows = []
    add = lambda text, lang="en": rows.append((len(rows), text, lang, "s", len(text or "")))
    for _ in range(60):
        add(" ".join(words(rng, rng.randint(40, 120))))
    for k in range(12):  # a menu line in twelve documents
        add(f"Home About Contact\n{' '.join(words(rng, 50))}")
    add(rows[0][1])
    near = rows[1][1].split()
    near[0] = "changed"
    add(" ".join(near))
    add(None)
    add("123 !!", None)
    item = " ".join(words(rng, 25))
    add(" ".join(words(rng, 30)) + " " + item + " " + " ".join(words(rng, 30)))
    return rows, item


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    rows, item = corpus(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontaminate", "pack"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    lost = len(rows) - 3  # the null text
    assert set(seen["language"]) == set(range(len(rows))) - {lost, lost + 1}
    texts = {(d, t) for d, _, _, t in brute([(r["doc_id"], r["text"]) for r in seen["language"].values()], 10)}
    assert {(d, r["text"]) for d, r in seen["lines"].items()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"].values())
    assert set(seen["lines"]) - set(seen["near_duplicates"]) == {72, 73}
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == {len(rows) - 1}
    assert set(seen["pack"]) == set(seen["decontaminate"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == set(seen["pack"])


CLASHING = [
    ("lang_pred", "int"), ("score", "string"), ("n_lines", "int"), ("n_dropped", "string"), ("n_words", "long"), ("hit_spans", "string"), ("hit_items", "array<string>"), ("row", "string"), ("rest", "double"),
    ("k1", "string"), ("_id", "string"), ("group_id", "string"), ("fp", "double"), ("h1", "string"), ("start", "string"), ("odd name.x", "string"), ("batch", "string"),
]


def test_own_columns_travel_unchanged(spark, tmp_path):
    """Columns named like the results of the stages keep names, types and values; repeated rows and very long texts take part."""
    rng = random.Random(9)
    rows, item = corpus(rng)
    rows.append((500, "word " * 300_000 + " ".join(words(rng, 40)), "en", "s", 1))
    rows += [rows[3], rows[3]]
    value = lambda kind, k: [str(k)] if kind.startswith("array") else k if kind in ("int", "long") else float(k) if kind == "double" else f"mine {k}"
    wide = [(*r, *[value(kind, r[0]) for _, kind in CLASHING]) for r in rows]
    named = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in CLASHING)
    docs = spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {named}")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / f"wide{k}"))
        docs = spark.read.parquet(str(tmp_path / f"wide{k}"))
        got = docs.collect()
        assert len(got) > 60 and all(r[5 + j] == value(kind, r["doc_id"]) for r in got for j, (_, kind) in enumerate(CLASHING)), name
    assert sum(r["doc_id"] == 500 for r in got) == 1 and sum(r["doc_id"] == 3 for r in got) == 1


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
