import numpy as np

from bondwise.llm import language, queries

SF = "/root/testdata/sf0.001"


def test_gram_vector_binds_rotated_letters():
    s = language.Space(64, 3, 1)
    a, b, c = (s.letter_vector(ord(x)).astype(int) for x in "abc")
    key = int(s.grams(np.array([ord(x) for x in "abc"], np.uint32))[0])
    assert (s.gram_vector(key) == np.roll(a, 2) * np.roll(b, 1) * c).all()


def test_bundle_is_the_sum_over_all_grams():
    s = language.Space(64, 3, 1)
    text = "Été, des mots!  et 99 encore"
    codes = [32, *map(ord, "été des mots et encore"), 32]
    want = sum(s.gram_vector((a << 42) | (b << 21) | c).astype(float) for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (s.bundle([text])[0] == want).all()
    # a text of many blocks gives the same vector
    block, language.BLOCK = language.BLOCK, 7
    try:
        assert (language.Space(64, 3, 1).bundle([text, None, "12"])[0] == want).all()
    finally:
        language.BLOCK = block


def test_held_out_accuracy(spark):
    got = queries.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 30 and (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 ?!", None, "x"), (None, "le mot", "fr", "x"), (5, "the word " * 20000, "en", "x"), (5, "the word", "en", "x")],
        "doc_id long, text string, lang string, score string",
    )
    model = language.fit(docs)
    assert model[0] == ["en", "fr"]
    got = {(r["doc_id"], r["text"] and r["text"][:8]): (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert got[1, None] == got[2, ""] == got[3, "123 ?!"] == ("und", 0.0)
    assert got[None, "le mot"][0] == "fr" and got[5, "the word"][0] == "en"
    nothing = language.fit(docs.limit(0))
    assert nothing[0] == [] and {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
