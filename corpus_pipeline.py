"""The corpus pipeline: documents in, packed training sequences out. Each stage calls one operator of ``bondwise.llm``.

Stages read what the stage before kept, as written Parquet, and all but the last return the columns of documents:

1. language: documents without a language (no letters, or no text) go;
2. lines: lines that stand in ten different texts or more are cut out of every document; ``n_chars`` follows;
3. near_duplicates: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8);
4. decontaminate: documents with ten consecutive words of a benchmark item go;
5. pack: all that is left, in sequences of 2048 tokens.

Nulls and edges are those of the operators: null texts end in the first stage, rows repeated in full in the third; an empty table ends as an
empty table of pieces; further columns travel with their documents unchanged, whatever their names and types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.llm import decontaminate, language, lines, packing, simhash
from bondwise.llm.queries import table, vocabulary
from bondwise.llm.text import packed, unpacked
from bondwise.session import shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: learn from the labelled documents, drop those it finds to have no language."""
    found = language.predict(packed(docs, "text"), language.fit(docs)).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*unpacked(found, docs, ("text",)))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, the documents stay. Copies of a text count once; the next stage is for them."""
    kept = lines.dedup(packed(docs, "doc_id", "text"), by_text=True)
    new = {"n_chars": F.char_length("text")} if "n_chars" in docs.columns else {}
    return kept.select(*unpacked(kept, docs, ("doc_id", "text"), **new))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents, without the ids themselves."""
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

# hyperdimensional cosines, fingerprints and token ids have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
