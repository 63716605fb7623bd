"""Line deduplication by levelled sorted runs of line hashes.

A run holds, for each line key of one batch, a 128-bit hash and the number of documents with it; it is bucketed and sorted by hash. One scan
deals the keys of all documents to batches, bucketed and sorted alike. Each batch is merge-joined with the runs before it: keys that the runs already
hold in ``min_docs`` documents are settled and drop out (an anti-join), all others become a new run of level 0. Both sides of these joins lie in equal
buckets, so none of them shuffles. When a level holds ``fanout`` runs, they are merged into one run of the next level, so that n batches leave
about fanout * log(n) runs. A line is repeated when all runs together hold it in ``min_docs`` documents; settled keys are from then on.

A line's key is the line without white space at its ends and with A-Z lower-cased. Lines whose key is empty never count as
repeated. A key counts once per document, however often it stands there.

Nulls and edges: a null or empty text is one empty line and stays the empty string; a null doc_id is a document like others, and rows
repeated in full are separate documents; an empty table gives no rows; other columns pass through, except the result columns, which are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.llm.text import SPACES, ascii_lower
from bondwise.session import cut, shared_dir

MIN_DOCS = 10
FANOUT = 2
BATCHES = 7
HOT = 10_000
RUN = "h1 long, h2 long, docs long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes_of(text: Column) -> Column:
    """For each line both halves of its key's hash; null where the key is empty."""
    keys = F.transform(lines_of(ascii_lower(text)), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second half"), k).alias("h2"))))


def key_counts(docs: DataFrame, batches: int = 1, by_text: bool = False) -> DataFrame:
    """(batch, h1, h2, docs): in how many documents of each batch, or in how many different texts, each line key stands.

    Documents are dealt to batches by id, texts by their hash."""
    text = F.col("text").cast("string")
    batch = F.pmod(F.xxhash64(text if by_text else F.col("doc_id")), F.lit(batches)).cast("int")
    held = docs.select(batch.alias("batch"), F.array_distinct(hashes_of(text)).alias("held"), *([F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second half"), text).alias("t2")] if by_text else []))
    if by_text:
        held = held.groupBy("t1", "t2").agg(F.first("batch").alias("batch"), F.first("held").alias("held"))
    found = held.select("batch", F.explode("held").alias("h")).filter("h is not null")
    return found.groupBy("batch", "h.h1", "h.h2").agg(F.count(F.lit(1)).alias("docs"))


@dataclass
class LineRuns:
    """The runs of one corpus: tables in a folder that all executors reach, all in the same number of buckets."""

    spark: SparkSession
    folder: str
    buckets: int
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=lambda: [[]])

    @classmethod
    def fresh(cls, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> LineRuns:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}", buckets, min_docs, fanout)

    def write(self, rows: DataFrame, what: str, *parts: str) -> str:
        """Write rows that lie in buckets already; returns the table's name."""
        name = f"lines_{what}_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def deal(self, counts: DataFrame) -> str:
        """Lay (batch, h1, h2, docs) out in the buckets of the runs, apart by batch. Counts come summed, so no bucket gets a key more than once a batch."""
        return self.write(counts.repartition(self.buckets, "h1", "h2"), "dealt", "batch")

    def _sums(self, names: list[str]) -> DataFrame:
        """The counts of several runs added up, by full merge joins. A union of bucketed scans must not stand here: Spark 4.1 takes it to be
        partitioned like its inputs and skips the shuffle of a sum over it, but lays the inputs end to end when they are columnar."""
        every = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("docs", "more").hint("merge")
            every = every.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return every

    def totals(self) -> DataFrame:
        """(h1, h2, docs) over all runs."""
        names = [name for level in self.levels for name in level]
        return self._sums(names) if names else self.spark.createDataFrame([], RUN)

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, docs) of the batch's keys that the runs do not yet hold in ``min_docs`` documents: one merge join per run."""
        held = F.lit(0).cast("long")
        for k, name in enumerate(name for level in self.levels for name in level):
            batch = batch.join(self.spark.table(name).withColumnRenamed("docs", f"run{k}").hint("merge"), ["h1", "h2"], "left")
            held = held + F.coalesce(f"run{k}", F.lit(0))
        return batch.filter(held < self.min_docs).select("h1", "h2", "docs")

    def add(self, batch: DataFrame) -> None:
        """Anti-join a batch of (h1, h2, docs) with the settled keys, add the rest as a run, then merge every level that is full."""
        self.levels[0].append(self.write(self.unsettled(batch), "level0"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(self._sums(old), f"level{level + 1}"))
            self.levels[level] = []
            self._drop(old)
            level += 1


def drop_lines(docs: DataFrame, repeated: DataFrame, n_held: int) -> DataFrame:
    """``docs`` without the lines whose key is in ``repeated`` (h1, h2, docs); adds ``n_lines`` and ``n_dropped``.

    Only hashes and places meet the repeated keys; each document then gathers the places to leave out. Of ``n_held`` pairs of document and key, a key with more
    than a ``HOT``-th is met by broadcast, where its places are; there are fewer than HOT such keys. Documents are matched by a
    128-bit hash of id and text, so that equal rows share their places.
    """
    out = docs.drop("n_lines", "n_dropped").withColumn("text", F.col("text").cast("string"))
    own = {"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit("second half"), "doc_id", "text")}
    places = out.withColumns(own).select("_k1", "_k2", F.posexplode(hashes_of(F.col("text"))).alias("_at", "h")).filter("h is not null")
    flat, keys = places.select("_k1", "_k2", "_at", "h.*"), ["h1", "h2"]
    is_hot = F.col("docs") * HOT > F.lit(n_held)
    hot = F.broadcast(repeated.filter(is_hot).select(*keys))
    hits = flat.join(hot, keys, "left_semi").unionByName(flat.join(hot, keys, "left_anti").join(repeated.filter(~is_hot).select(*keys), keys, "left_semi"))
    gone = hits.groupBy("_k1", "_k2").agg(F.collect_set("_at").alias("_gone"))
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    joined = out.withColumns(own).join(gone, ["_k1", "_k2"], "left").withColumn("_lines", lines)
    text = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return joined.select(
        *[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in out.columns],
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, by_text: bool = False) -> DataFrame:
    """Feed a table to fresh runs in batches, then drop every line that ``min_docs`` documents hold.

    With ``by_text`` copies of a text count once, so that a document is not emptied because it was copied.
    """
    runs = LineRuns.fresh(docs.sparkSession, min_docs, fanout)
    dealt = docs.sparkSession.table(runs.deal(key_counts(docs, batches, by_text)))
    for k in range(batches):
        runs.add(dealt.filter(F.col("batch") == k).drop("batch"))
    repeated = cut(runs.totals().filter(F.col("docs") >= min_docs), "repeated-lines")
    n_held = dealt.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    return drop_lines(docs, repeated, n_held)
