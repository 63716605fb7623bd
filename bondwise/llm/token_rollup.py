"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch holds inserts, deletes and revised counts of (document, tokenizer version). Its events are turned into signed ledger rows: a revision takes the
old row back and adds the new one, under its own source and language. Totals are sums of deltas, one small table per batch. A batch is
committed by the marker file that is written last; a batch that was interrupted is written again over its own folder, and one that is
committed is not read again, so a batch may be sent any number of times.

Within a batch the event of a key with the highest ``seq`` counts. An insert of a key that exists is a revision, as is a revision of a key that does
not an insert; a delete of a missing key changes nothing.

Nulls and edges: events with a null doc_id, version or seq are one key each under that null; null counts are 0; null sources and languages are groups
of their own; rows repeated in full count once; an empty batch commits no deltas; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.session import shared_dir

INSERT, DELETE, REVISE = "insert", "delete", "revise"
LEDGER = "doc_id long, version string, source string, lang string, tokens long, sign int"
TOTALS = "source string, lang string, version string, docs long, tokens long"


@dataclass
class TokenRollup:
    """Batches of one corpus in a folder that all executors reach."""

    spark: SparkSession
    folder: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> TokenRollup:
        return cls(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        """Ids of committed batches. The list is as long as there were batches since the last ``compact``."""
        files, path = self._path("committed")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """(doc_id, version, source, lang, tokens): the rows that have not been taken back."""
        keys = ["doc_id", "version", "source", "lang", "tokens"]
        return self._read("ledger", LEDGER).groupBy(*keys).agg(F.sum("sign").alias("n")).filter("n > 0").select(*keys)

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Apply ``events`` (doc_id, version, source, lang, tokens, op, seq) once under ``batch_id``; says whether anything was done."""
        if batch_id in self.committed():
            return False
        kinds = {"doc_id": "long", "version": "string", "source": "string", "lang": "string", "op": "string", "seq": "long"}
        typed = events.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"))
        last = typed.groupBy("doc_id", "version").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("e")).select("doc_id", "version", "e.*")
        asked = last.select("doc_id", "version").alias("a")
        now = self.current().alias("c")
        same = F.col("a.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("a.version").eqNullSafe(F.col("c.version"))
        old = now.join(asked, same, "left_semi").withColumn("sign", F.lit(-1))
        new = last.filter(F.col("op") != DELETE).withColumn("sign", F.lit(1))
        cols = [x.split()[0] for x in LEDGER.split(", ")]
        old.select(*cols).unionByName(new.select(*cols)).write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch_id}")
        deltas = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/{batch_id}").groupBy("source", "lang", "version")
        deltas = deltas.agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/totals/{batch_id}")
        files, marker = self._path("committed", batch_id)
        files.create(marker, True).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of groups that hold documents."""
        sums = self._read("totals", TOTALS).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs > 0")
