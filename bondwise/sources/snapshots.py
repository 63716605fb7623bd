"""Saved snapshots, guarded by a fingerprint of the declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.model import NODE, SITE, SITE_COLS, Snapshot


def fingerprint(type_decl: DataFrame) -> DataFrame:
    """(fingerprint): a hash over ordered type, site and state names; the declaration is as small as the model."""
    states = F.array_join(F.coalesce("allowed_states", F.array().cast("array<string>")), ",")
    line = F.concat_ws("|", "type", F.lpad(F.coalesce(F.col("site_idx").cast("string"), F.lit("")), 6, "0"), F.coalesce("site_name", F.lit("")), states)
    return type_decl.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def write_snapshot(snap: Snapshot, path: str, snapshot_id: str, type_decl: DataFrame) -> None:
    """Write nodes and sites of one snapshot under its id; other snapshots at the path stay."""
    mark = fingerprint(type_decl).first()[0]
    snap.nodes.write.mode("overwrite").parquet(f"{path}/nodes/snapshot_id={snapshot_id}")
    snap.sites.select(*SITE_COLS).write.mode("overwrite").parquet(f"{path}/sites/snapshot_id={snapshot_id}")
    meta = snap.nodes.sparkSession.createDataFrame([("sites-1", mark)], "format string, fingerprint string")
    meta.write.mode("overwrite").parquet(f"{path}/meta/snapshot_id={snapshot_id}")


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str, type_decl: DataFrame) -> Snapshot:
    """Load one snapshot; another format or other declared types are an error."""
    meta = spark.read.parquet(f"{path}/meta/snapshot_id={snapshot_id}").first()
    if meta["format"] != "sites-1":
        raise ValueError(f"unknown snapshot format {meta['format']!r}")
    if meta["fingerprint"] != fingerprint(type_decl).first()[0]:
        raise ValueError("the snapshot was saved under other type declarations")
    return Snapshot(
        spark.read.schema(NODE).parquet(f"{path}/nodes/snapshot_id={snapshot_id}"),
        spark.read.schema(SITE).parquet(f"{path}/sites/snapshot_id={snapshot_id}"),
    )
