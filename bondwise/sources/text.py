"""Shared pieces of the text readers and writers."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_FILES = 100_000


def number_text(value: Column) -> Column:
    """A double as text that reads back to the same double: whole numbers plain, others in shortest form."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def label_text(value: Column) -> Column:
    """A value as one field without white space or comment mark that ``label_of`` reads back, null and empty text included."""
    text = F.url_encode(value.cast("string"))
    return F.when(text.isNull(), "\\N").when(text == "", "\\E").otherwise(text)


def label_of(field: Column) -> Column:
    return F.when(field == "\\E", "").when(field != "\\N", F.try_url_decode(field))


def name_text(name: str) -> str:
    """A column name as ``label_text`` writes a value."""
    return quote_plus(name, safe="*-._").replace("~", "%7E") or "\\E"


def file_stem(path: Column, suffix: str) -> Column:
    """File name without directories and without ``suffix``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix.replace(".", r"\.") + "$", "")


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) with blank lines dropped; large files are split over tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    return rows.filter(F.length("line") > 0)


def small_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) for files where line order matters; each file is read as one value.

    Reference statistics, table functions and reports have one line per sample or model and stay small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return lines.select("file", "line_no", F.trim("line").alias("line")).filter(F.length("line") > 0)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line) for large files where line order matters; a file is split over tasks.

    ``block`` is where a split starts in its file. Lines of a file are ordered by (block, line_no); line numbers
    compare only within a block.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"),
    )
    return rows.filter(F.length("line") > 0)


def few_files(df: DataFrame) -> bool:
    """Whether a table with one row per input file may be broadcast: the driver knows the file list."""
    return len(df.inputFiles()) <= MAX_BROADCAST_FILES


def fields(line: Column) -> Column:
    """Tab- or space-separated fields without a leading comment mark."""
    return F.split(F.trim(F.regexp_replace(line, r"^#+\s*", "")), r"\s+")


def write_ordered_lines(rows: DataFrame, order: list[str], path: str, by: list[str] | None = None) -> None:
    """Write the column ``line`` in the given order, spread over part files that sort like their contents.

    With ``by``, each combination of those columns becomes a directory; a large one spans several files.
    """
    by = by or []
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    writer = placed.select(*by, "line").write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)
