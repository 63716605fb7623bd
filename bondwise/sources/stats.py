"""Reference statistics and run tables as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.sources.text import file_stem, number_text, small_files, write_ordered_lines


def _units(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(model, line_no, line): a model is a file named after it, or a directory ``model=…`` of part files in order."""
    lines = small_files(spark, path)
    folder = F.nullif(F.regexp_extract("file", "/model=([^/]+)/", 1), F.lit(""))
    lines = lines.withColumn("model", F.coalesce(F.url_decode(folder), file_stem(F.col("file"), suffix)))
    order = W.partitionBy("model").orderBy("file", "line_no")
    return lines.withColumn("line_no", F.row_number().over(order)).drop("file")


def _wide(spark: SparkSession, path: str, suffix: str, value: str) -> DataFrame:
    """(model, step, time, obs, value) of a wide table whose first line is its header."""
    lines = _units(spark, path, suffix).filter(~F.col("line").rlike(r"^#\s*$"))
    heads = lines.groupBy("model").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("first"))
    names = F.transform(F.split(F.regexp_replace("head", r"^#\s*", ""), "\t"), lambda x: F.trim(x))
    rows = lines.join(heads, "model").filter("line_no > first").select(
        "model",
        (F.col("line_no") - F.col("first") - 1).alias("step"),
        names.alias("names"),
        F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double")).alias("values"),
    )
    cells = F.explode(F.slice(F.arrays_zip("names", "values"), 2, F.greatest(F.size("values") - 1, F.lit(0))))
    long = rows.select("model", "step", F.element_at("values", 1).alias("time"), cells.alias("p"))
    return long.select("model", "step", "time", F.col("p.names").alias("obs"), F.col("p.values").alias(value))


def read_ref_stats(spark: SparkSession, means: str, stds: str | None = None, sems: str | None = None) -> DataFrame:
    """(model, obs, step, time, mean, std, sem). Spread files pair with means by row position.

    The time column of a spread file holds the spread of the times, 0 on every row, so it cannot be a key.
    """
    out = _wide(spark, means, ".mean.tsv", "mean")
    for path, name in ((stds, "std"), (sems, "sem")):
        if path:
            side = _wide(spark, path, f".{name}.tsv", name).drop("time")
            out = out.join(side, ["model", "step", "obs"], "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select("model", "obs", "step", "time", "mean", "std", "sem")


def read_ref_tint(spark: SparkSession, path: str) -> DataFrame:
    """(model, obs, i_mean, i_std, n_reps), by position since the first header name varies; bad rows are skipped."""
    rows = _units(spark, path, ".tint.tsv").filter(~F.col("line").startswith("#"))
    cell = F.split("line", "\t")
    first = rows.groupBy("model").agg(F.min("line_no").alias("head"))
    data = rows.join(first, "model").filter("line_no > head").select(
        "model",
        F.get(cell, 0).alias("obs"),
        F.get(cell, 1).try_cast("double").alias("i_mean"),
        F.get(cell, 2).try_cast("double").alias("i_std"),
        F.get(cell, 3).try_cast("int").alias("n_reps"),
    )
    return data.filter("i_mean is not null and i_std is not null and n_reps is not null")


def read_named_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, value) cells of a tab table with a header, whose first name may carry a comment mark.

    Missing trailing fields come back as null, ``N/A`` too. Comment lines after the header are skipped.
    """
    lines = small_files(spark, path)
    heads = lines.filter(F.col("line").contains("\t")).groupBy("file").agg(
        F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("first")
    )
    names = F.transform(F.split(F.regexp_replace("head", r"^#\s*", ""), "\t"), lambda x: F.trim(x))
    rows = lines.filter(~F.col("line").startswith("#")).join(heads, "file").filter("line_no > first")
    cells = rows.select("file", F.col("line_no").alias("row"), names.alias("names"), F.split("line", "\t").alias("values"))
    each = cells.select("file", "row", F.posexplode("names").alias("i", "name"), "values")
    value = F.nullif(F.nullif(F.trim(F.get("values", F.col("i"))), F.lit("N/A")), F.lit(""))
    return each.select("file", "row", "name", value.alias("value"))


def _typed(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    wide = cells.groupBy("file", "row").pivot("name", list(columns)).agg(F.first("value"))
    return wide.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()]).filter("model is not null")


def read_sim_params(spark: SparkSession, path: str) -> DataFrame:
    """(model, t_end, n_steps, flags, block_same_complex); column order and the flags column may vary."""
    cells = read_named_table(spark, path).withColumn("name", F.regexp_replace("name", r"^\w*_flags$", "flags"))
    rows = _typed(cells, {"model": "string", "t_end": "double", "n_steps": "int", "flags": "string"})
    flags = F.coalesce("flags", F.lit(""))
    return rows.select("model", "t_end", "n_steps", flags.alias("flags"), flags.contains("-bscb").alias("block_same_complex"))


def read_wall_summary(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_named_table(spark, path), {"model": "string", "n_reps_done": "int", "wall_mean_s": "double", "wall_std_s": "double"})


def read_noise_floor(spark: SparkSession, path: str) -> DataFrame:
    """(model, {tz,mz}_{p95,p99,max}_n{2,3,10})."""
    names = [f"{m}_{s}_n{n}" for m in ("tz", "mz") for s in ("p95", "p99", "max") for n in (2, 3, 10)]
    return _typed(read_named_table(spark, path), {"model": "string", **{n: "double" for n in names}})


def read_timeouts(spark: SparkSession, path: str) -> DataFrame:
    """(model, seconds); comments and a header line are skipped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c"))
    out = rows.filter(F.size("c") >= 2).select(F.get("c", 0).alias("model"), F.get("c", 1).try_cast("int").alias("seconds"))
    return out.filter(~F.col("model").startswith("#") & F.col("seconds").isNotNull())


def write_ensemble_set(stats: DataFrame, tint: DataFrame, path: str, names: list[str]) -> None:
    """mean, std, sem and tint text, one directory per model in each; the std time column is the spread of times, 0."""
    for kind in ("mean", "std", "sem"):
        at = F.col("time") if kind == "mean" else F.lit(0.0)
        wide = stats.groupBy("model", "step", "time").pivot("obs", names).agg(F.first(kind))
        cells = [number_text(at)] + [F.coalesce(number_text(F.col(f"`{n}`")), F.lit("nan")) for n in names]
        body = wide.select("model", "step", F.concat_ws("\t", *cells).alias("line"))
        head = stats.select("model").distinct().select("model", F.lit(-1).alias("step"), F.lit("\t".join(["time", *names])).alias("line"))
        write_ordered_lines(body.unionByName(head), ["step"], f"{path}/{kind}", ["model"])
    cells = F.concat_ws("\t", "obs", number_text(F.col("i_mean")), number_text(F.col("i_std")), F.col("n_reps").cast("string"))
    body = tint.select("model", F.lit(1).alias("ord"), F.col("obs"), cells.alias("line"))
    head = tint.select("model").distinct().select("model", F.lit(0).alias("ord"), F.lit("").alias("obs"), F.lit("obs\tI_mean\tI_std\tn_reps").alias("line"))
    write_ordered_lines(body.unionByName(head), ["ord", "obs"], f"{path}/tint", ["model"])


def write_run_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    """A replicate, footprint or benchmark table as delimited text with a header in each part."""
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_markdown(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report table as markdown lines; ``order`` sorts the rows."""
    names = rows.columns
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("—"))
    body = rows.select(F.lit(2).alias("ord"), *order, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("line"))
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
    one = rows.sparkSession.range(1)
    head = one.select(F.lit(0).alias("ord"), *empty, F.lit("| " + " | ".join(names) + " |").alias("line"))
    rule = one.select(F.lit(1).alias("ord"), *empty, F.lit("|" + "---|" * len(names)).alias("line"))
    write_ordered_lines(body.unionByName(head).unionByName(rule), ["ord", *order], path)
