"""Trajectory and sweep files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.operators.order import ranked
from bondwise.sources.text import few_files, fields, label_of, label_text, name_text, number_text, text_rows, write_ordered_lines


def read_gdat(spark: SparkSession, path: str, mode: str = "drop", per_directory: bool = False, labels: list[str] | None = None) -> DataFrame:
    """(file, time, obs, value) from trajectory text with a ``time …`` header line, tabs or spaces.

    The header names the columns of its file, or of its directory when a run spans several part files. Later
    comment lines are skipped. Rows with a field that is no number, or with a wrong field count, are dropped;
    ``mode="fail"`` stops on them instead. ``labels`` are the columns that tell runs apart in files of many runs, see
    ``write_gdat``; they are returned as text between file and time.
    """
    labels = labels or []
    n = len(labels)
    lines = text_rows(spark, path)
    if per_directory:
        lines = lines.withColumn("file", F.regexp_replace("file", "/[^/]*$", ""))
    # labels are written so that no line of values starts with a comment mark
    named = "".join(re.escape(name_text(name)) + r"\s+" for name in labels)
    is_header = F.col("line").rlike(rf"^#{'' if labels else '?'}\s*{named}time(\s|$)")
    heads = lines.filter(is_header).groupBy("file").agg(F.min("line").alias("head")).select("file", fields(F.col("head")).alias("names"))
    if few_files(lines):
        heads = F.broadcast(heads)
    data = lines.filter(~F.col("line").startswith("#") & ~is_header)
    cells = F.split("line", r"\s+")
    values = F.transform(F.slice(cells, n + 1, F.greatest(F.size(cells) - n, F.lit(0))), lambda x: x.try_cast("double"))
    heads = heads.withColumn("names", F.slice("names", n + 1, F.size("names") - n))
    rows = data.join(heads, "file").withColumn("values", values)
    bad = F.exists("values", lambda x: x.isNull()) | (F.size("values") != F.size("names"))
    if mode == "drop":
        rows = rows.filter(~bad)
    elif mode == "fail":
        message = F.concat(F.lit("malformed row in "), F.col("file"), F.lit(": "), F.col("line"))
        rows = rows.withColumn("values", F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(F.col("values")))
    else:
        raise ValueError("mode is 'drop' or 'fail'")
    pairs = F.explode(F.slice(F.arrays_zip("names", "values"), 2, F.greatest(F.size("values") - 1, F.lit(0))))
    of_run = [label_of(F.get(cells, F.lit(i))).alias(name) for i, name in enumerate(labels)]
    long = rows.select("file", *of_run, F.get("values", F.lit(0)).alias("time"), pairs.alias("p"))
    return long.select("file", *labels, "time", F.col("p.names").alias("obs"), F.col("p.values").alias("value"))


def with_steps(traj: DataFrame, group: str = "model") -> DataFrame:
    """Add ``step``: the place of a row's time on the sorted time grid of its group.

    The grid is ranked once from distinct times, so replicates are never ordered.
    """
    grid = traj.select(group, "time").distinct()
    grid = ranked(grid, [group], "time").select(group, "time", (F.col("rank") - 1).cast("int").alias("step"))
    return traj.join(grid, [group, "time"])


def _wide_body(traj: DataFrame, by: list[str], axis: str, names: list[str]) -> DataFrame:
    wide = traj.groupBy(*by, axis).pivot("obs", names).agg(F.first("value"))
    cells = [number_text(F.col(axis))] + [F.coalesce(number_text(F.col(f"`{n}`")), F.lit("nan")) for n in names]
    return wide.select(*by, F.col(axis).alias("at"), F.concat_ws("\t", *cells).alias("line"))


def _wide_lines(traj: DataFrame, by: list[str], axis: str, names: list[str], head: str) -> DataFrame:
    body = _wide_body(traj, by, axis, names)
    top = "\t".join([head, *names])
    axis_type = traj.schema[axis].dataType
    heads = traj.select(*by).distinct() if by else traj.sparkSession.range(1).select()
    return body.unionByName(heads.select(*by, F.lit(None).cast(axis_type).alias("at"), F.lit(top).alias("line")))


def write_gdat(traj: DataFrame, path: str, names: list[str], by: list[str], functions: list[str] | None = None, stacked: bool = False) -> None:
    """Trajectories as text, one directory per run; function columns follow the observables when asked for.

    Every value is written so that it reads back to the same double. A directory per run costs several file operations a run.
    With ``stacked``, all runs stand in one directory, whose files follow the rows and not the runs: each line starts with the
    run's columns ``by``, which the header names before ``time``.
    """
    columns = [*names, *(functions or [])]
    if not stacked:
        write_ordered_lines(_wide_lines(traj, by, "time", columns, "# time"), ["at"], path, by)
        return
    body = _wide_body(traj, by, "time", columns).withColumn("line", F.concat_ws("\t", *[label_text(F.col(c)) for c in by], "line"))
    top = "\t".join([*[name_text(c) for c in by], "time", *columns])
    kinds = {**{c: traj.schema[c].dataType for c in by}, "at": traj.schema["time"].dataType}
    head = traj.sparkSession.range(1).select(F.lit(0).alias("ord"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit(f"# {top}").alias("line"))
    write_ordered_lines(head.unionByName(body.withColumn("ord", F.lit(1))), ["ord", *by, "at"], path)


def write_scan(points: DataFrame, path: str, parameter: str, names: list[str], branches: bool = False) -> None:
    """One line per swept value (param_value, obs, value); with ``branches``, obs_fwd and obs_bwd column pairs."""
    if branches:
        points = points.withColumn("obs", F.concat_ws("_", "obs", "branch"))
        names = [f"{n}_{b}" for n in names for b in ("fwd", "bwd")]
    lines = _wide_lines(points, [], "param_value", names, f"# {parameter}")
    write_ordered_lines(lines, ["at"], path)


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """(param, param_value, obs, branch, value) from a sweep's directory; branch null for a plain scan."""
    lines = text_rows(spark, path).withColumn("file", F.regexp_replace("file", "/[^/]*$", ""))
    heads = lines.filter(F.col("line").startswith("#")).groupBy("file").agg(F.min("line").alias("head"))
    heads = heads.select("file", fields(F.col("head")).alias("names"))
    if few_files(lines):
        heads = F.broadcast(heads)
    rows = lines.filter(~F.col("line").startswith("#")).join(heads, "file")
    rows = rows.withColumn("values", F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double")))
    cell = F.explode(F.slice(F.arrays_zip("names", "values"), 2, F.greatest(F.size("values") - 1, F.lit(0))))
    long = rows.select(F.element_at("names", 1).alias("param"), F.element_at("values", 1).alias("param_value"), cell.alias("p"))
    branch = F.nullif(F.regexp_extract("p.names", "_(fwd|bwd)$", 1), F.lit(""))
    return long.select(
        "param", "param_value", F.regexp_replace("p.names", "_(fwd|bwd)$", "").alias("obs"), branch.alias("branch"),
        F.col("p.values").alias("value"),
    )
