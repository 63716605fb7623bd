"""Table functions, model annotations, run logs and file manifests."""

from __future__ import annotations

import ctypes
import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bondwise.session import cut
from bondwise.sources.text import file_stem, small_files, split_lines, text_rows, write_ordered_lines

# Lines of a report that one window sees together.
PIECE_LINES = 100_000
# A file of more than WHOLE_BYTES is hashed in pieces, READ_BYTES at a time.
WHOLE_BYTES, PIECE_BYTES, READ_BYTES = 64 << 20, 256 << 20, 4 << 20
# The size of OpenSSL's SHA256_CTX.
STATE_BYTES = 112
# The line formats of run logs, reports and model comments.
INVARIANT_LINE = r"^#\s*invariant\s*:\s*(.+?)\s*$"
INVARIANT_KINDS = r"^(nonneg|conserved|balance)\b"
FEATURE_LINE = r"^# (Feature|Tests:|Bug pattern:)"
SIMULATE_ACTION = r"simulate\w*\s*\(\s*\{([^}]+)\}"
ACTION_PARAM = r'param\s*=>\s*"([^"]*)"'
ACTION_END = r"t_end\s*=>\s*([0-9.eE+\-]+)"
ACTION_STEPS = r"n_steps\s*=>\s*([0-9]+)"
EVENTS_LINE = r"events=(\d+)"
NULLS_LINE = r"null=(\d+)"
TOTAL_LINE = r"total=([\d.]+)s"
PHASES = ["select_reactants", "fire_rule", "observables", "incr_update"]
FOOTPRINT_LINE = r"arena=(\d+) rules=(\d+) tabled=(\d+) bytes=(\d+) \([\d.]+ MB\) mol=(\d+) sampler=(\d+) reach_bytes=(\d+)"
PER_RULE_LINE = r"^\s*(\S+) \(.*\): rows=(\d+) reach=(\d+) mol=(\d+) sampler=(\d+)$"
SECTION_LINE = r"^###\s+(\S+)"
WALL_LINE = r"^-\s+\S+ reps:.*wall time:\s+([0-9.]+)s"


def read_tfun(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, idx, x, y) points of table-function files, and (name, line) of malformed rows."""
    rows = small_files(spark, path).filter(~F.col("line").startswith("#"))
    cell = F.split("line", r"[\s,]+")
    parsed = rows.select(
        file_stem(F.col("file"), ".tfun").alias("name"), "line_no", "line", F.get(cell, 0).try_cast("double").alias("x"),
        F.get(cell, 1).try_cast("double").alias("y"),
    )
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    points = parsed.filter(ok).withColumn("idx", F.row_number().over(W.partitionBy("name").orderBy("line_no")) - 1)
    return points.select("name", "idx", "x", "y"), parsed.filter(~ok).select("name", "line")


def inline_points(tables: DataFrame) -> DataFrame:
    """(name, idx, x, y) from inline lists (name, xs, ys), comma-separated text."""
    pairs = F.arrays_zip(F.split("xs", r"\s*,\s*").alias("x"), F.split("ys", r"\s*,\s*").alias("y"))
    rows = tables.select("name", F.posexplode(pairs).alias("idx", "p"))
    return rows.select("name", "idx", F.col("p.x").try_cast("double").alias("x"), F.col("p.y").try_cast("double").alias("y"))


def read_annotations(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(model, kind, lhs, rhs, expected) of invariant comments in model text."""
    rows = text_rows(spark, path).select(file_stem(F.col("file"), suffix).alias("model"), "line")
    spec = F.regexp_extract("line", INVARIANT_LINE, 1)
    rows = rows.select("model", spec.alias("spec")).filter("spec <> ''")
    kind = F.regexp_extract("spec", INVARIANT_KINDS, 1)
    rest = F.trim(F.regexp_replace("spec", r"^\w+\s*", ""))
    lhs = F.trim(F.get(F.split(rest, "=", 2), 0))
    rhs = F.trim(F.get(F.split(rest, "=", 2), 1))
    out = rows.select("model", kind.alias("kind"), lhs.alias("lhs"), rhs.alias("rhs")).filter("kind <> ''")
    return out.select(
        "model", "kind", F.when(F.col("kind") != "nonneg", F.col("lhs")).alias("lhs"),
        F.when(F.col("kind") == "balance", F.col("rhs")).alias("rhs"),
        F.when(F.col("kind") == "conserved", F.col("rhs").try_cast("double")).alias("expected"),
    )


def read_features(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(model, line_no, feature) from the leading comment block of model text."""
    rows = small_files(spark, path).select(file_stem(F.col("file"), suffix).alias("model"), "line_no", "line")
    end = rows.filter(~F.col("line").startswith("#")).groupBy("model").agg(F.min("line_no").alias("end"))
    head = rows.join(end, "model", "left").filter(F.col("end").isNull() | (F.col("line_no") < F.col("end")))
    wanted = head.filter(F.col("line").rlike(FEATURE_LINE))
    return wanted.select("model", "line_no", F.trim(F.expr("substring(line, 3)")).alias("feature"))


def read_actions(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(model, t_end, n_steps, flags): the last simulate action of a model's text, 100 where unset.

    Actions may span lines, so model files are read whole.
    """
    whole = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path"), suffix).alias("model"), "value")
    args = F.regexp_extract_all("value", F.lit(SIMULATE_ACTION), 1)
    rows = whole.withColumn("args", args)
    pick = lambda pattern: F.filter(F.transform("args", lambda a: F.regexp_extract(a, pattern, 1)), lambda x: x != "")
    last = lambda found: F.try_element_at(found, F.lit(-1))
    param = F.transform("args", lambda a: F.regexp_extract(a, ACTION_PARAM, 1))
    block = F.transform(F.filter(param, lambda x: x.contains("-bscb")), lambda x: F.lit("-bscb"))
    limit = F.transform(F.filter(param, lambda x: x.rlike(r"-utl\s+\d+")), lambda x: F.concat(F.lit("-utl "), F.regexp_extract(x, r"-utl\s+(\d+)", 1)))
    return rows.select(
        "model",
        F.coalesce(last(pick(ACTION_END)), F.lit("100")).cast("double").alias("t_end"),
        F.coalesce(last(pick(ACTION_STEPS)), F.lit("100")).cast("int").alias("n_steps"),
        F.array_join(F.concat(block, limit), " ").alias("flags"),
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, events, nulls, total_s, phase percentages): figures of each run log, 0 where a line is absent."""
    rows = text_rows(spark, path)
    grab = lambda pattern, kind: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast(kind)
    found = rows.select(
        "file", grab(EVENTS_LINE, "long").alias("events"), grab(NULLS_LINE, "long").alias("nulls"),
        grab(TOTAL_LINE, "double").alias("total_s"),
        *[grab(p + r":\s*[\d.]+s\s*\(([\d.]+)%\)", "double").alias(f"{p}_pct") for p in PHASES],
    )
    names = found.columns[1:]
    return found.groupBy("file").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, arena, rules, tabled, table_bytes, mol_bytes, sampler_bytes, reach_bytes, widest_row)."""
    rows = text_rows(spark, path)
    names = ["arena", "rules", "tabled", "table_bytes", "mol_bytes", "sampler_bytes", "reach_bytes"]
    grab = lambda pattern, i: F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).cast("long")
    per_line = rows.select(
        "file", *[grab(FOOTPRINT_LINE, i + 1).alias(n) for i, n in enumerate(names)],
        grab(PER_RULE_LINE, 2).alias("rule_rows"), grab(PER_RULE_LINE, 4).alias("rule_mol"),
    )
    widest = F.expr("rule_mol div greatest(rule_rows, 1)")
    out = per_line.groupBy("file").agg(*[F.max(n).alias(n) for n in names], F.coalesce(F.max(widest), F.lit(0)).alias("widest_row"))
    return out.filter("arena is not null")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, model, wall_s): wall times of report sections; a section's first wall-time line counts."""
    rows = split_lines(spark, path)
    model = F.nullif(F.regexp_extract("line", SECTION_LINE, 1), F.lit(""))
    wall = F.nullif(F.regexp_extract("line", WALL_LINE, 1), F.lit("")).cast("double")
    piece = F.struct("block", F.expr(f"line_no div {PIECE_LINES}").alias("number")).alias("piece")
    marked = rows.select("file", piece, "line_no", model.alias("head"), wall.alias("wall_s")).filter("head is not null or wall_s is not null")
    marked = cut(marked, "report-lines")  # read twice, with the same blocks
    # a piece carries on the section that the pieces before it left open
    last = F.max(F.when(F.col("head").isNotNull(), F.struct("line_no", "head")))
    ends = marked.groupBy("file", "piece").agg(last["head"].alias("last"), F.count("head").alias("n"))
    before = W.partitionBy("file").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)  # one row per piece
    open_head = F.last("last", ignorenulls=True).over(before).alias("open")
    ends = ends.select("file", "piece", open_head, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    here = W.partitionBy("file", "piece").orderBy("line_no")
    down = marked.withColumn("model", F.last("head", ignorenulls=True).over(here)).withColumn("part", F.count("head").over(here))
    inside = down.filter("wall_s is not null").join(ends, ["file", "piece"])
    inside = inside.withColumn("model", F.coalesce("model", "open")).withColumn("part", F.col("part") + F.col("shift")).filter("model is not null")
    first = inside.groupBy("file", "part", "model").agg(F.min(F.struct("piece", "line_no", "wall_s"))["wall_s"].alias("wall_s"))
    return first.groupBy("file", "model").agg(F.max_by("wall_s", "part").alias("wall_s"))


def _resumable_sha256():
    """SHA-256 of OpenSSL with a state that can be carried on elsewhere, or None where Python's own library does not offer it."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        half = _sha256_state(lib)
        lib.SHA256_Update(half, b"a" * 100, ctypes.c_size_t(100))
        rest = ctypes.create_string_buffer(half.raw, STATE_BYTES)
        lib.SHA256_Update(rest, b"b" * 100, ctypes.c_size_t(100))
        return lib if _sha256_end(lib, rest) == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


def _sha256_state(lib, state: bytes | None = None):
    held = ctypes.create_string_buffer(state or b"", STATE_BYTES)
    if state is None:
        lib.SHA256_Init(held)
    return held


def _sha256_end(lib, held) -> str:
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, held)
    return out.raw.hex()


def _file_system(path: str):
    """The file system of a path as Spark lists it, and the path there; raises for schemes that Arrow does not know."""
    scheme, _, rest = path.partition(":") if not path.startswith("/") else ("file", "", path)
    authority, _, inner = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    if scheme == "file":
        return fs.LocalFileSystem(), f"/{inner}"
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def hash_step(path: str, length: int, at: int, state: bytes | None, piece: int) -> tuple[int, bytes | None, str | None]:
    """One task's share of a file: the place it came to, the state there, and at the end of the file the digest.

    Without a resumable SHA-256 the file is hashed from its start, in one go.
    """
    lib = _resumable_sha256()
    system, name = _file_system(path)
    with system.open_input_file(name) as file:
        if lib is None:
            whole = hashlib.sha256()
            while chunk := file.read(READ_BYTES):
                whole.update(chunk)
            return length, None, whole.hexdigest()
        held, end = _sha256_state(lib, state), min(at + piece, length)
        file.seek(at)
        while at < end:
            chunk = file.read(min(READ_BYTES, end - at))
            if not chunk:
                raise OSError(f"{path} ends at {at}, not at {length}")
            lib.SHA256_Update(held, chunk, ctypes.c_size_t(len(chunk)))
            at += len(chunk)
    return (at, None, _sha256_end(lib, held)) if at == length else (at, held.raw, None)


def _large_hashes(spark: SparkSession, large: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(path, sha256) of large files. A SHA-256 is one chain, so each round takes every file one piece further, a task a piece."""
    piece, kind = PIECE_BYTES, "path string, length long, at long, state binary, sha256 string"

    def each(batches):
        for batch in batches:
            rows = [(r["path"], r["length"], *hash_step(r["path"], r["length"], r["at"], r["state"], piece)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], names)

    names = ["path", "length", "at", "state", "sha256"]
    rows, done = [(path, length, 0, None, None) for path, length in large], []
    while rows:
        dealt = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), kind)
        after = [tuple(r) for r in dealt.mapInArrow(each, kind).collect()]
        done += [(r[0], r[4]) for r in after if r[4] is not None]
        rows = [r for r in after if r[4] is None]
    return done


def file_hashes(spark: SparkSession, root: str, skip_dirs: list[str] | None = None, skip_files: list[str] | None = None) -> DataFrame:
    """(path, sha256) of every file under a root, scratch directories and files left out.

    Files of up to ``WHOLE_BYTES`` are read as one value. Larger ones are read in pieces: their number is at most the bytes under the root over
    ``WHOLE_BYTES``, and only names, places and states of 112 bytes pass the driver. On file systems that Arrow does not know, all are read as one value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    clean = lambda c: F.regexp_replace(c, r"^([a-z0-9]+):/+", "$1:/")
    inner = F.substr(clean(F.col("path")), F.length(clean(F.lit(base.rstrip("/")))) + 2)
    parts = F.split(inner, "/")
    keep = F.lit(True)
    if skip_files:
        keep = keep & ~F.element_at(parts, -1).isin(skip_files)
    if skip_dirs:
        keep = keep & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in skip_dirs]))
    kept = files.filter(keep)
    whole = lambda rows: rows.select(inner.alias("path"), F.sha2("content", 256).alias("sha256"))
    large = [tuple(r) for r in kept.filter(F.col("length") > WHOLE_BYTES).select("path", "length").collect()]
    try:
        for path, _ in large[:1]:
            _file_system(path)
    except (OSError, ValueError, NotImplementedError):
        large = []
    if not large:
        return whole(kept)
    hashed = spark.createDataFrame(_large_hashes(spark, large), "path string, sha256 string")
    return whole(kept.filter(F.col("length") <= WHOLE_BYTES)).unionByName(hashed.select(inner.alias("path"), "sha256"))


def write_manifest(hashes: DataFrame, path: str, header: list[str]) -> None:
    """Comment lines, then path and hash separated by a tab, in path order."""
    body = hashes.select(F.lit(len(header)).alias("ord"), "path", F.concat_ws("\t", "path", "sha256").alias("line"))
    rows = [(i, None, f"# {h}") for i, h in enumerate(header)]
    heads = hashes.sparkSession.createDataFrame(rows, "ord int, path string, line string")
    write_ordered_lines(body.unionByName(heads), ["ord", "path"], path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    cell = F.split("line", "\t")
    rows = text_rows(spark, path).filter(~F.col("line").startswith("#")).select(cell.alias("c")).filter(F.size("c") == 2)
    return rows.select(F.get("c", 0).alias("path"), F.get("c", 1).alias("sha256"))
