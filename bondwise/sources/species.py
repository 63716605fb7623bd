"""Species files and species text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.model import Snapshot
from bondwise.operators.components import connected_components
from bondwise.sources.text import text_rows, write_ordered_lines


def write_species(census: DataFrame, path: str) -> None:
    """Two comment lines with the counts, then ``pattern  count`` sorted by pattern."""
    body = census.select(F.lit(2).alias("ord"), "species", F.concat_ws("  ", "species", F.col("complexes").cast("string")).alias("line"))
    total = census.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("complexes"), F.lit(0)).alias("m"))
    none = F.lit(None).cast("string").alias("species")
    head = total.select(F.lit(1).alias("ord"), none, F.format_string("# %d species, %d complexes", "n", "m").alias("line"))
    title = census.sparkSession.range(1).select(F.lit(0).alias("ord"), none, F.lit("# generated species list").alias("line"))
    write_ordered_lines(title.unionByName(head).unionByName(body), ["ord", "species"], path)


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """(species, count): comments stripped, any white space between the fields, repeated species added up."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = text_rows(spark, path).select(line.alias("line")).filter(F.length("line") > 0)
    hit = r"^(\S+)\s+(\d+)$"
    pairs = rows.filter(F.col("line").rlike(hit)).select(
        F.regexp_extract("line", hit, 1).alias("species"), F.regexp_extract("line", hit, 2).cast("long").alias("count")
    )
    return pairs.groupBy("species").agg(F.sum("count").alias("count"))


def parse_species(texts: DataFrame, type_decl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Species text (species_id, text) to template rows and errors (species_id, error).

    Template rows are (species_id, pos, type, site_idx, site_name, state, partner_pos, partner_site), site_idx
    null for a type without sites. Sites that share a name map to declared ones by occurrence. Only complete,
    connected species pass: every declared site once, concrete allowed states, each bond label on two sites.
    """
    mols = texts.select("species_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^.()]+\([^()]*\))"), 1)).alias("pos", "mol"))
    shape = r"^\s*[A-Za-z_]\w*\([^()]*\)(\s*\.\s*[A-Za-z_]\w*\([^()]*\))*\s*$"
    unreadable = texts.filter(~F.coalesce(F.col("text").rlike(shape), F.lit(False))).select("species_id", F.lit("not a species pattern").alias("error"))
    mols = mols.select(
        "species_id", "pos", F.trim(F.regexp_extract("mol", r"^([^(]*)\(", 1)).alias("type"),
        F.trim(F.regexp_extract("mol", r"\(([^)]*)\)", 1)).alias("inner"),
    )
    types = F.broadcast(type_decl.select("type").distinct())
    bad_type = mols.join(types, "type", "left_anti").select("species_id", F.lit("unknown type").alias("error"))
    given = mols.filter(F.length("inner") > 0).select("species_id", "pos", "type", F.posexplode(F.split("inner", ",")).alias("at", "site"))
    form = r"^\s*([A-Za-z_]\w*)(~(\w+))?(!([0-9]+))?\s*$"
    given = given.select(
        "species_id", "pos", "type", "at", F.col("site").rlike(form).alias("ok"), F.regexp_extract("site", form, 1).alias("site_name"),
        F.nullif(F.regexp_extract("site", form, 3), F.lit("")).alias("state"), F.nullif(F.regexp_extract("site", form, 5), F.lit("")).alias("bond"),
    )
    bad_site = given.filter(~F.col("ok")).select("species_id", F.lit("site is not name~state!bond").alias("error"))
    # occurrence number within one molecule: its site list is short, so a collected array decides it
    listed = given.groupBy("species_id", "pos", "type").agg(F.array_sort(F.collect_list(F.struct("at", "site_name", "state", "bond"))).alias("s"))
    seen = F.transform("s", lambda x: F.struct(
        x["site_name"].alias("site_name"), x["state"].alias("state"), x["bond"].alias("bond"),
        F.size(F.filter("s", lambda y: (y["site_name"] == x["site_name"]) & (y["at"] <= x["at"]))).alias("occ"),
    ))
    given = listed.select("species_id", "pos", "type", F.explode(seen).alias("g")).select("species_id", "pos", "type", "g.*")
    decl = type_decl.filter("site_name is not null").groupBy("type", "site_name").agg(
        F.array_sort(F.collect_list(F.struct("site_idx", "allowed_states"))).alias("d")
    ).select("type", "site_name", F.posexplode("d").alias("o", "d"))
    decl = decl.select("type", "site_name", (F.col("o") + 1).alias("occ"), F.col("d.site_idx").cast("long").alias("site_idx"), "d.allowed_states")
    met = given.join(F.broadcast(decl), ["type", "site_name", "occ"], "left")
    known = met.join(types, "type", "left_semi")
    extra = known.filter("site_idx is null").select("species_id", F.lit("site not declared or repeated").alias("error"))
    want = mols.join(F.broadcast(decl), "type").select("species_id", "pos", "site_idx")
    missing = want.join(met.select("species_id", "pos", "site_idx"), ["species_id", "pos", "site_idx"], "left_anti")
    missing = missing.select("species_id", F.lit("declared site missing").alias("error"))
    has_states = F.coalesce(F.size("allowed_states"), F.lit(0)) > 0
    legal = F.when(has_states, F.coalesce(F.array_contains("allowed_states", F.col("state")), F.lit(False))).otherwise(F.col("state").isNull())
    bad_state = met.filter("site_idx is not null").filter(~legal).select("species_id", F.lit("state missing or not allowed").alias("error"))
    bonded = met.filter("bond is not null")
    ends = bonded.groupBy("species_id", "bond").agg(F.count(F.lit(1)).alias("n"))
    bad_bond = ends.filter("n <> 2").select("species_id", F.lit("bond label not on two sites").alias("error"))
    far = bonded.select("species_id", "bond", F.col("pos").alias("partner_pos"), F.col("site_idx").alias("partner_site"))
    linked = bonded.select("species_id", "bond", "pos", "site_idx").join(far, ["species_id", "bond"]).filter(
        "pos <> partner_pos or site_idx <> partner_site"
    ).select("species_id", "pos", "site_idx", "partner_pos", "partner_site")
    # connected: the text's own graph, one vertex per molecule
    vertex = lambda p: F.xxhash64("species_id", p)
    parts = connected_components(
        mols.select(vertex("pos").alias("node_id")), linked.select(vertex("pos").alias("node_a"), vertex("partner_pos").alias("node_b"))
    )
    split = mols.select("species_id", vertex("pos").alias("node_id")).join(parts, "node_id").groupBy("species_id").agg(
        (F.min("complex_id") != F.max("complex_id")).alias("split")
    )
    apart = split.filter("split").select("species_id", F.lit("not connected").alias("error"))
    errors = reduce(DataFrame.unionByName, [unreadable, bad_type, bad_site, extra, missing, bad_state, bad_bond, apart]).distinct()
    sites = met.select("species_id", "pos", "type", "site_idx", "site_name", "state").join(linked, ["species_id", "pos", "site_idx"], "left")
    bare = mols.filter(F.length("inner") == 0).select("species_id", "pos", "type")
    rows = sites.unionByName(bare, allowMissingColumns=True).join(errors.select("species_id").distinct(), "species_id", "left_anti")
    return rows.select("species_id", "pos", "type", "site_idx", "site_name", "state", "partner_pos", "partner_site"), errors


def species_graph(template: DataFrame) -> tuple[Snapshot, DataFrame]:
    """One copy of each parsed species as a snapshot, and (node_id, species_id, complex_id).

    Node ids are hashes of (species, position); a clash would show as a repeated site in the link check.
    """
    node = F.xxhash64("species_id", "pos")
    ids = template.select("species_id", "pos", "type").distinct().select(node.alias("node_id"), "type", "species_id")
    home = ids.groupBy("species_id").agg(F.min("node_id").alias("complex_id"))
    sites = template.filter("site_idx is not null").select(
        node.alias("node_id"), "type", "site_idx", "site_name", "state",
        F.when(F.col("partner_pos").isNotNull(), F.xxhash64("species_id", "partner_pos")).alias("partner_node"), "partner_site",
    )
    return Snapshot(ids.select("node_id", "type"), sites), ids.join(home, "species_id").select("node_id", "species_id", "complex_id")


def species_lookup(texts: DataFrame, type_decl: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(species_id, class_id, count) for species text against classified complexes, 0 where absent, and errors.

    ``ids`` is the (complex_id, class_id) table of the snapshot; text goes through the same classification, so it
    need not be canonical itself.
    """
    from bondwise.operators.canonical import classes

    template, errors = parse_species(texts, type_decl)
    snap, home = species_graph(template)
    mine, _, _ = classes(snap, home.select("node_id", "complex_id"))
    named = mine.join(home.select("species_id", "complex_id").distinct(), "complex_id").select("species_id", "class_id")
    live = ids.groupBy("class_id").agg(F.count(F.lit(1)).alias("count"))
    found = named.join(live, "class_id", "left")
    return found.select("species_id", "class_id", F.coalesce("count", F.lit(0)).alias("count")), errors
