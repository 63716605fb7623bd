"""Batches of edits on a snapshot, instantiation and removal of species."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondwise.functions.combinatorics import distinct_sum, subsets
from bondwise.model import SITE_COLS, Mol, Snapshot
from bondwise.operators.draw import first_n
from bondwise.operators.order import PART_ROWS, running_sum
from bondwise.operators.skew import hub_join
from bondwise.operators.spanning import cut_labels, judge
from bondwise.session import cut, cut_measured

STATE_OPS = ("set_state", "inc_state", "dec_state")
OPS = (*STATE_OPS, "add_bond", "delete_bond", "add_node", "delete_node", "delete_complex")
COPY_CHUNK = 100_000


def expand_complex_deletes(edits: DataFrame, complexes: DataFrame) -> DataFrame:
    """Replace delete_complex by a delete_node for each member."""
    whole = edits.filter("op = 'delete_complex'").select("edit_id", "node_id")
    if complexes is None:
        return edits
    hit = whole.join(complexes, "node_id").select("edit_id", "complex_id").distinct()
    gone = complexes.join(hit, "complex_id").select("edit_id", F.lit("delete_node").alias("op"), "node_id")
    unknown = whole.join(complexes, "node_id", "left_anti").select("edit_id", F.lit("delete_node").alias("op"), "node_id")
    kept = edits.filter("op <> 'delete_complex'")
    return kept.unionByName(gone, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)


def _bond_ends(edits: DataFrame) -> DataFrame:
    near = edits.select("edit_id", "op", "node_id", "site_idx", "new_state")
    far = edits.filter("op = 'add_bond'").select(
        "edit_id", "op", F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"), "new_state"
    )
    return near.unionByName(far)


def _named_sites(snap: Snapshot, edits: DataFrame, new_sites: DataFrame) -> DataFrame:
    """(node_id, site_idx, edit_id, op, new_state, type, site_name, state, partner_node, partner_site): each site that an edit names as it was before, written out."""
    sites = snap.sites.select(*SITE_COLS).unionByName(new_sites.drop("edit_id").select(*SITE_COLS))
    ends = _bond_ends(edits.filter(~F.col("op").isin("add_node", "delete_node")))
    found = ends.join(sites.select("node_id", "site_idx", "type", "site_name", "state", "partner_node", "partner_site"),
                      ["node_id", "site_idx"], "left")
    return cut(found, "touched-sites")


def edit_errors(snap: Snapshot, edits: DataFrame, found: DataFrame, type_decl: DataFrame) -> DataFrame:
    """(edit_id, error): edits that name something absent, are impossible, or clash with another edit; ``found`` are the named sites.

    An edit is all rows with one edit_id. Edits clash when they set the same state, use the same site for a bond,
    or one deletes a node that the other touches; nothing is decided by order.
    """
    bad_site = found.filter("type is null").select("edit_id", F.lit("no such site").alias("error"))
    on_free = found.filter("op = 'delete_bond' and type is not null and partner_node is null").select(
        "edit_id", F.lit("site has no bond").alias("error")
    )
    on_bound = found.filter("op = 'add_bond' and partner_node is not null").select(
        "edit_id", F.lit("site is already bound").alias("error")
    )
    loop = edits.filter("op = 'add_bond' and node_id = partner_node and site_idx = partner_site").select(
        "edit_id", F.lit("site bound to itself").alias("error")
    )
    allowed = type_decl.select("type", "site_name", "allowed_states").dropDuplicates(["type", "site_name"])
    bad_state = (
        found.filter("op = 'set_state'").join(F.broadcast(allowed), ["type", "site_name"], "left")
        .filter(~F.coalesce(F.array_contains("allowed_states", F.col("new_state")), F.lit(False)))
        .select("edit_id", F.lit("state not allowed").alias("error"))
    )
    deletes = edits.filter("op = 'delete_node'").select("edit_id", "node_id")
    no_node = deletes.join(snap.nodes, "node_id", "left_anti").select("edit_id", F.lit("no such node").alias("error"))
    added = edits.filter("op = 'add_node'").select("edit_id", "node_id")
    in_use = added.join(snap.nodes, "node_id", "left_semi").select("edit_id", F.lit("node id in use").alias("error"))

    facet = F.when(F.col("op").isin(*STATE_OPS), "state").otherwise("bond")
    touch = found.select("edit_id", "node_id", "site_idx", facet.alias("facet"), F.lit(False).alias("by_delete"))
    freed = found.filter("op = 'delete_bond' and partner_node is not null").select(
        "edit_id", F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"), F.lit("bond").alias("facet"),
        F.lit(False).alias("by_delete"),
    )
    dropped = deletes.join(snap.sites, "node_id").filter("partner_node is not null").select(
        "edit_id", F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"), F.lit("bond").alias("facet"),
        F.lit(True).alias("by_delete"),
    )
    touch, seen = cut_measured(touch.unionByName(freed).unionByName(dropped), "touches")
    # such rows are short and alike, so many of them pass for a small part: the number of parts follows the rows
    count = seen["n_rows"] // PART_ROWS + 1
    parts = max(count, int(touch.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if count > 1 else None
    # a site is touched by few edits or is in error; the counts pre-aggregate either way
    place = ["node_id", "site_idx", "facet"]
    crowded = touch.groupBy(*place).agg(
        F.count(F.lit(1)).alias("deg"), F.bool_and("by_delete").alias("only_deletes")
    ).filter("deg > 1 and not only_deletes").drop("only_deletes")
    clash = hub_join(touch, crowded, place, seen["n_rows"], parts=parts)
    clash = clash.select("edit_id", F.lit("site touched twice").alias("error"))
    twice = deletes.unionByName(added).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node_id")
    doubled = deletes.unionByName(added).join(twice, "node_id", "left_semi").select("edit_id", F.lit("node given twice").alias("error"))
    # a node that is both touched and deleted gets one flag; touches and deletes then meet the flag, not each other
    live_touch = touch.filter("not by_delete").select("edit_id", "node_id")
    both = live_touch.select("node_id", F.lit(True).alias("touched")).unionByName(deletes.select("node_id", F.lit(False).alias("touched")))
    flagged = both.groupBy("node_id").agg(F.bool_or("touched").alias("touched"), F.bool_or(~F.col("touched")).alias("deleted")).filter("touched and deleted").select("node_id")
    killed = live_touch.unionByName(deletes).join(flagged, "node_id", "left_semi").select("edit_id")
    killed = killed.select("edit_id", F.lit("touches a deleted node").alias("error"))
    every = reduce(DataFrame.unionByName, [bad_site, on_free, on_bound, loop, bad_state, no_node, in_use, clash, doubled, killed])
    return (every.repartition(parts, "edit_id") if parts else every).distinct()


def apply_edits(snap: Snapshot, edits: DataFrame, type_decl: DataFrame, complexes: DataFrame | None = None,
                errors: DataFrame | None = None) -> tuple[Snapshot, DataFrame]:
    """(edited snapshot, errors). Edits listed in ``errors`` are left out whole; all others apply at once.

    Incremented and decremented states stop at the ends of the site's state list. New nodes take their type from
    ``new_state`` and get the declared sites in their first state. A deleted node frees its neighbours' sites.
    """
    edits, seen = cut_measured(expand_complex_deletes(edits, complexes), "edits", deletes=F.count_if(F.col("op") == "delete_node"))
    fresh = edits.filter("op = 'add_node'").select("edit_id", "node_id", F.col("new_state").alias("type"))
    no_partner = F.lit(None).cast("long")
    first_state = F.when(F.size("allowed_states") > 0, F.element_at("allowed_states", 1))
    new_sites = fresh.join(F.broadcast(type_decl), "type").select(
        "edit_id", "node_id", "type", F.col("site_idx").cast("long").alias("site_idx"), "site_name",
        first_state.alias("state"), no_partner.alias("partner_node"), no_partner.alias("partner_site"),
    )
    found = _named_sites(snap, edits, new_sites)
    if errors is None:
        errors = cut(edit_errors(snap, edits, found, type_decl), "edit-errors")
    bad = errors.select("edit_id")  # an edit may have several errors, which anti joins need not know
    good = edits.join(bad, "edit_id", "left_anti")
    new_sites = new_sites.join(bad, "edit_id", "left_anti").select(*SITE_COLS)
    new_nodes = fresh.join(bad, "edit_id", "left_anti").select("node_id", "type")
    gone = good.filter("op = 'delete_node'").select("node_id")
    # a batch that deletes no node need not look for deleted ones among all sites
    stays = lambda rows: rows.join(gone, "node_id", "left_anti") if seen["deletes"] else rows
    nodes = stays(snap.nodes).unionByName(new_nodes)
    sites = stays(snap.sites.select(*SITE_COLS)).unionByName(new_sites)

    # one change row per touched site: states and bonds of a site come from different edits
    states = good.filter(F.col("op").isin(*STATE_OPS)).select("node_id", "site_idx", "op", "new_state")
    add = good.filter("op = 'add_bond'")
    bound = add.select("node_id", "site_idx", "partner_node", "partner_site").unionByName(
        add.select(
            F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"),
            F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"),
        )
    )
    cut_ends = good.filter("op = 'delete_bond'").select("node_id", "site_idx")
    cut_far = found.filter("op = 'delete_bond' and type is not null").join(bad, "edit_id", "left_anti").select(
        F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx")
    )
    freed = cut_ends.unionByName(cut_far)
    if seen["deletes"]:
        gone_far = snap.sites.join(gone, "node_id", "left_semi").filter("partner_node is not null")
        freed = freed.unionByName(gone_far.select(F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx")))
    freed = freed.distinct()
    none_s = F.lit(None).cast("string")
    change = (
        states.select("node_id", "site_idx", "op", "new_state", no_partner.alias("to_node"), no_partner.alias("to_site"), F.lit(False).alias("free"))
        .unionByName(bound.select("node_id", "site_idx", none_s.alias("op"), none_s.alias("new_state"),
                                  F.col("partner_node").alias("to_node"), F.col("partner_site").alias("to_site"), F.lit(False).alias("free")))
        .unionByName(freed.select("node_id", "site_idx", none_s.alias("op"), none_s.alias("new_state"),
                                  no_partner.alias("to_node"), no_partner.alias("to_site"), F.lit(True).alias("free")))
        .groupBy("node_id", "site_idx")
        .agg(*[F.max(c).alias(c) for c in ("op", "new_state", "to_node", "to_site", "free")])
    )
    change = cut(change, "changes")
    merged = sites.join(change, ["node_id", "site_idx"], "left").join(
        F.broadcast(type_decl.select("type", "site_name", "allowed_states").dropDuplicates(["type", "site_name"])), ["type", "site_name"], "left"
    )
    at = F.array_position("allowed_states", F.col("state")).cast("int")
    up = F.element_at("allowed_states", F.least(at + 1, F.size("allowed_states")))
    down = F.element_at("allowed_states", F.greatest(at - 1, F.lit(1)))
    known = at > 0
    state = (
        F.when(F.col("op") == "set_state", F.col("new_state"))
        .when((F.col("op") == "inc_state") & known, up)
        .when((F.col("op") == "dec_state") & known, down)
        .otherwise(F.col("state"))
    )
    free = F.coalesce("free", F.lit(False)) & F.col("to_node").isNull()
    out = merged.select(
        "node_id", "type", "site_idx", "site_name", state.alias("state"),
        F.when(free, None).otherwise(F.coalesce("to_node", "partner_node")).alias("partner_node"),
        F.when(free, None).otherwise(F.coalesce("to_site", "partner_site")).alias("partner_site"),
    )
    return Snapshot(nodes, out), errors


def touched_sites(snap: Snapshot, edits: DataFrame, type_decl: DataFrame) -> DataFrame:
    """(edit_id, node_id, site_idx, type, site_name, state, partner_node, new_state, new_partner): an overlay of each match, the sites it touches before and after.

    Every match sees its own edits only; nothing is written to the snapshot. Both ends of a bond are touched, and so are sites that a deleted node lets go.
    """
    none = lambda kind: F.lit(None).cast(kind)
    named = edits.filter(F.col("op").isin(*STATE_OPS, "add_bond", "delete_bond"))
    change = lambda op, far, free: F.struct(op.alias("op"), F.col("new_state").alias("to_state"), far.alias("to_node"), F.lit(free).alias("free"))
    state = F.when(F.col("op").isin(*STATE_OPS), F.col("op"))
    near = named.select("edit_id", "node_id", "site_idx", F.when(F.col("op") == "delete_bond", change(none("string"), none("long"), True)).otherwise(
        change(state, F.when(F.col("op") == "add_bond", F.col("partner_node")), False)).alias("x"))
    bare = F.struct(none("string").alias("op"), none("string").alias("to_state"), none("long").alias("to_node"), F.lit(True).alias("free"))
    far = edits.filter("op = 'add_bond'").select("edit_id", F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"),
                                                 F.struct(none("string").alias("op"), none("string").alias("to_state"), F.col("node_id").alias("to_node"), F.lit(False).alias("free")).alias("x"))
    ends = snap.sites.filter("partner_node is not null")
    let_go = edits.filter("op = 'delete_bond'").select("edit_id", "node_id", "site_idx").join(ends.select("node_id", "site_idx", "partner_node", "partner_site"), ["node_id", "site_idx"])
    lost = edits.filter("op = 'delete_node'").select("edit_id", "node_id").join(ends.select("node_id", "partner_node", "partner_site"), "node_id")
    freed = let_go.select("edit_id", "partner_node", "partner_site").unionByName(lost.select("edit_id", "partner_node", "partner_site"))
    freed = freed.select("edit_id", F.col("partner_node").alias("node_id"), F.col("partner_site").alias("site_idx"), bare.alias("x"))
    every = near.unionByName(far).unionByName(freed).groupBy("edit_id", "node_id", "site_idx").agg(
        F.max("x.op").alias("op"), F.max("x.to_state").alias("to_state"), F.max("x.to_node").alias("to_node"), F.max("x.free").alias("free")
    )
    allowed = type_decl.select("type", "site_name", "allowed_states").dropDuplicates(["type", "site_name"])
    rows = every.join(snap.sites.select("node_id", "site_idx", "type", "site_name", "state", "partner_node"), ["node_id", "site_idx"]).join(allowed, ["type", "site_name"], "left")
    at = F.array_position("allowed_states", F.col("state")).cast("int")
    step = F.when(F.col("op") == "inc_state", F.element_at("allowed_states", F.least(at + 1, F.size("allowed_states")))).when(F.col("op") == "dec_state", F.element_at("allowed_states", F.greatest(at - 1, F.lit(1))))
    new_state = F.when(F.col("op") == "set_state", F.col("to_state")).when((at > 0) & F.col("op").isNotNull(), step).otherwise(F.col("state"))
    new_partner = F.when(F.col("to_node").isNotNull(), F.col("to_node")).when(~F.col("free"), F.col("partner_node"))
    return rows.select("edit_id", "node_id", "site_idx", "type", "site_name", "state", "partner_node", new_state.alias("new_state"), new_partner.alias("new_partner"))


def constrained_after(snap: Snapshot, matches: DataFrame, edits: DataFrame, type_decl: DataFrame, include: tuple[Mol, ...] = (), exclude: tuple[Mol, ...] = ()) -> DataFrame:
    """Matches (edit_id, node_id) whose node fits at least one of ``include`` and none of ``exclude`` once the match's own edits are made.

    A node's condition counts are taken once for all its matches; each match adds what its touched sites change, so no match reads its node's other sites.
    """
    touched = touched_sites(snap, edits, type_decl).join(matches, ["edit_id", "node_id"], "left_semi")
    before = touched.select("edit_id", "node_id", "type", "site_name", "state", "partner_node", F.lit(-1).alias("sign"))
    after = touched.select("edit_id", "node_id", "type", "site_name", F.col("new_state").alias("state"), F.col("new_partner").alias("partner_node"), F.lit(1).alias("sign"))
    moved = cut(before.unionByName(after), "overlay")
    own = snap.sites.join(matches.select("node_id").distinct(), "node_id", "left_semi")

    def fitting(m: Mol) -> DataFrame:
        here = matches.join(snap.nodes.filter(F.col("type") == m.type), "node_id", "left_semi")
        if not m.slots:
            return here
        names: dict[str, list] = {}
        for s in m.slots:
            names.setdefault(s.family, []).append(s)
        label = {(n, b): f"n{k}_" + "_".join(map(str, b)) for k, (n, slots) in enumerate(names.items()) for b in subsets(len(slots))}
        cond = lambda n, b: reduce(lambda x, y: x & y, (names[n][i].predicate() for i in b))
        base = own.filter(F.col("type") == m.type).groupBy("node_id").agg(*[F.count_if(cond(*key)).alias(name) for key, name in label.items()])
        delta = moved.groupBy("edit_id", "node_id").agg(*[F.sum(F.when(cond(*key), F.col("sign")).otherwise(0)).alias("d" + name) for key, name in label.items()])
        rows = here.join(base, "node_id", "left").join(delta, ["edit_id", "node_id"], "left")
        count = lambda n: lambda b: F.coalesce(label[n, b], F.lit(0)) + F.coalesce("d" + label[n, b], F.lit(0))
        ways = reduce(lambda x, y: x * y, (distinct_sum(tuple(range(len(slots))), count(n)) for n, slots in names.items()))
        return rows.filter(ways > 0).select("edit_id", "node_id")

    kept = matches.select("edit_id", "node_id")
    if include:
        kept = kept.join(reduce(DataFrame.unionByName, (fitting(m).select("edit_id", "node_id") for m in include)), ["edit_id", "node_id"], "left_semi")
    for m in exclude:
        kept = kept.join(fitting(m).select("edit_id", "node_id"), ["edit_id", "node_id"], "left_anti")
    return kept


MATCH_ROW = "edit_id long, node_id long, site_idx long, connected boolean"


def still_connected(snap: Snapshot, complexes: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit_id, node_id, site_idx, connected): for each delete_bond, whether its two ends still share a complex after the edits of its own match.

    A match is all rows with one edit_id; every match is judged on the snapshot as it is, whatever the others do. All bonds it deletes and adds count, also
    those to nodes it adds. Only complexes that lose a bond are looked at, once for all matches; a match is then judged from the labels of its few links.
    A match holds no more edits than a rule has operations, so its rows meet in one task. A bond from a node to itself leaves its ends connected.
    """
    gone = edits.filter("op = 'delete_bond'").select("edit_id", "node_id", "site_idx").join(
        snap.sites.select("node_id", "site_idx", "partner_node", "partner_site"), ["node_id", "site_idx"]
    ).filter("partner_node is not null")
    gone = cut(gone, "cut-bonds")
    hit = complexes.join(gone.select("node_id"), "node_id", "left_semi").select("complex_id").distinct()
    inside = cut(complexes.join(hit, "complex_id", "left_semi").select("node_id", "complex_id"), "cut-complexes")
    links = snap.links().join(inside.select(F.col("node_id").alias("node_a")), "node_a", "left_semi")
    labelled, places = cut_labels(cut(links, "cut-links"), inside)
    swap = (F.col("node_id") > F.col("partner_node")) | ((F.col("node_id") == F.col("partner_node")) & (F.col("site_idx") > F.col("partner_site")))
    lower = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one))
    known = gone.withColumns({"node_a": lower("node_id", "partner_node"), "site_a": lower("site_idx", "partner_site")})
    known = known.join(labelled.select("node_a", "site_a", "label", "first", "last"), ["node_a", "site_a"], "left")
    at = lambda name, cx, place: places.select(F.col("node_id").alias(name), F.col("complex_id").alias(cx), F.col("place").alias(place))
    known = known.join(at("node_id", "complex_id", "place"), "node_id").join(at("partner_node", "far_complex", "far_place"), "partner_node")
    add = edits.filter("op = 'add_bond'").select("edit_id", "node_id", "partner_node").join(gone.select("edit_id").distinct(), "edit_id", "left_semi")
    # a complex without deleted bonds is one piece, and so is a node that the match adds
    home = complexes.select("node_id", "complex_id").join(places.select("node_id", "place"), "node_id", "left")
    end = lambda name, cx, place: home.select(F.col("node_id").alias(name), F.col("complex_id").alias(cx), F.col("place").alias(place))
    add = add.join(end("node_id", "complex_id", "place"), "node_id", "left").join(end("partner_node", "far_complex", "far_place"), "partner_node", "left")
    add = add.withColumns({
        "complex_id": F.coalesce("complex_id", "node_id"), "far_complex": F.coalesce("far_complex", "partner_node"),
        "place": F.coalesce("place", F.lit(-1)), "far_place": F.coalesce("far_place", F.lit(-1)),
    })
    row = F.struct("node_id", "site_idx", "label", "first", "last", "complex_id", "place", "far_place", "far_complex")
    rows = known.select("edit_id", F.lit(True).alias("cut"), row.alias("row")).unionByName(
        add.withColumns({c: F.lit(None).cast("long") for c in ("site_idx", "label", "first", "last")}).select("edit_id", F.lit(False).alias("cut"), row.alias("row"))
    )
    matches = rows.groupBy("edit_id").agg(F.collect_list(F.when(F.col("cut"), F.col("row"))).alias("gone"), F.collect_list(F.when(~F.col("cut"), F.col("row"))).alias("added"))

    def each(batches):
        for batch in batches:
            out = {"edit_id": [], "node_id": [], "site_idx": [], "connected": []}
            for edit_id, cuts, added in zip(*(batch.column(c).to_pylist() for c in ("edit_id", "gone", "added"))):
                proper = [c for c in cuts if c["label"] is not None]
                kept = [True] * (len(cuts) - len(proper)) + judge(proper, added)
                for c, good in zip([c for c in cuts if c["label"] is None] + proper, kept):
                    for name, value in (("edit_id", edit_id), ("node_id", c["node_id"]), ("site_idx", c["site_idx"]), ("connected", good)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({name: pa.array(v, pa.bool_() if name == "connected" else pa.int64()) for name, v in out.items()})

    return matches.mapInArrow(each, MATCH_ROW)


def instantiate(copies: DataFrame, template: DataFrame, first_id: int) -> Snapshot:
    """New nodes and sites for ``copies`` (species_id, copies) of template complexes.

    ``template`` has a row per site: (species_id, pos, type, site_idx, site_name, state, partner_pos,
    partner_site), site_idx null for a node without sites. Ids are first_id, then dense over species, copy and
    position. Copies are laid out in chunks spread over tasks, so one abundant species does not fill one task.
    """
    size = template.groupBy("species_id").agg((F.max("pos") + 1).alias("size"))
    plan = copies.filter("copies > 0").join(size, "species_id").withColumn("ids", F.col("copies") * F.col("size"))
    plan = running_sum(plan, [], ["species_id"], "ids", "upto").withColumn("start", F.lit(first_id) + F.col("upto") - F.col("ids"))
    # species meet the template before they are copied: no join ever sees the copies, whose number no plan can foresee
    last = F.expr(f"(copies - 1) div {COPY_CHUNK}")
    lo = F.col("chunk") * COPY_CHUNK
    hi = F.least(lo + COPY_CHUNK, F.col("copies")) - 1
    tasks = int(template.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def laid_out(rows: DataFrame) -> DataFrame:
        # a given number of parts, since a chunk is a short row, and short rows would be put back into one task
        chunks = plan.join(rows, "species_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(tasks)
        each = chunks.withColumn("copy", F.explode(F.sequence(lo, hi)))
        return each.withColumn("base", F.col("start") + F.col("copy") * F.col("size"))

    node_id = (F.col("base") + F.col("pos")).alias("node_id")
    nodes = laid_out(template.select("species_id", "pos", "type").distinct()).select(node_id, "type")
    sites = laid_out(template.filter("site_idx is not null")).select(
        node_id, "type", "site_idx", "site_name", "state", (F.col("base") + F.col("partner_pos")).alias("partner_node"), "partner_site",
    )
    return Snapshot(nodes, sites)


def add_copies(snap: Snapshot, copies: DataFrame, template: DataFrame) -> Snapshot:
    top = snap.nodes.agg(F.max("node_id")).first()[0]
    new = instantiate(copies, template, 0 if top is None else top + 1)
    return Snapshot(snap.nodes.unionByName(new.nodes), snap.sites.unionByName(new.sites))


def remove_nodes(snap: Snapshot, gone: DataFrame) -> Snapshot:
    """Drop whole complexes given by their node ids; nothing outside is linked to them."""
    return Snapshot(snap.nodes.join(gone, "node_id", "left_anti"), snap.sites.join(gone, "node_id", "left_anti"))


def remove_copies(snap: Snapshot, complexes: DataFrame, ids: DataFrame, class_id: str, n: int) -> Snapshot:
    """Remove ``n`` complexes of one class (``ids`` has complex_id, class_id); an error when fewer exist."""
    if n <= 0:
        raise ValueError("count must be positive")
    live = ids.filter(F.col("class_id") == class_id).select("complex_id")
    have = live.count()
    if have < n:
        raise ValueError(f"only {have} copies of {class_id}, {n} requested")
    gone = complexes.join(first_n(live, "complex_id", n), "complex_id", "left_semi").select("node_id")
    return remove_nodes(snap, gone)


def set_count(snap: Snapshot, complexes: DataFrame, ids: DataFrame, class_id: str, target: int, template: DataFrame) -> Snapshot:
    """Add or remove copies so that exactly ``target`` complexes of the class exist."""
    if target < 0:
        raise ValueError("count must not be negative")
    delta = target - ids.filter(F.col("class_id") == class_id).count()
    if delta < 0:
        return remove_copies(snap, complexes, ids, class_id, -delta)
    if delta == 0:
        return snap
    copies = template.select("species_id").distinct().withColumn("copies", F.lit(delta).cast("long"))
    return add_copies(snap, copies, template)


def clamp_population(snap: Snapshot, matching: DataFrame, target: int, template: DataFrame) -> Snapshot:
    """Hold free single nodes (``matching`` has their node_id) at ``target``: add from the template or remove the excess."""
    delta = target - matching.count()
    if delta > 0:
        copies = template.select("species_id").distinct().withColumn("copies", F.lit(delta).cast("long"))
        return add_copies(snap, copies, template)
    if delta < 0:
        return remove_nodes(snap, first_n(matching.select("node_id"), "node_id", -delta))
    return snap
