import random

import pytest
from pyspark.sql import functions as F

from bondwise.model import EDIT, TYPE_DECL, Slot, Snapshot, mol, observable, pattern
from bondwise.operators import canonical, edits, match, quality, spanning
from bondwise.operators.components import complexes_of
from bondwise.session import cut, fresh_path
from bondwise.sources import snapshots, species
from bondwise.streaming.feed import CountFeed
from tests.graphs import graph

DECL = [("A", 0, "s", []), ("A", 1, "s", []), ("A", 2, "m", ["u", "p", "q"]), ("B", 0, "s", [])]


def decl(spark):
    return spark.createDataFrame(DECL, TYPE_DECL)


def chain(spark):
    """A1 - A2 - B3, A4 alone."""
    nodes = {1: "A", 2: "A", 3: "B", 4: "A"}
    sites = [(n, i, "s", None) for n in (1, 2, 4) for i in (0, 1)] + [(n, 2, "m", "u") for n in (1, 2, 4)] + [(3, 0, "s", None)]
    return graph(spark, nodes, sites, [((1, 1), (2, 0)), ((2, 1), (3, 0))])


def batch(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], EDIT)


def links(snap):
    return sorted((r.node_a, r.site_a, r.node_b, r.site_b) for r in snap.links().collect())


def test_each_edit(spark):
    snap = chain(spark)
    e = batch(spark, (1, "set_state", 1, 2, "q"), (2, "inc_state", 2, 2), (3, "dec_state", 4, 2), (4, "delete_bond", 2, 0), (5, "add_bond", 4, 0, None, 1, 0), (6, "add_node", 9, None, "A"),
              (6, "add_bond", 9, 1, None, 4, 1))
    after, errors = edits.apply_edits(snap, e, decl(spark))
    assert errors.count() == 0
    state = {r.node_id: r.state for r in after.sites.filter("site_name = 'm'").collect()}
    assert state == {1: "q", 2: "p", 4: "u", 9: "u"}
    assert links(after) == [(1, 0, 4, 0), (2, 1, 3, 0), (4, 1, 9, 1)]
    assert quality.link_errors(after.sites).count() == 0


def test_deletes_free_neighbours(spark):
    snap = chain(spark)
    after, _ = edits.apply_edits(snap, batch(spark, (1, "delete_node", 2)), decl(spark))
    assert links(after) == [] and after.nodes.count() == 3 and quality.link_errors(after.sites).count() == 0
    gone, _ = edits.apply_edits(snap, batch(spark, (1, "delete_complex", 3)), decl(spark), complexes_of(snap))
    assert [r.node_id for r in gone.nodes.collect()] == [4]


def test_conflicts_leave_both_edits_out(spark):
    snap = chain(spark)
    e = batch(spark, (1, "set_state", 1, 2, "q"), (2, "inc_state", 1, 2), (3, "add_bond", 4, 0, None, 1, 1), (4, "delete_bond", 4, 1), (5, "set_state", 4, 2, "zz"), (6, "delete_node", 3),
              (7, "delete_bond", 2, 1), (8, "set_state", 77, 0, "u"), (9, "inc_state", 4, 2), (10, "delete_node", 99))
    after, errors = edits.apply_edits(snap, e, decl(spark))
    bad = {r.edit_id for r in errors.collect()}
    assert {1, 2, 3, 4, 5, 6, 7, 8, 10} <= bad
    assert links(after) == links(snap) and after.nodes.count() == 4


def test_still_connected(spark):
    nodes = {n: "R" for n in range(4)}
    sites = [(n, i, "s", None) for n in nodes for i in (0, 1)]
    ring = graph(spark, nodes, sites, [((k, 1), ((k + 1) % 4, 0)) for k in range(4)])
    cx = complexes_of(ring)
    one = edits.still_connected(ring, cx, batch(spark, (1, "delete_bond", 0, 1))).collect()
    both = edits.still_connected(ring, cx, batch(spark, (1, "delete_bond", 0, 1), (1, "delete_bond", 2, 1))).collect()
    apart = edits.still_connected(ring, cx, batch(spark, (1, "delete_bond", 0, 1), (2, "delete_bond", 2, 1))).collect()
    joined = edits.still_connected(ring, cx, batch(spark, (1, "delete_bond", 0, 1), (1, "delete_bond", 2, 1), (1, "add_bond", 1, 5, None, 3, 5))).collect()
    assert [r.connected for r in one] == [True] and [r.connected for r in both] == [False, False]
    # two matches do not see each other's cuts
    assert [r.connected for r in apart] == [True, True] and [r.connected for r in joined] == [True, True]


def connected_by_search(links, gone, added, one, two):
    near = {}
    for a, b in [(a[0], b[0]) for a, b in links if (a, b) not in gone] + added:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, todo = {one}, [one]
    while todo:
        for n in near.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return two in seen


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_judged_by_themselves_as_a_search_would(spark, seed):
    rng = random.Random(seed)
    n = 24
    # sparse random links with parallel ones, rings, bridges and links from a node to itself
    ends, links = {k: 0 for k in range(n)}, []
    for _ in range(int(n * (0.9, 1.2, 1.6)[seed])):
        a = rng.randrange(n)
        b = a if rng.random() < 0.05 else min(n - 1, max(0, a + rng.choice((-2, -1, 1, 1, 2))))
        link = ((a, ends[a]), (b, ends[b] + (a == b)))
        ends[a] += 1
        ends[b] += 1
        links.append(link)
    nodes = {k: "R" for k in range(n)}
    snap = graph(spark, nodes, [(k, i, "s", None) for k in nodes for i in range(ends[k])], links)
    cx = complexes_of(snap)
    rows, want = [], {}
    for match in range(60):
        gone = rng.sample(links, rng.choice((1, 1, 2, 3)))
        added = [(rng.randrange(n + 2), rng.randrange(n + 2)) for _ in range(rng.choice((0, 0, 1, 2)))]
        added = [(x if x < n else 1000 + match, y) for x, y in added if y < n]
        for link in gone:
            (a, sa), (b, _) = link if rng.random() < 0.5 else link[::-1]
            rows.append((match, "delete_bond", a, sa))
            want[match, a, sa] = connected_by_search(links, gone, added, a, b)
        rows += [(match, "add_bond", x, 50, None, y, 51) for x, y in added]
    got = {(r.edit_id, r.node_id, r.site_idx): r.connected for r in edits.still_connected(snap, cx, batch(spark, *rows)).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_tours_of_deep_and_wide_trees(spark):
    """Places of a chain of 3000 nodes and of a star are those of a walk around them."""
    deep = [(k, 0, k + 1, 1) for k in range(3000)]
    wide = [(5000, k, 5001 + k, 0) for k in range(500)]
    forest = spark.createDataFrame(deep + wide, "node_a long, site_a long, node_b long, site_b long")
    cx = spark.createDataFrame([(k, 0) for k in range(3001)] + [(k, 5000) for k in range(5000, 5501)], "node_id long, complex_id long")
    place = {(r.u, r.v): r.place for r in spanning.tours(forest, cx).collect()}
    assert all(place[k, k + 1] == k and place[k + 1, k] == 5999 - k for k in range(3000))
    assert all(place[5000, 5001 + k] == 2 * k and place[5001 + k, 5000] == 2 * k + 1 for k in range(500))


def test_species_counts_can_be_set(spark):
    rows = [("d", 0, "A", 0, "s", None, 1, 0), ("d", 0, "A", 1, "s", None, None, None), ("d", 0, "A", 2, "m", "u", None, None), ("d", 1, "B", 0, "s", None, 0, 0)]
    template = spark.createDataFrame(rows, "species_id string, pos long, type string, site_idx long, site_name string, state string, partner_pos long, partner_site long")
    snap = edits.add_copies(chain(spark), spark.createDataFrame([("d", 5)], "species_id string, copies long"), template)
    cx = complexes_of(snap)
    ids = canonical.classes(snap, cx)[0]
    pair = ids.groupBy("class_id").count().filter("count = 5").first()["class_id"]
    left = edits.remove_copies(snap, cx, ids, pair, 2)
    assert left.nodes.count() == 4 + 6 and quality.link_errors(left.sites).count() == 0
    assert edits.set_count(snap, cx, ids, pair, 8, template).nodes.count() == 4 + 16
    assert edits.set_count(snap, cx, ids, pair, 0, template).nodes.count() == 4
    with pytest.raises(ValueError):
        edits.remove_copies(snap, cx, ids, pair, 6)


def test_species_text(spark):
    texts = {"ok": "A(s!1,s,m~u).B(s!1)", "same": "B(s!7).A(m~u,s,s!7)", "none": "A(s,s,m~q)", "type": "Z()", "wild": "A(s!+,s,m~u)", "label": "A(s!1,s,m~u)", "state": "A(s,s,m~x)", "lost": "A(s,m~u)",
             "extra": "A(s,s,s,m~u)", "apart": "B(s).B(s)", "junk": "A(s"}
    df = spark.createDataFrame(sorted(texts.items()), ["species_id", "text"])
    template, errors = species.parse_species(df, decl(spark))
    assert {r.species_id for r in errors.collect()} == {"type", "wild", "label", "state", "lost", "extra", "apart", "junk"}
    good = df.filter(F.col("species_id").isin("ok", "same", "none"))
    rows = [r for k in range(3) for r in (("p", 2 * k), )]
    nodes = {0: "A", 1: "B", 2: "A", 3: "B"}
    sites = [(n, i, "s", None) for n in (0, 2) for i in (0, 1)] + [(n, 2, "m", "u") for n in (0, 2)] + [(1, 0, "s", None), (3, 0, "s", None)]
    snap = graph(spark, nodes, sites, [((0, 0), (1, 0)), ((2, 1), (3, 0))])
    ids = canonical.classes(snap, complexes_of(snap))[0]
    found, _ = species.species_lookup(good, decl(spark), ids)
    assert {r.species_id: r["count"] for r in found.collect()} == {"ok": 2, "same": 2, "none": 0}


def test_species_file(spark, tmp_path):
    c = spark.createDataFrame([("A(a)", 1, 0, 508), ("A(a!1).A(a!1)", 2, 1, 246)], "species string, n_nodes long, n_links long, complexes long")
    path = str(tmp_path / "s")
    species.write_species(c, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "# 2 species, 754 complexes" in lines and "A(a!1).A(a!1)  246" in lines
    (tmp_path / "more.species").write_text("# note\nA(a)\t 5 # tail\nA(a) 7\n")
    assert {r.species: r["count"] for r in species.read_species(spark, str(tmp_path / "more.species")).collect()} == {"A(a)": 12}


def test_snapshots_refuse_other_types(spark, tmp_path):
    snap = chain(spark)
    snapshots.write_snapshot(snap, str(tmp_path), "x", decl(spark))
    assert links(snapshots.read_snapshot(spark, str(tmp_path), "x", decl(spark))) == links(snap)
    other = spark.createDataFrame([("A", 0, "s", ["u"])], TYPE_DECL)
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(tmp_path), "x", other)


def test_feed_equals_recount_and_resumes(spark, tmp_path):
    snap = chain(spark)
    obs = [
        observable("p", "Molecules", pattern(mol("A", Slot("m", "p")))), observable("links", "Molecules", pattern(mol("A", Slot("s", None, 1)), mol("A", Slot("s", None, 1)))),
        observable("big", "Species", pattern(mol("A"), relation=">=", quantity=2)),
    ]
    steps = [
        batch(spark, (1, "inc_state", 1, 2), (2, "add_bond", 4, 0, None, 1, 0)),
        batch(spark, (3, "delete_bond", 2, 0), (4, "inc_state", 4, 2)),
        batch(spark, (5, "delete_complex", 3), (6, "add_node", 9, None, "A"), (6, "add_bond", 9, 0, None, 4, 1)),
    ]
    src, place = tmp_path / "src", str(tmp_path / "place")
    src.mkdir()
    feed = CountFeed(spark, str(tmp_path / "state"), obs, decl(spark))
    feed.start(snap, complexes_of(snap))
    for n, step in enumerate(steps):
        step.coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(EDIT).parquet(str(src))
        # a new query each time: it resumes from the place the last one left
        feed.follow(stream, place).trigger(availableNow=True).start().awaitTermination()
        now = feed.snapshot(n)
        recount = match.observe(now, obs, complexes_of(now))
        assert quality.tracked_differences(feed.totals(n), recount).count() == 0
    assert {r.obs: r.value for r in feed.totals(2).collect()} == {"p": 2, "links": 4, "big": 1}
    assert {r.obs: r.value for r in feed.compact(2, str(tmp_path / "next")).totals(2).collect()} == {"p": 2, "links": 4, "big": 1}


def test_constraints_hold_on_the_edited_match(spark):
    """The overlay of each match against the snapshot really edited by that match alone."""
    snap, d = chain(spark), decl(spark)
    steps = [
        (1, ("set_state", 1, 2, "q")), (2, ("inc_state", 1, 2)), (3, ("add_bond", 4, 0, None, 1, 0)), (4, ("delete_bond", 2, 1)), (5, ("delete_node", 3)), (6, ("dec_state", 2, 2)),
        (7, ("delete_bond", 1, 1)), (7, ("set_state", 1, 2, "p")),
    ]
    e = batch(spark, *[(k, *s) for k, s in steps])
    mols = [mol("A", Slot("m", "q")), mol("A", Slot("s", None, "bound"), Slot("s", None, "bound")), mol("A", Slot("s", None, "free"), Slot("s", None, "free")), mol("A", Slot("m", "p"), Slot("s", None, "free"))]
    seeds = spark.createDataFrame([(k, n) for k in range(1, 8) for n in (1, 2, 4)], "edit_id long, node_id long")
    every = {(k, n) for k in range(1, 8) for n in (1, 2, 4)}
    want = {m: set() for m in mols}
    for k in range(1, 8):
        after, _ = edits.apply_edits(snap, e.filter(f"edit_id = {k}"), d)
        after.sites = cut(after.sites, "one-match")
        for m in mols:
            want[m] |= {(k, r.node_id) for r in match.node_counts(after, m).collect()} & every
    for m in mols:
        got = {(r.edit_id, r.node_id) for r in edits.constrained_after(snap, seeds, e, d, include=(m,), exclude=(mols[0],) if m is not mols[0] else ()).collect()}
        assert got == (want[m] - want[mols[0]] if m is not mols[0] else want[m]) and want[m]


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    """3000 small complexes in 32 buckets: three edits open a few of them, and the totals stay those of a recount."""
    nodes = spark.range(6000).select(F.col("id").alias("node_id"), F.lit("A").alias("type"))
    far = (F.col("node_id").bitwiseXOR(F.lit(1))).alias("partner_node")
    one = lambda k, name, linked: nodes.select(
        "node_id", "type", F.lit(k).cast("long").alias("site_idx"), F.lit(name).alias("site_name"), F.lit("u" if name == "m" else None).cast("string").alias("state"),
        far if linked else F.lit(None).cast("long").alias("partner_node"), F.lit(0 if linked else None).cast("long").alias("partner_site"))
    snap = Snapshot(nodes, one(0, "s", True).unionByName(one(1, "s", False)).unionByName(one(2, "m", False)))
    obs = [observable("p", "Molecules", pattern(mol("A", Slot("m", "p")))), observable("pairs", "Species", pattern(mol("A"), relation=">=", quantity=2))]
    feed = CountFeed(spark, str(tmp_path / "state"), obs, decl(spark), buckets=32)
    feed.start(snap, complexes_of(snap))
    step = batch(spark, (1, "inc_state", 10, 2), (2, "delete_bond", 400, 0), (3, "add_bond", 2000, 1, None, 3000, 1))
    named = step.select("node_id").unionByName(step.filter("partner_node is not null").select(F.col("partner_node").alias("node_id")))
    assert len(feed.members.numbers(named)) <= 4

    def opened(rows):
        """Directories that the scan really opened, from its own metrics."""
        run = rows._jdf.queryExecution()
        run.toRdd().count()
        return run.executedPlan().collectLeaves().apply(0).metrics().apply("numPartitions").value()

    for log in (feed.nodes, feed.sites, feed.members):
        assert opened(log.raw(0, named)) <= 4 and opened(log.raw(0)) == 32
    feed.apply(step, 0)
    # what the batch wrote lies in the buckets of the eight members of its complexes
    assert len(list((tmp_path / "state" / "sites" / "batch=0").glob("bucket=*"))) <= 8
    now = feed.snapshot(0)
    assert quality.tracked_differences(feed.totals(0), match.observe(now, obs, complexes_of(now))).count() == 0
    assert {r.obs: r.value for r in feed.totals(0).collect()} == {"p": 1, "pairs": 2998}


def test_the_feed_reads_one_version_of_a_bucket(spark, tmp_path):
    """after batches that touch all complexes and few of them, each row lies once in what is read, and a bucket left empty stays so."""
    snap = chain(spark)
    obs = [observable("p", "Molecules", pattern(mol("A", Slot("m", "p")))), observable("p too", "Species", pattern(mol("A", Slot("m", "p"))))]
    feed = CountFeed(spark, str(tmp_path / "state"), obs, decl(spark), buckets=64)
    feed.start(snap, complexes_of(snap))
    n = snap.nodes.count()
    top = max(r.node_id for r in snap.nodes.collect())
    alone = [(100 + k, "add_node", top + 1 + k, None, "A") for k in range(6)]
    steps = [batch(spark, (1, "inc_state", 1, 2), (2, "inc_state", 4, 2), *alone), batch(spark, (3, "inc_state", top + 1, 2)), batch(spark, (4, "delete_node", top + 2)), batch(spark, (4, "delete_node", top + 2))]
    want = [n + 6, n + 6, n + 5, n + 5]
    for k, step in enumerate(steps):
        feed.apply(step, k)
        assert feed.nodes.raw(k).count() == want[k] == feed.inside.raw(k).count() == feed.complexes(k).count(), k
        assert feed.sites.raw(k).count() == feed.sites.raw(k).select("node_id", "site_idx").distinct().count()
        now = feed.snapshot(k)
        assert quality.tracked_differences(feed.totals(k), match.observe(now, obs, complexes_of(now))).count() == 0
    gone = spark.createDataFrame([(top + 2,)], "node_id long")
    assert feed.nodes.versions(3)[feed.nodes.numbers(gone)[0]] == 3 and feed.nodes.read(3, gone).count() == 0 and feed.nodes.read(1, gone).count() == 1
    assert [r.error for r in spark.read.parquet(f"{feed.errors}/batch=3").collect()] == ["no such node"]


def test_copies_of_species_meet_no_join(spark):
    """the number of copies is data that no plan foresees, so a join of the copies may broadcast them all."""
    template = spark.createDataFrame(
        [("d", 0, "A", 0, "s", "p", 1, 0), ("d", 1, "B", 0, "s", None, 0, 0), ("e", 0, "C", None, None, None, None, None)],
        "species_id string, pos long, type string, site_idx long, site_name string, state string, partner_pos long, partner_site long",
    )
    copies = spark.createDataFrame([("d", 150_000), ("e", 3), ("d0", 0)], "species_id string, copies long")
    made = edits.instantiate(copies, template, 10)
    for part in (made.nodes, made.sites):
        above = part._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
        assert "Join" not in above, above
    ids = made.nodes.agg(F.min("node_id"), F.max("node_id"), F.countDistinct("node_id"), F.count("node_id")).first()
    assert tuple(ids) == (10, 300_012, 300_003, 300_003)
    assert made.sites.count() == 300_000 and quality.link_errors(made.sites).count() == 0
    assert sorted(r.node_id for r in made.nodes.filter("type = 'C'").collect()) == [300_010, 300_011, 300_012]


def test_errors_of_many_edits_are_dealt_out(spark, monkeypatch):
    """Short rows of many edits go to a number of tasks that follows the rows; an edit with two errors and a crowded site keep their results."""
    monkeypatch.setattr(edits, "PART_ROWS", 3)
    dealt = []
    join = edits.hub_join
    monkeypatch.setattr(edits, "hub_join", lambda *a, **k: dealt.append(k["parts"]) or join(*a, **k))
    e = batch(spark, *[(k, "set_state", 1, 2, "p") for k in range(1, 9)], (20, "set_state", 2, 2, "nowhere"), (21, "set_state", 2, 2, "q"), (22, "set_state", 4, 2, "q"), (23, "set_state", 7, 0, "u"))
    after, errors = edits.apply_edits(chain(spark), e, decl(spark))
    want = {(k, "site touched twice") for k in (*range(1, 9), 20, 21)} | {(20, "state not allowed"), (23, "no such site"), (23, "state not allowed")}
    assert sorted(map(tuple, errors.collect())) == sorted(want) and dealt == [5]
    assert {r.node_id: r.state for r in after.sites.filter("site_name = 'm'").collect()} == {1: "u", 2: "u", 4: "q"}
