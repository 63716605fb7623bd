import random

import pytest
from pyspark.sql import functions as F

from bondwise.operators import bench
from bondwise.sources import files, models, stats, trajectories


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_gdat_headers_and_malformed_rows(spark, tmp_path):
    put(tmp_path / "a.gdat", "# time\tX\tY\n0\t1\t2\n# note\n1\t3\tbad\n2\t5\t6\n")
    put(tmp_path / "b.gdat", "  time  X\n\n 0.5   7\n 1.5 8 9\n")
    put(tmp_path / "c.gdat", "#time X\n0 1e-3\n")
    rows = trajectories.read_gdat(spark, str(tmp_path / "*.gdat")).collect()
    got = sorted((r.file[-6], r.time, r.obs, r.value) for r in rows)
    assert got == [("a", 0.0, "X", 1.0), ("a", 0.0, "Y", 2.0), ("a", 2.0, "X", 5.0), ("a", 2.0, "Y", 6.0), ("b", 0.5, "X", 7.0), ("c", 0.0, "X", 0.001)]
    with pytest.raises(Exception, match="malformed row"):
        trajectories.read_gdat(spark, str(tmp_path / "a.gdat"), mode="fail").collect()


def test_gdat_values_survive(spark, tmp_path):
    values = [0.1, 1 / 3, 1e-300, 12345678901234567.0, -2.0, 3e22]
    df = spark.createDataFrame([("r", float(k), "X", v) for k, v in enumerate(values)], "run string, time double, obs string, value double")
    trajectories.write_gdat(df, str(tmp_path / "g"), ["X"], ["run"])
    back = trajectories.read_gdat(spark, str(tmp_path / "g/*/*.txt"), per_directory=True).orderBy("time").collect()
    assert [r.value for r in back] == values


def test_gdat_files_follow_rows_not_runs(spark, tmp_path):
    """the text of many runs takes few files, and any run's columns read back."""
    runs = [None, "", "# time", "a b\tc", "time", "é%+"] + [f"r{k}" for k in range(200)]
    want = {(r, k, float(t), obs): (k + t) / 3 for r in runs for k in (0, 1) for t in range(3) for obs in ("X", "f")}
    df = spark.createDataFrame([(*key, v) for key, v in want.items()], "run string, `rep no` int, time double, obs string, value double")
    trajectories.write_gdat(df, str(tmp_path / "g"), ["X"], ["run", "rep no"], ["f"], stacked=True)
    assert len(list((tmp_path / "g").glob("**/*.txt"))) < 20
    back = trajectories.read_gdat(spark, str(tmp_path / "g"), per_directory=True, labels=["run", "rep no"]).collect()
    got = {(r.run, int(r["rep no"]), r.time, r.obs): r.value for r in back}
    assert got == want and len(back) == len(want)
    put(tmp_path / "g/more.txt", "r1\t0\t9\tbad\t1\nr1\t0\t9\t1\nr1\n")
    assert trajectories.read_gdat(spark, str(tmp_path / "g"), per_directory=True, labels=["run", "rep no"]).count() == len(want)


def test_scan_files(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, "A", "fwd", 5.0), (1.0, "A", "bwd", 6.0), (2.0, "A", "fwd", 7.0), (2.0, "A", "bwd", 7.0)], "param_value double, obs string, branch string, value double")
    trajectories.write_scan(pts, str(tmp_path / "s"), "k", ["A"], branches=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert lines[0] == "# k\tA_fwd\tA_bwd" and "1\t5\t6" in lines
    assert {(r.param_value, r.branch): r.value for r in trajectories.read_scan(spark, str(tmp_path / "s")).collect()}[1.0, "bwd"] == 6.0


def test_spread_pairs_by_position(spark, tmp_path):
    put(tmp_path / "m.mean.tsv", "time\tA\tB\n0\t1\t2\n5\t3\t4\n")
    put(tmp_path / "m.std.tsv", "time\tA\tB\n0\t0.1\t0.2\n0\t0.3\t0.4\n")
    got = {(r.obs, r.step): (r.time, r.mean, r.std) for r in stats.read_ref_stats(spark, str(tmp_path / "*.mean.tsv"), str(tmp_path / "*.std.tsv")).collect()}
    assert got["A", 1] == (5.0, 3.0, 0.3) and got["B", 0] == (0.0, 2.0, 0.2)


def test_small_tables(spark, tmp_path):
    t = put(tmp_path / "m.tint.tsv", "observable\tI_mean\tI_std\tn_reps\nA\t1.5\t0.5\t100\nB\tx\t1\t2\n")
    assert [tuple(r) for r in stats.read_ref_tint(spark, t).collect()] == [("m", "A", 1.5, 0.5, 100)]
    p = put(tmp_path / "p.tsv", "#model\tsuffix\tt_end\tn_steps\tis_equil\tx_flags\na\ts\t10\t5\t0\t-bscb -utl 3\n# note\nb\ts\t20\t6\t0\n")
    got = {r.model: r for r in stats.read_sim_params(spark, p).collect()}
    assert got["a"].block_same_complex and got["b"].flags == "" and got["b"].t_end == 20.0
    w = put(tmp_path / "w.tsv", "model\tn_reps_done\twall_mean_s\twall_std_s\na\t3\t1.5\tN/A\n")
    assert stats.read_wall_summary(spark, w).first().wall_std_s is None
    n = put(tmp_path / "n.tsv", "# c\nmodel\ttz_p99_n10\na\t4.5\n")
    assert stats.read_noise_floor(spark, n).first().tz_p99_n10 == 4.5
    o = put(tmp_path / "o.tsv", "# c\nmodel\tseconds\na\t90\n")
    assert [tuple(r) for r in stats.read_timeouts(spark, o).collect()] == [("a", 90)]


def test_annotations_and_actions(spark, tmp_path):
    put(tmp_path / "m.model", '# Feature: x\n# Tests: y\n# invariant: nonneg\n# invariant: conserved X\n#invariant: conserved Y = 100\n# invariant: balance A = B\nbegin\n# Feature: late\n'
        'simulate_nf({t_end=>50,\n n_steps=>10, param=>"-bscb -utl 4"})\n')
    path = str(tmp_path / "m.model")
    got = sorted((r.kind, r.lhs or "", r.rhs or "", r.expected) for r in files.read_annotations(spark, path, ".model").collect())
    assert got == [("balance", "A", "B", None), ("conserved", "X", "", None), ("conserved", "Y", "", 100.0), ("nonneg", "", "", None)]
    assert files.read_features(spark, path, ".model").count() == 2
    a = files.read_actions(spark, path, ".model").first()
    assert (a.model, a.t_end, a.n_steps, a.flags) == ("m", 50.0, 10, "-bscb -utl 4")


def test_logs_and_reports(spark, tmp_path):
    log = put(tmp_path / "run.log", "[t] events=12 null=3 total=1.5s wall=2.0s\n  fire_rule: 0.5s (33.3%)\n")
    r = files.read_run_logs(spark, log).first()
    assert (r.events, r.nulls, r.total_s, r.fire_rule_pct, r.observables_pct) == (12, 3, 1.5, 33.3, 0.0)
    foot = put(tmp_path / "foot.log", "[t] arena=10 rules=2 tabled=1 bytes=100 (0.0 MB) mol=60 sampler=40 reach_bytes=50\n  R1 (x): rows=4 reach=2 mol=80 sampler=1\n")
    f = files.read_footprints(spark, foot).first()
    assert (f.arena, f.table_bytes, f.reach_bytes, f.widest_row) == (10, 100, 50, 20)
    rep = put(tmp_path / "rep.md", "- A reps: 1, wall time: 9.0s\n### m1\n- A reps: 3, wall time: 1.250s\n- A reps: 3, wall time: 7.0s\n### m2\n")
    assert [(r.model, r.wall_s) for r in files.read_reports(spark, rep).collect()] == [("m1", 1.25)]


def test_tfun_files(spark, tmp_path):
    put(tmp_path / "a.tfun", "# x y\n0.5 3\n 7 1.25\n\n31\t0.75\n")
    put(tmp_path / "b.tfun", "0 1\noops 3\n")
    points, bad = files.read_tfun(spark, str(tmp_path / "*.tfun"))
    assert [(r.idx, r.x, r.y) for r in points.filter("name = 'a'").orderBy("idx").collect()] == [(0, 0.5, 3.0), (1, 7.0, 1.25), (2, 31.0, 0.75)]
    assert [r.name for r in bad.collect()] == ["b"]
    inline = spark.createDataFrame([("c", "1, 2,3", "4,5 ,6")], "name string, xs string, ys string")
    assert [(r.x, r.y) for r in files.inline_points(inline).orderBy("idx").collect()] == [(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)]


def test_manifest(spark, tmp_path):
    put(tmp_path / "t/a.txt", "one")
    put(tmp_path / "t/sub/b.txt", "two")
    put(tmp_path / "t/scratch/c.txt", "three")
    live = files.file_hashes(spark, str(tmp_path / "t"), skip_dirs=["scratch"])
    assert sorted(r.path for r in live.collect()) == ["a.txt", "sub/b.txt"]
    files.write_manifest(live, str(tmp_path / "man"), ["listing"])
    assert bench.manifest_problems(files.read_manifest(spark, str(tmp_path / "man")), live).count() == 0
    put(tmp_path / "t/a.txt", "changed")
    put(tmp_path / "t/d.txt", "new")
    (tmp_path / "t/sub/b.txt").unlink()
    again = files.file_hashes(spark, str(tmp_path / "t"), skip_dirs=["scratch"])
    got = {r.path: r.problem for r in bench.manifest_problems(files.read_manifest(spark, str(tmp_path / "man")), again).collect()}
    assert got == {"a.txt": "mismatch", "d.txt": "untracked", "sub/b.txt": "missing"}


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """no task reads more than a piece, whatever the size of a file."""
    import hashlib

    sizes = {"a b%20": 64, "s/c#d": 65, "s/é": 1000, "e": 1001, "f": 3500}
    body = random.Random(1).randbytes(4000)
    for name, n in sizes.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(body[:n])
    for name, value in (("WHOLE_BYTES", 64), ("PIECE_BYTES", 500), ("READ_BYTES", 64)):
        monkeypatch.setattr(files, name, value)
    got = {r.path: r.sha256 for r in files.file_hashes(spark, str(tmp_path / "t")).collect()}
    assert got == {name: hashlib.sha256(body[:n]).hexdigest() for name, n in sizes.items()}
    path, at, state, digest, steps = str(tmp_path / "t/f"), 0, None, None, []
    while digest is None:
        before = at
        at, state, digest = files.hash_step(path, 3500, at, state, 500)
        steps.append(at - before)
    assert steps == [500] * 7 and digest == got["f"]
    monkeypatch.setattr(files, "_resumable_sha256", lambda: None)
    assert files.hash_step(path, 3500, 500, b"", 500) == (3500, None, got["f"])


def test_files_beyond_two_gigabytes_have_a_hash(spark, tmp_path):
    """more bytes than one value can hold; a hole takes no room on the disk."""
    import hashlib

    (tmp_path / "big").touch()
    with open(tmp_path / "big", "r+b") as file:
        file.truncate(2**31 + 5)
    want = hashlib.sha256()
    for _ in range(32):
        want.update(bytes(2**26))
    want.update(bytes(5))
    assert [tuple(r) for r in files.file_hashes(spark, str(tmp_path)).collect()] == [("big", want.hexdigest())]


XML = """<m><model id="x"><ListOfParameters><Parameter id="k" type="Constant" value="-1" expr="2*j"/><Parameter id="j" type="Constant" value="3"/></ListOfParameters>
<ListOfMoleculeTypes><MoleculeType id="A"><ListOfComponentTypes><ComponentType id="s"/><ComponentType id="s"><ListOfAllowedStates><AllowedState id="u"/><AllowedState id="p"/></ListOfAllowedStates></ComponentType></ListOfComponentTypes></MoleculeType>
<MoleculeType id="B" population="1"/></ListOfMoleculeTypes>
<ListOfCompartments><compartment id="c"/></ListOfCompartments>
<ListOfSpecies><Species id="S1" name="$A(s,s~u)" concentration="k" Fixed="1"><ListOfMolecules><Molecule id="S1_M1" name="A"/></ListOfMolecules></Species>
<Species id="S2" name="$A(s,s~p)" concentration="5" Fixed="1"><ListOfMolecules><Molecule id="S2_M1" name="A"/></ListOfMolecules></Species></ListOfSpecies>
<ListOfReactionRules>
<ReactionRule id="R1" name="one" symmetry_factor="1"><ListOfReactantPatterns>
<ReactantPattern id="R1_RP1"><ListOfMolecules><Molecule id="R1_RP1_M1" name="A"><ListOfComponents><Component id="R1_RP1_M1_C1" name="s" numberOfBonds="0"/></ListOfComponents></Molecule></ListOfMolecules></ReactantPattern>
<ReactantPattern id="R1_RP2"><ListOfMolecules><Molecule id="R1_RP2_M1" name="A"/><Molecule id="R1_RP2_M2" name="B"/></ListOfMolecules></ReactantPattern>
<ReactantPattern id="R1_RP3"><ListOfMolecules><Molecule id="R1_RP3_M1" name="A"/></ListOfMolecules></ReactantPattern></ListOfReactantPatterns>
<RateLaw id="L1" type="Ele" totalrate="0"><ListOfRateConstants><RateConstant value="k"/></ListOfRateConstants></RateLaw></ReactionRule>
<ReactionRule id="R2" name="two" symmetry_factor="0.5" priority="3"><ListOfReactantPatterns><ReactantPattern id="R2_RP1"><ListOfMolecules><Molecule id="R2_RP1_M1" name="A"><ListOfComponents><Component id="R2_RP1_M1_C1" name="s" numberOfBonds="0"/></ListOfComponents></Molecule></ListOfMolecules></ReactantPattern></ListOfReactantPatterns>
<RateLaw id="L2" type="Function" name="f" totalrate="1"/><ListOfOperations><StateChange site="R2_RP1_M1_C1" finalState="p"/></ListOfOperations></ReactionRule>
<ReactionRule id="R3" name="three" symmetry_factor="0.5"><ListOfReactantPatterns><ReactantPattern id="R3_RP1"><ListOfMolecules><Molecule id="R3_RP1_M1" name="A"><ListOfComponents><Component id="R3_RP1_M1_C1" name="s" numberOfBonds="0"/></ListOfComponents></Molecule></ListOfMolecules></ReactantPattern>
<ReactantPattern id="R3_RP2"><ListOfMolecules><Molecule id="R3_RP2_M1" name="B"/></ListOfMolecules></ReactantPattern></ListOfReactantPatterns><ListOfOperations><StateChange site="R3_RP1_M1_C1" finalState="p"/><Delete id="R3_RP2_M1"/></ListOfOperations><RateLaw id="L3" type="MM" totalrate="0"><ListOfRateConstants><RateConstant value="1"/><RateConstant value="k"/></ListOfRateConstants></RateLaw></ReactionRule>
</ListOfReactionRules>
<ListOfObservables><Observable id="O1" name="Obs" type="Molecules"><ListOfPatterns><Pattern id="O1_P1"><ListOfMolecules><Molecule id="O1_P1_M1" name="A"/></ListOfMolecules></Pattern></ListOfPatterns></Observable></ListOfObservables>
<ListOfFunctions><Function id="f"><ListOfArguments><Argument id="x"/></ListOfArguments><Expression> k*reactant_2() </Expression></Function></ListOfFunctions></model></m>"""


def test_model_tables_and_lint(spark, tmp_path):
    path = put(tmp_path / "x.xml", XML)
    assert {(r.name, r.expr, r.value) for r in models.read_parameters(spark, path).collect()} == {("k", "2*j", -1.0), ("j", "3", 3.0)}
    types = models.read_types(spark, path).filter("type = 'A'").orderBy("site_idx").collect()
    assert [(r.site_name, r.allowed_states) for r in types] == [("s", None), ("s", ["u", "p"])]
    assert models.read_observables(spark, path).first().obs == "Obs" and models.read_functions(spark, path).first().args == ["x"]
    assert {r.seed_id: r.amount_expr for r in models.read_seeds(spark, path).collect()} == {"S1": "k", "S2": "5"}
    audit = {(r.rule_id, r.reactant): r.loose for r in models.pattern_audit(models.read_rules(spark, path)).collect()}
    assert audit == {("R1", 0): False, ("R1", 1): True, ("R1", 2): False, ("R2", 0): False, ("R3", 0): False, ("R3", 1): False}
    found = models.lint_models(spark, path).collect()
    got = {(r.severity, r.element, r.subject) for r in found}
    assert sum(r.severity == "Warn" and r.element == "RateLaw@type=MM" for r in found) == 2
    assert got == {
        ("Error", "ListOfCompartments", "c"), ("Error", "ListOfReactantPatterns", "R1"), ("Error", "MoleculeType@population", "B"), ("Error", "Species@Fixed", "A"),
        ("Error", "RateLaw@totalrate", "R2"), ("Error", "reactant_N", "R2"), ("Error", "RateLaw@type=MM", "R3"), ("Warn", "priority", "R2"), ("Warn", "RateLaw@type=MM", "R3")}


def test_pattern_shapes_agree_with_patterns(spark, tmp_path):
    """Bonds among four molecules drawn at random: the audit of model files and the pattern object tell the same shape."""
    import random

    from bondwise.model import Slot, mol, pattern

    rng, rules, want = random.Random(1), [], {}
    for k in range(12):
        pairs = [p for p in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) if rng.random() < 0.4]
        p = pattern(*[mol("A", *[Slot("s", None, n) for n, ends in enumerate(pairs) if i in ends]) for i in range(4)])
        want[f"R{k}"] = (4, len(pairs), len(p.fragments()) > 1, p.diameter())
        mols = "".join(f'<Molecule id="R{k}_RP1_M{i}" name="A"/>' for i in range(4))
        bonds = "".join(f'<Bond id="b{n}" site1="R{k}_RP1_M{a}_C1" site2="R{k}_RP1_M{b}_C1"/>' for n, (a, b) in enumerate(pairs))
        rules.append(f'<ReactionRule id="R{k}"><ListOfReactantPatterns><ReactantPattern id="R{k}_RP1"><ListOfMolecules>{mols}</ListOfMolecules>'
                     f"<ListOfBonds>{bonds}</ListOfBonds></ReactantPattern></ListOfReactantPatterns></ReactionRule>")
    path = put(tmp_path / "shapes.xml", "<ListOfReactionRules>\n" + "\n".join(rules) + "\n</ListOfReactionRules>\n")
    got = {r.rule_id: (r.n_mols, r.n_bonds, r.loose, r.diameter) for r in models.pattern_audit(models.read_rules(spark, path)).collect()}
    assert got == want and len({v[3] for v in want.values()}) >= 3


@pytest.mark.parametrize("lines", [7, 100_000])
def test_reports_are_split_over_tasks(spark, tmp_path, monkeypatch, lines):
    """a section may begin in one split of a file and have its wall time in a later one."""
    monkeypatch.setattr(files, "PIECE_LINES", lines, raising=False)
    text = "- A reps: 1, wall time: 9.0s\n"
    for k in range(300):
        text += f"### m{k % 290}\r\n" + "- note\n" * (k % 40) + f"- A reps: 3, wall time: {k + 1}.5s\n- A reps: 3, wall time: 0.1s\n"
    rep = put(tmp_path / "rep.md", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        got = {r.model: r.wall_s for r in files.read_reports(spark, rep).collect()}
        from bondwise.sources import text as texts

        assert texts.split_lines(spark, rep).select("block").distinct().count() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"m{k % 290}": k + 1.5 for k in range(300)}


def test_lint_parses_each_tag_once(spark, tmp_path):
    """The checks read written tables, not the files again, and tags that stand in no file are known from one pass over text."""
    path = put(tmp_path / "x.xml", XML)
    found = models.lint_models(spark, path)
    assert found.count() == 10 and not any(f.endswith(".xml") for f in found.inputFiles())
    assert models.tags_in(spark, path, ["ReactionRule", "Species", "compartment", "Nowhere"]) == {"ReactionRule", "Species", "compartment"}
