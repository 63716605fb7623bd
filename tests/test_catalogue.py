import random

import pytest

from bondwise.model import Pattern
from bondwise.operators import catalogue, match
from bondwise.operators.components import complexes_of
from bondwise.sources import models
from tests.graphs import graph, random_graph
from tests.test_match import PATTERNS, brute


def element(p: Pattern, key: str) -> str:
    """A pattern as model files write it."""
    ends = {}
    for k, (a, b) in enumerate(p.bonds()):
        ends[a] = ends[b] = k
    site = lambda i, j: f"{key}_M{i + 1}_C{j + 1}"
    mols = ""
    for i, m in enumerate(p.mols):
        sites = "".join(
            f'<Component id="{site(i, j)}" name="{s.name}"' + (f' state="{s.state}"' if s.state else "")
            + f' numberOfBonds="{"1" if isinstance(s.bond, int) else {"free": "0", "bound": "+", "any": "?"}[s.bond]}"/>'
            for j, s in enumerate(m.slots)
        )
        mols += f'<Molecule id="{key}_M{i + 1}" name="{m.type}"><ListOfComponents>{sites}</ListOfComponents></Molecule>'
    bonds = "".join(f'<Bond id="{key}_B{k}" site1="{site(*a)}" site2="{site(*b)}"/>' for k, (a, b) in enumerate(p.bonds()))
    rel = f' relation="{p.relation}" quantity="{p.quantity}"' if p.relation else ""
    return f'<Pattern id="{key}"{rel}><ListOfMolecules>{mols}</ListOfMolecules><ListOfBonds>{bonds}</ListOfBonds></Pattern>'


@pytest.fixture
def corpus(spark, tmp_path):
    joined = {n: p for n, p in PATTERNS.items() if len(p.fragments()) == 1}
    for model in ("m1", "m2"):
        folder = tmp_path / f"model={model}"
        folder.mkdir()
        obs = "".join(
            f'<Observable id="{n}" name="{n}" type="{"Species" if p.relation else "Molecules"}"><ListOfPatterns>{element(p, n)}</ListOfPatterns></Observable>' for n, p in joined.items()
        )
        (folder / "a.xml").write_text(f"<ListOfObservables>\n{obs}\n</ListOfObservables>")
    return joined, models.read_observables(spark, str(tmp_path))


def test_corpus_counts_are_those_of_all_assignments(spark, corpus):
    joined, rows = corpus
    rng = random.Random(5)
    nodes, sites, links = random_graph(spark, rng, 9)
    snap = graph(spark, nodes, sites, links)
    obs = models.observable_patterns(rows)
    programs = catalogue.compile_patterns(obs).cache()
    assert programs.filter("error is not null").count() == 0
    # both models hold the same patterns, so they share every program
    assert programs.select("leaf").distinct().count() == len(set(joined.values()))
    counts = catalogue.match_programs(snap, programs)
    cx = complexes_of(snap)
    got = {(r.model, r.obs): r.value for r in catalogue.observe_models(counts, programs, obs, cx).collect()}
    for name, p in joined.items():
        if not p.relation:
            want = len(brute(nodes, sites, links, p))
            assert got["m1", name] == got["m2", name] == want, name
    by_seed = {(r.leaf, r.node_id): r.c for r in counts.collect()}
    leaf = {r.pattern_id: r.leaf for r in programs.collect()}
    pid = {r.obs: r.pattern_id for r in obs.filter("model = 'm1'").collect()}
    for name, p in joined.items():
        want = {r.node_id: r.c for r in match.seed_counts(snap, p).collect()}
        assert {n: c for (l, n), c in by_seed.items() if l == leaf[pid[name]]} == want, name


def test_plan_does_not_grow_with_the_patterns(spark, tmp_path):
    """Twenty patterns take as many jobs' joins as two: the number of levels is that of the longest pattern."""
    from bondwise.model import Slot, mol, pattern

    def steps_of(n):
        ps = [pattern(mol("A", Slot("s", f"v{k}", 1)), mol("B", Slot("s", None, 1), Slot("t", f"w{k}"))) for k in range(n)]
        (tmp_path / f"n{n}").mkdir()
        body = "".join(f'<Observable id="o{k}" name="o{k}" type="Molecules"><ListOfPatterns>{element(p, f"o{k}")}</ListOfPatterns></Observable>' for k, p in enumerate(ps))
        (tmp_path / f"n{n}" / "m.xml").write_text(f"<ListOfObservables>\n{body}\n</ListOfObservables>")
        obs = models.observable_patterns(models.read_observables(spark, str(tmp_path / f"n{n}")))
        programs = catalogue.compile_patterns(obs)
        nodes, sites, links = random_graph(spark, random.Random(1), 6)
        counts = catalogue.match_programs(graph(spark, nodes, sites, links), programs)
        return counts._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert steps_of(2) == steps_of(20)


def test_matches_meet_a_node_once_for_all_steps(spark, tmp_path):
    """steps that differ only in conditions or states do not multiply the rows that are shuffled to a node's sites."""
    import json

    from bondwise.model import Slot, mol, pattern

    states = [f"v{k}" for k in range(20)]
    sites = [(n, 0, "s", states[n % 20]) for n in range(400)] + [(n, 1, "t", "u") for n in range(400)]
    snap = graph(spark, {n: "A" for n in range(400)}, sites, [((n, 1), (n + 1, 1)) for n in range(0, 400, 2)])
    ps = [pattern(mol("A", Slot("s", v), Slot("t", None, 1)), mol("A", Slot("t", None, 1), Slot("s", w))) for v in states for w in states[:5]]
    obs = "".join(f'<Observable id="o{k}" name="o{k}" type="Molecules"><ListOfPatterns>{element(p, f"o{k}")}</ListOfPatterns></Observable>' for k, p in enumerate(ps))
    (tmp_path / "m.xml").write_text(f"<ListOfObservables>\n{obs}\n</ListOfObservables>")
    programs = catalogue.compile_patterns(models.observable_patterns(models.read_observables(spark, str(tmp_path)))).cache()
    # states are tested before bonds are walked, so a match carries on for one of twenty patterns only
    assert all([s["kind"] for s in json.loads(r[0])] == ["start", "count", "follow", "count"] for r in programs.selectExpr("to_json(steps)").collect())
    seen, keep = [], catalogue.cut
    catalogue.cut = lambda df, tag, *a: (lambda out: (seen.append(out.count()) if tag == "matches" else None, out)[1])(keep(df, tag, *a))
    try:
        counts = catalogue.match_programs(snap, programs)
    finally:
        catalogue.cut = keep
    assert seen == [400, 400, 400, 100]
    by_leaf = {r.leaf: r.c for r in counts.groupBy("leaf").sum("c").toDF("leaf", "c").collect()}
    partner = lambda n: n + 1 if n % 2 == 0 else n - 1
    want = {k: sum(states[n % 20] == v and states[partner(n) % 20] == w for n in range(400)) for k, (v, w) in enumerate((v, w) for v in states for w in states[:5])}
    leaf = {r.pattern_id: r.leaf for r in programs.collect()}
    assert {k: by_leaf.get(leaf[f"m/o{k}/o{k}"], 0) for k in want} == want and sum(want.values()) == 100


def test_unmatched_elements_are_reported(spark):
    kind = models.PATTERN_X
    loose = {"_id": "p", "_relation": None, "_quantity": None, "ListOfBonds": None, "ListOfMolecules": {"Molecule": [{"_id": "a", "_name": "A", "ListOfComponents": None}, {"_id": "b", "_name": "B", "ListOfComponents": None}]}}
    empty = {**loose, "ListOfMolecules": None}
    rows = spark.createDataFrame([("two", loose), ("none", empty), ("null", None)], f"pattern_id string, pattern {kind}")
    got = {r.pattern_id: (r.leaf, r.error) for r in catalogue.compile_patterns(rows).collect()}
    assert got == {"two": (None, "parts without a bond between them"), "none": (None, "no molecules"), "null": (None, "no molecules")}


def test_loose_names_strip_digits():
    x = {"ListOfMolecules": {"Molecule": [{"_name": "A", "ListOfComponents": {"Component": [{"_id": "c", "_name": "arm12", "_state": None, "_numberOfBonds": "0"}]}}]}, "ListOfBonds": None}
    assert catalogue.pattern_of(x).mols[0].slots[0].name == "arm12" and catalogue.pattern_of(x, loose_names=True).mols[0].slots[0].name == "arm"
