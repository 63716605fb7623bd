"""Whole model corpora matched and priced as data.

Every pattern becomes a program of steps: start at a node type, follow or close a pattern bond, count the other sites of a pattern node. Programs of all
patterns are merged into one tree by their common beginnings, so a step that many patterns share runs once. Matching walks that tree level by
level: the partial matches of a level meet the steps below them by an equi-join, and then the sites of the node at hand. The plan therefore has
as many joins as the longest pattern has steps, however many patterns, observables, rules and models there are.

Sites off the pattern's bonds are counted, not listed, by inclusion and exclusion over set partitions; conditions are counted once per node for all patterns.
Bonds are listed, so a pattern with two bonds at one hub costs the square of its links; ``match.observe`` counts such stars without.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bondwise.functions import rates
from bondwise.functions.combinatorics import partitions, weight
from bondwise.functions.expressions import to_sql
from bondwise.model import Mol, Pattern, Slot, Snapshot
from bondwise.session import cut

_of = lambda **kinds: T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
CONDITION = _of(name=TEXT, state=TEXT, bond=TEXT)
STEP = _of(
    parent=LONG, id=LONG, depth=INT, kind=TEXT, mol=INT, far_mol=INT, type=TEXT, name=TEXT, state=TEXT, far_name=TEXT, far_state=TEXT,
    groups=T.ArrayType(T.ArrayType(_of(coef=LONG, conds=T.ArrayType(CONDITION)))),
)
PROGRAM = _of(pattern_id=TEXT, leaf=LONG, error=TEXT, steps=T.ArrayType(STEP))
MAX_FORMULAS = 200


def pattern_of(x: dict, loose_names: bool = False) -> Pattern:
    """A pattern element of a model file, as read by ``sources.models``, as a ``Pattern``. Digits at the end of site names go with ``loose_names``."""
    listed = lambda part, key: ((part or {}).get(key) or []) if part else []
    labels: dict[str, int] = {}
    for k, b in enumerate(listed(x.get("ListOfBonds"), "Bond"), 1):
        labels[b["_site1"]] = labels[b["_site2"]] = k
    mols = []
    for m in listed(x.get("ListOfMolecules"), "Molecule"):
        slots = []
        for c in listed(m.get("ListOfComponents"), "Component"):
            bond = labels.get(c["_id"]) or {"0": "free", "+": "bound", "?": "any", None: "any"}.get(c["_numberOfBonds"], "bound")
            slots.append(Slot(c["_name"].rstrip("0123456789") if loose_names else c["_name"], c["_state"], bond))
        mols.append(Mol(m["_name"], tuple(slots)))
    return Pattern(tuple(mols), x.get("_relation"), int(x.get("_quantity") or 0))


def _meet(slots: list[Slot]) -> dict | None:
    """The condition that several slots put on one site together; None where no site can meet them all."""
    states = {s.state for s in slots if s.state is not None}
    bonds = {"bound" if isinstance(s.bond, int) else s.bond for s in slots} - {"any"}
    if len(states) > 1 or len(bonds) > 1:
        return None
    return {"name": slots[0].name, "state": next(iter(states), None), "bond": next(iter(bonds), "any")}


def _count_groups(mol: Mol) -> list[list[dict]]:
    """Per site name, the signed products of condition counts whose sum is the number of ways to place the node's unbonded slots."""
    names: dict[str, list[Slot]] = {}
    for s in sorted((s for s in mol.slots if not isinstance(s.bond, int)), key=lambda s: (s.name, s.state or "", s.bond)):
        names.setdefault(s.name, []).append(s)
    out = []
    for slots in names.values():
        terms = []
        for blocks in partitions(tuple(range(len(slots)))):
            conds = [_meet([slots[i] for i in b]) for b in blocks]
            if None not in conds:
                terms.append({"coef": weight(blocks), "conds": conds})
        out.append(terms)
    return out


def program(p: Pattern) -> list[dict]:
    """The steps of a connected pattern, from its first node along its bonds. Each step's id names all steps up to it."""
    blank = {c: None for c in STEP.fieldNames()}
    partner = {}
    for a, b in p.bonds():
        partner[a], partner[b] = b, a
    steps = [{"kind": "start", "mol": 0, "type": p.mols[0].type}]
    placed, done, queue = {0: 0}, set(), [0]

    def count(i: int, early: bool) -> None:
        """A node whose bonded and other slots have no name in common is counted at once: its bonds cannot take the sites, and fewer matches are walked on."""
        free, bonded = ({s.name for s in p.mols[i].slots if isinstance(s.bond, int) is b} for b in (False, True))
        groups = _count_groups(p.mols[i])
        if groups and early is free.isdisjoint(bonded):
            steps.append({"kind": "count", "mol": placed[i], "groups": groups, "type": p.mols[i].type})

    count(0, True)
    while queue:
        i = queue.pop(0)
        for j in sorted((j for k, j in partner if k == i), key=lambda j: (p.mols[i].slots[j].name, p.mols[i].slots[j].state or "", j)):
            far = partner[i, j]
            if (i, j) in done:
                continue
            done |= {(i, j), far}
            near_slot, far_slot = p.mols[i].slots[j], p.mols[far[0]].slots[far[1]]
            step = {"mol": placed[i], "name": near_slot.name, "state": near_slot.state, "far_name": far_slot.name, "far_state": far_slot.state, "type": p.mols[far[0]].type}
            if far[0] in placed:
                steps.append({**step, "kind": "close", "far_mol": placed[far[0]]})
            else:
                placed[far[0]] = len(placed)
                queue.append(far[0])
                steps.append({**step, "kind": "follow", "far_mol": placed[far[0]]})
                count(far[0], True)
    for i in placed:
        count(i, False)
    parent, out = 0, []
    for depth, step in enumerate(steps):
        name = int.from_bytes(hashlib.blake2b(f"{parent} {sorted(step.items())}".encode(), digest_size=8).digest(), "big", signed=True)
        out.append({**blank, **step, "parent": parent, "id": name, "depth": depth})
        parent = name
    return out


def compile_patterns(patterns: DataFrame, loose_names: bool = False) -> DataFrame:
    """(pattern_id, leaf, error, steps) of rows (pattern_id, pattern); ``leaf`` names the last step. Equal patterns share their leaf."""

    def each(batches):
        for batch in batches:
            rows = []
            for key, x in zip(batch.column("pattern_id").to_pylist(), batch.column("pattern").to_pylist()):
                row = {"pattern_id": key, "leaf": None, "error": None, "steps": []}
                try:
                    p = pattern_of(x or {}, loose_names)
                    if len(p.fragments()) != 1:
                        raise ValueError("no molecules" if not p.mols else "parts without a bond between them")
                    row["steps"] = program(p)
                    row["leaf"] = row["steps"][-1]["id"]
                except ValueError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(PROGRAM)
    return patterns.select(F.col("pattern_id").cast("string").alias("pattern_id"), "pattern").mapInArrow(each, PROGRAM)


def _fits(site: Column | dict, name: Column, state: Column, bond: Column) -> Column:
    """Whether a site (name, state, bound) meets a condition; a null state asks for nothing."""
    bound = site["bound"]
    return (site["name"] == name) & F.coalesce(state == site["state"], state.isNull()) & (
        (bond == "any") | ((bond == "free") & ~bound) | ((bond == "bound") & bound)
    )


def _key(c: Column) -> Column:
    return F.concat_ws("\u0001", c["name"], F.coalesce(c["state"], F.lit("\u0002")), c["bond"])


def match_programs(snap: Snapshot, programs: DataFrame) -> DataFrame:
    """(leaf, node_id, c): for every different pattern, its embeddings by the image of its first node."""
    steps = programs.select(F.explode("steps").alias("s")).select("s.*").dropDuplicates(["id"])
    keyed = lambda t: F.struct(t["coef"].alias("coef"), F.transform(t["conds"], lambda c: c.withField("key", _key(c))).alias("conds"))
    steps = steps.withColumn("groups", F.transform("groups", lambda g: F.transform(g, keyed)))
    # a group of one condition fails where no site meets it, which is cheaper to see than the whole product
    alone = F.get(F.filter("groups", lambda g: (F.size(g) == 1) & (F.size(F.get(g, F.lit(0))["conds"]) == 1)), F.lit(0))
    steps = cut(steps.withColumn("need", F.get(F.get(alone, F.lit(0))["conds"], F.lit(0))["key"]), "pattern-steps")
    leaves = programs.filter("leaf is not null").select("leaf").distinct()
    # only links along which some step walks
    walks, bonded = steps.filter("kind in ('follow', 'close')"), snap.sites.filter("partner_node is not null")
    near = bonded.join(walks.select(F.col("name").alias("site_name")).distinct(), "site_name", "left_semi")
    far = bonded.select(
        F.col("node_id").alias("partner_node"), F.col("site_idx").alias("partner_site"), F.col("type").alias("far_type"), F.col("site_name").alias("far_name"), F.col("state").alias("far_state")
    ).join(walks.select(F.col("type").alias("far_type"), "far_name").distinct(), ["far_type", "far_name"], "left_semi")
    ends = cut(near.drop("type").join(far, ["partner_node", "partner_site"]), "pattern-ends")
    conds = steps.filter("kind = 'count'").select("type", F.explode(F.flatten(F.transform(F.flatten("groups"), lambda t: t["conds"]))).alias("c")).distinct()
    site = {"name": F.col("site_name"), "state": F.col("site_state"), "bound": F.col("partner_node").isNotNull()}
    held = snap.sites.select("node_id", "type", "site_name", F.col("state").alias("site_state"), "partner_node")
    hits = held.join(conds.withColumn("site_name", F.col("c.name")), ["type", "site_name"]).filter(_fits(site, F.col("c.name"), F.col("c.state"), F.col("c.bond")))
    per = hits.groupBy("node_id", F.col("c.key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # a node has as many entries as its type has different conditions in all models
    counts = cut(per.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("held")), "condition-counts")
    depth = steps.agg(F.max("depth")).first()[0]

    used_kind = "array<struct<m:int,site:long,name:string,state:string,bound:boolean>>"
    start = steps.filter("kind = 'start'").select("id", "type")
    rows = cut(snap.nodes.join(start, "type").select("id", F.array("node_id").alias("n"), F.array().cast(used_kind).alias("used"), F.lit(1).cast("long").alias("c")), "matches")
    found = [rows.join(leaves.withColumnRenamed("leaf", "id"), "id", "left_semi")]
    for d in range(1, (depth or 0) + 1):
        below = steps.filter(F.col("depth") == d).select(
            F.col("parent").alias("id"), F.col("id").alias("child"), "kind", "mol", "far_mol", F.col("type").alias("far_type"), F.col("name").alias("site_name"), F.col("state").alias("w_state"),
            "far_name", F.col("far_state").alias("wf_state"), "groups", "need",
        )
        # matches meet the sites of a node once, and only there the steps that differ in states or conditions
        at = lambda some, *keys: rows.join(some.select("id", "mol", *keys).distinct(), "id").withColumn("node_id", F.get("n", F.col("mol")))
        along, near_far = below.filter("kind <> 'count'"), ["site_name", "far_type", "far_name"]
        walk = at(along, *near_far).join(ends, ["node_id", *near_far]).join(along.drop("groups", "need"), ["id", "mol", *near_far])
        free = lambda m, s: ~F.exists("used", lambda u: (u["m"] == F.col(m)) & (u["site"] == F.col(s)))
        same = lambda want, has: F.col(want).isNull() | F.coalesce(F.col(want) == F.col(has), F.lit(False))
        walk = walk.filter(same("w_state", "state") & same("wf_state", "far_state") & free("mol", "site_idx"))
        closes = (F.get("n", F.col("far_mol")) == F.col("partner_node")) & free("far_mol", "partner_site") & ((F.col("node_id") != F.col("partner_node")) | (F.col("site_idx") != F.col("partner_site")))
        walk = walk.filter(F.when(F.col("kind") == "close", closes).otherwise(~F.array_contains("n", F.col("partner_node"))))
        entry = lambda m, s, name, state: F.struct(F.col(m).alias("m"), F.col(s).alias("site"), F.col(name).alias("name"), F.col(state).alias("state"), F.lit(True).alias("bound"))
        grown = F.when(F.col("kind") == "close", F.col("n")).otherwise(F.concat("n", F.array("partner_node")))
        walked = walk.select(F.col("child").alias("id"), grown.alias("n"), F.concat("used", F.array(entry("mol", "site_idx", "site_name", "state"), entry("far_mol", "partner_site", "far_name", "far_state"))).cast(used_kind).alias("used"), "c")
        # a count of sites leaves out those the pattern's bonds have taken
        number = lambda c: F.coalesce(F.element_at("held", c["key"]), F.lit(0)) - F.size(F.filter("used", lambda u: (u["m"] == F.col("mol")) & _fits(u, c["name"], c["state"], c["bond"])))
        product = lambda t: F.aggregate(t["conds"], t["coef"], lambda acc, c: acc * number(c))
        ways = F.aggregate("groups", F.lit(1).cast("long"), lambda acc, g: acc * F.aggregate(g, F.lit(0).cast("long"), lambda s, t: s + product(t)))
        tests = below.filter("kind = 'count'")
        counted = at(tests).join(counts, "node_id").join(tests.select("id", "mol", "child", "groups", "need"), ["id", "mol"]).filter("need is null or map_contains_key(held, need)")
        counted = counted.select(F.col("child").alias("id"), "n", "used", (F.col("c") * ways).alias("c")).filter("c > 0")
        rows = cut(walked.unionByName(counted), "matches")
        found.append(rows.join(leaves.withColumnRenamed("leaf", "id"), "id", "left_semi"))
    every = reduce(DataFrame.unionByName, [f.select(F.col("id").alias("leaf"), F.get("n", F.lit(0)).alias("node_id"), "c") for f in found])
    return every.groupBy("leaf", "node_id").agg(F.sum("c").alias("c"))


def observe_models(counts: DataFrame, programs: DataFrame, observables: DataFrame, complexes: DataFrame) -> DataFrame:
    """(model, obs, value): observables of all models, zero included; ``observables`` has (model, obs, kind, pattern_id, relation, quantity)."""
    listed = observables.join(programs.select("pattern_id", "leaf"), "pattern_id", "left")
    totals = counts.groupBy("leaf").agg(F.sum("c").alias("value"))
    molecules = listed.filter("kind = 'Molecules'").join(totals, "leaf", "left").select("model", "obs", F.coalesce("value", F.lit(0)).alias("value"))
    # complexes by how many matches they hold: far fewer rows than complexes, and the conditions are put to those
    asked = listed.filter("kind = 'Species'").select("leaf").distinct()
    per = counts.join(asked, "leaf", "left_semi").join(complexes, "node_id").groupBy("leaf", "complex_id").agg(F.sum("c").alias("m")).groupBy("leaf", "m").agg(F.count(F.lit(1)).alias("complexes"))
    tests = listed.filter("kind = 'Species'").join(per, "leaf", "left")
    m, q = F.col("m"), F.col("quantity")
    holds = F.when(F.col("relation").isNull(), m > 0)
    for sign, test in (("==", m == q), (">=", m >= q), ("<=", m <= q), (">", m > q), ("<", m < q)):
        holds = holds.when(F.col("relation") == sign, (m > 0) & test)
    species = tests.select("model", "obs", F.when(holds, F.col("complexes")).otherwise(F.lit(0)).alias("value"))
    return molecules.unionByName(species).groupBy("model", "obs").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def price_models(counts: DataFrame, programs: DataFrame, rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(model, rule_id, n_1, n_2, rate, clamped, reason) of all rules of all models.

    ``rules`` has (model, rule_id, symmetry, law, constants, formula, total_rate, pattern_ids); ``symbols`` (model, name, value) holds parameters and observables, one value per name.
    Laws "Ele" take one constant, "MM" two, "Function" a formula over symbols and ``reactant_1``, ``reactant_2``; formulas are planned once per different text, ``MAX_FORMULAS`` at most.
    Two reactants of equal patterns are unordered pairs of different nodes. Rules that cannot be priced have a null rate and a reason.
    """
    sums = counts.groupBy("leaf").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("c")).cast("double").alias("sq"))
    parts = rules.select("model", "rule_id", F.posexplode_outer("pattern_ids").alias("at", "pattern_id")).join(programs.select("pattern_id", "leaf", "error"), "pattern_id", "left").join(sums, "leaf", "left")
    pick = lambda i, value: F.max(F.when(F.col("at") == i, value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = parts.groupBy("model", "rule_id").agg(
        F.count("at").alias("k"), F.max("error").alias("error"), *[pick(i, zero(F.col("n"))).alias(f"reactant_{i + 1}") for i in (0, 1)], pick(0, zero(F.col("sq"))).alias("sq"),
        (pick(0, F.col("leaf")) == pick(1, F.col("leaf"))).alias("alike"),
    )
    known = symbols.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("value").cast("double")))).alias("symbols"))
    rows = rules.join(per, ["model", "rule_id"]).join(known, "model", "left")
    rows = rows.withColumn("symbols", F.coalesce("symbols", F.create_map().cast("map<string,double>")))
    value_of = lambda text: F.coalesce(text.try_cast("double"), F.element_at("symbols", text))
    formulas = [r[0] for r in rules.filter("law = 'Function' and formula is not null").select("formula").distinct().limit(MAX_FORMULAS + 1).collect()]
    if len(formulas) > MAX_FORMULAS:
        raise ValueError(f"more than {MAX_FORMULAS} different formulas")
    law = F.when(F.col("law") == "Ele", value_of(F.get("constants", F.lit(0))))
    for text in formulas:
        # formulas write names in backticks; all but the reactants' are looked up
        sql = re.sub("`([^`]+)`", lambda m: m[0] if m[1].startswith("reactant_") else f"element_at(symbols, '{m[1]}')", to_sql(text))
        rows = rows.withColumn("f", F.when(F.col("formula") == text, F.expr(sql).cast("double")).otherwise(F.col("f") if "f" in rows.columns else F.lit(None).cast("double")))
    if formulas:
        law = law.when(F.col("law") == "Function", F.col("f"))
    n1, n2, k = F.col("reactant_1"), F.col("reactant_2"), F.col("k")
    rows, law = rows.withColumn("law_value", law), F.col("law_value")
    sym = F.coalesce(F.col("symmetry"), F.lit(1.0))
    rate = (
        F.when(F.col("law") == "MM", rates.michaelis_menten(value_of(F.get("constants", F.lit(0))), value_of(F.get("constants", F.lit(1))), n1 * sym, n2))
        .when(F.col("total_rate"), F.when((k >= 1) & (n1 <= 0) | (k >= 2) & (n2 <= 0), 0.0).otherwise(law))
        .when(k == 0, law).when(k == 1, n1 * law * sym)
        .when((k == 2) & F.col("alike"), (n1 * n1 - F.col("sq")) / 2.0 * law).when(k == 2, n1 * n2 * law * sym)
    )
    rows, rate = rows.withColumn("raw", rate), F.col("raw")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(k > 2, "more than two reactants").when(~F.col("law").isin("Ele", "MM", "Function"), "law not covered")
        .when((F.col("law") == "MM") & (k != 2), "two reactants are needed").when(rate.isNull(), "a name without a value")
    )
    value, clamped = rates.guarded(rate)
    priced = rows.withColumns({"reason": reason, "rate": value, "clamped": clamped})
    return priced.select("model", "rule_id", F.when(k >= 1, n1).alias("n_1"), F.when(k >= 2, n2).alias("n_2"), F.when(F.col("reason").isNull(), F.col("rate")).alias("rate"),
                         F.when(F.col("reason").isNull(), F.col("clamped")).alias("clamped"), "reason")
