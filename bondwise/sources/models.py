"""Model files as tables, read with Spark's XML source, and the checks that flag constructs not covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.session import cut

MAX_REACTANTS = 6


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """(model, …): elements of one tag over many files; attributes carry an underscore.

    A model is a file, or a directory ``model=…`` of files.
    """
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    path_of = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(path_of, "/model=([^/]+)/", 1), F.lit(""))
    name = F.coalesce(F.url_decode(folder), F.regexp_replace(F.element_at(F.split(path_of, "/"), -1), r"\.xml$", ""))
    return rows.select(name.alias("model"), *[c for c in rows.columns if c != "model"])


SITE_X = "struct<_id:string,_name:string,_state:string,_numberOfBonds:string>"
MOL_X = f"struct<_id:string,_name:string,ListOfComponents:struct<Component:array<{SITE_X}>>>"
BOND_X = "struct<_id:string,_site1:string,_site2:string>"
PATTERN_X = (
    f"struct<_id:string,_relation:string,_quantity:string,ListOfMolecules:struct<Molecule:array<{MOL_X}>>,"
    f"ListOfBonds:struct<Bond:array<{BOND_X}>>>"
)
OP_X = "array<struct<_id:string,_site:string,_site1:string,_site2:string,_finalState:string,_DeleteMolecules:string,_moveConnected:string>>"
RULE_SCHEMA = (
    "_id string, _name string, _symmetry_factor double, _priority string, "
    f"ListOfReactantPatterns struct<ReactantPattern:array<{PATTERN_X}>>, "
    f"ListOfProductPatterns struct<ProductPattern:array<{PATTERN_X}>>, "
    "RateLaw struct<_id:string,_type:string,_name:string,_totalrate:string,"
    "ListOfRateConstants:struct<RateConstant:array<struct<_value:string>>>>, "
    f"ListOfOperations struct<AddBond:{OP_X},DeleteBond:{OP_X},StateChange:{OP_X},Add:{OP_X},Delete:{OP_X}>"
)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(model, name, expr, value)."""
    rows = _rows(spark, path, "Parameter", "_id string, _type string, _value string, _expr string")
    return rows.select("model", F.col("_id").alias("name"), F.coalesce("_expr", "_value").alias("expr"), F.col("_value").try_cast("double").alias("value"))


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """(model, type, population, site_idx, site_name, allowed_states); site_idx null for a type without sites."""
    one = "struct<_id:string,ListOfAllowedStates:struct<AllowedState:array<struct<_id:string>>>>"
    rows = _rows(spark, path, "MoleculeType", f"_id string, _population string, ListOfComponentTypes struct<ComponentType:array<{one}>>")
    sites = rows.select("model", F.col("_id").alias("type"), F.coalesce(F.col("_population") == "1", F.lit(False)).alias("population"),
                        F.posexplode_outer("ListOfComponentTypes.ComponentType").alias("site_idx", "c"))
    return sites.select("model", "type", "population", "site_idx", F.col("c._id").alias("site_name"),
                        F.col("c.ListOfAllowedStates.AllowedState._id").alias("allowed_states"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(model, seed_id, seed_name, amount_expr, fixed, n_molecules, n_bonds, first_type)."""
    rows = _rows(
        spark, path, "Species",
        "_id string, _name string, _concentration string, _Fixed string, "
        f"ListOfMolecules struct<Molecule:array<{MOL_X}>>, ListOfBonds struct<Bond:array<{BOND_X}>>",
    )
    mols = F.col("ListOfMolecules.Molecule")
    return rows.select(
        "model", F.col("_id").alias("seed_id"), F.col("_name").alias("seed_name"), F.col("_concentration").alias("amount_expr"),
        F.coalesce(F.col("_Fixed") == "1", F.lit(False)).alias("fixed"), F.coalesce(F.size(mols), F.lit(0)).alias("n_molecules"),
        F.coalesce(F.size("ListOfBonds.Bond"), F.lit(0)).alias("n_bonds"), F.get(mols, 0)["_name"].alias("first_type"),
    )


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    """(model, name, expr, args, refs): a function with arguments is local."""
    rows = _rows(
        spark, path, "Function",
        "_id string, Expression string, ListOfArguments struct<Argument:array<struct<_id:string>>>, "
        "ListOfReferences struct<Reference:array<struct<_name:string,_type:string>>>",
    )
    return rows.select("model", F.col("_id").alias("name"), F.trim("Expression").alias("expr"),
                       F.col("ListOfArguments.Argument._id").alias("args"), F.col("ListOfReferences.Reference._name").alias("refs"))


def read_observables(spark: SparkSession, path: str) -> DataFrame:
    """(model, obs_id, obs, kind, pattern): one row per pattern."""
    rows = _rows(spark, path, "Observable", f"_id string, _name string, _type string, ListOfPatterns struct<Pattern:array<{PATTERN_X}>>")
    return rows.select("model", F.col("_id").alias("obs_id"), F.col("_name").alias("obs"), F.col("_type").alias("kind"),
                       F.explode_outer("ListOfPatterns.Pattern").alias("pattern"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(model, rule_id, rule, symmetry, priority, reactants, products, law, law_name, constants, total_rate, ops)."""
    rows = _rows(spark, path, "ReactionRule", RULE_SCHEMA)
    none = F.array().cast("array<struct<op:string,target:string,target2:string,state:string,move_connected:boolean>>")

    def listed(kind: str):
        one = lambda o: F.struct(
            F.lit(kind).alias("op"), F.coalesce(o["_site"], o["_site1"], o["_id"]).alias("target"), o["_site2"].alias("target2"),
            o["_finalState"].alias("state"), (F.coalesce(o["_moveConnected"], F.lit("0")) == "1").alias("move_connected"),
        )
        return F.coalesce(F.transform(F.col(f"ListOfOperations.{kind}"), one), none)

    ops = F.concat(*[listed(kind) for kind in ("AddBond", "DeleteBond", "StateChange", "Add", "Delete")])
    return rows.select(
        "model", F.col("_id").alias("rule_id"), F.col("_name").alias("rule"), F.col("_symmetry_factor").alias("symmetry"),
        F.col("_priority").alias("priority"), F.col("ListOfReactantPatterns.ReactantPattern").alias("reactants"),
        F.col("ListOfProductPatterns.ProductPattern").alias("products"), F.col("RateLaw._type").alias("law"),
        F.col("RateLaw._name").alias("law_name"), F.col("RateLaw.ListOfRateConstants.RateConstant._value").alias("constants"),
        F.coalesce(F.col("RateLaw._totalrate") == "1", F.lit(False)).alias("total_rate"), ops.alias("ops"),
    )


def observable_patterns(observables: DataFrame) -> DataFrame:
    """(model, obs, kind, pattern_id, pattern, relation, quantity): rows of ``read_observables`` with their patterns named and their conditions read."""
    quantity = F.col("pattern._quantity").try_cast("long")
    name = F.concat_ws("/", "model", "obs_id", "pattern._id")
    return observables.filter("pattern is not null").select("model", "obs", "kind", name.alias("pattern_id"), "pattern", F.col("pattern._relation").alias("relation"), quantity.alias("quantity"))


def rule_patterns(rules: DataFrame) -> DataFrame:
    """(pattern_id, pattern) of the reactants of ``read_rules``; ``pattern_id`` names model, rule and place."""
    pats = rules.select("model", "rule_id", F.posexplode("reactants").alias("at", "pattern"))
    return pats.select(F.concat_ws("/", "model", "rule_id", F.col("at").cast("string")).alias("pattern_id"), "pattern")


def pricing_table(rules: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(model, rule_id, symmetry, law, constants, formula, total_rate, pattern_ids): what ``catalogue.price_models`` reads."""
    ids = F.transform(F.sequence(F.lit(0), F.size("reactants") - 1), lambda k: F.concat_ws("/", "model", "rule_id", k.cast("string")))
    ids = F.when(F.size("reactants") > 0, ids).otherwise(F.array().cast("array<string>"))
    rows = rules.withColumn("pattern_ids", F.coalesce(ids, F.array().cast("array<string>")))
    if functions is None:
        rows = rows.withColumn("formula", F.lit(None).cast("string"))
    else:
        rows = rows.join(functions.select("model", F.col("name").alias("law_name"), F.col("expr").alias("formula")), ["model", "law_name"], "left")
    return rows.select("model", "rule_id", "symmetry", "law", "constants", "formula", "total_rate", "pattern_ids")


def pattern_sites(rules: DataFrame) -> DataFrame:
    """(model, rule_id, reactant, mol, type, site_id, site_name, state, bonds) of reactant patterns."""
    pats = rules.select("model", "rule_id", F.posexplode("reactants").alias("reactant", "p"))
    mols = pats.select("model", "rule_id", "reactant", F.posexplode_outer("p.ListOfMolecules.Molecule").alias("mol", "m"))
    sites = mols.select("model", "rule_id", "reactant", "mol", F.col("m._name").alias("type"), F.explode_outer("m.ListOfComponents.Component").alias("c"))
    return sites.select("model", "rule_id", "reactant", "mol", "type", F.col("c._id").alias("site_id"), F.col("c._name").alias("site_name"),
                        F.col("c._state").alias("state"), F.col("c._numberOfBonds").alias("bonds"))


def pattern_audit(rules: DataFrame) -> DataFrame:
    """(model, rule_id, reactant, n_mols, n_bonds, loose, diameter): loose patterns have molecules not joined by bonds.

    A pattern is joined when its bond ends reach every molecule; patterns hold a handful of molecules, so the
    reachable set grows inside one array expression, one bond layer per step. ``diameter`` is the longest shortest path in
    bonds between molecules that are joined.
    """
    pats = rules.select("model", "rule_id", F.posexplode("reactants").alias("reactant", "p"))
    mol_ids = F.coalesce("p.ListOfMolecules.Molecule._id", F.array().cast("array<string>"))
    bonds = F.coalesce("p.ListOfBonds.Bond", F.array().cast(f"array<{BOND_X}>"))
    owner = lambda site: F.regexp_replace(site, "_C[0-9]+$", "")
    pairs = F.transform(bonds, lambda b: F.struct(owner(b["_site1"]).alias("a"), owner(b["_site2"]).alias("b")))
    rows = pats.select("model", "rule_id", "reactant", mol_ids.alias("ids"), pairs.alias("pairs"))
    grow = lambda seen, _: F.array_union(seen, F.flatten(F.transform(
        F.filter("pairs", lambda q: F.array_contains(seen, q["a"]) | F.array_contains(seen, q["b"])), lambda q: F.array(q["a"], q["b"]))))
    reach = F.aggregate("ids", F.slice("ids", 1, 1), grow)

    def layers(start):
        """Bond layers from one molecule until nothing new is reached."""
        def step(acc, _):
            wider = grow(acc["seen"], None)
            return F.struct(wider.alias("seen"), (acc["depth"] + (F.size(wider) > F.size(acc["seen"])).cast("int")).alias("depth"))

        return F.aggregate("ids", F.struct(F.array(start).alias("seen"), F.lit(0).alias("depth")), step, lambda acc: acc["depth"])

    diameter = F.coalesce(F.array_max(F.transform("ids", layers)), F.lit(0)).alias("diameter")
    return rows.select("model", "rule_id", "reactant", F.size("ids").alias("n_mols"), F.size("pairs").alias("n_bonds"),
                       (F.size(F.array_intersect(reach, F.col("ids"))) < F.size("ids")).alias("loose"), diameter)


def unpinned_patterns(rules: DataFrame, types: DataFrame) -> DataFrame:
    """(model, rule_id, reactant, mol): pattern molecules that leave a declared site, its state or its bond open."""
    sites = pattern_sites(rules)
    takes_state = types.filter("site_name is not null").groupBy("model", "type", "site_name").agg(
        F.max(F.coalesce(F.size("allowed_states"), F.lit(0)) > 0).alias("takes_state")
    )
    stated = sites.join(takes_state, ["model", "type", "site_name"], "left")
    open_site = (F.coalesce("takes_state", F.lit(False)) & F.col("state").isNull()) | F.col("bonds").isin("+", "?")
    per = stated.groupBy("model", "rule_id", "reactant", "mol", "type").agg(
        F.count("site_id").alias("listed"), F.coalesce(F.bool_or(open_site & F.col("site_id").isNotNull()), F.lit(False)).alias("open")
    )
    declared = types.groupBy("model", "type").agg(F.count("site_name").alias("declared"))
    return per.join(declared, ["model", "type"], "left").filter(F.col("open") | (F.col("listed") < F.col("declared")))


def tags_in(spark: SparkSession, path: str, tags: list[str]) -> set[str]:
    """Those of ``tags`` whose names stand anywhere in the files: one pass over text, in pieces up to the next ``>``, so that long lines do no harm."""
    pieces = spark.read.option("lineSep", ">").text(path)
    found = pieces.agg(*[F.coalesce(F.bool_or(F.contains("value", F.lit(t))), F.lit(False)).alias(t) for t in tags]).first()
    return {t for t in tags if found[t]}


def lint_models(spark: SparkSession, path: str) -> DataFrame:
    """(model, element, severity, feature, subject): constructs that cannot be honoured or only in part.

    Each tag is read once and written, since every check would parse the files again; a tag that stands in no file is not parsed at all.
    """
    readers = {
        "ReactionRule": read_rules, "MoleculeType": read_types, "Species": read_seeds, "Parameter": read_parameters, "Function": read_functions,
        **{t: lambda spark, path, t=t: _rows(spark, path, t, "_id string") for t in ("compartment", "Compartment")},
    }
    present = tags_in(spark, path, list(readers))

    def once(tag: str) -> DataFrame:
        rows = readers[tag](spark, path)
        return cut(rows, f"lint-{tag}") if tag in present else spark.createDataFrame([], rows.schema)

    rules, types, seeds, params, functions = (once(t) for t in ("ReactionRule", "MoleculeType", "Species", "Parameter", "Function"))

    def finding(rows: DataFrame, subject: str, severity: str, element: str, feature: str) -> DataFrame:
        return rows.select("model", F.lit(element).alias("element"), F.lit(severity).alias("severity"), F.lit(feature).alias("feature"), F.col(subject).alias("subject"))

    n_react = F.coalesce(F.size("reactants"), F.lit(0))
    out = []
    areas = once("compartment").unionByName(once("Compartment"))
    out.append(finding(areas.filter("_id is not null"), "_id", "Error", "ListOfCompartments", "compartment volumes"))
    for law, note in (("Sat", "deprecated saturation law"), ("Hill", "law for generated networks only")):
        out.append(finding(rules.filter(F.col("law") == law), "rule_id", "Error", f"RateLaw@type={law}", note))
    binds = F.exists("ops", lambda o: o["op"] == "AddBond") | F.exists("ops", lambda o: o["op"] == "DeleteBond")
    arrhenius = rules.filter((F.col("law") == "Arrhenius") & ~(binds & (F.size("ops") == 1) & (n_react <= 2)))
    out.append(finding(arrhenius, "rule_id", "Error", "RateLaw@type=Arrhenius", "energy rule beyond two-reactant binding"))
    many = rules.filter(n_react >= 3)
    loose = pattern_audit(many).filter("loose").select("model", "rule_id").distinct().withColumn("loose", F.lit(True))
    many = many.join(loose, ["model", "rule_id"], "left")
    many = many.filter(F.coalesce("loose", F.lit(False)) | (F.col("law") != "Ele") | (n_react > MAX_REACTANTS))
    out.append(finding(many, "rule_id", "Error", "ListOfReactantPatterns", "three or more reactants outside the covered shapes"))
    out.append(finding(types.filter("population").select("model", "type").distinct(), "type", "Error", "MoleculeType@population", "hybrid population type"))
    fixed = seeds.filter("fixed")
    out.append(finding(fixed.filter("n_molecules <> 1 or n_bonds > 0"), "seed_id", "Error", "Species@Fixed", "fixed species of several molecules"))
    again = fixed.groupBy("model", "first_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out.append(finding(again, "first_type", "Error", "Species@Fixed", "several fixed species of one type"))
    twice = types.filter("site_name is not null").groupBy("model", "type", "site_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    touched = pattern_sites(rules.filter("total_rate")).join(twice, ["model", "type", "site_name"], "left_semi").select("model", "rule_id").distinct()
    out.append(finding(touched, "rule_id", "Error", "RateLaw@totalrate", "total rate on repeated sites"))
    out.append(finding(rules.filter("total_rate").join(touched, ["model", "rule_id"], "left_anti"), "rule_id", "Warn", "RateLaw@totalrate", "total rate"))
    laws = rules.filter("law = 'Function'").select("model", "rule_id", "total_rate", n_react.alias("n"), F.col("law_name").alias("name"))
    laws = laws.join(functions.select("model", "name", "expr", "args"), ["model", "name"])
    called = F.array_max(F.transform(F.regexp_extract_all("expr", F.lit(r"reactant_([0-9]+)\s*\("), 1), lambda x: x.cast("int")))
    laws = laws.withColumn("called", called).filter("called is not null")
    is_local = F.coalesce(F.size("args"), F.lit(0)) > 0
    out.append(finding(laws.filter("called > n"), "rule_id", "Error", "reactant_N", "count of a reactant the rule does not have"))
    out.append(finding(laws.filter(F.col("called") <= F.col("n")).filter(is_local), "rule_id", "Error", "reactant_N", "reactant count in a local function"))
    out.append(finding(laws.filter((F.col("called") <= F.col("n")) & ~is_local & ~F.col("total_rate")), "rule_id", "Warn", "reactant_N", "counts enter the rate twice"))
    mm = rules.filter("law = 'MM'").withColumn("km", F.get("constants", 1))
    mm = mm.join(params.select("model", F.col("name").alias("km"), "value"), ["model", "km"], "left")
    km = F.coalesce(F.col("km").try_cast("double"), F.col("value"))
    out.append(finding(mm.filter(km < 0), "rule_id", "Error", "RateLaw@type=MM", "negative half-saturation"))
    vague = unpinned_patterns(mm, types).select("model", "rule_id").distinct()
    out.append(finding(vague, "rule_id", "Warn", "RateLaw@type=MM", "a reactant can match several species"))
    owners = F.transform("ops", lambda o: F.regexp_extract(o["target"], r"^(.*_RP[0-9]+)_M", 1))
    changed = mm.filter("symmetry <> 1").select("model", "rule_id", F.explode(owners).alias("changed")).filter("changed <> ''")
    both = changed.groupBy("model", "rule_id").agg(F.countDistinct("changed").alias("n")).filter("n > 1")
    out.append(finding(both, "rule_id", "Warn", "RateLaw@type=MM", "symmetry factor on two changed reactants"))
    out.append(finding(rules.filter(F.exists("ops", lambda o: o["move_connected"])), "rule_id", "Warn", "MoveConnected", "needs compartments"))
    out.append(finding(rules.filter("priority is not null"), "rule_id", "Warn", "priority", "execution order ignored"))
    return reduce(DataFrame.unionByName, out)
