"""A written model corpus: read, observed and priced against one snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondwise.operators import catalogue
from bondwise.plans.file_queries import write_documents
from bondwise.plans.registry import query
from bondwise.plans.tables import customer_graph, kept, table
from bondwise.session import cut, fresh_path
from bondwise.sources import models


def _site(key, name, bonds, state=None):
    at = F.concat(F.lit(' state="'), state, F.lit('"')) if state is not None else F.lit("")
    return F.concat(F.lit('<Component id="'), key, F.lit(f'" name="{name}"'), at, F.lit(f' numberOfBonds="{bonds}"/>'))


def _mol(key, name, *sites):
    return F.concat(F.lit('<Molecule id="'), key, F.lit(f'" name="{name}"><ListOfComponents>'), *sites, F.lit("</ListOfComponents></Molecule>"))


def _pattern(tag, key, mols, bond=None, more=None):
    bonds = F.lit("") if bond is None else F.concat(F.lit('<ListOfBonds><Bond id="b" site1="'), bond[0], F.lit('" site2="'), bond[1], F.lit('"/></ListOfBonds>'))
    return F.concat(F.lit(f'<{tag} id="'), key, F.lit('"'), F.lit("") if more is None else more, F.lit("><ListOfMolecules>"), *mols, F.lit("</ListOfMolecules>"), bonds, F.lit(f"</{tag}>"))


def write_corpus(spark, sf, path):
    """A model per nation. Each of its suppliers brings two observables and a rule, with states and laws taken from its number."""
    k = F.col("s_suppkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))
    status, digit = pick("FOP", 3), pick("12345", 5)
    seg = pick(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], 5)
    name = lambda kind: F.concat(F.lit(kind), k.cast("string"))
    key = lambda kind, *parts: F.concat(name(kind), F.lit("_" + "_".join(parts)))
    pair = _pattern(
        "Pattern", key("p", "P1"),
        [_mol(key("p", "P1", "M1"), "Customer", _site(key("p", "P1", "M1", "C1"), "seg", "0", seg), _site(key("p", "P1", "M1", "C2"), "order", "1")),
         _mol(key("p", "P1", "M2"), "Order", _site(key("p", "P1", "M2", "C1"), "cust", "1"), _site(key("p", "P1", "M2", "C2"), "status", "0", status))],
        (key("p", "P1", "M1", "C2"), key("p", "P1", "M2", "C1")),
    )
    at_least = F.concat(F.lit(' relation="&gt;=" quantity="'), (k % 4 + 1).cast("string"), F.lit('"'))
    busy = _pattern(
        "Pattern", key("b", "P1"),
        [_mol(key("b", "P1", "M1"), "Customer", _site(key("b", "P1", "M1", "C1"), "order", "1", digit)), _mol(key("b", "P1", "M2"), "Order", _site(key("b", "P1", "M2", "C1"), "cust", "1"))],
        (key("b", "P1", "M1", "C1"), key("b", "P1", "M2", "C1")), at_least,
    )
    observed = lambda kind, mode, p: F.concat(F.lit('<Observable id="'), name(kind), F.lit('" name="'), name(kind), F.lit(f'" type="{mode}"><ListOfPatterns>'), p, F.lit("</ListOfPatterns></Observable>"))
    first = _pattern("ReactantPattern", key("R", "RP1"), [_mol(key("R", "RP1", "M1"), "Order", _site(key("R", "RP1", "M1", "C1"), "status", "?", status))])
    second = _pattern("ReactantPattern", key("R", "RP2"), [_mol(key("R", "RP2", "M1"), "Customer", _site(key("R", "RP2", "M1", "C1"), "seg", "?", seg))])
    law = pick(["Ele", "Ele", "Function", "MM"], 4)
    constants = F.when(k % 4 == 3, '<RateConstant value="k1"/><RateConstant value="k2"/>').when(k % 4 == 1, '<RateConstant value="0.25"/>').otherwise('<RateConstant value="k1"/>')
    rule = F.concat(
        F.lit('<ReactionRule id="'), name("R"), F.lit('" name="rule" symmetry_factor="1"><ListOfReactantPatterns>'), first, F.when(k % 2 == 1, second).otherwise(""),
        F.lit('</ListOfReactantPatterns><RateLaw id="l" type="'), law, F.lit('" name="slow" totalrate="0"><ListOfRateConstants>'), constants, F.lit("</ListOfRateConstants></RateLaw></ReactionRule>"),
    )
    model = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    lines = table(spark, sf, "supplier").select(model.alias("model"), F.explode(F.array(observed("p", "Molecules", pair), observed("b", "Species", busy), rule)).alias("line"))
    own = lambda n, value: F.concat(F.lit(f'<Parameter id="{n}" type="Constant" value="'), value, F.lit('"/>'))
    fixed = F.array(own("k1", (F.col("s_nationkey") + 0.5).cast("string")), own("k2", F.lit("100")), F.lit('<Function id="slow"><Expression>k1/(1 + reactant_1)^2</Expression></Function>'))
    shared = table(spark, sf, "supplier").select("s_nationkey").distinct().select(model.alias("model"), F.explode(fixed).alias("line"))
    write_documents(shared.unionByName(lines), path, "model")


@query(
    """
    WITH o AS (SELECT o_orderstatus st, substr(o_orderpriority, 1, 1) d, o_custkey c, c_mktsegment seg FROM orders JOIN customer ON c_custkey = o_custkey),
    s AS (SELECT s_suppkey k, 'nation ' || s_nationkey AS model, s_nationkey + 0.5 AS k1, substr('FOP', CAST(s_suppkey % 3 + 1 AS INT), 1) st, CAST(s_suppkey % 5 + 1 AS VARCHAR) d,
          ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_suppkey % 5 + 1] seg, s_suppkey % 4 + 1 AS q FROM supplier),
    pairs AS (SELECT seg, st, count(*) n FROM o GROUP BY ALL), busy AS (SELECT d, m, count(*) n FROM (SELECT d, c, count(*) m FROM o GROUP BY ALL) GROUP BY ALL),
    n AS (SELECT s.*, (SELECT count(*) FROM orders WHERE o_orderstatus = s.st)::DOUBLE n1, (SELECT count(*) FROM customer WHERE c_mktsegment = s.seg)::DOUBLE n2 FROM s),
    f AS (SELECT *, n1 - 100 - n2 AS b, sqrt((n1 - 100 - n2) * (n1 - 100 - n2) + 400 * n1) AS root FROM n),
    g AS (SELECT *, CASE WHEN b >= 0 THEN 0.5 * (b + root) ELSE 200 * n1 / nullif(root - b, 0) END AS free FROM f)
    SELECT model, 'p' || k AS name, CAST(coalesce(pairs.n, 0) AS DOUBLE) AS value FROM s LEFT JOIN pairs USING (seg, st)
    UNION ALL SELECT model, 'b' || k, CAST(coalesce((SELECT sum(n) FROM busy WHERE busy.d = s.d AND m >= q), 0) AS DOUBLE) FROM s
    UNION ALL SELECT model, 'R' || k, round(CASE k % 4 WHEN 0 THEN n1 * k1 WHEN 1 THEN n1 * n2 * 0.25 WHEN 2 THEN n1 * (k1 / ((1 + n1) * (1 + n1)))
        ELSE CASE WHEN n1 <= 0 OR n2 <= 0 THEN 0 ELSE k1 * free * n2 / (100 + free) END END, 6) FROM g
    """
)
def model_corpus(spark, sf):
    """Every observable's value and every rule's rate, of all models at once."""
    path = fresh_path(spark, "corpus")
    write_corpus(spark, sf, path)
    snap, cx = kept(customer_graph(spark, sf))
    obs = cut(models.observable_patterns(models.read_observables(spark, path)), "corpus-observables")
    rules = cut(models.read_rules(spark, path), "corpus-rules")
    programs = cut(catalogue.compile_patterns(obs.select("pattern_id", "pattern").unionByName(models.rule_patterns(rules))), "programs")
    counts = cut(catalogue.match_programs(snap, programs), "corpus-counts")
    seen = catalogue.observe_models(counts, programs, obs, cx).select("model", F.col("obs").alias("name"), F.col("value").cast("double").alias("value"))
    symbols = models.read_parameters(spark, path).select("model", "name", "value")
    priced = catalogue.price_models(counts, programs, models.pricing_table(rules, models.read_functions(spark, path)), symbols)
    return seen.unionByName(priced.select("model", F.col("rule_id").alias("name"), F.round("rate", 6).alias("value")))
