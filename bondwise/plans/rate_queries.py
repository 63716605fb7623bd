"""Queries that price rules, evaluate expressions and resolve parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondwise.functions import expressions, params, rates, tfun
from bondwise.model import Slot, mol, observable, pattern
from bondwise.operators import canonical, match, scoring
from bondwise.plans.registry import query
from bondwise.plans.tables import customer_graph, kept, line_graph, table, timed_events


@query(
    """
    WITH p AS (SELECT sum(l_quantity * l_discount * l_tax) abc, sum(l_quantity) a, sum(l_discount) b, sum(l_tax) c, sum(l_quantity * l_discount) ab,
                      sum(l_quantity * l_tax) ac, sum(l_discount * l_tax) bc FROM lineitem)
    SELECT round((a * b * c - ab * c - ac * b - bc * a + 2 * abc) / 1e6, 3) AS total FROM p
    """
)
def distinct_tuple_sum_3(spark, sf):
    """Sum over triples of distinct lines of quantity, discount and tax, from seven sums."""
    t = rates.distinct_tuple_sum(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return t.select(F.round(F.col("total") / 1e6, 3).alias("total"))


@query(
    """
    WITH s AS (SELECT *, row_number() OVER () i FROM lineitem),
    t AS (SELECT a.l_orderkey, sum(a.l_quantity * b.l_quantity * c.l_linenumber) AS total
          FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.i <> b.i JOIN s c ON a.l_orderkey = c.l_orderkey AND c.i <> a.i AND c.i <> b.i GROUP BY 1)
    SELECT l_orderkey, round(coalesce(t.total, 0), 3) AS total FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN t USING (l_orderkey)
    """
)
def distinct_tuple_sum_per_order(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("a"), F.col("l_quantity").alias("b"), F.col("l_linenumber").alias("c"))
    t = rates.distinct_tuple_sum(rows, ["a", "b", "c"], ("l_orderkey",))
    return t.select("l_orderkey", F.round("total", 3).alias("total"))


@query(
    """
    WITH n AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'F') c FROM lineitem GROUP BY 1)
    SELECT round((pow(sum(c), 2) - sum(c * c)) / 2 * 0.001, 3) AS rate, CAST(sum(c) AS DOUBLE) AS both, CAST(sum(c * c) AS DOUBLE) AS both_sq FROM n
    """
)
def homodimer_pairs(spark, sf):
    """Unordered pairs of parts through their open line sites."""
    snap = line_graph(spark, sf)
    part = mol("Part", Slot("line", "F"))
    sums = scoring.homodimer_sums(scoring.shared_sites(snap, part, 0, part, 0))
    rate = rates.homodimer(*[F.col(c) for c in ("a_only", "b_total", "both", "b_only", "both_sq")], F.lit(0.001))
    return sums.select(F.round(rate, 3).alias("rate"), "both", "both_sq")


@query(
    """
    WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') a, count(*) FILTER (o_orderstatus = 'O') b FROM orders GROUP BY 1)
    SELECT round((sum(a) * sum(b) - sum(a * b)) * 0.01, 3) AS rate FROM c
    """
)
def distinct_complex_pairs(spark, sf):
    """Pairs of open and filled orders of different customers, without forming any pair."""
    snap, cx = kept(customer_graph(spark, sf))
    a, b = (match.node_counts(snap, mol("Order", Slot("status", s))) for s in "FO")
    pairs = scoring.same_complex_pairs(a, b, cx)
    sums = a.agg(F.sum("c").cast("double").alias("a")).crossJoin(b.agg(F.sum("c").cast("double").alias("b"))).crossJoin(pairs)
    return sums.select(F.round(rates.heterodimer(F.col("a"), F.col("b"), F.lit(0.01), 1.0, F.col("pairs")), 3).alias("rate"))


@query(
    """
    WITH g AS (SELECT p_brand, p_type, count(*) * 1.0 AS s, sum(p_size) / 100.0 AS e, avg(p_retailprice) / 100 - 9 AS km0, p_type = 'ECONOMY' AS zero FROM part GROUP BY 1, 2),
    h AS (SELECT *, CASE WHEN zero THEN 0.0 WHEN p_type = 'SMALL' THEN -1.0 ELSE km0 END AS km FROM g),
    r AS (SELECT p_brand, p_type, CASE WHEN km < 0 THEN NULL WHEN km = 0 THEN 2 * least(s, e)
          ELSE 2 * (0.5 * ((s - km - e) + sqrt((s - km - e) * (s - km - e) + 4 * km * s))) * e / (km + 0.5 * ((s - km - e) + sqrt((s - km - e) * (s - km - e) + 4 * km * s))) END AS v FROM h)
    SELECT p_brand, p_type, round(coalesce(v, 0), 6) AS rate, v IS NULL AS clamped FROM r
    """
)
def michaelis_menten_rates(spark, sf):
    """Substrate and enzyme counts per brand and type; zero and negative half-saturation included."""
    g = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).cast("double").alias("s"), (F.sum("p_size") / 100.0).alias("e"), (F.avg("p_retailprice") / 100 - 9).alias("km0")
    )
    km = F.when(F.col("p_type") == "ECONOMY", 0.0).when(F.col("p_type") == "SMALL", -1.0).otherwise(F.col("km0"))
    rate, clamped = rates.guarded(rates.michaelis_menten(F.lit(2.0), km, F.col("s"), F.col("e")))
    return g.select("p_brand", "p_type", F.round(rate, 6).alias("rate"), clamped.alias("clamped"))


TFUN = """
    WITH pts AS (SELECT CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1),
    seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM pts),
    f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + l_discount * 30 - 1 AS arg FROM lineitem),
    j AS (SELECT f.*, seg.*, (SELECT min(x) FROM pts) lo, (SELECT max(x) FROM pts) hi FROM f ASOF LEFT JOIN seg ON f.arg >= seg.x0)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN arg <= lo THEN (SELECT y FROM pts WHERE x = lo) WHEN arg >= hi THEN (SELECT y FROM pts WHERE x = hi) ELSE {mid} END, 6) AS value FROM j
"""


def _table_function(spark, sf, method):
    points = table(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    at = F.col("l_quantity") + F.col("l_discount") * 30 - 1
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", at.alias("at"))
    return tfun.apply_table(rows, points, "at", method).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("value", 6).alias("value"))


@query(TFUN.format(mid="y0 + (y1 - y0) * ((arg - x0) / (x1 - x0))"))
def tfun_linear(spark, sf):
    return _table_function(spark, sf, "linear")


@query(TFUN.format(mid="y0"))
def tfun_step(spark, sf):
    return _table_function(spark, sf, "step")


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(-(0.5 + 0.3 * dg) / 2.478, 9) AS ln_fwd, round(-(0.5 - 0.7 * dg) / 2.478, 9) AS ln_rev FROM (
      SELECT *, 1.5 + CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN -2.0 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.75 ELSE 0 END AS dg FROM lineitem)
    """
)
def energy_rates(spark, sf):
    """Each line as a match: one term always applies, one with any of two contexts, one with a single context."""
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf, "lineitem").select(*ids, "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
    lines = lines.withColumn("match_id", F.concat_ws("/", *[F.col(c).cast("string") for c in [*ids, "l_extendedprice", "l_shipdate"]]))
    contexts = lines.select("match_id", F.explode(F.array(F.concat(F.lit("flag "), "l_returnflag"), F.concat(F.lit("status "), "l_linestatus"))).alias("context"))
    terms = spark.createDataFrame(
        [("base", 1.5, None), ("gated", -2.0, "flag R"), ("gated", -2.0, "status F"), ("open", 0.75, "status O")], "term string, energy double, context string"
    )
    both = rates.energy_rates(lines.select("match_id", *ids), contexts, terms, 0.3, 0.5, 2.478)
    return both.select(*ids, F.round(F.ln("rate"), 9).alias("ln_fwd"), F.round(F.ln("reverse"), 9).alias("ln_rev"))


PRICED = """
    WITH c AS (SELECT o_custkey k, count(*) n, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o, count(*) FILTER (o_orderstatus = 'P') p FROM orders GROUP BY 1),
    t AS (SELECT sum(f)::DOUBLE f, sum(o)::DOUBLE o, sum(p)::DOUBLE p, sum(f * f)::DOUBLE ff, sum(f * o)::DOUBLE fo, count(*) FILTER (f > 0)::DOUBLE cf FROM c),
    r AS (
      SELECT 'source' AS rule, NULL::DOUBLE n_1, NULL::DOUBLE n_2, NULL::DOUBLE n_3, 2.5 AS rate, false AS clamped FROM t
      UNION ALL SELECT 'close', f, NULL, NULL, f * 0.02, false FROM t
      UNION ALL SELECT 'meet', f, o, NULL, (f * o - fo) * 0.02, false FROM t
      UNION ALL SELECT 'pair', f, f, NULL, (f * f - f) / 2 * 0.02, false FROM t
      UNION ALL SELECT 'whole', p, NULL, NULL, p * 0.5, false FROM t
      UNION ALL SELECT 'negative', f, NULL, NULL, 0.0, true FROM t
      UNION ALL SELECT 'context', cf, NULL, NULL, cf * 0.02, false FROM t
      UNION ALL SELECT 'triple', f, f, o, f * (f - 1) * o * 0.02 * 0.5, false FROM t)
"""


@query(
    PRICED
    + "SELECT rule, n_1, n_2, n_3, round(rate / 1e3, 4) AS rate, clamped, round(rate / (SELECT sum(rate) FROM r), 9) AS share FROM r"
)
def rule_rates(spark, sf):
    """Rules of every order priced on one snapshot, with their shares of the total."""
    snap, cx = kept(customer_graph(spark, sf))
    f, o, p = (pattern(mol("Order", Slot("status", s))) for s in "FOP")
    symbols = spark.range(1).select(F.lit(0.02).alias("k"), F.lit(0.0).alias("time"))
    rules = [
        scoring.Rule("source", (), "2.5"),
        scoring.Rule("close", (f,), "k"),
        scoring.Rule("meet", (f, o), "k", same_complex_ok=False),
        scoring.Rule("pair", (f, f), "k", same_site=(0, 0)),
        scoring.Rule("whole", (p,), "0.5*reactant_1", kind="total"),
        scoring.Rule("negative", (f,), "k - 1"),
        scoring.Rule("context", (f,), "k", context=(True,)),
        scoring.Rule("triple", (f, f, o), "k", symmetry=0.5),
    ]
    r = scoring.score_rules(snap, rules, symbols, cx)
    return r.select("rule", "n_1", "n_2", "n_3", F.round(F.col("rate") / 1e3, 4).alias("rate"), "clamped", F.round("share", 9).alias("share"))


@query(
    """
    WITH c AS (SELECT o_custkey k, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE f, (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE o FROM orders GROUP BY 1),
    t AS (SELECT sum(f) f, sum(o) o, count(*) FILTER (f > 0) cf FROM c),
    p AS (SELECT sum(0.02 * a.f * a.f * 2 * b.o) twice, sum(0.02 * a.f * a.f * b.o) half, sum(CASE WHEN a.f > 0 THEN 0.02 * b.o ELSE 0 END) context FROM c a JOIN c b ON a.k <> b.k),
    r AS (SELECT 'local' AS rule, f AS n_1, NULL::DOUBLE AS n_2, (SELECT sum(0.02 * f * f) FROM c) AS rate FROM t UNION ALL SELECT 'product', f, o, twice FROM t, p
          UNION ALL SELECT 'half', f, o, half * 0.5 FROM t, p UNION ALL SELECT 'context', cf, o, context FROM t, p)
    SELECT rule, n_1, n_2, round(rate / 1e3, 4) AS rate, round(rate / (SELECT sum(rate) FROM r), 9) AS share FROM r
    """
)
def product_rates(spark, sf):
    """Laws read at each match: a sum, products of two sums with and without a factor on the second side, and a context side priced once per complex."""
    snap, cx = kept(customer_graph(spark, sf))
    f, o = (pattern(mol("Order", Slot("status", s))) for s in "FO")
    near = pattern(mol("Customer", Slot("order", None, 1)), mol("Order", Slot("cust", None, 1), Slot("status", "F")))
    filled, open_ = observable("filled", "Molecules", f), observable("open", "Molecules", o)
    symbols = spark.range(1).select(F.lit(0.02).alias("k"))
    rules = [
        scoring.Rule("local", (f,), "k*filled", kind="local", local=(filled,), scopes=("complex",)),
        scoring.Rule("product", (f, o), "k*filled", kind="product", law_b="1 + open", local=(filled, open_), scopes=("complex", "node"), same_complex_ok=False),
        scoring.Rule("half", (f, o), "k*filled", kind="product", symmetry=0.5, local=(filled,), scopes=("complex",), same_complex_ok=False),
        scoring.Rule("context", (near, o), "k*(1 + filled)", kind="product", local=(filled,), context=(True, False), same_complex_ok=False),
    ]
    r = scoring.score_rules(snap, rules, symbols, cx, canonical.classes(snap, cx)[1])
    return r.select("rule", "n_1", "n_2", F.round(F.col("rate") / 1e3, 4).alias("rate"), F.round("share", 9).alias("share"))


@query(
    """
    WITH c AS (SELECT o_custkey k, count(*) FILTER (o_orderstatus = 'F') f, count(*) n FROM orders GROUP BY 1),
    t AS (SELECT sum(f) total FROM c)
    SELECT round(sum(n * 0.1 * f * total) / 1e6, 6) AS by_complex, round((SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 0.1 * total ELSE 0 END) FROM orders, t) / 1e6, 6) AS by_node FROM c, t
    """
)
def local_rates(spark, sf):
    """A law that reads filled orders at its own order or complex, and their total under a bare name."""
    snap, cx = kept(customer_graph(spark, sf))
    o = observable("filled", "Molecules", pattern(mol("Order", Slot("status", "F"))))
    weights = match.node_counts(snap, mol("Order"))
    total = match.observe(snap, [o]).select(F.col("value").cast("double").alias("all_filled"), F.lit(0.1).alias("k"))
    by = {s: scoring.local_rate_sum(snap, weights, [o], "k*filled*all_filled", total, cx, s) for s in ("complex", "node")}
    a = by["complex"].select(F.round(F.col("total") / 1e6, 6).alias("by_complex"))
    return a.crossJoin(by["node"].select(F.round(F.col("total") / 1e6, 6).alias("by_node")))


@query(
    """
    WITH r AS (SELECT event_type AS rule, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS time, value - 5 AS v FROM events)
    SELECT rule, min(time) AS time, round(arg_min(v, time), 6) AS value FROM r WHERE v < 0 GROUP BY 1
    """
)
def first_clamps(spark, sf):
    """When each event type's value, less five, first falls below zero."""
    rows = timed_events(spark, sf).select(F.col("event_type").alias("rule"), "time", (F.col("value") - 5).alias("value"))
    return scoring.first_clamps(rows).select("rule", "time", F.round("value", 6).alias("value"))


@query(
    """
    WITH p AS (SELECT l_orderkey AS rule, l_linenumber AS reactant, l_partkey AS site FROM lineitem), o AS (SELECT l_orderkey AS rule, CASE WHEN l_tax = 0 THEN NULL ELSE l_partkey END AS site FROM lineitem WHERE l_discount >= 0.09 OR l_tax = 0),
    v AS (SELECT DISTINCT rule FROM o WHERE site IS NULL), h AS (SELECT DISTINCT rule, site FROM o WHERE site IS NOT NULL)
    SELECT p.rule, CAST(reactant AS INTEGER) AS reactant, bool_or(h.rule IS NOT NULL OR v.rule IS NOT NULL) AS transformed FROM p LEFT JOIN h ON h.rule = p.rule AND h.site = p.site LEFT JOIN v ON v.rule = p.rule GROUP BY 1, 2
    """
)
def reactant_roles(spark, sf):
    """Orders as rules, their line numbers as reactants, discounted lines as the operations."""
    lines = table(spark, sf, "lineitem")
    pats = lines.select(F.col("l_orderkey").alias("rule"), F.col("l_linenumber").alias("reactant"), F.col("l_partkey").alias("site_id"))
    ops = lines.filter("l_discount >= 0.09 or l_tax = 0").select(F.col("l_orderkey").alias("rule"), F.when(F.col("l_tax") != 0, F.col("l_partkey")).alias("site_id"))
    return scoring.reactant_roles(pats, ops)


PARAMS = [("A", None, 100.0), ("C", "2*B + A^2", 40000.5), ("B", "A/4 + D", 25.001), ("D", "0.5", 0.5), ("F", "D*3", 1.49), ("X", "Y + 1", 7.0), ("Y", "X - 1", 6.0)]


@query(
    """
    WITH s AS (SELECT s_suppkey AS scenario_id, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS sa, CASE WHEN s_nationkey = 3 THEN s_suppkey * 1.0 END AS sb FROM supplier),
    a AS (SELECT *, coalesce(sa, 100.0) AS a FROM s),
    b AS (SELECT *, coalesce(sb, CASE WHEN a / 4 + 0.5 = 100.0 / 4 + 0.5 THEN 25.001 ELSE a / 4 + 0.5 END) AS b FROM a),
    c AS (SELECT *, CASE WHEN 2 * b + a * a = 2 * 25.001 + 100.0 * 100.0 THEN 40000.5 ELSE 2 * b + a * a END AS c FROM b)
    SELECT scenario_id, a AS "A", round(b, 9) AS "B", round(c, 6) AS "C", 0.5::DOUBLE AS "D", 1.49::DOUBLE AS "F", 7.0::DOUBLE AS "X", 'X,Y' AS unresolved FROM c
    """
)
def derived_params(spark, sf):
    """One scenario per supplier overriding A by a positive balance and, for one nation, B by the supplier number."""
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scenario_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("A"),
        F.when(F.col("s_nationkey") == 3, F.col("s_suppkey").cast("double")).alias("B"),
    )
    d = params.derive_parameters(s, PARAMS)
    return d.select("scenario_id", "A", F.round("B", 9).alias("B"), F.round("C", 6).alias("C"), "D", "F", "X", F.array_join(F.array_sort("unresolved"), ",").alias("unresolved"))


@query(
    """
    WITH s AS (SELECT s_suppkey AS scenario_id, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 100.0 END AS a FROM supplier),
    r AS (SELECT scenario_id, 'S1' AS seed_id, a * 1.5 + 0.25 AS amount FROM s UNION ALL SELECT scenario_id, 'S2', 10.9 - a FROM s)
    SELECT r.scenario_id, seed_id, round(CASE WHEN seed_id = 'S2' AND r.scenario_id % 10 = 0 THEN 421.5498 ELSE amount END, 6) AS amount,
           CAST(trunc(CASE WHEN seed_id = 'S2' AND r.scenario_id % 10 = 0 THEN 421.5498 ELSE amount END) AS BIGINT) AS copies FROM r
    """
)
def seed_amounts(spark, sf):
    """Seed amounts per scenario; a pin on every tenth scenario outranks the expression."""
    sup = table(spark, sf, "supplier")
    s = sup.select(F.col("s_suppkey").alias("scenario_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("A"))
    pins = sup.filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("scenario_id"), F.lit("S2").alias("seed_id"), F.lit(421.5498).alias("amount"))
    t = params.seed_table(s, [("S1", "A()", "A*1.5 + 0.25"), ("S2", "B()", "10.9 - A")], [("A", None, 100.0)], pins)
    return t.select("scenario_id", "seed_id", F.round("amount", 6).alias("amount"), "copies")


@query(
    """
    WITH s AS (SELECT p_partkey AS id, p_name AS name FROM part), k AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT CAST(p_size AS VARCHAR) FROM part UNION SELECT 'zz' || p_type FROM part),
    n AS (SELECT name, count(*) c, min(CAST(id AS VARCHAR)) lo FROM s GROUP BY 1)
    SELECT key, CASE WHEN c = 1 THEN lo WHEN c > 1 THEN NULL ELSE CAST(id AS VARCHAR) END AS seed_id,
           CASE WHEN c > 1 THEN 'ambiguous name' WHEN c IS NULL AND id IS NULL THEN 'unknown seed' END AS error
    FROM k LEFT JOIN n ON n.name = key LEFT JOIN s ON CAST(s.id AS VARCHAR) = key
    """
)
def seed_keys(spark, sf):
    part = table(spark, sf, "part")
    seeds = part.select(F.col("p_partkey").cast("string").alias("seed_id"), F.col("p_name").alias("seed_name"))
    keys = part.select(F.explode(F.array("p_name", F.col("p_size").cast("string"), F.concat(F.lit("zz"), "p_type"))).alias("key")).distinct()
    return params.resolve_keys(keys, seeds)


@query(
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           round(CASE WHEN l_quantity >= 25 AND NOT l_discount < 0.05 THEN ln(l_quantity) ELSE sqrt(l_extendedprice) END + pow(-2.0, 2) + pow(1 + l_tax, 2) - least(l_quantity, 30) * 2, 6) AS value,
           round(exp(-l_tax) * greatest(l_discount, 0.05) * 7, 9) AS shadowed,
           round(CASE WHEN l_quantity <> 25 AND l_discount > 0.05 THEN CASE WHEN l_quantity = 30 THEN 'inf'::DOUBLE ELSE 512 / (l_quantity - 30) END
                ELSE CASE WHEN l_tax > 0.04 THEN l_quantity ELSE 0 END - CASE WHEN l_tax = 0 OR l_quantity > 40 THEN 1 ELSE 0 END END, 9) AS guarded FROM lineitem
    """
)
def expressions_on_lines(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
                                               F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("e"))
    one = expressions.evaluate(rows, "if(q >= 25 and not(d < 0.05), ln(q), sqrt(e)) + (-2)^2 + (1 + x)^2 - min(q, 30)*2")
    two = expressions.evaluate(one, "exp(-x)*max(d, 0.05)*q", {"q": 7.0}, "shadowed")
    # a parameter may be named like a word of SQL; conditions count 1 or 0; a division by zero is infinite and only matters where it is taken;
    # a quantity not taken adds 0 even where it is unknown or infinite, which a product with the condition would not
    named = two.withColumn("order", F.col("d"))
    three = expressions.evaluate(named, "if(q != 25 && order > 0.05, 2^3^2/(q - 30), if(x > 0.04, q, 0) - (x == 0 || q > 40))", name="guarded")
    shown = [expressions.rounded(F.col(c), n).alias(c) for c, n in (("value", 6), ("shadowed", 9), ("guarded", 9))]
    return three.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *shown)


@query(
    """
    SELECT o_orderkey, round(o_totalprice / 1000, 9) AS f1, round(o_totalprice / 1000 * 2 + 1, 9) AS f2, round(sqrt(o_totalprice / 1000 * 2 + 1), 9) AS f3 FROM orders
    """
)
def chained_functions(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    out = expressions.with_functions(rows, [("f1", "price/1000"), ("f2", "f1*2 + 1"), ("f3", "sqrt(f2)")])
    return out.select("o_orderkey", *[F.round(f, 9).alias(f) for f in ("f1", "f2", "f3")])


@query(
    """
    WITH e AS (SELECT p_partkey, unnest([('obs' || p_size, true), ('k_' || lower(p_type), false), ('vol', false)]) AS r FROM part)
    SELECT p_partkey, r[1] AS name, r[2] AS tagged FROM e
    """
    .replace("r[1]", "struct_extract(r, 1)").replace("r[2]", "struct_extract(r, 2)")
)
def formula_names(spark, sf):
    """Names read by a formula built from each part, told apart by whether they are applied to a tag."""
    part = table(spark, sf, "part")
    text = F.concat(F.lit("k_"), F.lower("p_type"), F.lit("*vol*exp(-1.5e-3*obs"), F.col("p_size").cast("string"), F.lit("(x1)) + 2*vol"))
    named = expressions.referenced_names(part.select("p_partkey", text.alias("expr")))
    return named.filter("name <> 'x1'").select("p_partkey", "name", "tagged")
