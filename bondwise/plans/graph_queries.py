"""Queries over site graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondwise.model import Slot, Snapshot, mol, observable, pattern, snapshot_from_links
from bondwise.operators import canonical, components, match, quality, rings
from bondwise.plans.registry import query
from bondwise.plans.tables import customer_graph, kept, line_graph, supply_graph, table, talk_graph
from bondwise.session import cut, fresh_path
from bondwise.sources import snapshots, species


@query(
    """
    SELECT l_returnflag || '-' || l_linestatus AS obs, CAST(count(*) AS BIGINT) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE o_orderstatus = 'F' GROUP BY 1
    UNION ALL SELECT 'any', CAST(count(*) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    """
)
def obs_molecules_two_node(spark, sf):
    snap = line_graph(spark, sf)
    obs = [
        observable(
            f"{r}-{s}", "Molecules",
            pattern(mol("Order", Slot("item", r, 1), Slot("status", "F")), mol("Part", Slot("line", s, 1))),
        )
        for r in "ARN"
        for s in "FO"
    ]
    obs.append(observable("any", "Molecules", pattern(mol("Order", Slot("item", None, 1)), mol("Part", Slot("line", None, 1)))))
    return match.observe(snap, obs)


@query(
    """
    WITH s AS (SELECT l_orderkey k, row_number() OVER () AS i, l_returnflag f FROM lineitem)
    SELECT a.k * 4 + 1 AS node_id, CAST(count(*) AS BIGINT) AS c
    FROM s a JOIN s b ON a.k = b.k AND a.i <> b.i JOIN s c ON a.k = c.k AND c.i <> a.i AND c.i <> b.i
    WHERE a.f = 'R' AND b.f = 'A' GROUP BY 1
    """
)
def single_node_embeddings(spark, sf):
    return match.node_counts(line_graph(spark, sf), mol("Order", Slot("item", "R"), Slot("item", "A"), Slot("item")))


@query(
    """
    WITH s AS (SELECT l_partkey k, row_number() OVER () AS i, l_linestatus f FROM lineitem)
    SELECT a.k * 4 + 2 AS node_id, CAST(count(*) AS BIGINT) AS c FROM s a
    WHERE a.f = 'F' AND EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.i <> a.i AND b.f = 'O') GROUP BY 1
    """
)
def reacting_site_images(spark, sf):
    return match.reacting_counts(line_graph(spark, sf), mol("Part", Slot("line", "F"), Slot("line", "O")), 0)


@query(
    """
    WITH w AS (
      SELECT l_partkey k, l_orderkey o, count(*) FILTER (l_returnflag = 'R') r, count(*) FILTER (l_returnflag = 'A') a
      FROM lineitem GROUP BY 1, 2)
    SELECT k * 4 + 2 AS node_id, CAST(sum(r) * sum(a) - sum(r * a) AS BIGINT) AS c
    FROM w GROUP BY 1 HAVING sum(r) * sum(a) - sum(r * a) > 0
    """
)
def star_embeddings(spark, sf):
    p = pattern(
        mol("Part", Slot("line", None, 1), Slot("line", None, 2)),
        mol("Order", Slot("item", "R", 1)),
        mol("Order", Slot("item", "A", 2)),
    )
    return match.seed_counts(line_graph(spark, sf), p)


@query(
    """
    WITH s AS (SELECT *, row_number() OVER () AS i FROM lineitem)
    SELECT a.l_orderkey * 4 + 1 AS n0, a.l_partkey * 4 + 2 AS n1, CAST(count(*) AS BIGINT) AS embeddings
    FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.i <> b.i GROUP BY 1, 2
    """
)
def ring_embeddings(spark, sf):
    """Orders and parts joined by two lines at once: the links of a pair are counted, not paired."""
    p = pattern(mol("Order", Slot("item", None, 1), Slot("item", None, 2)), mol("Part", Slot("line", None, 1), Slot("line", None, 2)))
    return rings.pair_counts(line_graph(spark, sf), p).withColumnRenamed("c", "embeddings")


@query(
    """
    WITH op AS (SELECT l_orderkey o, l_partkey p, count(*) w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    ps AS (SELECT l_partkey p, l_suppkey s, count(*) w FROM lineitem GROUP BY 1, 2),
    os AS (SELECT l_orderkey o, l_suppkey s, count(*) w FROM lineitem GROUP BY 1, 2)
    SELECT op.o * 4 + 1 AS n0, op.p * 4 + 2 AS n1, os.s * 4 + 3 AS n2, CAST(op.w * ps.w * os.w AS BIGINT) AS c
    FROM op JOIN os ON op.o = os.o JOIN ps ON ps.p = op.p AND ps.s = os.s
    """
)
def triangle_embeddings(spark, sf):
    """Orders that took a returned part and bought, by that line or another, from a supplier who ever delivered the part."""
    p = pattern(
        mol("Order", Slot("part", "R", 1), Slot("supp", None, 2)),
        mol("Part", Slot("order", None, 1), Slot("supp", None, 3)),
        mol("Supplier", Slot("order", None, 2), Slot("part", None, 3)),
    )
    return rings.triangle_counts(supply_graph(spark, sf), p)


@query(
    """
    WITH w AS (SELECT l_orderkey o, l_partkey p, count(*) FILTER (l_returnflag = 'A') a, count(*) n FROM lineitem GROUP BY 1, 2),
    pairs AS (
      SELECT x.o, y.o AS q, sum(x.a * y.n) * sum(x.n * y.n) - sum(x.a * y.n * x.n * y.n) AS c
      FROM w x JOIN w y ON x.p = y.p AND x.o <> y.o GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT 'squares' AS obs, CAST(coalesce(sum(c), 0) AS BIGINT) AS value FROM pairs
    """
)
def square_embeddings(spark, sf):
    """Two orders that share two parts, the first bond by a line of flag A."""
    p = pattern(
        mol("Order", Slot("item", "A", 1), Slot("item", None, 4)),
        mol("Part", Slot("line", None, 1), Slot("line", None, 2)),
        mol("Order", Slot("item", None, 2), Slot("item", None, 3)),
        mol("Part", Slot("line", None, 3), Slot("line", None, 4)),
    )
    return match.observe(line_graph(spark, sf), [observable("squares", "Molecules", p)])


@query(
    """
    WITH n AS (SELECT o_custkey k, count(*) a, count(*) FILTER (substr(o_orderpriority, 1, 1) <> '1') b FROM orders GROUP BY 1)
    SELECT k * 4 AS node_id, CAST((a - 1) * b AS BIGINT) AS c FROM n WHERE (a - 1) * b > 0
    """
)
def loose_site_names(spark, sf):
    """Urgent orders hang on sites of a name of their own. Numbered names of a pattern fit sites of just that name, and those without a number."""
    snap = customer_graph(spark, sf)
    urgent = (F.col("site_name") == "order") & (F.col("state") == "1")
    sites = snap.sites.withColumn("site_name", F.when(urgent, "order1").otherwise(F.col("site_name")))
    m = mol("Customer", Slot("order1", None, "bound", loose=True), Slot("order2", None, "bound", loose=True))
    return match.node_counts(Snapshot(snap.nodes, sites), m)


@query(
    """
    SELECT o_custkey * 4 AS n1, o_orderkey * 4 + 1 AS n0 FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '1' AND c_mktsegment = 'BUILDING'
    """
)
def embedding_list(spark, sf):
    p = pattern(mol("Order", Slot("cust", None, 1), Slot("status", "P")), mol("Customer", Slot("order", "1", 1), Slot("seg", "BUILDING")))
    return match.embeddings(customer_graph(spark, sf), p).select("n0", "n1")


@query(
    """
    SELECT o_orderkey * 4 + 1 AS node_id, CAST(1 AS BIGINT) AS c FROM orders o
    WHERE (EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
           OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A'))
      AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')
    """
)
def include_exclude(spark, sf):
    snap = line_graph(spark, sf)
    base = match.node_counts(snap, mol("Order"))
    include = (pattern(mol("Order", Slot("item", "R"))), pattern(mol("Order", Slot("item", "A"))))
    exclude = (pattern(mol("Order", Slot("item", None, 1)), mol("Part", Slot("line", "F", 1))),)
    return match.constrained(snap, base, include, exclude)


@query(
    """
    SELECT 'Customer-free' AS obs, CAST(0 AS BIGINT) AS value
    UNION ALL SELECT 'Customer-bound', CAST(count(*) AS BIGINT) FROM orders
    UNION ALL SELECT 'Order-any', CAST(count(*) AS BIGINT) FROM orders
    UNION ALL SELECT 'Order-free', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'two patterns', CAST(count(*) + count(*) FILTER (o_orderstatus = 'F') AS BIGINT) FROM orders
    """
)
def bond_predicates(spark, sf):
    one = lambda name, *ps: observable(name, "Molecules", *ps)
    return match.observe(
        customer_graph(spark, sf),
        [
            one("Customer-free", pattern(mol("Customer", Slot("order", None, "free")))),
            one("Customer-bound", pattern(mol("Customer", Slot("order", None, "bound")))),
            one("Order-any", pattern(mol("Order", Slot("cust")))),
            one("Order-free", pattern(mol("Order", Slot("status", "O", "free")))),
            one("two patterns", pattern(mol("Order")), pattern(mol("Order", Slot("status", "F")))),
        ],
    )


@query(
    "SELECT type, CAST(count(*) AS BIGINT) AS nodes FROM (SELECT 'Order' AS type FROM orders UNION ALL SELECT 'Part' FROM part) GROUP BY 1"
)
def node_counts_by_type(spark, sf):
    return match.count_by_type(line_graph(spark, sf))


LINE_COMPONENTS = """
    WITH RECURSIVE e AS (
      SELECT l_orderkey * 4 + 1 AS u, l_partkey * 4 + 2 AS v FROM lineitem {where}
      UNION SELECT l_partkey * 4 + 2, l_orderkey * 4 + 1 FROM lineitem {where}),
    cc(node, comp) USING KEY (node) AS (
      SELECT n, n FROM (SELECT o_orderkey * 4 + 1 AS n FROM orders UNION ALL SELECT p_partkey * 4 + 2 FROM part)
      UNION
      SELECT r.node, min(c.comp) FROM cc c JOIN e ON e.u = c.node JOIN recurring.cc r ON r.node = e.v
      WHERE c.comp < r.comp GROUP BY r.node),
"""


@query(
    LINE_COMPONENTS.format(where="")
    + "sizes AS (SELECT comp, count(*) n FROM cc GROUP BY 1) SELECT n AS n_nodes, CAST(count(*) AS BIGINT) AS complexes FROM sizes GROUP BY 1"
)
def components_size_dist(spark, sf):
    """All lines as links: one complex holds nearly every node."""
    snap = line_graph(spark, sf)
    return components.size_distribution(components.connected_components(snap.nodes, snap.links()))


@query(
    LINE_COMPONENTS.format(where="")
    + """
    n AS (SELECT comp, count(*) n FROM cc GROUP BY 1),
    m AS (SELECT comp, count(*) m FROM lineitem JOIN cc ON node = l_orderkey * 4 + 1 GROUP BY 1)
    SELECT n AS n_nodes, CAST(coalesce(m, 0) AS BIGINT) AS n_links, CAST(coalesce(m, 0) - n + 1 AS BIGINT) AS cycles,
           CAST(count(*) AS BIGINT) AS complexes
    FROM n LEFT JOIN m USING (comp) GROUP BY ALL
    """
)
def cycle_counts(spark, sf):
    snap, cx = kept(line_graph(spark, sf))
    rows = components.cycle_counts(snap, cx)
    return rows.groupBy("n_nodes", "n_links", "cycles").agg(F.count(F.lit(1)).alias("complexes"))


@query("SELECT CAST(count(*) AS BIGINT) AS complexes FROM (SELECT DISTINCT conv_id FROM conversations)")
def complex_count(spark, sf):
    snap = talk_graph(spark, sf)
    return components.complex_count(components.connected_components(snap.nodes, snap.links()))


@query(
    """
    WITH per AS (SELECT c_custkey, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT n AS n_nodes, CAST(count(*) AS BIGINT) AS complexes FROM per GROUP BY 1
    """
)
def orders_per_complex(spark, sf):
    snap, cx = kept(customer_graph(spark, sf))
    return components.type_size_distribution(snap, cx, "Order")


@query(
    """
    WITH per AS (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o
                 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'any' AS obs, CAST(count(*) FILTER (f > 0) AS BIGINT) AS value FROM per
    UNION ALL SELECT 'exactly 3', CAST(count(*) FILTER (f = 3) AS BIGINT) FROM per
    UNION ALL SELECT 'at least 4', CAST(count(*) FILTER (f >= 4) AS BIGINT) FROM per
    UNION ALL SELECT 'at most 2', CAST(count(*) FILTER (f > 0 AND f <= 2) AS BIGINT) FROM per
    UNION ALL SELECT 'above 5', CAST(count(*) FILTER (f > 5) AS BIGINT) FROM per
    UNION ALL SELECT 'below 2', CAST(count(*) FILTER (f > 0 AND f < 2) AS BIGINT) FROM per
    UNION ALL SELECT 'F or O', CAST(count(*) FILTER (f > 0) + count(*) FILTER (o > 0) AS BIGINT) FROM per
    UNION ALL SELECT 'F with O', CAST(count(*) FILTER (f > 0 AND o > 0) AS BIGINT) FROM per
    """
)
def obs_species_quantity(spark, sf):
    snap, cx = kept(customer_graph(spark, sf))
    f = mol("Order", Slot("status", "F"))
    o = mol("Order", Slot("status", "O"))
    cases = [("exactly 3", "==", 3), ("at least 4", ">=", 4), ("at most 2", "<=", 2), ("above 5", ">", 5), ("below 2", "<", 2)]
    obs = [observable(name, "Species", pattern(f, relation=r, quantity=q)) for name, r, q in cases]
    obs += [
        observable("any", "Species", pattern(f)),
        observable("F or O", "Species", pattern(f), pattern(o)),
        observable("F with O", "Species", pattern(f, o)),
    ]
    return match.observe(snap, obs, cx)


@query(
    """
    WITH per AS (SELECT o_custkey k, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o, count(*) n FROM orders GROUP BY 1)
    SELECT 'F.O' AS obs, CAST(sum(f * o) AS BIGINT) AS value FROM per
    UNION ALL SELECT 'Order.Order.Customer', CAST(sum(n * (n - 1)) AS BIGINT) FROM per
    UNION ALL SELECT 'F.any', CAST(sum(f * (n - 1)) AS BIGINT) FROM per
    """
)
def same_complex_parts(spark, sf):
    """Patterns whose parts share a complex without a bond between them."""
    snap, cx = kept(customer_graph(spark, sf))
    f, o, any_order = mol("Order", Slot("status", "F")), mol("Order", Slot("status", "O")), mol("Order")
    obs = [
        observable("F.O", "Molecules", pattern(f, o)),
        observable("Order.Order.Customer", "Molecules", pattern(any_order, any_order, mol("Customer"))),
        observable("F.any", "Molecules", pattern(f, any_order)),
    ]
    return match.observe(snap, obs, cx)


@query(
    """
    WITH f AS (SELECT o_custkey k, count(*) FILTER (o_orderstatus = 'F') v FROM orders GROUP BY 1),
    w AS (SELECT o_orderkey * 4 + 1 AS node_id, v FROM orders JOIN f ON k = o_custkey
          UNION ALL SELECT c_custkey * 4, coalesce(v, 0) FROM customer LEFT JOIN f ON k = c_custkey),
    n AS (SELECT o_orderkey * 4 + 1 AS node_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END v FROM orders
          UNION ALL SELECT c_custkey * 4, 0 FROM customer)
    SELECT w.node_id, CAST(n.v AS BIGINT) AS at_node, CAST(w.v AS BIGINT) AS in_complex FROM w JOIN n USING (node_id)
    """
)
def local_observable_values(spark, sf):
    snap, cx = kept(customer_graph(spark, sf))
    o = observable("f", "Molecules", pattern(mol("Order", Slot("status", "F"))))
    near = match.local_values(snap, o).withColumnRenamed("value", "at_node")
    wide = match.local_values(snap, o, cx, "complex").withColumnRenamed("value", "in_complex")
    return near.join(wide, "node_id")


@query(
    """
    WITH s AS (
      SELECT c_custkey, c_mktsegment seg, count(o_orderkey) n, count(*) FILTER (o_orderstatus = 'F') f, count(*) FILTER (o_orderstatus = 'O') o,
             string_agg(substr(o_orderpriority, 1, 1) || o_orderstatus, ',' ORDER BY substr(o_orderpriority, 1, 1) || o_orderstatus) sig
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT seg, CAST(n + 1 AS BIGINT) AS n_nodes, CAST(n AS BIGINT) AS n_links, CAST(max(f) AS BIGINT) AS n_f, CAST(max(o) AS BIGINT) AS n_o,
           CAST(count(*) AS BIGINT) AS complexes
    FROM s GROUP BY seg, n, sig
    """
)
def species_census(spark, sf):
    """Customers with the same segment and the same mix of orders are one species; figures are read off its text."""
    snap, cx = kept(customer_graph(spark, sf))
    rows = canonical.census(snap, cx)
    return rows.select(
        F.regexp_extract("species", r"seg~(\w+)", 1).alias("seg"), "n_nodes", "n_links",
        F.regexp_count("species", F.lit("status~F")).cast("long").alias("n_f"), F.regexp_count("species", F.lit("status~O")).cast("long").alias("n_o"), "complexes",
    )


@query(
    """
    WITH s AS (SELECT conv_id, count(*) n, count(*) FILTER (role = 'user') u, string_agg(role, ',' ORDER BY turn) sig FROM conversations GROUP BY 1)
    SELECT CAST(n AS BIGINT) AS n_nodes, CAST(max(u) AS BIGINT) AS n_user, CAST(count(*) AS BIGINT) AS complexes FROM s GROUP BY n, sig
    """
)
def species_census_chains(spark, sf):
    snap, cx = kept(talk_graph(spark, sf))
    rows = canonical.census(snap, cx)
    return rows.select("n_nodes", F.regexp_count("species", F.lit(r"user\(")).cast("long").alias("n_user"), "complexes")


WL_SQL = (
    LINE_COMPONENTS.format(where="")
    + """
    h AS (SELECT l_orderkey * 4 + 1 AS u, l_partkey * 4 + 2 AS v, 'i' || l_returnflag || l_linestatus AS k FROM lineitem
          UNION ALL SELECT l_partkey * 4 + 2, l_orderkey * 4 + 1, 'l' || l_returnflag || l_linestatus FROM lineitem),
    c0 AS (SELECT o_orderkey * 4 + 1 AS u, 'O' || o_orderstatus AS c FROM orders UNION ALL SELECT p_partkey * 4 + 2, 'P' || p_brand FROM part),
    """
    + "".join(
        f"""c{i} AS (SELECT a.u, md5(any_value(a.c) || coalesce(string_agg(h.k || b.c, ',' ORDER BY h.k || b.c), '')) AS c
            FROM c{i - 1} a LEFT JOIN h ON h.u = a.u LEFT JOIN c{i - 1} b ON b.u = h.v GROUP BY a.u),
    """
        for i in range(1, 13)
    )
    + """
    links AS (SELECT comp, count(*) m FROM lineitem JOIN cc ON node = l_orderkey * 4 + 1 GROUP BY 1),
    sig AS (SELECT comp, count(*) n, string_agg(c, ',' ORDER BY c) s FROM c12 JOIN cc ON node = u GROUP BY 1)
    SELECT n AS n_nodes, CAST(coalesce(m, 0) AS BIGINT) AS n_links, CAST(count(*) AS BIGINT) AS complexes
    FROM sig LEFT JOIN links USING (comp) GROUP BY n, coalesce(m, 0), s
    """
)


@query(WL_SQL)
def species_census_lines(spark, sf):
    """All lines as links: one complex with most nodes, many cycles and repeated links, and single nodes."""
    # the lines give links with both ends, so sites are not written out
    snap = line_graph(spark, sf)
    return canonical.class_sizes(snap, components.complexes_of(snap)).select("n_nodes", "n_links", "complexes")


@query(
    """
    SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS BIGINT) AS census_nodes,
           CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS BIGINT) AS total_nodes, true AS ok
    """
)
def mass_check(spark, sf):
    snap, cx = kept(customer_graph(spark, sf))
    return quality.mass_check(canonical.class_sizes(snap, cx), snap.nodes)


@query("SELECT CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS site_idx, '' AS error WHERE false")
def link_errors(spark, sf):
    return quality.link_errors(line_graph(spark, sf).sites)


@query(
    """
    WITH n AS (SELECT 'type' AS kind, 'Customer' AS name UNION SELECT 'type', 'Order' UNION SELECT 'site', 'seg' UNION SELECT 'site', 'order'
               UNION SELECT 'site', 'cust' UNION SELECT 'site', 'status' UNION SELECT 'state', c_mktsegment FROM customer
               UNION SELECT 'state', o_orderstatus FROM orders UNION SELECT 'state', substr(o_orderpriority, 1, 1) FROM orders)
    SELECT kind, name, CAST(dense_rank() OVER (PARTITION BY kind ORDER BY name) AS INTEGER) AS rank FROM n
    """
)
def name_ranks(spark, sf):
    return canonical.name_ranks(customer_graph(spark, sf))


@query(
    """
    WITH o AS (SELECT c_custkey k, c_mktsegment seg, o_orderstatus || substr(o_orderpriority, 1, 1) s FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
    c AS (SELECT k, 1 + count(s) AS n, seg || ':' || coalesce(string_agg(s, ',' ORDER BY s), '') AS form FROM o GROUP BY k, seg)
    SELECT CAST(n AS BIGINT) AS nodes, CAST(count(*) AS BIGINT) AS complexes, CAST(sum(n * (n + 1) / 2) AS BIGINT) AS places, CAST(count(*) AS BIGINT) AS customers_first,
           CAST(count(DISTINCT form) AS BIGINT) AS forms, CAST(count(DISTINCT form) AS BIGINT) AS spellings FROM c GROUP BY 1
    """
)
def canonical_positions(spark, sf):
    """Complexes read out in canonical order, by size: places run from 1, customers come first, and alike complexes read alike.

    ``forms`` counts complexes that differ as multisets of orders, ``spellings`` those that differ when their nodes are read by place: the places of alike
    complexes agree just when both are equal.
    """
    snap, cx = kept(customer_graph(spark, sf))
    _, colours, half = canonical.classes(snap, cx)
    place = cut(canonical.positions(colours, snap.nodes, half), "places")
    # an order is told by its own state and that of the customer's site for it; equal places and texts are summed as hashes, so a complex is never one row
    far = snap.sites.filter("type = 'Customer' and partner_node is not null").select(F.col("partner_node").alias("node_id"), F.col("state").alias("far_state"))
    own = snap.sites.filter("site_name in ('seg', 'status')").select("node_id", "state")
    text = F.concat(F.col("state"), F.coalesce("far_state", F.lit("")))
    told = place.join(own, "node_id").join(far, "node_id", "left").select("complex_id", "pos", "type", text.alias("t"))
    wide = lambda *cols: F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    per = told.groupBy("complex_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("pos").alias("places"), F.max(((F.col("type") == "Customer") & (F.col("pos") == 1)).cast("long")).alias("first"),
        F.struct(wide("t"), wide("t", F.lit("b"))).alias("form"), F.struct(wide("pos", "t"), wide("pos", "t", F.lit("b"))).alias("spelling"),
    )
    return per.groupBy("nodes").agg(
        F.count(F.lit(1)).alias("complexes"), F.sum("places").cast("long").alias("places"), F.sum("first").alias("customers_first"),
        F.countDistinct("form").alias("forms"), F.countDistinct("spelling").alias("spellings"),
    )


@query(
    """
    WITH s AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) sig FROM conversations GROUP BY 1),
    g AS (SELECT sig, count(*) n FROM s GROUP BY 1)
    SELECT CAST(n AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS species FROM g GROUP BY 1
    """
)
def species_file_round_trip(spark, sf):
    snap, cx = kept(talk_graph(spark, sf))
    path = fresh_path(spark, "species")
    species.write_species(canonical.census(snap, cx), path)
    back = species.read_species(spark, path)
    return back.groupBy("count").agg(F.count(F.lit(1)).alias("species"))


@query(
    """
    WITH s AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) sig FROM conversations GROUP BY 1),
    g AS (SELECT sig, count(*) n FROM s GROUP BY 1)
    SELECT CAST(n AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS species FROM g GROUP BY 1
    """
)
def species_text_lookup(spark, sf):
    """Every species' text parsed back and looked up: its count is that of the census."""
    snap, cx = kept(talk_graph(spark, sf))
    ids, labels = canonical.labelled_classes(snap, cx)
    labels = cut(labels, "labels")
    roles = snap.nodes.select("type").distinct()
    none = F.array().cast("array<string>")
    decl = roles.select(
        "type", F.posexplode(F.array(F.lit("prev"), F.lit("next"))).alias("site_idx", "site_name"), none.alias("allowed_states")
    )
    found, _ = species.species_lookup(labels.select(F.col("class_id").alias("species_id"), F.col("label").alias("text")), decl, ids)
    return found.groupBy("count").agg(F.count(F.lit(1)).alias("species"))


@query(
    """
    SELECT 'Customer' AS type, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) + (SELECT count(*) FROM orders) AS BIGINT) AS sites FROM customer
    UNION ALL SELECT 'Order', CAST(count(*) AS BIGINT), CAST(2 * count(*) AS BIGINT) FROM orders
    """
)
def snapshot_round_trip(spark, sf):
    from bondwise.plans.tables import customer_decl

    path, decl = fresh_path(spark, "snapshot"), customer_decl(spark)
    snapshots.write_snapshot(customer_graph(spark, sf), path, "s1", decl)
    back = snapshots.read_snapshot(spark, path, "s1", decl)
    nodes = back.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(back.sites.groupBy("type").agg(F.count(F.lit(1)).alias("sites")), "type")


# two graphs of eight nodes in which all nodes have three neighbours: rings with chords, a cube and a Moebius ladder
RING = [(i, (i + 1) % 8) for i in range(8)]
CUBE, LADDER = RING + [(0, 3), (4, 7), (1, 6), (2, 5)], RING + [(i, i + 4) for i in range(4)]


@query(
    """
    WITH c AS (SELECT s_suppkey % 2 + (s_suppkey // 2) % 2 AS ladders, count(*) AS n FROM supplier GROUP BY 1)
    SELECT CAST(n AS BIGINT) AS complexes, CAST(count(*) AS BIGINT) AS classes FROM c GROUP BY 1
    """
)
def symmetric_cores(spark, sf):
    """A complex per supplier: a hub linked to all nodes of two cores, each a cube or a ladder by a bit of the supplier's number.

    Refinement leaves the nodes of a core alike and takes both kinds for one; the classes tell complexes by how many of their cores are ladders.
    """
    k = F.col("s_suppkey")
    pairs = lambda links: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(links)])
    cores = table(spark, sf, "supplier").select((k * 32).alias("hub"), F.explode(F.array(F.struct(F.lit(0).alias("at"), (k % 2).alias("ladder")), F.struct(F.lit(1).alias("at"), (F.floor(k / 2) % 2).alias("ladder")))).alias("core"))
    node = lambda i: F.col("hub") + 1 + F.col("core.at") * 8 + i
    inner = cores.withColumn("l", F.explode(F.when(F.col("core.ladder") == 1, pairs(LADDER)).otherwise(pairs(CUBE)))).select(
        node(F.col("l.a")).alias("node_a"), F.col("l.n").cast("long").alias("site_a"), node(F.col("l.b")).alias("node_b"), F.col("l.n").cast("long").alias("site_b"), F.lit("core").alias("name")
    )
    spokes = cores.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        F.col("hub").alias("node_a"), (F.col("core.at") * 8 + F.col("i")).cast("long").alias("site_a"), node(F.col("i")).alias("node_b"), F.lit(20).cast("long").alias("site_b"), F.lit("hub").alias("name")
    )
    links = cut(inner.unionByName(spokes), "core-links")
    ends = links.select(F.col("node_a").alias("node_id"), F.col("site_a").alias("site_idx"), "name").unionByName(links.select(F.col("node_b").alias("node_id"), F.col("site_b").alias("site_idx"), "name"))
    kind = F.when(F.col("node_id") % 32 == 0, "Hub").otherwise("Node")
    sites = ends.select("node_id", kind.alias("type"), "site_idx", F.col("name").alias("site_name"), F.lit(None).cast("string").alias("state"))
    snap, cx = kept(snapshot_from_links(sites.select("node_id", "type").distinct(), sites, links.drop("name")))
    ids = canonical.classes(snap, cx)[0]
    per = ids.groupBy("class_id").agg(F.count(F.lit(1)).alias("complexes"))
    return per.groupBy("complexes").agg(F.count(F.lit(1)).alias("classes"))
