"""Queries that edit snapshots, build and remove species, and follow a stream of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from bondwise.model import EDIT, SITE_COLS, TYPE_DECL, Slot, Snapshot, mol, observable, pattern
from bondwise.operators import canonical, components, draw, edits, match
from bondwise.operators.order import ranked
from bondwise.plans.registry import query
from bondwise.plans.tables import CUSTOMER, ORDER, customer_decl, customer_graph, kept, node_key, table
from bondwise.session import cut, fresh_path
from bondwise.streaming.feed import CountFeed


def _edit(rows, edit_id, op, node, site=None, state=None, far=None, far_site=None):
    value = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
    return rows.select(
        edit_id.cast("long").alias("edit_id"), F.lit(op).alias("op"), node.alias("node_id"), value(site, "long").alias("site_idx"),
        value(state, "string").alias("new_state"), value(far, "long").alias("partner_node"), value(far_site, "long").alias("partner_site"),
    )


STATE = [
    ("F", pattern(mol("Order", Slot("status", "F")))),
    ("O", pattern(mol("Order", Slot("status", "O")))),
    ("P", pattern(mol("Order", Slot("status", "P")))),
]


def _state_counts(snap):
    bound = pattern(mol("Customer", Slot("order", None, 1)), mol("Order", Slot("cust", None, 1)))
    obs = [observable(name, "Molecules", p) for name, p in STATE] + [observable("linked", "Molecules", bound)]
    return match.observe(Snapshot(snap.nodes, cut(snap.sites, "edited")), obs)


@query(
    """
    WITH e AS (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN least(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END + 1, 3)
                              WHEN o_orderpriority LIKE '2%' THEN greatest(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END - 1, 1)
                              WHEN o_orderpriority LIKE '3%' THEN 3 ELSE CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END END AS s FROM orders)
    SELECT 'F' AS obs, CAST(count(*) FILTER (s = 1) AS BIGINT) AS value FROM e UNION ALL SELECT 'O', CAST(count(*) FILTER (s = 2) AS BIGINT) FROM e
    UNION ALL SELECT 'P', CAST(count(*) FILTER (s = 3) AS BIGINT) FROM e UNION ALL SELECT 'linked', CAST(count(*) AS BIGINT) FROM e
    """
)
def state_edits(spark, sf):
    """Urgent orders move up a state, high ones down, medium ones are set; the ends of the state list hold."""
    snap, o = customer_graph(spark, sf), table(spark, sf, "orders")
    node, pick = node_key("o_orderkey", ORDER), lambda d: o.filter(F.col("o_orderpriority").startswith(d))
    batch = (
        _edit(pick("1"), F.col("o_orderkey"), "inc_state", node, F.lit(1))
        .unionByName(_edit(pick("2"), F.col("o_orderkey"), "dec_state", node, F.lit(1)))
        .unionByName(_edit(pick("3"), F.col("o_orderkey"), "set_state", node, F.lit(1), F.lit("P")))
    )
    after, _ = edits.apply_edits(snap, batch, customer_decl(spark))
    return _state_counts(after)


@query(
    """
    WITH kept AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'F' AS obs, CAST(0 AS BIGINT) AS value UNION ALL SELECT 'O', CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) FROM kept
    UNION ALL SELECT 'P', CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) FROM kept UNION ALL SELECT 'linked', CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) FROM kept
    """
)
def bond_and_node_edits(spark, sf):
    """Filled orders are deleted, which frees their customers' sites; pending orders lose their link."""
    snap, o = customer_graph(spark, sf), table(spark, sf, "orders")
    node = node_key("o_orderkey", ORDER)
    batch = _edit(o.filter("o_orderstatus = 'F'"), F.col("o_orderkey"), "delete_node", node).unionByName(
        _edit(o.filter("o_orderstatus = 'P'"), F.col("o_orderkey"), "delete_bond", node, F.lit(0))
    )
    after, _ = edits.apply_edits(snap, batch, customer_decl(spark))
    return _state_counts(after)


@query(
    """
    WITH a AS (SELECT count(*) n FROM part p WHERE p_partkey % 3 = 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 1)),
    b AS (SELECT count(*) n FROM supplier WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 3 * s_suppkey))
    SELECT CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS BIGINT) AS nodes, CAST(a.n + b.n AS BIGINT) AS links,
           CAST((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) - a.n - b.n AS BIGINT) AS complexes, CAST(0 AS BIGINT) AS errors FROM a, b
    """
)
def add_bonds(spark, sf):
    """Every third part is linked to the next, and a new node per supplier to the part of three times its number."""
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    none = lambda kind: F.lit(None).cast(kind)
    decl = spark.createDataFrame([("Part", 0, "prev", []), ("Part", 1, "next", [])], TYPE_DECL)
    nodes = part.select((F.col("p_partkey") * 2).alias("node_id"), F.lit("Part").alias("type"))
    free = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("site_idx"), F.lit("prev").alias("site_name")), F.struct(F.lit(1).cast("long").alias("site_idx"), F.lit("next").alias("site_name"))))
    sites = nodes.select("node_id", "type", free.alias("s")).select("node_id", "type", "s.*", none("string").alias("state"), none("long").alias("partner_node"), none("long").alias("partner_site"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"))
    linked = part.filter("p_partkey % 3 = 0").join(after, "p_partkey", "left_semi")
    fresh = F.col("s_suppkey") * 2 + 1
    met = supplier.join(part.select((F.col("p_partkey")).alias("third")), F.col("third") == F.col("s_suppkey") * 3)
    batch = (
        _edit(linked, F.col("p_partkey") * 3, "add_bond", F.col("p_partkey") * 2, F.lit(1), far=(F.col("p_partkey") + 1) * 2, far_site=F.lit(0))
        .unionByName(_edit(supplier, F.col("s_suppkey") * 3 + 1, "add_node", fresh, state=F.lit("Part")))
        .unionByName(_edit(met, F.col("s_suppkey") * 3 + 2, "add_bond", fresh, F.lit(1), far=F.col("third") * 2, far_site=F.lit(0)))
    )
    snap, errors = edits.apply_edits(Snapshot(nodes, sites.select(*SITE_COLS)), batch, decl)
    snap, cx = kept(snap)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(snap.nodes, "nodes").crossJoin(count(snap.links(), "links")).crossJoin(components.complex_count(cx))
    return rows.crossJoin(count(errors, "errors"))


@query(
    """
    WITH c AS (SELECT c_custkey, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
    SELECT 'Customer' AS type, CAST((SELECT count(*) FROM customer) - count(*) AS BIGINT) AS nodes FROM c
    UNION ALL SELECT 'Order', CAST((SELECT count(*) FROM orders) - sum(n) + (SELECT count(*) FROM part) AS BIGINT) FROM c
    """
)
def complex_deletes_and_new_nodes(spark, sf):
    """Building customers go with all their orders; one unlinked order is added per part."""
    snap, cx = kept(customer_graph(spark, sf))
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    top = table(spark, sf, "orders").agg(F.max("o_orderkey").alias("top"))
    new = table(spark, sf, "part").crossJoin(F.broadcast(top))
    batch = _edit(gone, F.col("c_custkey"), "delete_complex", node_key("c_custkey", CUSTOMER)).unionByName(
        _edit(new, -F.col("p_partkey") - 1, "add_node", (F.col("top") + 1 + F.col("p_partkey")) * 4 + ORDER, None, F.lit("Order"))
    )
    after, _ = edits.apply_edits(snap, batch, customer_decl(spark), cx)
    return match.count_by_type(after)


@query(
    """
    WITH e AS (SELECT l_orderkey, l_linestatus FROM lineitem), n AS (SELECT l_orderkey, count(*) c FROM e GROUP BY 1)
    SELECT error, CAST(count(*) AS BIGINT) AS edits FROM (
      SELECT 'site touched twice' AS error FROM e JOIN n USING (l_orderkey) WHERE c > 1
      UNION ALL SELECT 'state not allowed' FROM customer
      UNION ALL SELECT 'site is already bound' FROM supplier
      UNION ALL SELECT 'no such site' FROM part) GROUP BY 1
    """
)
def edit_conflicts(spark, sf):
    """One state edit per line: orders with several lines are in conflict. Customers, suppliers and parts give other errors."""
    snap = customer_graph(spark, sf)
    line = table(spark, sf, "lineitem").withColumn("id", F.monotonically_increasing_id() * 4)
    cust, sup, part = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    batch = (
        _edit(line, F.col("id"), "set_state", node_key("l_orderkey", ORDER), F.lit(1), F.lit("F"))
        .unionByName(_edit(cust, F.col("c_custkey") * 4 + 1, "set_state", node_key("c_custkey", CUSTOMER), F.lit(0), F.lit("NONE")))
        .unionByName(_edit(sup, F.col("s_suppkey") * 4 + 2, "add_bond", node_key("s_suppkey", ORDER), F.lit(0), None, F.col("s_suppkey") * 4 + CUSTOMER, F.lit(0)))
        .unionByName(_edit(part, F.col("p_partkey") * 4 + 3, "delete_bond", F.lit(-1).cast("long"), F.col("p_partkey")))
    )
    # ids are written once, since a lost task would number its lines anew
    _, errors = edits.apply_edits(snap, cut(batch, "batch"), customer_decl(spark))
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("edits"))


@query(
    """
    SELECT CAST(count(*) AS BIGINT) AS cut, CAST(0 AS BIGINT) AS still_connected FROM orders WHERE o_orderstatus = 'P'
    """
)
def still_connected(spark, sf):
    """Cutting the one link of each pending order always takes it out of its customer's complex."""
    snap, cx = kept(customer_graph(spark, sf))
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    batch = _edit(o, F.col("o_orderkey"), "delete_bond", node_key("o_orderkey", ORDER), F.lit(0))
    r = edits.still_connected(snap, cx, batch)
    return r.agg(F.count(F.lit(1)).alias("cut"), F.count_if("connected").alias("still_connected"))


def order_rings(spark, sf):
    """(snapshot, orders): a customer's orders form a chain by number, and the filled ones also hang on the customer, which closes rings.

    ``Order(cust, prev, next)`` has sites 0, 1 and 2; the customer's site for an order is numbered by the order. An order knows its customer and the next order.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    numbered = ranked(o, ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "rank")
    after = numbered.select("o_custkey", (F.col("rank") - 1).alias("rank"), F.col("o_orderkey").alias("next"))
    o = cut(numbered.join(after, ["o_custkey", "rank"], "left").drop("rank"), "chained-orders")
    customer = table(spark, sf, "customer")
    nodes = customer.select(node_key("c_custkey", CUSTOMER).alias("node_id"), F.lit("Customer").alias("type")).unionByName(
        o.select(node_key("o_orderkey", ORDER).alias("node_id"), F.lit("Order").alias("type"))
    )
    none, long = F.lit(None), lambda v: F.lit(v).cast("long")
    me, kept = node_key("o_orderkey", ORDER), F.col("o_orderstatus") == "F"
    site = lambda rows, node, kind, idx, name, far, far_site: rows.select(
        node.alias("node_id"), F.lit(kind).alias("type"), idx.cast("long").alias("site_idx"), F.lit(name).alias("site_name"), none.cast("string").alias("state"),
        far.alias("partner_node"), F.when(far.isNotNull(), far_site).cast("long").alias("partner_site"),
    )
    sites = (
        site(o, me, "Order", long(0), "cust", F.when(kept, node_key("o_custkey", CUSTOMER)), F.col("o_orderkey"))
        .unionByName(site(o, me, "Order", long(2), "next", node_key("next", ORDER), long(1)))
        .unionByName(site(o.filter("next is not null"), node_key("next", ORDER), "Order", long(1), "prev", me, long(2)))
        .unionByName(site(o.filter(kept), node_key("o_custkey", CUSTOMER), "Customer", F.col("o_orderkey"), "order", me, long(0)))
    )
    return Snapshot(nodes, sites.select(*SITE_COLS)), o


@query(
    """
    WITH RECURSIVE o AS (SELECT o_orderkey k, o_custkey c, o_orderstatus s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) nx FROM orders),
    l AS (SELECT 'L' || k AS id, 'C' || c AS a, 'O' || k AS b FROM o WHERE s = 'F' UNION ALL SELECT 'N' || k, 'O' || k, 'O' || nx FROM o WHERE nx IS NOT NULL),
    adj AS (SELECT id, a, b FROM l UNION ALL SELECT id, b, a FROM l),
    gone AS (SELECT k, 'N' || k AS id, 2 AS site, 'O' || k AS a, 'O' || nx AS b FROM o WHERE nx IS NOT NULL
             UNION ALL SELECT k, 'L' || k, 0, 'O' || k, 'C' || c FROM o WHERE k % 3 = 1 AND s = 'F'),
    dels AS (SELECT k, list(id) AS ids FROM gone GROUP BY k),
    extra AS (SELECT k, 'C' || c AS a, 'O' || nx AS b FROM o WHERE k % 3 = 2 AND nx IS NOT NULL UNION ALL SELECT k, 'O' || nx, 'C' || c FROM o WHERE k % 3 = 2 AND nx IS NOT NULL),
    reach AS (
      SELECT g.k, g.site, ids, g.a AS start, g.a AS here FROM gone g JOIN dels USING (k)
      UNION SELECT r.k, r.site, r.ids, r.start, e.b FROM reach r JOIN (SELECT NULL::BIGINT AS k, id, a, b FROM adj UNION ALL SELECT k, '', a, b FROM extra) e
        ON e.a = r.here AND (e.k IS NULL OR e.k = r.k) AND NOT list_contains(r.ids, e.id)
    )
    SELECT g.k AS edit_id, CAST(g.site AS BIGINT) AS site_idx, r.here IS NOT NULL AS connected
    FROM gone g LEFT JOIN reach r ON r.k = g.k AND r.site = g.site AND r.here = g.b
    """
)
def match_connectivity(spark, sf):
    """One match per order, each judged by itself: all cut the link to the next order, a third also the one to the customer, a third add a bond from the customer to the next order."""
    snap, o = order_rings(spark, sf)
    snap, cx = kept(snap)
    me, key, linked = node_key("o_orderkey", ORDER), F.col("o_orderkey"), o.filter("next is not null")
    batch = (
        _edit(linked, key, "delete_bond", me, F.lit(2))
        .unionByName(_edit(o.filter("o_orderkey % 3 = 1 and o_orderstatus = 'F'"), key, "delete_bond", me, F.lit(0)))
        .unionByName(_edit(linked.filter("o_orderkey % 3 = 2"), key, "add_bond", node_key("o_custkey", CUSTOMER), -key, far=node_key("next", ORDER), far_site=F.lit(3)))
    )
    return edits.still_connected(snap, cx, batch).select("edit_id", "site_idx", "connected")


@query(
    """
    WITH o AS (SELECT o_orderkey k, o_custkey c, substr(o_orderpriority, 1, 1) p FROM orders),
    n AS (SELECT c, count(*) FILTER (p = '3') n3 FROM o GROUP BY 1)
    SELECT k AS edit_id FROM o JOIN n USING (c) JOIN customer ON c_custkey = c
    WHERE (p = '1' OR n3 - CASE WHEN p = '3' THEN 1 ELSE 0 END >= 2) AND k % 2 = 1 AND c_mktsegment <> 'MACHINERY'
    """
)
def constrained_after(spark, sf):
    """One match per order that cuts its link, and for even numbers moves the customer to another segment; the constraints hold on the customer as the match leaves it.

    Kept are matches after which an urgent site is free or two medium orders are still linked, unless the customer is then in the excluded segment.
    """
    snap = customer_graph(spark, sf)
    o = table(spark, sf, "orders")
    at, key = node_key("o_custkey", CUSTOMER), F.col("o_orderkey")
    batch = _edit(o, key, "delete_bond", node_key("o_orderkey", ORDER), F.lit(0)).unionByName(
        _edit(o.filter("o_orderkey % 2 = 0"), key, "set_state", at, F.lit(0), F.lit("MACHINERY"))
    )
    matches = o.select(key.alias("edit_id"), at.alias("node_id"))
    include = (mol("Customer", Slot("order", "1", "free")), mol("Customer", Slot("order", "3", "bound"), Slot("order", "3", "bound")))
    exclude = (mol("Customer", Slot("seg", "MACHINERY")),)
    return edits.constrained_after(snap, matches, batch, customer_decl(spark), include, exclude).select("edit_id")


TEMPLATE = "species_id string, pos long, type string, site_idx long, site_name string, state string, partner_pos long, partner_site long"


def _template(spark):
    """A customer with one open order, and a lone order."""
    return spark.createDataFrame(
        [
            ("pair", 0, "Customer", 0, "seg", "BUILDING", None, None), ("pair", 0, "Customer", 1, "order", None, 1, 0),
            ("pair", 1, "Order", 0, "cust", None, 0, 1), ("pair", 1, "Order", 1, "status", "O", None, None),
            ("lone", 0, "Order", 0, "cust", None, None, None), ("lone", 0, "Order", 1, "status", "F", None, None),
        ],
        TEMPLATE,
    )


@query(
    """
    SELECT type, site_name, state, CAST(n AS BIGINT) AS sites FROM (
      SELECT 'Customer' AS type, 'seg' AS site_name, 'BUILDING' AS state, sum(p_size) AS n FROM part UNION ALL SELECT 'Customer', 'order', NULL, sum(p_size) FROM part
      UNION ALL SELECT 'Order', 'cust', NULL, sum(p_size) + (SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem) FROM part
      UNION ALL SELECT 'Order', 'status', 'O', sum(p_size) FROM part UNION ALL SELECT 'Order', 'status', 'F', (SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem))
    """
)
def instantiate_species(spark, sf):
    """As many customer-order pairs as the parts' sizes add up to, and a lone order per unit sold."""
    pairs = table(spark, sf, "part").agg(F.sum("p_size").alias("copies")).select(F.lit("pair").alias("species_id"), "copies")
    lone = table(spark, sf, "lineitem").agg(F.sum(F.col("l_quantity").cast("long")).alias("copies")).select(F.lit("lone").alias("species_id"), "copies")
    made = edits.instantiate(pairs.unionByName(lone), _template(spark), 1)
    return made.sites.groupBy("type", "site_name", "state").agg(F.count(F.lit(1)).alias("sites"))


@query(
    """
    WITH s AS (SELECT conv_id, count(*) n, string_agg(role, ',' ORDER BY turn) sig FROM conversations GROUP BY 1), g AS (SELECT sig, n, count(*) c FROM s GROUP BY 1, 2),
    top AS (SELECT * FROM g WHERE c = (SELECT max(c) FROM g) ORDER BY n LIMIT 1)
    SELECT CAST((SELECT count(*) FROM conversations) - (c - 1) * n AS BIGINT) AS nodes FROM top
    """
)
def remove_species_copies(spark, sf):
    """Remove all but one copy of the most frequent conversation."""
    from bondwise.plans.tables import talk_graph

    snap, cx = kept(talk_graph(spark, sf))
    ids = canonical.classes(snap, cx)[0]
    top = ids.groupBy("class_id").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).orderBy(F.desc("c"), "n").first()
    left = edits.remove_copies(snap, cx, ids, top["class_id"], top["c"] - 1)
    return left.nodes.agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT CAST(0 AS BIGINT) AS step, CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS BIGINT) AS nodes UNION ALL SELECT 1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + 5")
def clamp_population(spark, sf):
    """Lone filled orders held first at the number of parts, then at five."""
    snap = customer_graph(spark, sf)
    lone = _template(spark).filter("species_id = 'lone'")
    n = table(spark, sf, "part").count()
    up = edits.clamp_population(snap, match.free_singletons(snap, "Order", {"status": "F"}), n, lone)
    up = Snapshot(cut(up.nodes, "nodes"), cut(up.sites, "sites"))
    down = edits.clamp_population(up, match.free_singletons(up, "Order", {"status": "F"}), 5, lone)
    size = lambda s, k: s.nodes.agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(k).cast("long").alias("step"), "nodes")
    return size(up, 0).unionByName(size(down, 1))


@query("SELECT CAST(least(count(*), 777) AS BIGINT) AS n, CAST(least(count(*), 777) AS BIGINT) AS n_distinct FROM orders")
def any_n_rows(spark, sf):
    """Any 777 orders, the same ones on every run."""
    rows = draw.first_n(table(spark, sf, "orders"), "o_orderkey", 777)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))


@query(
    """
    WITH m AS (SELECT c_custkey k FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT CAST((SELECT count(*) FROM m) + (SELECT count(*) FROM orders JOIN m ON k = o_custkey) AS BIGINT) AS nodes,
           CAST((SELECT count(*) FROM m) + 3 * (SELECT count(*) FROM orders JOIN m ON k = o_custkey) AS BIGINT) AS sites
    """
)
def subgraph(spark, sf):
    """The complexes of one segment's customers."""
    snap, cx = kept(customer_graph(spark, sf))
    start = snap.sites.filter("site_name = 'seg' and state = 'MACHINERY'").select("node_id")
    wanted = cx.join(start, "node_id", "left_semi").select("complex_id").distinct()
    part = components.members(snap, cx, wanted)
    return part.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(part.sites.agg(F.count(F.lit(1)).alias("sites")))


FEED_SQL = """
    SELECT 'F' AS obs, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS value FROM orders
    UNION ALL SELECT 'linked', CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) FROM orders
    UNION ALL SELECT 'with F', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    UNION ALL SELECT 'busy', CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 5)
    UNION ALL SELECT 'tracked <> recount', CAST(0 AS BIGINT)
    """


# every batch here touches every bucket, so few of them do
FEED_BUCKETS = 8


def _followed(spark, sf, stages):
    """All orders start open and linked; a stream sets their real states and unlinks the pending ones.

    ``stages`` parts of the edits arrive one after the other; each is followed to its end by a new query and a new feed
    object that find their place in the checkpoint. The counts kept along the stream are returned with the number of
    observables on which a full recount differs.
    """
    real, decl = customer_graph(spark, sf), customer_decl(spark)
    sites = real.sites.withColumn("state", F.when(F.col("site_name") == "status", F.lit("O")).otherwise(F.col("state")))
    many = pattern(mol("Customer", Slot("order", None, 1)), mol("Order", Slot("cust", None, 1)), relation=">=", quantity=5)
    obs = [
        observable("F", "Molecules", pattern(mol("Order", Slot("status", "F")))),
        observable("linked", "Molecules", pattern(mol("Customer", Slot("order", None, 1)), mol("Order", Slot("cust", None, 1)))),
        observable("with F", "Species", pattern(mol("Order", Slot("status", "F")))),
        observable("busy", "Species", many),
    ]
    state, source, place = (fresh_path(spark, x) for x in ("feed", "edits", "place"))
    CountFeed(spark, state, obs, decl, FEED_BUCKETS).start(Snapshot(real.nodes, sites))
    o, node = table(spark, sf, "orders"), node_key("o_orderkey", ORDER)
    batch = _edit(o, F.col("o_orderkey"), "set_state", node, F.lit(1), F.col("o_orderstatus")).unionByName(
        _edit(o.filter("o_orderstatus = 'P'"), -F.col("o_orderkey") - 1, "delete_bond", node, F.lit(0))
    )
    for k in range(stages):
        # edits of one order stay together; a trigger takes several of the files
        batch.filter(F.pmod(F.xxhash64("node_id"), F.lit(stages)) == k).repartition(8, "node_id").write.mode("append").parquet(source)
        feed = CountFeed(spark, state, obs, decl, FEED_BUCKETS)
        stream = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 4 * stages).parquet(source)
        run = feed.follow(stream, place).trigger(availableNow=True).start()
        run.awaitTermination()
    last = run.lastProgress["batchId"]
    totals = cut(feed.totals(last), "totals")
    recount = match.observe(feed.snapshot(last), obs, feed.complexes(last))
    off = totals.join(recount.withColumnRenamed("value", "again"), "obs", "full").filter(~F.col("value").eqNullSafe(F.col("again")))
    return totals.unionByName(off.agg(F.count(F.lit(1)).alias("value")).select(F.lit("tracked <> recount").alias("obs"), "value"))


@query(FEED_SQL)
def edit_feed(spark, sf):
    """The counts at the end of a stream of edits."""
    return _followed(spark, sf, 1)


@query(FEED_SQL)
def edit_feed_resumed(spark, sf):
    """The same counts when the stream was stopped half way and taken up again from its checkpoint."""
    return _followed(spark, sf, 2)
