"""The driver tables as site graphs and trajectories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bondwise.model import SITE_COLS, TYPE_DECL, Snapshot
from bondwise.operators.components import connected_components
from bondwise.operators.order import ranked
from bondwise.operators.sampling import EvenGrid, sample_counts
from bondwise.session import cut

CUSTOMER, ORDER, PART, SUPPLIER = 0, 1, 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_key(key: str, code: int):
    return F.col(key) * 4 + code


def _none(kind: str):
    return F.lit(None).cast(kind)


def customer_graph(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Customers linked to their orders: ``Customer(seg~, order~…)`` and ``Order(cust, status~)``.

    The customer's site for an order is numbered by the order and holds the priority digit as state.
    """
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    nodes = customer.select(node_key("c_custkey", CUSTOMER).alias("node_id"), F.lit("Customer").alias("type")).unionByName(
        orders.select(node_key("o_orderkey", ORDER).alias("node_id"), F.lit("Order").alias("type"))
    )
    seg = customer.select(
        node_key("c_custkey", CUSTOMER).alias("node_id"), F.lit("Customer").alias("type"), F.lit(0).cast("long").alias("site_idx"),
        F.lit("seg").alias("site_name"), F.col("c_mktsegment").alias("state"), _none("long").alias("partner_node"), _none("long").alias("partner_site"),
    )
    # one branch per kind of site, not one exploded row: a filter on type then drops whole branches and their columns
    at_customer = orders.select(
        node_key("o_custkey", CUSTOMER).alias("node_id"), F.lit("Customer").alias("type"), (F.col("o_orderkey") + 1).alias("site_idx"),
        F.lit("order").alias("site_name"), F.substring("o_orderpriority", 1, 1).alias("state"),
        node_key("o_orderkey", ORDER).alias("partner_node"), F.lit(0).cast("long").alias("partner_site"),
    )
    at_order = orders.select(
        node_key("o_orderkey", ORDER).alias("node_id"), F.lit("Order").alias("type"), F.lit(0).cast("long").alias("site_idx"),
        F.lit("cust").alias("site_name"), _none("string").alias("state"),
        node_key("o_custkey", CUSTOMER).alias("partner_node"), (F.col("o_orderkey") + 1).alias("partner_site"),
    )
    status = orders.select(
        node_key("o_orderkey", ORDER).alias("node_id"), F.lit("Order").alias("type"), F.lit(1).cast("long").alias("site_idx"),
        F.lit("status").alias("site_name"), F.col("o_orderstatus").alias("state"),
        _none("long").alias("partner_node"), _none("long").alias("partner_site"),
    )
    sites = seg.unionByName(at_customer).unionByName(at_order).unionByName(status)
    return Snapshot(nodes, sites.select(*SITE_COLS))


def line_key():
    """A site number for a line. Order, part, supplier and line number may repeat, so price and date take part."""
    return F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")


def line_graph(spark: SparkSession, sf_dir: str, min_quantity: float | None = None) -> Snapshot:
    """Orders linked to parts by their lines: ``Order(status~, item~…)`` and ``Part(brand~, line~…)``.

    The graph of full-load lines keeps lines of at least ``min_quantity`` as links; all orders and parts stay nodes.
    """
    orders, part, lines = (table(spark, sf_dir, t) for t in ("orders", "part", "lineitem"))
    if min_quantity is not None:
        lines = lines.filter(F.col("l_quantity") >= min_quantity)
    nodes = orders.select(node_key("o_orderkey", ORDER).alias("node_id"), F.lit("Order").alias("type")).unionByName(
        part.select(node_key("p_partkey", PART).alias("node_id"), F.lit("Part").alias("type"))
    )
    own = lambda df, key, code, type_name, name, state: df.select(
        node_key(key, code).alias("node_id"), F.lit(type_name).alias("type"), F.lit(0).cast("long").alias("site_idx"), F.lit(name).alias("site_name"),
        F.col(state).alias("state"), _none("long").alias("partner_node"), _none("long").alias("partner_site"),
    )
    item, line = ("l_orderkey", ORDER, "Order", "item", "l_returnflag"), ("l_partkey", PART, "Part", "line", "l_linestatus")
    end = lambda key, code, type_name, name, state, far: lines.select(
        node_key(key, code).alias("node_id"), F.lit(type_name).alias("type"), line_key().alias("site_idx"), F.lit(name).alias("site_name"),
        F.col(state).alias("state"), node_key(far[0], far[1]).alias("partner_node"), line_key().alias("partner_site"),
        F.lit(far[2]).alias("far_type"), F.lit(far[3]).alias("far_name"), F.col(far[4]).alias("far_state"),
    )
    both = end(*item, line).unionByName(end(*line, item))
    sites = own(orders, "o_orderkey", ORDER, "Order", "status", "o_orderstatus").unionByName(
        own(part, "p_partkey", PART, "Part", "brand", "p_brand")
    )
    return Snapshot(nodes, sites.unionByName(both.select(*SITE_COLS)).select(*SITE_COLS), ends=both)


def supply_graph(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Orders, parts and suppliers, each line linking the three of them with one another; a node names its sites by the far end's type."""
    lines = table(spark, sf_dir, "lineitem")
    ends = {"order": ("l_orderkey", ORDER, "Order"), "part": ("l_partkey", PART, "Part"), "supp": ("l_suppkey", SUPPLIER, "Supplier")}
    # a site holds the line's number and the name of the far end, so a node's sites for one line differ
    site = lambda name: F.xxhash64(line_key(), F.lit(name)).alias
    sites = [
        lines.select(
            node_key(ends[a][0], ends[a][1]).alias("node_id"), F.lit(ends[a][2]).alias("type"), site(b)("site_idx"), F.lit(b).alias("site_name"),
            F.col("l_returnflag").alias("state"), node_key(ends[b][0], ends[b][1]).alias("partner_node"), site(a)("partner_site"),
            F.lit(ends[b][2]).alias("far_type"), F.lit(a).alias("far_name"), F.col("l_returnflag").alias("far_state"),
        )
        for a in ends for b in ends if a != b
    ]
    keys = {"order": ("orders", "o_orderkey"), "part": ("part", "p_partkey"), "supp": ("supplier", "s_suppkey")}
    nodes = [table(spark, sf_dir, t).select(node_key(k, ends[a][1]).alias("node_id"), F.lit(ends[a][2]).alias("type")) for a, (t, k) in keys.items()]
    linked = reduce(DataFrame.unionByName, sites)
    return Snapshot(reduce(DataFrame.unionByName, nodes), linked.select(*SITE_COLS), ends=linked)


def talk_graph(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Conversation turns as nodes typed by role, each linked to the next: ``user(prev, next)`` and so on.

    Nodes are numbered by rank, and neighbours meet by an equi-join on (conversation, turn), so a very long conversation
    spreads over tasks and no turn number is too large.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    numbered = ranked(turns, [], "conv_id", "turn").select("conv_id", "turn", "role", F.col("rank").alias("node_id"))
    here = numbered.select("node_id", F.col("role").alias("type"))
    beside = lambda step, name: numbered.select("conv_id", (F.col("turn") - step).alias("turn"), F.col("node_id").alias(name))
    mine = numbered.select("conv_id", "turn", "node_id", F.col("role").alias("type"))
    both = mine.join(beside(1, "after"), ["conv_id", "turn"], "left").join(beside(-1, "before"), ["conv_id", "turn"], "left")
    site = lambda idx, name, far, far_site: F.struct(
        F.lit(idx).cast("long").alias("site_idx"), F.lit(name).alias("site_name"), _none("string").alias("state"),
        F.col(far).alias("partner_node"), F.when(F.col(far).isNotNull(), far_site).cast("long").alias("partner_site"),
    )
    sites = both.select("node_id", "type", F.explode(F.array(site(0, "prev", "before", 1), site(1, "next", "after", 0))).alias("s"))
    return Snapshot(here, sites.select("node_id", "type", "s.*").select(*SITE_COLS))


def kept(snap: Snapshot) -> tuple[Snapshot, DataFrame]:
    """A snapshot written out with its complexes, for operators that read it several times."""
    out = Snapshot(cut(snap.nodes, "nodes"), cut(snap.sites, "sites"))
    return out, cut(connected_components(out.nodes, out.links()), "complexes")


CUSTOMER_DECL = [
    ("Customer", 0, "seg", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    ("Order", 0, "cust", []),
    ("Order", 1, "status", ["F", "O", "P"]),
]


def customer_decl(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CUSTOMER_DECL, TYPE_DECL)


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``time`` in seconds since the first one; the origin is one row."""
    ev = table(spark, sf_dir, "events")
    origin = ev.agg(F.min("ts").alias("t0"))
    # an interval between time stamps without zone, so the session's time zone plays no part
    part = lambda unit: F.extract(F.lit(unit), F.col("ts") - F.col("t0"))
    whole = (part("DAY") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    seconds = whole.cast("long") * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")
    return ev.crossJoin(F.broadcast(origin)).withColumn("time", seconds / 1e6).drop("t0")


def day_grid(spark: SparkSession, sf_dir: str) -> EvenGrid:
    """Day boundaries from the first event to the end of the last day; one number is fetched."""
    last = timed_events(spark, sf_dir).agg(F.ceil(F.max("time") / 86400).alias("days")).first()["days"]
    return EvenGrid(0.0, 86400.0 * (last or 0), last or 0)


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, rep, obs, step, time, value): how many events of each type a user had before each day boundary.

    A user's cohort is the model and the user the replicate; a type the user has not shown yet counts 0.
    """
    ev = timed_events(spark, sf_dir).withColumn("delta", F.lit(1))
    rows = sample_counts(ev, ["user_id", "event_type"], day_grid(spark, sf_dir))
    return rows.select(
        F.concat(F.lit("cohort"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("user_id").cast("int").alias("rep"),
        F.col("event_type").alias("obs"), "step", "time", "value",
    )


def halves(traj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate and reference ensembles: users by the parity of their number within the cohort."""
    odd = (F.floor(F.col("rep") / 5) % 2) == 1
    return traj.filter(~odd), traj.filter(odd)
