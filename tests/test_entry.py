import duckdb
import pytest

import __spark_entry__ as contract
from bondwise.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "obs_molecules_two_node", "single_node_embeddings", "reacting_site_images", "star_embeddings", "include_exclude", "components_size_dist", "species_census_lines",
    "sample_at_day", "trapezoid_stats", "bifurcate_align", "distinct_tuple_sum_per_order", "tfun_step", "derived_params", "manifest_problems", "scan_round_trip", "ring_embeddings",
    "triangle_embeddings", "square_embeddings",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame, cols):
    cell = lambda x: "~" if x is None or x != x else (repr(float(x)) if isinstance(x, float) else str(x))
    return sorted(tuple(cell(x) for x in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and plain(got, cols) == plain(want, cols)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["obs", "value"]


def test_scan_reads_only_what_it_needs(spark):
    """Column pruning and filters reach the parquet scan through the graph tables."""
    from bondwise.model import mol, Slot
    from bondwise.operators import match
    from bondwise.plans.tables import line_graph

    plan = match.node_counts(line_graph(spark, SF, 50), mol("Order", Slot("item", "R")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,50.0)]" in plan
    assert "l_extendedprice" not in plan and "Cartesian" not in plan
