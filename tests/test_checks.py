"""Registered queries against their SQL at the smallest scale (compare.py runs them all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidecore import checks

QUICK = """clean_edge_lines self_loop_count adjacency in_out_degrees bin_equal_count bin_sorted_boundaries
discretize start_bin slide_delta effective_delta window_step_sweep batch_from_bins core_numbers pcd_index
dataset_profile temporal_profile inter_event_gaps power_law_slope quality_score novelty_index
advise_composite advise_history advice_scorecard stream_bin_counts stream_pair_expiry""".split()
TABLES = "orders lineitem events documents customer".split()


def test_every_query_is_registered_with_a_callable():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(f) for f in queries.values())
    assert set(checks.queries()) <= set(queries)
    assert set(checks.queries()) - set(checks.oracles()) == {"sample_non_edges"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, cur.fetchall())
