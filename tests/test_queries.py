"""A spread of named queries against their SQL twins on the smallest tables; check.py runs them all."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from quillgraph.session import TABLES

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "s2_filter_corpus", "s3_limit_corpus", "s7_error_rows", "e2_encode_tokens", "g11_weighted_mutation_sampling", "t1_split_train_val",
    "t7_best_and_early_stop", "p3_top_k", "p5_entropy_ood", "d1_duplicate_groups", "m1_engine_union", "m2_engine_intersection",
    "c3_fan_in_out", "c8_max_call_depth", "c11_transform_chains", "c12_variable_flows", "c13_clusters", "r2_role_priority",
    "q12_global_score", "q14_recommendations", "a10_facet_top_n", "s9_report_json", "w1_anchored_quota",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    ok, note, _ = compare(spark, duck, name, queries()[name], oracle_sql()[name], SF)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
