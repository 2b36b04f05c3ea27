"""Registered queries against their SQL on the smallest tables; `compare.py` runs all of them at any size."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from driftlens.plans.oracles import ORACLES
from driftlens.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "a1_evolution a6_categories a9_by_type a12_unnamed c3_usage_drift c4_surface c5_surface_schema c7_dry_run c8_summary d1_blocks d4_issues "
    "d9_position f1_normalise f4_position g4_type_mismatch g5_documents h8_dynamic h15_models h17_defs h20_errors h22_string_lines h23_assignment_line h24_assignment_end h25_block_lines "
    "j3_paths j5_spreads j5_nested_spreads j6_client j9_inputs j12_override m5_models m11_models p6_versions s2_exclusions s7_introspection sd4_field_diff"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_every_query_has_sql():
    # Those of the optional part state in their own tests what stands in for SQL.
    assert set(QUERIES) == set(ORACLES) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["category", "label", "n"]
