"""The driver contract: every SQL has a query, texts build, and a sample of queries agrees with its SQL."""

import pytest

import __spark_entry__ as contract
from harness.compare import connect, differences

SF = "/root/testdata/sf0.001"
SAMPLE = ["mtr_git_person_weekly", "bullet_ic_collab", "temporal_join", "fields_history", "stream_dedup", "match_rules"]


def test_every_sql_belongs_to_a_query():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    # Queries without SQL: a queue checked against the walk-through, a sketch, a hash without a SQL twin.
    # The training-data subpackage tests its own and may be absent.
    own = set(queries) - set(contract.LLM)
    assert own - set(sql) == {"bootstrap_job_unmapped", "distinct_aggregate_approx"}


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees(spark, name):
    assert differences(spark, connect(SF), SF, name) is None
