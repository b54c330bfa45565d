"""Every registered query against its SQL on the smallest tables; the others must give rows."""

import pytest
from checks import DATA, compare, connect, run_spark, run_sql

import __spark_entry__ as entry

FOLDER = f"{DATA}/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(run_spark(spark, QUERIES[name], FOLDER), run_sql(con, ORACLES[name])).startswith("ok")


# Queries whose result SQL cannot state; their content is tested in test_models and test_semantics.
@pytest.mark.parametrize("name", ["api_cluster_complete", "api_review_sample", "smp_balanced", "win_random_sample", "ml_label_codes_random"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
