import pytest

from tests.compare import differs, duck
from tidemark import registry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()
#: Queries whose results hang on ties and last digits, which small tables hide.
RANKED = ("conditional_ic", "feature_ranking_toxic", "psi", "spearman_ic", "spearman_matrix")


@pytest.fixture(scope="module")
def con():
    return {sf: duck(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, con, name):
    assert differs(spark, con[SF], registry.queries()[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", RANKED)
def test_same_on_more_rows(spark, con, name):
    assert differs(spark, con[LARGER], registry.queries()[name], SQL[name], LARGER) == ""


def test_one_window_for_all_features(spark):
    plan = registry.queries()["causal_window_sum"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3  # the timeline, and one seed Window for events and for quotes
