import pytest

from strandline.plans import oracles, queries
from tests.compare import assert_same, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle_or_is_listed_as_without():
    assert set(queries.QUERIES) - set(oracles.SQL) == {"gbt_predictions", "search_trials"}


#: These need more sessions than the smallest tables have.
LONG = {"walk_forward_folds", "walk_forward_rolling", "purge_counts", "scaler_standard", "scaler_robust", "scaler_robust_selected", "scaled_validation"}
LONG |= {"inner_selection", "inner_fold_geometry", "split_manifest", "prepared_folds", "gated_validation", "experiment_baselines"}
LONG |= {"baseline_predictions", "regression_metrics", "classification_metrics", "macro_objective", "experiment_leaderboard"}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_its_oracle(spark, con, sf_dir, name):
    if name in LONG:
        sf_dir = sf_dir.replace("sf0.001", "sf0.01")
        con = duck(sf_dir)
    assert_same(queries.QUERIES[name](spark, sf_dir), con, oracles.SQL[name])
