"""What a panel query must not leave out."""

from pyspark.sql import functions as F

from strandline.plans import models, queries


def test_trees_predict_every_fold_with_the_defaults(spark, sf_dir, monkeypatch):
    d = sf_dir.replace("sf0.001", "sf0.01")  # the smallest has too few sessions
    fits = []

    class Recorded(models.BoostedTrees):
        def fit(self, rows, features, spec, selection=None, history=None):
            days = [r.agg(F.min("session_date"), F.max("session_date"), F.countDistinct("session_date")).first() for r in (rows, selection)]
            fits.append((self.params(), *days))
            return self

        def predict(self, rows, history=None):
            return rows.withColumn("y_pred", F.lit(0.0))

    defaults = models.BoostedTrees().params()
    monkeypatch.setattr(models, "BoostedTrees", Recorded)
    keys = ["ticker", "session_date", "fold_id"]
    got = [tuple(r) for r in queries.QUERIES["gbt_predictions"](spark, d).select(*keys).collect()]
    want = [tuple(r) for r in queries.QUERIES["baseline_predictions"](spark, d).select(*keys).collect()]
    assert sorted(got) == sorted(want) and len({k[2] for k in got}) == len(fits) > 1
    for params, fit, held in fits:
        assert params == defaults
        # A fifth of the sessions selects, after all of the fit rows.
        assert fit[1] < held[0] and abs(held[2] / (fit[2] + held[2]) - 0.2) < 0.01
