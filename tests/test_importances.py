"""Importances of forests grown in parts."""

import random

import numpy as np

from donorlift.operators import models as md


def _table(spark):
    rnd = random.Random(8)
    rows = [(i, y := int(rnd.random() < 0.4), y + rnd.gauss(0, 0.6), y + rnd.gauss(0, 2), rnd.gauss(0, 1)) for i in range(600)]
    df = md.with_class_weight(spark.createDataFrame(rows, "k long, target_b int, good double, fair double, bad double").repartition(2).cache(), "target_b")
    return md.assemble(df, ["good", "fair", "bad"], "k")


def test_small_tables_have_the_importances_of_one_model(spark):
    ff = _table(spark)
    forest = md.forest_classifier(trees=60)
    assert np.allclose(md.forest_importances(ff.df, forest), forest.fit(ff.df).featureImportances.toArray(), atol=1e-12)


def test_large_tables_grow_all_trees_in_bounded_parts(spark, monkeypatch):
    ff, fitted, fit = _table(spark), [], md.RandomForestClassifier._fit

    def noted(self, df):
        fitted.append((self.getNumTrees(), self.getSeed()))
        return fit(self, df)

    monkeypatch.setattr(md.RandomForestClassifier, "_fit", noted)
    monkeypatch.setattr(md, "PART_ROWS", 500)
    got = md.select_from_model(ff, trees=101).collect()
    assert sorted(n for n, _ in fitted) == [33, 34, 34] and len({s for _, s in fitted}) == 3
    assert [r.feature for r in got] == ["good", "fair", "bad"] and got[0].selected and not got[2].selected
    assert abs(sum(r.importance for r in got) - 1) < 1e-9
    monkeypatch.setattr(md, "PART_ROWS", 600)
    whole = md.forest_importances(ff.df, md.forest_classifier(trees=101, depth=6))
    assert np.allclose([r.importance for r in got], sorted(whole, reverse=True), atol=0.05)
