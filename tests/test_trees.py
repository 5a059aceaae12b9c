"""Trees and their importance go through distinct rows, with the result of all rows."""

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from stopwise.operators import evaluate as ev
from stopwise.plans import datasets, model
from stopwise.queries import QUERIES


def _made(spark):
    """6 kinds of rows, some much more frequent than others, with 4 delays."""
    df = spark.range(2400).withColumn("b", F.when(F.col("id") % 11 == 0, 1.0).otherwise(0.0))
    return df.selectExpr("id", "concat('l', id % 3) AS line", "'s' AS stop", "'d' AS direction", "CAST(id % 3 AS DOUBLE) AS a", "b", "CAST(id % 3 * 100 + b * 40 + floor(id / 7) % 4 * 9 AS DOUBLE) AS y", "90.0D AS baseline")


@pytest.fixture
def given(monkeypatch):
    """The frames that trees are fitted on."""
    frames, fit = [], GBTRegressor.fit

    def seen(self, dataset, params=None):
        frames.append(dataset)
        return fit(self, dataset, params)

    monkeypatch.setattr(GBTRegressor, "fit", seen)
    return frames


def test_equal_rows_are_one_for_the_trees(spark, given):
    df = _made(spark)
    m = model.fit_trees(df, None, ["a", "b"], rounds=4, depth=3)
    seen = given[0].groupBy("_f_a", "_f_b", "_i_line", "y").agg(F.sum(model.WEIGHT).alias("n"))
    assert seen.count() == df.select("a", "b", "line", "y").distinct().count() == 24 and seen.agg(F.sum("n")).first()[0] == 2400
    assert given[0].count() <= 24 * 4  # 64 bins need so many rows
    prepared = df
    for s in m.stages[:-1]:
        prepared = s.transform(prepared)
    plain = GBTRegressor(featuresCol="_features", labelCol="y", predictionCol="_pred", lossType="absolute", maxIter=4, maxDepth=3, maxBins=64, seed=0).fit(prepared)
    want = {r["id"]: r["_pred"] for r in plain.transform(prepared).collect()}
    got = {r["id"]: r["pred"] for r in model.predict(m, df, numbers=["a", "b"]).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(set(want.values())) > 3


def test_residuals_are_told_apart_by_their_label(spark, given):
    df = _made(spark).withColumn("baseline", F.col("y") - F.col("id") % 2)
    model.fit_trees(model.residual(df), None, ["a", "b"], label="residual", rounds=1, depth=2)
    assert given[0].agg(F.sum(model.WEIGHT), F.count("*")).first() == (2400.0, 12 * 8)  # 12 rows, cut for 64 bins


def test_importance_scores_a_pair_of_kinds_once(spark):
    df, scored = _made(spark).drop("baseline"), []

    def score(rows):
        scored.append(rows)
        return rows.withColumn("pred", F.col("a") * 100 + F.col("b") * 40)

    got = {r["feature"]: r for r in ev.permutation_importance(df, score, ["a", "b"], ["id"], inputs=["a", "b"]).collect()}
    assert sum(rows.count() for rows in scored) <= 6 * 6 * 2 + 6
    # As defined: every row with its partner's value.
    rows = ev.with_partners(df, ["a", "b"], ["id"], 3, 10)
    plain = df.agg(F.avg(F.abs(F.col("a") * 100 + F.col("b") * 40 - F.col("y")))).first()[0]
    for c, other in (("a", F.col("_partner.a") * 100 + F.col("b") * 40), ("b", F.col("a") * 100 + F.col("_partner.b") * 40)):
        grown = [r[1] - plain for r in rows.groupBy("_repeat").agg(F.avg(F.abs(other - F.col("y")))).collect()]
        assert got[c]["mean_increase_s"] == pytest.approx(sum(grown) / 3)


def test_rows_without_y_or_prediction_count_nowhere(spark):
    df = _made(spark).withColumns({"y": F.when(F.col("id") % 5 > 0, F.col("y")), "a": F.when(F.col("id") % 4 > 0, F.col("a"))})
    score = lambda rows: rows.withColumn("pred", F.col("a") * 100)
    got = {r["feature"]: r["mean_increase_s"] for r in ev.permutation_importance(df, score, ["a", "b"], ["id"]).collect()}
    assert got["b"] == pytest.approx(0, abs=1e-9) and got["a"] > 30


def test_the_columns_with_most_gain_need_train_rows_only(spark, monkeypatch):
    made, split_dataset = [], datasets.split_dataset

    def split(rows, histories, name):
        made.append(name)
        return split_dataset(rows, histories, name)

    monkeypatch.setattr(datasets, "split_dataset", split)
    assert QUERIES["sort_05_features"](spark, "/root/testdata/sf0.001").count() == 5 and made == ["train"]
