"""Samples by group, variants, shared categories, importance of a fitted model, and rows without a key."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stopwise.operators import asof
from stopwise.operators import evaluate as ev
from stopwise.plans import datasets, model
from stopwise.sources import adapters


@pytest.mark.parametrize("small", [2, 50_000])
def test_each_group_has_its_own_sample(spark, monkeypatch, small):
    monkeypatch.setattr(datasets, "SMALL", small)
    rows = spark.range(3000, numPartitions=5).selectExpr("CAST(id AS STRING) AS k", "CAST(id % 4 AS STRING) AS g")
    rows = rows.withColumn("g", F.when(F.col("g") != "3", F.col("g")))  # null is a group too
    size = F.when(F.col("g") == "0", 10).when(F.col("g") == "1", 5000).when(F.col("g") == "2", 333)  # null: all
    seed = F.when(F.col("g") == "2", 9).otherwise(1)
    got = {}
    for r in datasets.fixed_samples(rows, F.col("g"), size, ["k"], seed).collect():
        got.setdefault(r["g"], []).append(r["k"])
    for g, of, n, s in (("0", 0, 10, 1), ("1", 1, 5000, 1), ("2", 2, 333, 9), (None, 3, 5000, 1)):
        order = sorted((hashlib.md5(f"{i}|{s}".encode()).hexdigest(), str(i)) for i in range(of, 3000, 4))
        assert sorted(got[g]) == sorted(k for _, k in order[:n])
    assert datasets.fixed_samples(rows.limit(0), F.col("g"), size, ["k"], seed).count() == 0
    assert datasets.fixed_samples(rows, F.col("g"), F.lit(0), ["k"], seed).count() == 0


def test_variants_differ_in_what_they_name():
    v = datasets.variants(adapters.DAILY, ["1995-07-04"])
    assert list(v) == ["V0", "V1", "V2", "V3", "V4", "V4u", "V5", "V6", "C", "C2", "D"]
    assert v["C"].start == "1995-03-01" and v["V0"].start == "1994-12-01" and v["V0"].share == 12 and not v["V0"].all_rows


def test_a_category_of_one_set_only_has_an_index_of_its_own(spark):
    make = lambda lines: spark.createDataFrame([(x, "s", None) for x in lines], "line string, stop string, direction string")
    indexer = model.shared_indices(make(["b", "a"]), make(["c", "b"]))
    assert [list(x.labels) for x in indexer.stages] == [["a", "b", "c"], ["s"], []]
    got = {r["line"]: (r["_i_line"], r["_i_direction"]) for r in indexer.transform(make(["a", "c", "zz", None])).collect()}
    assert got == {"a": (0.0, 0.0), "c": (2.0, 0.0), "zz": (3.0, 0.0), None: (3.0, 0.0)}


def _made(spark):
    return spark.range(900).selectExpr("id", "concat('l', id % 3) AS line", "'s' AS stop", "'d' AS direction", "CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 10 * 20 AS DOUBLE) AS y", "90.0D AS baseline")


def test_importance_of_fitted_trees_in_one_pass(spark):
    df = _made(spark)
    m = model.fit_trees(df, None, ["a", "b"], rounds=3, depth=4)
    score = lambda rows: model.predict(m, rows, numbers=["a", "b"])
    got = {r["feature"]: r for r in ev.permutation_importance(df, score, ["a", "b", "line"], ["id"]).collect()}
    assert set(got) == {"a", "b", "line"} and got["a"]["mean_increase_s"] > 30 and abs(got["b"]["mean_increase_s"]) < 1
    again = ev.permutation_importance(df.repartition(7), score, ["a", "b", "line"], ["id"]).collect()
    assert {r["feature"]: round(r["sd_s"], 9) for r in again} == {f: round(r["sd_s"], 9) for f, r in got.items()}
    assert ev.permutation_importance(df.limit(0), score, ["a"], ["id"]).count() == 0


def test_every_row_is_partner_once_in_each_repeat(spark):
    rows = ev.with_partners(_made(spark).select("id", "a"), ["id"], ["id"], 3, 5).collect()
    assert len(rows) == 2700
    for r in range(3):
        mine = [x for x in rows if x["_repeat"] == r]
        assert sorted(x["id"] for x in mine) == sorted(x["_partner"]["id"] for x in mine) == list(range(900))
        assert sum(x["id"] == x["_partner"]["id"] for x in mine) < 15
    pairs = [{(x["id"], x["_partner"]["id"]) for x in rows if x["_repeat"] == r} for r in range(3)]
    assert len(pairs[0] & pairs[1]) < 15


def test_means_of_seeds_and_controls(spark):
    df = _made(spark)
    models = [model.fit_trees(df, None, ["a", "b"], seed=s, rounds=2, depth=3) for s in (0, 1)]
    parts = [{r["id"]: r["pred"] for r in model.predict(m, df, numbers=["a", "b"]).collect()} for m in models]
    mean = {r["id"]: r["pred"] for r in model.seed_average(models, df, ["a", "b"]).collect()}
    assert all(mean[i] == pytest.approx((parts[0][i] + parts[1][i]) / 2) for i in mean) and len(mean) == 900
    error = lambda m, numbers: model.predict(m, df, numbers=numbers).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    without = model.fit_trees(df, None, ["b"], rounds=2, depth=3)
    assert error(without, ["b"]) > error(models[0], ["a", "b"]) + 10


def test_rows_without_key_or_time_find_nothing_and_are_spread(spark):
    left = spark.sql("SELECT id, IF(id % 2 = 0, NULL, 'k') AS k, IF(id % 3 = 0, NULL, TIMESTAMP_NTZ '2024-01-05 10:00:00') AS t FROM range(600)")
    right = spark.sql("SELECT * FROM VALUES ('k', TIMESTAMP_NTZ '2024-01-03 09:00:00', 7), ('k', TIMESTAMP_NTZ '9000-02-01 00:00:00', 8), (NULL, TIMESTAMP_NTZ '2024-01-05 09:00:00', 9) AS r(k, t2, v)")
    got = {r["id"]: r["v"] for r in asof.asof_join(left, right, ["k"], "t", "t2", ["v"]).collect()}
    assert got == {i: 7 if i % 2 and i % 3 else None for i in range(600)}
