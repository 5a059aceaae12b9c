"""ML-01..05, SORT-05: boosted trees on the daily and real-time sets (no SQL: tree ensembles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import history
from ..plans import datasets, live, model
from ..sources import adapters
from ..sources.scratch import stored
from .base import DAILY, daily, query, rounded
from .live_queries import _World

SETUP = adapters.DAILY
NUMBERS = ["seq", "hour", "daytype", "minute_of_day", *history.FEATURES]


def _sets(spark, sf_dir, *splits):
    """The named splits: train, valid, test."""
    rows = stored(daily(spark, sf_dir)).withColumns({c: F.col("stop") for c in ("stop_name", "origin_name", "dest_name")})
    h = datasets.Histories(rows, SETUP)
    return [stored(datasets.split_dataset(rows, h, s)) for s in splits]


def _refit(train, valid):
    """The rows to refit on: train and valid with the history of both periods."""
    return datasets.with_refit(train).unionByName(datasets.with_refit(valid))


def _scores(df, *methods):
    return rounded(ev.metrics_by_method(df, methods), 3)


@query("ml_01")
def ml_01(spark, sf_dir):
    """Early stopping on valid, refit on train and valid, judged on test."""
    train, valid, test = _sets(spark, sf_dir, "train", "valid", "test")
    m = model.fit_and_refit(train, valid, _refit(train, valid), NUMBERS)
    return _scores(model.predict(m, test, numbers=NUMBERS), "pred", "baseline")


_SPLIT_ROWS = """s AS (SELECT *, CASE WHEN bucket < 20 AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train'
  WHEN bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'valid' WHEN bucket < 25 AND date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' THEN 'test' END AS split FROM c),
  x AS (SELECT split, 'line' AS column_name, line AS value FROM s WHERE split IS NOT NULL UNION ALL SELECT split, 'stop', stop FROM s WHERE split IS NOT NULL UNION ALL SELECT split, 'direction', direction FROM s WHERE split IS NOT NULL)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_rows" for s in ("train", "valid", "test"))


@query("ml_02", f"WITH {DAILY}, {_SPLIT_ROWS} SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS index, {_COUNTS} FROM x GROUP BY column_name, value")
def ml_02(spark, sf_dir):
    """The indices that the model has for the categories of all three sets, and the rows of each set with them."""
    rows, sets = stored(daily(spark, sf_dir)), ("train", "valid", "test")
    parts = [datasets.sampled(rows, SETUP, s) for s in sets]
    indexer = model.shared_indices(*parts)
    out = None
    for name, part in zip(sets, parts):
        one = indexer.transform(part)
        one = one.select(F.lit(name).alias("split"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col("_i_" + c).cast("int").alias("index")) for c in model.CATEGORIES])))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("column_name", "value", "index").agg(*[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_rows") for s in sets])


@query("ml_03")
def ml_03(spark, sf_dir):
    """The mean of models that differ by seed."""
    train, valid, test = _sets(spark, sf_dir, "train", "valid", "test")
    refit = _refit(train, valid)
    models = [model.fit_trees(refit, None, NUMBERS, seed=s, rounds=10) for s in (0, 1)]
    return _scores(model.seed_average(models, test, NUMBERS), "pred", "baseline")


@query("ml_04")
def ml_04(spark, sf_dir):
    """Trees on what the baseline leaves, added back to it."""
    train, valid, test = _sets(spark, sf_dir, "train", "valid", "test")
    refit = _refit(train, valid)
    m = model.fit_trees(model.residual(refit), None, NUMBERS, label="residual", rounds=10)
    out = model.predict(m, test, "r", NUMBERS).withColumn("pred", F.col("baseline") + F.col("r"))
    return _scores(out, "pred", "baseline")


@query("ml_05")
def ml_05(spark, sf_dir):
    """A control: the same model without the history columns."""
    train, valid, test = _sets(spark, sf_dir, "train", "valid", "test")
    refit = _refit(train, valid)
    fewer = [c for c in NUMBERS if not c.startswith("hist_")]
    m = model.fit_trees(refit, None, fewer, rounds=10)
    return _scores(model.predict(m, test, numbers=fewer), "pred", "baseline")


@query("ml_05_live")
def ml_05_live(spark, sf_dir):
    """Controls on the real-time sets: all columns, without real time, and those of the first round only."""
    w = _World(spark, sf_dir)
    train, test = (stored(live.live_dataset(w.visits, w.rows, w.plan, w.histories, s)) for s in ("train", "test"))
    columns = [c for c in datasets.feature_columns(train.columns) if c not in model.CATEGORIES]
    out = None
    for name, pick in (("all", list), ("without_realtime", datasets.without_realtime), ("round_one", datasets.round_one)):
        numbers = pick(columns)
        filled = [c for c in numbers if train.agg(F.count(c)).first()[0]]  # a column without any value has no median
        m = model.fit_trees(train, None, filled, rounds=3, depth=3)
        one = ev.metrics(model.predict(m, test, numbers=filled)).select(F.lit(name).alias("control"), F.lit(len(numbers)).alias("columns"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 3)


@query("sort_05_features")
def sort_05_features(spark, sf_dir):
    """The columns that the trees gain most from."""
    (train,) = _sets(spark, sf_dir, "train")
    m = model.fit_trees(train, None, NUMBERS, rounds=3, depth=3)
    return rounded(model.importances(m, spark, NUMBERS).orderBy(F.desc("importance"), "feature").limit(5))


@query("ev_20_model")
def ev_20_model(spark, sf_dir):
    """How much the error of the fitted trees grows when one of their columns is shuffled among the test rows."""
    train, valid, test = _sets(spark, sf_dir, "train", "valid", "test")
    m = model.fit_and_refit(train, valid, _refit(train, valid), NUMBERS, rounds=10, others=[test])
    score = lambda rows: model.predict(m, rows, numbers=NUMBERS)
    return rounded(ev.permutation_importance(test, score, [*NUMBERS, *model.CATEGORIES], ["journey_id", "seq"], inputs=[*NUMBERS, *model.CATEGORIES]), 3)
