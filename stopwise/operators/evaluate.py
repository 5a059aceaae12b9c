"""Evaluation of predictions: errors, intervals, oracle bounds, calibration, breakdowns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def error_metrics(y: str = "y", pred: str = "pred") -> list[Column]:
    e = F.col(pred) - F.col(y)
    return [F.avg(F.abs(e)).alias("mae_s"), F.sqrt(F.avg(e * e)).alias("rmse_s"), (F.avg((F.abs(e) <= 60).cast("int")) * 100).alias("within_1min_pct"), (F.avg((F.abs(e) <= 120).cast("int")) * 100).alias("within_2min_pct")]


def metrics(df: DataFrame, *by: str, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(*error_metrics(y, pred))


def long_predictions(df: DataFrame, ids: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One row per method."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in methods]).unpivot(list(ids), list(methods), "method", "pred")


def metrics_by_method(df: DataFrame, methods: Sequence[str], *by: str) -> DataFrame:
    return metrics(long_predictions(df, ["y", *by], methods), *by, "method")


def pivoted_mae(df: DataFrame, methods: Sequence[str], by: str, values: Sequence | None = None) -> DataFrame:
    """MAE with a row per method and a column per value of `by`."""
    long = long_predictions(df, ["y", by], methods).withColumn("e", F.abs(F.col("pred") - F.col("y")))
    return long.groupBy("method").pivot(by, list(values) if values else None).agg(F.avg("e"))


def block_totals(df: DataFrame, model: str, base: str, block: str = "day", date: str = "date") -> DataFrame:
    """Absolute errors of two methods added up over each day, or over each week from Monday."""
    if block not in ("day", "week"):
        raise ValueError(f"errors are blocked by day or by week: {block!r}")
    key = F.trunc(date, "week") if block == "week" else F.col(date)
    off = lambda c: F.sum(F.abs(F.col(c) - F.col("y")))
    return df.groupBy(key.alias("block")).agg(
        off(model).alias("model_error"), off(base).alias("base_error"), F.count("*").alias("n_rows"), F.countDistinct(date).alias("n_days")
    )


#: Draws of a bootstrap that are held at once.
_DRAWS = 250


def _drawn(draws: int, seed: int, absolute: bool):
    """Blocks drawn with replacement: how often each one is drawn is multinomial, and a draw's totals are weighted sums."""

    def value_of(totals):
        model, base, n = totals.T
        return (model - base) / n if absolute else (base - model) / base * 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("block")
        blocks = pdf[["model_error", "base_error", "n_rows"]].to_numpy(float)
        n, rng, values = len(blocks), np.random.default_rng(seed), []
        for a in range(0, draws, _DRAWS):
            times = rng.multinomial(n, np.full(n, 1 / n), size=min(_DRAWS, draws - a))
            values.append(value_of(times @ blocks))
        low, high = np.quantile(np.concatenate(values), [0.025, 0.975])
        value = value_of(blocks.sum(axis=0, keepdims=True))[0]
        return pd.DataFrame({"comparison": [pdf["comparison"].iloc[0]], "value": [value], "low": [low], "high": [high], "days": [int(pdf["n_days"].sum())], "blocks": [n]})

    return run


def block_bootstrap(totals: DataFrame, draws: int = 2000, seed: int = 0, absolute: bool = False) -> DataFrame:
    """95 % interval per comparison from block totals (one row per comparison and block).

    Whole blocks are drawn, as rows of a day are not independent.  value is the relative
    gain in per cent or, with absolute, the difference of the mean errors in seconds.
    Only the block totals, at most a row per day, reach the resampling task.
    """
    return totals.groupBy("comparison").applyInPandas(_drawn(draws, seed, absolute), "comparison string, value double, low double, high double, days long, blocks long")


def mae_gain(df: DataFrame, pairs: Sequence[tuple[str, str]], block: str = "day", **options) -> DataFrame:
    """Bootstrap intervals of the gain of each (model, base)."""
    out = None
    for model, base in pairs:
        one = block_totals(df, model, base, block).withColumn("comparison", F.lit(f"{model} over {base}"))
        out = one if out is None else out.unionByName(one)
    return block_bootstrap(out, **options)


def grid_search(df: DataFrame, grid: Sequence[float], pred: Column, name: str, *by: str) -> DataFrame:
    """MAE per grid value; pred is an expression over the column `name`. Each task adds up its own rows per value first."""
    g = df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    return g.groupBy(*by, name).agg(F.avg(F.abs(pred - F.col("y"))).alias("mae_s"))


def best_of(grid: DataFrame, name: str, *by: str) -> DataFrame:
    """The value with the least error; ties go to the smallest value."""
    return grid.groupBy(*by).agg(F.min_by(name, F.struct(F.round("mae_s", 9), F.col(name))).alias(name), F.min("mae_s").alias("mae_s"))


BLEND_WEIGHTS = [round(0.5 + 0.05 * i, 2) for i in range(15)]
RULE_STRENGTHS = [round(0.05 * i, 2) for i in range(21)]


def blended(model: str, base: str, weight: Column | float) -> Column:
    return F.col(base) + (F.col(model) - F.col(base)) * weight


def blend_search(df: DataFrame, model: str = "pred", base: str = "baseline", *by: str) -> DataFrame:
    return grid_search(df, BLEND_WEIGHTS, blended(model, base, F.col("w")), "w", *by)


def rule(baseline: str, deviation: str, typical: Column, k: Column | float) -> Column:
    """Baseline plus k times what the line's last hour deviates from typical; no deviation known counts as typical."""
    return F.col(baseline) + (F.coalesce(F.col(deviation), typical) - typical) * k


def rule_search(df: DataFrame, deviation: str = "rt_ld_anom60", baseline: str = "baseline") -> DataFrame:
    typical = quantiles(df, F.col(deviation), [0.5]).select(F.col("q")[0].alias("typical"))
    return grid_search(df.crossJoin(F.broadcast(typical)), RULE_STRENGTHS, rule(baseline, deviation, F.col("typical"), F.col("k")), "k")  # typical is one row


ORACLE_LEVELS = {"nothing": [], "date": ["date"], "line_date": ["line", "date"], "line_direction_date_hour": ["line", "direction", "date", "hour"], "trip": ["journey_id"]}


def oracle_bounds(df: DataFrame, pred: str = "pred") -> DataFrame:
    """MAE if the median error of each group were known, at five levels of knowledge.

    The median comes from counts per distinct error in a group, never from all its rows at once.
    """
    rows = df.withColumn("e", F.col("y") - F.col(pred))
    out = None
    for level, keys in ORACLE_LEVELS.items():
        counts = rows.groupBy(*keys, "e").agg(F.count("*").alias("n"))
        if keys:
            g = counts.groupBy(*keys).agg(F.expr("percentile(e, 0.5, n)").alias("m"))
            same = F.lit(True)
            for k in keys:
                same = same & counts[k].eqNullSafe(g[k])
            counts = counts.join(g, same).select("e", "n", "m")
        else:
            counts = counts.withColumn("m", F.lit(0.0))
        one = counts.agg((F.sum(F.abs(F.col("e") - F.col("m")) * F.col("n")) / F.sum("n")).alias("mae_s")).select(F.lit(level).alias("level"), "mae_s")
        out = one if out is None else out.unionByName(one)
    return out


#: Ranges of equal numbers of distinct values, in which running counts are made.
RANGES = 64


def with_ranks(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """counts (rows with a number n per `by` and value) with _below, the rows of smaller values, and _total, all rows.

    Values are cut into RANGES at approximate quantiles, so no window holds more than about a 64th of the distinct
    values, whatever their scale; where the cuts lie does not change the result.
    """
    cuts = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    keys = [F.col(c).alias("_b_" + c) for c in by]
    edges = counts.groupBy(*keys).agg(F.expr(f"percentile_approx({value}, array({cuts}), 1000)").alias("_edges"), F.sum("n").alias("_total"))

    def joined(left: DataFrame, right: DataFrame, on=None) -> DataFrame:
        for c in by:
            same = left[c].eqNullSafe(right["_b_" + c])
            on = same if on is None else on & same
        return (left.crossJoin(F.broadcast(right)) if on is None else left.join(right, on)).drop(*["_b_" + c for c in by])  # edges: one row

    placed = joined(counts, edges).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sums = placed.groupBy(*keys, F.col("_range").alias("_r")).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*["_b_" + c for c in by]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = joined(placed, sums, placed["_range"] == sums["_r"])
    return ranked.withColumn("_below", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("_before", "_range", "_r")


def quantiles(df: DataFrame, value: Column, probabilities: Sequence[float], *by: str) -> DataFrame:
    """by, q: the exact quantiles of a value by group, with linear interpolation between neighbours; nulls are left out.

    From counts per distinct value and their ranks; nothing but the few neighbours of each quantile is brought together.
    """
    counts = df.filter(value.isNotNull()).groupBy(*by, value.cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ranked = with_ranks(counts, "_v", *by)
    at = lambda place: F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("n")), F.col("_v")))
    found, parts = [], []
    for i, p in enumerate(probabilities):
        place = (F.col("_total") - 1) * F.lit(float(p))
        found += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
        parts.append(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}"))
    return ranked.groupBy(*by).agg(*found).select(*by, F.array(*parts).alias("q"))


def auc(df: DataFrame, score: str, label: Column, *by: str) -> DataFrame:
    """Area under the ROC curve by average ranks; ties share their mean rank. Ranks come from counts per distinct score."""
    per = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("pos"))
    rank = F.col("_below") + (F.col("n") + 1) / 2
    p, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    ranked = with_ranks(per, "_s", *by).withColumn("rank", rank)
    return ranked.groupBy(*by).agg(((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0.0))).alias("auc"))


def fit_logistic(df: DataFrame, x: Column, label: Column, steps: int = 25) -> tuple[float, float]:
    """P(label) = 1 / (1 + exp(-(a + b x))) by Newton's method; each step is one aggregate of five sums."""
    rows = df.select(x.cast("double").alias("x"), label.cast("double").alias("t")).groupBy("x").agg(F.count("*").alias("n"), F.sum("t").alias("t")).cache()
    a = b = 0.0
    try:
        for _ in range(steps):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.col("x") * b)))
            w = F.col("n") * p * (F.lit(1.0) - p)
            r = rows.agg(F.sum(F.col("t") - F.col("n") * p), F.sum((F.col("t") - F.col("n") * p) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
            g0, g1, h00, h01, h11 = (float(v or 0) for v in r)
            h00, h11 = h00 + 1e-9, h11 + 1e-9
            det = h00 * h11 - h01 * h01
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-12:
                break
    finally:
        rows.unpersist()
    return a, b


def probability(ab: tuple[float, float], x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(ab[0]) + x * ab[1])))


def brier(df: DataFrame, p: str, label: Column, *by: str) -> DataFrame:
    """Brier score, that of the base rate, and the skill against it."""
    t = label.cast("double")
    g = df.groupBy(*by).agg(F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"), F.avg(t).alias("rate"))
    return g.select(*by, "brier", "rate", (F.lit(1.0) - F.col("brier") / F.nullif(F.col("rate") * (1 - F.col("rate")), F.lit(0.0))).alias("skill"))


def decile_edges(df: DataFrame, pred: str) -> DataFrame:
    """One row: the distinct inner edges of the prediction's tenths."""
    e = quantiles(df, F.col(pred), [i / 10 for i in range(11)]).select(F.array_distinct("q").alias("edges"))
    return e.select(F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2)).otherwise(F.array().cast("array<double>")).alias("edges"))


def decile_of(pred: str, edges: str = "edges") -> Column:
    """Number of inner edges at or below the prediction."""
    p = F.col(pred).cast("double")
    return F.size(F.filter(edges, lambda e: e <= p))


def interval_table(valid: DataFrame, pred: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Per tenth of the prediction the quantiles of the error on valid."""
    e = decile_edges(valid, pred)
    rows = valid.crossJoin(F.broadcast(e)).select(decile_of(pred).alias("bin"), (F.col("y") - F.col(pred)).alias("e"))  # edges: one row
    return quantiles(rows, F.col("e"), [low, high], "bin").select("bin", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def with_interval(test: DataFrame, valid: DataFrame, pred: str) -> DataFrame:
    """test with the interval (low, high) that valid's errors give its predictions."""
    table, edges = interval_table(valid, pred), decile_edges(valid, pred)
    rows = test.crossJoin(F.broadcast(edges)).withColumn("_bin", decile_of(pred)).drop("edges")
    rows = rows.join(F.broadcast(table), F.col("_bin") == F.col("bin"))  # ten rows
    return rows.withColumns({"low": F.col(pred) + F.col("lo"), "high": F.col(pred) + F.col("hi")}).drop("_bin", "bin", "lo", "hi")


def coverage(df: DataFrame, *by: str) -> DataFrame:
    inside = ((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).cast("int")
    return df.groupBy(*by).agg((F.avg(inside) * 100).alias("coverage_pct"), F.median(F.col("high") - F.col("low")).alias("median_width_s"))


def per_day(df: DataFrame, methods: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Per day: MAE of each method, mean delay, rows, and the means of other columns (the weather)."""
    errors = [F.avg(F.abs(F.col(m) - F.col("y"))).alias("mae_" + m) for m in methods]
    return df.groupBy("date").agg(F.count("*").alias("n"), F.avg("y").alias("mean_delay_s"), *errors, *[F.avg(c).alias("mean_" + c) for c in means])


def days_better(days: DataFrame, model: str, base: str) -> DataFrame:
    """On how many days the model errs less than the base, of all days."""
    return days.agg(F.count("*").alias("days"), F.sum((F.col(model) < F.col(base)).cast("long")).alias("days_better"), F.avg(F.col(base) - F.col(model)).alias("mean_gain_s"))


def _row_errors(df: DataFrame, reference: str, keys: Sequence[str]) -> DataFrame:
    """Each row's absolute error, averaged over the seeds of a variant, beside the reference variant's on the same row.
    Rows that the reference has no predictions for, as in months of its own, are left out."""
    errors = df.groupBy("variant", *keys, "date", "month").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("error"), F.count("*").alias("seeds"))
    base = errors.filter(F.col("variant") == reference).select(*keys, F.col("error").alias("base_error"))
    return errors.join(base, list(keys))


def variant_summary(df: DataFrame, reference: str, keys: Sequence[str]) -> DataFrame:
    """Of predictions by variant and seed: mean of the rows' errors in all months that the variant shares with the reference,
    its difference from the reference's, and the months in which it is smaller. All rows weigh alike."""
    month = _row_errors(df, reference, keys).groupBy("variant", "month").agg(
        F.max("seeds").alias("seeds"), F.count("*").alias("n"), F.sum("error").alias("error"), F.sum("base_error").alias("base")
    )
    return month.groupBy("variant").agg(
        F.max("seeds").alias("seeds"), F.count("*").alias("months"), (F.sum("error") / F.sum("n")).alias("mean_mae_s"), ((F.sum("error") - F.sum("base")) / F.sum("n")).alias("difference_s"),
        F.sum((F.col("error") < F.col("base")).cast("long")).alias("months_better"),
    )


def variant_intervals(df: DataFrame, reference: str, keys: Sequence[str], **options) -> DataFrame:
    """Bootstrap intervals by day of each variant's difference in MAE from the reference, in seconds; rows' errors are
    averaged over seeds first."""
    both = _row_errors(df, reference, keys).filter(F.col("variant") != reference)
    totals = both.groupBy("variant", F.col("date").alias("block")).agg(F.sum("error").alias("model_error"), F.sum("base_error").alias("base_error"), F.count("*").alias("n_rows"))
    named = totals.withColumn("n_days", F.lit(1)).withColumn("comparison", F.concat("variant", F.lit(f" over {reference}"))).drop("variant")
    return block_bootstrap(named, absolute=True, **options)


def worst_days(days: DataFrame, model: str, base: str, n: int = 10) -> DataFrame:
    """Mean gain on the n days on which the base errs most, and on all others."""
    worst = days.orderBy(F.desc(base), "date").limit(n).select("date", F.lit("worst").alias("part"))
    rest = days.join(worst, "date", "left_anti").select("date", F.lit("other").alias("part"))
    d = days.join(worst.unionByName(rest), "date").withColumn("gain", F.col(base) - F.col(model))
    return d.groupBy("part").agg(F.count("*").alias("days"), F.avg("gain").alias("mean_gain_s"), F.sum((F.col("gain") > 0).cast("long")).alias("days_better"))


def calibration_curve(df: DataFrame, p: str, label: Column) -> DataFrame:
    """Mean probability and observed share per tenth of the probability."""
    edges = decile_edges(df, p)
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", decile_of(p))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label.cast("double")).alias("observed"))


def gain_pct(model: str, base: str, y: str = "y") -> Column:
    return (F.lit(1.0) - F.sum(F.abs(F.col(model) - F.col(y))) / F.nullif(F.sum(F.abs(F.col(base) - F.col(y))).cast("double"), F.lit(0.0))) * 100


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The join of two prediction tables by key, and one row that tells whether any row found no partner."""
    r = right.withColumn("_there", F.lit(True))
    joined = left.join(r, list(keys), "left")
    check = joined.agg(F.count("*").alias("n_rows"), F.sum(F.col("_there").isNull().cast("long")).alias("unmatched"))
    return joined.drop("_there"), check


def against_earlier(df: DataFrame, earlier: DataFrame, keys: Sequence[str], pred: str, *by: str) -> DataFrame:
    """df with the predictions `pred` of an earlier round (at most one row per keys), for those groups `by` alone in which
    every row has one: a gain over a part of a group's rows is not the group's.  Rows of a null group are left out."""
    joined = df.join(earlier.select(*keys, pred), list(keys), "left")
    whole = joined.groupBy(*by).agg(F.bool_and(F.col(pred).isNotNull()).alias("_whole")).filter("_whole")
    return joined.join(whole.drop("_whole"), list(by), "left_semi")


def row_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A checksum that any engine can make again; it does not depend on the order of rows and changes with any value:
    the sum of the first 15 hex digits of the MD5 of each row's values as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("checksum"))


#: Rows that are numbered in one task, about.
_NUMBERED = 100_000


def numbered(df: DataFrame, order: Column, key: Sequence[str], groups: int, name: str, *by: str) -> DataFrame:
    """df with the place of each row (of each `by`) in the order of a 64-bit hash, from 0: a running number inside each of
    `groups` ranges of the hash, plus the rows of the ranges before."""
    h = df.withColumn("_h", order).withColumn("_g", F.floor((F.shiftright("_h", 32) + 2**31) * groups / 2.0**32).cast("int"))
    sums = h.groupBy(*by, F.col("_g").alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    sums = sums.select(*[F.col(c).alias("_b_" + c) for c in by], "_s", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_g").orderBy("_h", *key)) - 1
    on = F.col("_g") == F.col("_s")
    for c in by:
        on = on & (F.col(c) == F.col("_b_" + c))
    out = h.withColumn("_i", inside).join(F.broadcast(sums), on).withColumn(name, F.col("_before") + F.col("_i"))  # a row per range
    return out.drop("_h", "_g", "_s", "_i", "_before", *["_b_" + c for c in by])


def shuffled_column(df: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """df with `column` dealt anew among all its rows: the values in the order of one hash go to the rows in the order of
    another. key tells rows apart."""
    groups = max(8, df.count() // _NUMBERED)
    rows = numbered(df.drop(column), F.xxhash64(F.lit(1), *key), key, groups, "_to")
    values = numbered(df.select(*key, column), F.xxhash64(F.lit(seed), *key), key, groups, "_from").select("_from", column)
    return rows.join(values, F.col("_to") == F.col("_from")).select(*df.columns)


def with_partners(df: DataFrame, columns: Sequence[str], key: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Each row once for every repeat, with `_partner`, the columns of another row: in a repeat every row is partner once.

    Rows are numbered by one hash, partners by another one for each repeat; one join by (repeat, number) serves all columns.
    """
    groups = max(8, df.count() // _NUMBERED)
    every = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    rows = numbered(df, F.xxhash64(F.lit(1), *key), key, groups, "_to").withColumn("_repeat", every)
    partners = df.select(*key, F.struct(*columns).alias("_partner")).withColumn("_r", every)
    partners = numbered(partners, F.xxhash64(F.col("_r") + seed, *key), key, groups, "_from", "_r").select("_r", "_from", "_partner")
    return rows.join(partners, (F.col("_repeat") == F.col("_r")) & (F.col("_to") == F.col("_from"))).drop("_r", "_from", "_to")


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], columns: Sequence[str], key: Sequence[str], repeats: int = 3, seed: int = 10, pred: str = "pred", inputs: Sequence[str] | None = None) -> DataFrame:
    """feature, mean_increase_s, sd_s: how much the MAE of a model grows when one of its columns is shuffled among the
    rows before scoring. score adds the prediction to a frame; it reads the columns `inputs` (None: all but y and key).

    Rows with the same inputs and partners with the same columns are scored once for each column, all of them in one pass,
    so the number of jobs does not grow with columns and repeats, and rows are no more than numbered and matched.  Rows
    without y or without a prediction count nowhere; without any row there is no feature in the result.
    """
    inputs = list(dict.fromkeys([*columns, *([c for c in df.columns if c not in (*key, "y")] if inputs is None else inputs)]))
    kinds = stored(df.select(*inputs).distinct().withColumn("_kind", F.monotonically_increasing_id()))
    named = kinds.withColumnsRenamed({c: "_k_" + c for c in inputs})
    on = F.lit(True)
    for c in inputs:
        on = on & F.col(c).eqNullSafe(F.col("_k_" + c))
    narrow = stored(df.join(named, on, "left").select(*key, "y", "_kind"))
    pairs = with_partners(narrow, ["_kind"], key, repeats, seed).select("_repeat", "_kind", F.col("_partner._kind").alias("_other"), "y")
    pairs = stored(pairs.groupBy("_repeat", "_kind", "_other", "y").agg(F.count("*").alias("_n")))
    other = kinds.select(F.col("_kind").alias("_other"), F.struct(*columns).alias("_partner"))
    rows = pairs.select("_kind", "_other").distinct().join(kinds, "_kind").join(other, "_other")
    rows = rows.withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    rows = rows.withColumns({c: F.when(F.col("_feature") == c, F.col("_partner")[c]).otherwise(F.col(c)) for c in columns}).drop("_partner")
    scored = stored(score(rows).groupBy("_kind", "_other").agg(F.map_from_entries(F.collect_list(F.struct("_feature", F.col(pred).cast("double")))).alias("_preds")))  # one row per column
    plain = score(kinds).select("_kind", F.col(pred).cast("double").alias("_plain"))
    pairs = pairs.join(scored, ["_kind", "_other"]).join(plain, "_kind")
    off = lambda p: F.sum(F.abs(p - F.col("y")) * F.col("_n")) / F.sum(F.when((p - F.col("y")).isNotNull(), F.col("_n")))
    errors = pairs.groupBy("_repeat").agg(off(F.col("_plain")).alias("plain"), *[off(F.col("_preds")[c]).alias(f"_e{i}") for i, c in enumerate(columns)])
    first = errors.filter("_repeat = 0").select(F.col("plain").alias("_first"))  # one row
    grown = errors.join(F.broadcast(first)).select("_first", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_e{i}").alias("mae")) for i, c in enumerate(columns)])))
    grown = grown.withColumn("increase", F.col("mae") - F.col("_first"))
    return grown.groupBy("feature").agg(F.avg("increase").alias("mean_increase_s"), F.stddev_pop("increase").alias("sd_s"))
