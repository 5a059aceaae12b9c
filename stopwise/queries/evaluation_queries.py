"""EV, WIN-11..13, SORT, JN-15, DS-10: evaluation of stand-in predictions on the daily visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import binned
from ..operators import evaluate as ev
from ..operators import history
from ..plans import browse, datasets
from ..sources import io
from ..sources.scratch import stored, temp_folder
from .base import DAILY, daily, query, rounded
from .history_queries import _PERIODS, BASELINE, MONTHS, PAST_ROWS, RECENT_ROWS, lookups, tables_sql
from .trip_queries import CLEAN, clean_live

#: Predictions: median of line, stop and direction; mean of line and hour; both from before 2000.
P = f"""{DAILY}, bl AS (SELECT line, stop, direction, median(y) AS baseline FROM c WHERE date < DATE '2000-01-01' GROUP BY ALL), gm AS (SELECT line, hour, round(avg(y)) AS pred FROM c WHERE date < DATE '2000-01-01' GROUP BY ALL),
 d0 AS (SELECT c.*, baseline, pred, baseline + CAST((seq * 37 + minute_of_day) % 41 - 20 AS DOUBLE) AS rt FROM c JOIN bl USING (line, stop, direction) JOIN gm USING (line, hour) WHERE date >= DATE '2000-01-01'),
 p AS (SELECT * FROM d0 WHERE date >= DATE '2001-01-01'), va AS (SELECT * FROM d0 WHERE date < DATE '2001-01-01')"""


def both(spark, sf_dir) -> DataFrame:
    rows = daily(spark, sf_dir)
    old = rows.filter("date < DATE '2000-01-01'")
    b = old.groupBy("line", "stop", "direction").agg(F.median("y").alias("baseline"))
    g = old.groupBy("line", "hour").agg(F.round(F.avg("y")).alias("pred"))
    d = rows.filter("date >= DATE '2000-01-01'").join(b, ["line", "stop", "direction"]).join(g, ["line", "hour"])
    return d.withColumn("rt", F.col("baseline") + ((F.col("seq") * 37 + F.col("minute_of_day")) % 41 - 20).cast("double"))


def test(spark, sf_dir):
    return both(spark, sf_dir).filter("date >= DATE '2001-01-01'")


def valid(spark, sf_dir):
    return both(spark, sf_dir).filter("date < DATE '2001-01-01'")


METHODS = ["baseline", "pred", "rt"]
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT p.*, '{m}' AS method, CAST({m} AS DOUBLE) AS e_pred FROM p" for m in METHODS) + ")"


def metric_sql(pred: str) -> str:
    return f"round(avg(abs({pred} - y)), 6) AS mae_s, round(sqrt(avg(({pred} - y) * ({pred} - y))), 6) AS rmse_s, round(avg(CAST(abs({pred} - y) <= 60 AS INT)) * 100, 6) AS within_1min_pct, round(avg(CAST(abs({pred} - y) <= 120 AS INT)) * 100, 6) AS within_2min_pct"


@query("ev_01", f"WITH {DAILY}, {_PERIODS}, {tables_sql(PAST_ROWS)}, s AS (SELECT c.*, {BASELINE.format(p='h')} AS pred FROM c {lookups('c.month')} WHERE month >= DATE '1996-01-01') SELECT month, count(*) AS n_rows, {metric_sql('pred')} FROM s GROUP BY month")
def ev_01(spark, sf_dir):
    """The flagship: how good is the historical median, month by month?"""
    rows = daily(spark, sf_dir)
    judged = history.expanding(rows, [m for m in MONTHS if m >= "1996"]).baseline(rows.filter("month >= DATE '1996-01-01'"), F.col("month"), "pred")
    return rounded(judged.groupBy("month").agg(F.count("*").alias("n_rows"), *ev.error_metrics()))


@query("ev_02", f"WITH {P}, {LONG} SELECT hour, method, {metric_sql('e_pred')} FROM lg GROUP BY hour, method")
def ev_02(spark, sf_dir):
    return rounded(ev.metrics_by_method(test(spark, sf_dir), METHODS, "hour"))


@query("ev_02_pivot", f"WITH {P}, {LONG} SELECT method, " + ", ".join(f"round(avg(abs(e_pred - y)) FILTER (WHERE line = 'L{i}'), 6) AS \"L{i}\"" for i in range(4)) + " FROM lg GROUP BY method")
def ev_02_pivot(spark, sf_dir):
    return rounded(ev.pivoted_mae(test(spark, sf_dir), METHODS, "line", ["L0", "L1", "L2", "L3"]))


@query("ev_03")
def ev_03(spark, sf_dir):
    t = test(spark, sf_dir)
    pairs = [("pred", "baseline"), ("rt", "baseline")]
    return ev.mae_gain(t, pairs).withColumn("block", F.lit("day")).unionByName(ev.mae_gain(t, pairs, "week").withColumn("block", F.lit("week")))


@query("ev_03_blocks", f"WITH {P} SELECT date - CAST(isodow(date) - 1 AS INTEGER) AS block, sum(abs(pred - y)) AS model_error, sum(abs(baseline - y)) AS base_error, count(*) AS n_rows, count(DISTINCT date) AS n_days FROM p GROUP BY 1")
def ev_03_blocks(spark, sf_dir):
    return ev.block_totals(test(spark, sf_dir), "pred", "baseline", "week")


@query("ev_04")
def ev_04(spark, sf_dir):
    return ev.mae_gain(test(spark, sf_dir), [("pred", "baseline")], absolute=True)


_GRID = "(SELECT CAST(unnest([{v}]) AS DOUBLE) AS {n})"


@query("ev_05", f"WITH {P}, g AS (SELECT w, avg(abs(baseline + (pred - baseline) * w - y)) AS mae_s FROM va, {_GRID.format(v=', '.join(map(str, ev.BLEND_WEIGHTS)), n='w')} GROUP BY w) SELECT w, round(mae_s, 6) AS mae_s FROM g ORDER BY round(mae_s, 9), w LIMIT 1")
def ev_05(spark, sf_dir):
    return rounded(ev.best_of(ev.blend_search(valid(spark, sf_dir)), "w"))


@query("ev_05_months", f"WITH {P}, g AS (SELECT month, w, avg(abs(baseline + (pred - baseline) * w - y)) AS mae_s FROM va, {_GRID.format(v=', '.join(map(str, ev.BLEND_WEIGHTS)), n='w')} GROUP BY month, w) SELECT month, w, round(mae_s, 6) AS mae_s FROM g QUALIFY row_number() OVER (PARTITION BY month ORDER BY round(mae_s, 9), w) = 1")
def ev_05_months(spark, sf_dir):
    return rounded(ev.best_of(ev.blend_search(valid(spark, sf_dir), "pred", "baseline", "month"), "w", "month"))


_DEV = "dv AS (SELECT line, date, round(avg(y - baseline)) AS dev FROM va WHERE hour < 12 GROUP BY line, date), vd AS (SELECT va.*, dev FROM va LEFT JOIN dv USING (line, date))"


def _deviating(spark, sf_dir):
    v = valid(spark, sf_dir)
    d = v.filter("hour < 12").groupBy("line", "date").agg(F.round(F.avg(F.col("y") - F.col("baseline"))).alias("dev"))
    return v.join(d, ["line", "date"], "left")


@query("ev_06", f"WITH {P}, {_DEV}, ty AS (SELECT median(dev) AS typical FROM vd) SELECT k, round(avg(abs(baseline + (coalesce(dev, typical) - typical) * k - y)), 6) AS mae_s FROM vd, ty, {_GRID.format(v=', '.join(map(str, ev.RULE_STRENGTHS)), n='k')} GROUP BY k")
def ev_06(spark, sf_dir):
    return rounded(ev.rule_search(_deviating(spark, sf_dir), "dev"))


@query("sort_06", f"WITH {P}, {_DEV}, ty AS (SELECT median(dev) AS typical FROM vd), g AS (SELECT k, avg(abs(baseline + (coalesce(dev, typical) - typical) * k - y)) AS mae_s FROM vd, ty, {_GRID.format(v=', '.join(map(str, ev.RULE_STRENGTHS)), n='k')} GROUP BY k) SELECT k, round(mae_s, 6) AS mae_s FROM g ORDER BY round(mae_s, 9), k LIMIT 1")
def sort_06(spark, sf_dir):
    return rounded(ev.best_of(ev.rule_search(_deviating(spark, sf_dir), "dev"), "k"))


_ORACLE = " UNION ALL ".join(f"SELECT '{level}' AS level, round(avg(abs(e - m)), 6) AS mae_s FROM (SELECT e, {'0' if not keys else 'median(e) OVER (PARTITION BY ' + ', '.join(keys) + ')'} AS m FROM (SELECT *, y - pred AS e FROM p))" for level, keys in ev.ORACLE_LEVELS.items())


@query("ev_07", f"WITH {P} {_ORACLE}")
def ev_07(spark, sf_dir):
    return rounded(ev.oracle_bounds(test(spark, sf_dir)))


@query("win_11", f"WITH {P} SELECT journey_id, seq, median(y - pred) OVER (PARTITION BY line, direction, date, hour) AS group_error FROM p")
def win_11(spark, sf_dir):
    t = test(spark, sf_dir).withColumn("e", F.col("y") - F.col("pred"))
    g = t.groupBy("line", "direction", "date", "hour").agg(F.median("e").alias("group_error"))
    return t.join(g, ["line", "direction", "date", "hour"]).select("journey_id", "seq", "group_error")


_SINCE = "CASE WHEN seq <= 2 THEN 'first' WHEN seq <= 4 THEN 'middle' ELSE 'late' END"


@query("ev_08", f"WITH {P} SELECT {_SINCE} AS bin, " + ", ".join(f"round((1 - sum(abs(pred - y)) FILTER (WHERE line = 'L{i}') / sum(abs(baseline - y)) FILTER (WHERE line = 'L{i}')) * 100, 6) AS \"L{i}\"" for i in range(4)) + " FROM p GROUP BY 1")
def ev_08(spark, sf_dir):
    t = test(spark, sf_dir).withColumn("bin", binned("seq", [0, 2, 4, float("inf")], ["first", "middle", "late"]))
    return rounded(t.groupBy("bin").pivot("line", ["L0", "L1", "L2", "L3"]).agg(ev.gain_pct("pred", "baseline")))


LEADS = [10, 30, 60]
#: A prediction for each lead, and minutes from the trip's start.
PL = f"""{P}, st AS (SELECT journey_id, min(minute_of_day) AS start FROM c GROUP BY journey_id),
 pl AS (SELECT p.*, lead_min, minute_of_day - start AS since, baseline + CAST((seq * 37 + minute_of_day + lead_min) % 41 - 20 AS DOUBLE) AS pred_rt
   FROM p JOIN st USING (journey_id), (SELECT CAST(unnest({LEADS}) AS INTEGER) AS lead_min))"""
_FIRST = "CASE WHEN since <= 5 THEN '0-5' WHEN since <= 15 THEN '5-15' ELSE '15+' END"


def by_lead(spark, sf_dir) -> DataFrame:
    start = daily(spark, sf_dir).groupBy("journey_id").agg(F.min("minute_of_day").alias("start"))
    t = test(spark, sf_dir).join(start, "journey_id").withColumn("since", F.col("minute_of_day") - F.col("start")).drop("start")
    t = t.withColumn("lead_min", F.explode(F.array(*map(F.lit, LEADS))))
    return t.withColumn("pred_rt", F.col("baseline") + ((F.col("seq") * 37 + F.col("minute_of_day") + F.col("lead_min")) % 41 - 20).cast("double"))


_GAIN = "round((1 - sum(abs(pred_rt - y)) {f} / sum(abs(pred - y)) {f}) * 100, 6)"


@query("ev_08_leads", f"WITH {PL} SELECT lead_min, {_FIRST} AS bin, count(*) AS n_rows, {_GAIN.format(f='')} AS gain_pct FROM pl GROUP BY ALL")
def ev_08_leads(spark, sf_dir):
    """The real-time prediction's gain over the one from the day before, by lead and by minutes from the trip's start."""
    t = by_lead(spark, sf_dir).withColumn("bin", binned("since", [-1, 5, 15, float("inf")], ["0-5", "5-15", "15+"]))
    return rounded(t.groupBy("lead_min", "bin").agg(F.count("*").alias("n_rows"), ev.gain_pct("pred_rt", "pred").alias("gain_pct")))


@query("ev_08_pivot", f"WITH {PL} SELECT {_FIRST} AS bin, " + ", ".join(_GAIN.format(f=f"FILTER (WHERE lead_min = {x})") + f' AS "{x}"' for x in LEADS) + " FROM pl GROUP BY 1")
def ev_08_pivot(spark, sf_dir):
    t = by_lead(spark, sf_dir).withColumn("bin", binned("since", [-1, 5, 15, float("inf")], ["0-5", "5-15", "15+"]))
    return rounded(t.groupBy("bin").pivot("lead_min", LEADS).agg(ev.gain_pct("pred_rt", "pred")))


_AUC = "r AS (SELECT y > 180 AS late, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS rk FROM p)"


@query("ev_09", f"WITH {P}, {_AUC.format(s='rt')} SELECT round((sum(rk) FILTER (WHERE late) - count(*) FILTER (WHERE late) * (count(*) FILTER (WHERE late) + 1) / 2.0) / (count(*) FILTER (WHERE late) * count(*) FILTER (WHERE NOT late)), 6) AS auc FROM r")
def ev_09(spark, sf_dir):
    return rounded(ev.auc(test(spark, sf_dir), "rt", F.col("y") > 180))


@query("win_12", f"WITH {P} SELECT DISTINCT rt, CAST(rank() OVER (ORDER BY rt) + (count(*) OVER (PARTITION BY rt) - 1) / 2.0 AS DOUBLE) AS rank FROM p")
def win_12(spark, sf_dir):
    per = test(spark, sf_dir).groupBy("rt").agg(F.count("*").alias("n"))
    w = Window.orderBy("rt").rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct score of a small range
    return per.select("rt", (F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2).cast("double").alias("rank"))


@query("ev_10")
def ev_10(spark, sf_dir):
    v, t = valid(spark, sf_dir), test(spark, sf_dir)
    ab = ev.fit_logistic(v, F.col("rt") / 60, F.col("y") > 180)
    return rounded(ev.brier(t.withColumn("p", ev.probability(ab, F.col("rt") / 60)), "p", F.col("y") > 180).withColumns({"a": F.lit(ab[0]), "b": F.lit(ab[1])}))


_PROB = "pr AS (SELECT *, 1 / (1 + exp(-(rt - 1500) / 600)) AS pp, CAST(y > 1500 AS INT) AS late FROM p)"


def _probabilities(spark, sf_dir):
    return test(spark, sf_dir).withColumn("pp", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("rt") - 1500) / 600)))


@query("ev_11", f"WITH {P}, {_PROB}, b AS (SELECT avg((pp - late) * (pp - late)) AS brier, avg(late) AS rate FROM pr) SELECT round(brier, 6) AS brier, round(rate, 6) AS rate, round(1 - brier / (rate * (1 - rate)), 6) AS skill FROM b")
def ev_11(spark, sf_dir):
    return rounded(ev.brier(_probabilities(spark, sf_dir), "pp", F.col("y") > 1500))


_Q = ", ".join(str(i / 10) for i in range(11))
_EDGES = f"e0 AS (SELECT list_sort(list_distinct(quantile_cont(rt, [{_Q}]))) AS e FROM va), ed AS (SELECT e[2:len(e) - 1] AS edges FROM e0)"
_BIN = "CAST(len(list_filter(edges, lambda x: x <= rt)) AS INTEGER)"
_INTERVALS = f"iv AS (SELECT {_BIN} AS bin, quantile_cont(y - rt, 0.1) AS lo, quantile_cont(y - rt, 0.9) AS hi FROM va, ed GROUP BY 1)"


@query("ev_12", f"WITH {P}, {_EDGES}, {_INTERVALS} SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi FROM iv")
def ev_12(spark, sf_dir):
    return rounded(ev.interval_table(valid(spark, sf_dir), "rt"))


@query("ev_13", f"WITH {P}, {_EDGES}, {_INTERVALS}, x AS (SELECT p.*, {_BIN} AS bin FROM p, ed), z AS (SELECT month, y, rt + lo AS low, rt + hi AS high FROM x JOIN iv USING (bin)) SELECT month, round(avg(CAST(y >= low AND y <= high AS INT)) * 100, 6) AS coverage_pct, round(median(high - low), 6) AS median_width_s FROM z GROUP BY month")
def ev_13(spark, sf_dir):
    return rounded(ev.coverage(ev.with_interval(test(spark, sf_dir), valid(spark, sf_dir), "rt"), "month"))


_PER_DAY = "pd AS (SELECT date, count(*) AS n, avg(y) AS mean_delay_s, avg(abs(baseline - y)) AS mae_baseline, avg(abs(pred - y)) AS mae_pred, avg(abs(rt - y)) AS mae_rt FROM p GROUP BY date)"


@query("ev_14", f"WITH {P}, {_PER_DAY} SELECT date, n, round(mean_delay_s, 6) AS mean_delay_s, round(mae_baseline, 6) AS mae_baseline, round(mae_pred, 6) AS mae_pred, round(mae_rt, 6) AS mae_rt FROM pd")
def ev_14(spark, sf_dir):
    return rounded(ev.per_day(test(spark, sf_dir), METHODS))


@query("ev_14_days", f"WITH {P}, {_PER_DAY} SELECT count(*) AS days, count(*) FILTER (WHERE mae_rt < mae_pred) AS days_better, round(avg(mae_pred - mae_rt), 6) AS mean_gain_s FROM pd")
def ev_14_days(spark, sf_dir):
    """On how many days the real-time prediction is better than the one from the day before."""
    return rounded(ev.days_better(ev.per_day(test(spark, sf_dir), METHODS), "mae_rt", "mae_pred"))


_WEATHERED = f"""{CLEAN}, lb AS (SELECT line, median(y) AS baseline FROM clean WHERE date < DATE '2024-01-26' GROUP BY line), lp AS (SELECT line, hour, round(avg(y)) AS pred FROM clean WHERE date < DATE '2024-01-26' GROUP BY ALL)"""


@query("ev_14_weather", f"""WITH {_WEATHERED} SELECT date, count(*) AS n, round(avg(y), 6) AS mean_delay_s, round(avg(abs(baseline - y)), 6) AS mae_baseline, round(avg(abs(pred - y)), 6) AS mae_pred, round(avg(temp), 6) AS mean_temp,
  round(avg(precip), 6) AS mean_precip, round(avg(wind), 6) AS mean_wind, round(avg(abs(baseline - y)) - avg(abs(pred - y)), 6) AS gain_s FROM clean JOIN lb USING (line) JOIN lp USING (line, hour) WHERE date >= DATE '2024-01-26' GROUP BY date""")  # fmt: skip
def ev_14_weather(spark, sf_dir):
    c = clean_live(spark, sf_dir)
    old = c.filter("date < DATE '2024-01-26'")
    t = c.filter("date >= DATE '2024-01-26'").join(old.groupBy("line").agg(F.median("y").alias("baseline")), "line")
    t = t.join(old.groupBy("line", "hour").agg(F.round(F.avg("y")).alias("pred")), ["line", "hour"])
    days = ev.per_day(t, ["baseline", "pred"], ["temp", "precip", "wind"])
    return rounded(days.withColumn("gain_s", F.col("mae_baseline") - F.col("mae_pred")))


@query("sort_03", f"WITH {P}, {_PER_DAY}, z AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY mae_baseline DESC, date) <= 10 THEN 'worst' ELSE 'other' END AS part FROM pd) SELECT part, count(*) AS days, round(avg(mae_baseline - mae_rt), 6) AS mean_gain_s, count(*) FILTER (WHERE mae_baseline > mae_rt) AS days_better FROM z GROUP BY part")
def sort_03(spark, sf_dir):
    return rounded(ev.worst_days(ev.per_day(test(spark, sf_dir), METHODS), "mae_rt", "mae_baseline"))


@query("ev_15", f"WITH {P}, {_PROB}, e0 AS (SELECT list_sort(list_distinct(quantile_cont(pp, [{_Q}]))) AS e FROM pr), ed AS (SELECT e[2:len(e) - 1] AS edges FROM e0) SELECT CAST(len(list_filter(edges, lambda x: x <= pp)) AS INTEGER) AS bin, count(*) AS n, round(avg(pp), 6) AS mean_p, round(avg(late), 6) AS observed FROM pr, ed GROUP BY 1")
def ev_15(spark, sf_dir):
    return rounded(ev.calibration_curve(_probabilities(spark, sf_dir), "pp", F.col("y") > 1500))


_MONTHLY = "mo AS (SELECT month, count(*) AS n, avg(abs(pred - y)) AS mae_model, avg(abs(baseline - y)) AS mae_base FROM p GROUP BY month)"


@query("ev_16", f"WITH {P}, {_MONTHLY} SELECT count(*) AS months, count(*) FILTER (WHERE mae_model < mae_base) AS won, round((1 - sum(n * mae_model) / sum(n * mae_base)) * 100, 6) AS gain_pct FROM mo")
def ev_16(spark, sf_dir):
    m = test(spark, sf_dir).groupBy("month").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("m"), F.avg(F.abs(F.col("baseline") - F.col("y"))).alias("b"))
    return rounded(m.agg(F.count("*").alias("months"), F.sum((F.col("m") < F.col("b")).cast("long")).alias("won"), ((1 - F.sum(F.col("n") * F.col("m")) / F.sum(F.col("n") * F.col("b"))) * 100).alias("gain_pct")))


@query("ev_17", f"WITH {P}, {LONG}, x AS (SELECT month, method, avg(abs(e_pred - y)) AS mae FROM lg GROUP BY ALL) SELECT a.method, round(avg(a.mae), 6) AS mean_mae_s, round(avg(a.mae - b.mae), 6) AS against_baseline_s, count(*) FILTER (WHERE a.mae < b.mae) AS months_better FROM x a JOIN x b ON a.month = b.month AND b.method = 'baseline' GROUP BY a.method")
def ev_17(spark, sf_dir):
    x = ev.long_predictions(test(spark, sf_dir), ["y", "month"], METHODS).groupBy("month", "method").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
    b = x.filter("method = 'baseline'").select("month", F.col("mae").alias("base"))
    g = x.join(b, "month").groupBy("method").agg(F.avg("mae").alias("mean_mae_s"), F.avg(F.col("mae") - F.col("base")).alias("against_baseline_s"), F.sum((F.col("mae") < F.col("base")).cast("long")).alias("months_better"))
    return rounded(g)


#: Predictions of each method with two seeds.
_SEEDED = f"""{LONG}, sd AS (SELECT method AS variant, seed, journey_id, seq, month, y, e_pred + (seq * 31 + minute_of_day * seed) % 7 - 3 AS pred FROM lg, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS seed)),
 er AS (SELECT variant, journey_id, seq, month, avg(abs(pred - y)) AS error, count(*) AS seeds FROM sd GROUP BY ALL),
 sm AS (SELECT a.variant, a.month, max(a.seeds) AS seeds, count(*) AS n, sum(a.error) AS error, sum(b.error) AS base FROM er a JOIN er b ON a.journey_id = b.journey_id AND a.seq = b.seq AND b.variant = 'baseline' GROUP BY ALL)"""


def _seeded(spark, sf_dir) -> DataFrame:
    t = ev.long_predictions(test(spark, sf_dir), ["journey_id", "seq", "minute_of_day", "date", "month", "y"], METHODS).withColumnRenamed("method", "variant")
    t = t.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    return t.withColumn("pred", F.col("pred") + (F.col("seq") * 31 + F.col("minute_of_day") * F.col("seed")) % 7 - 3)


@query("ev_17_seeds", f"WITH {P}, {_SEEDED} SELECT variant, max(seeds) AS seeds, count(*) AS months, round(sum(error) / sum(n), 6) AS mean_mae_s, round((sum(error) - sum(base)) / sum(n), 6) AS difference_s, count(*) FILTER (WHERE error < base) AS months_better FROM sm GROUP BY variant")
def ev_17_seeds(spark, sf_dir):
    return rounded(ev.variant_summary(_seeded(spark, sf_dir), "baseline", ["journey_id", "seq"]))


@query("ev_17_intervals")
def ev_17_intervals(spark, sf_dir):
    """Each variant's difference from the reference with its interval."""
    return ev.variant_intervals(_seeded(spark, sf_dir), "baseline", ["journey_id", "seq"])


@query("ev_18", f"WITH {P}, {LONG} SELECT strftime(date, '%m-%d') AS day, method, {metric_sql('e_pred')} FROM lg WHERE strftime(date, '%m-%d') IN ('05-01', '05-17', '01-01') GROUP BY 1, 2")
def ev_18(spark, sf_dir):
    t = test(spark, sf_dir).withColumn("day", F.date_format("date", "MM-dd")).filter(F.col("day").isin("05-01", "05-17", "01-01"))
    return rounded(ev.metrics_by_method(t, METHODS, "day"))


@query("win_13", f"WITH {P}, {LONG}, x AS (SELECT method, avg(abs(e_pred - y)) AS mae FROM lg GROUP BY method) SELECT method, round(mae, 6) AS mae_s, round(mae - lag(mae) OVER (ORDER BY method), 6) AS step_s FROM x")
def win_13(spark, sf_dir):
    m = ev.metrics_by_method(test(spark, sf_dir), METHODS).select("method", "mae_s")
    return rounded(m.withColumn("step_s", F.col("mae_s") - F.lag("mae_s").over(Window.orderBy("method"))))  # a row per method


@query("ev_19", f"WITH {P}, {LONG} SELECT method, round(avg(abs(e_pred - y)) FILTER (WHERE hour < 12), 6) AS early_s, round(avg(abs(e_pred - y)) FILTER (WHERE hour >= 12), 6) AS late_s, round(avg(abs(e_pred - y)) FILTER (WHERE seq <= 2), 6) AS first_stops_s FROM lg GROUP BY method")
def ev_19(spark, sf_dir):
    lg = ev.long_predictions(test(spark, sf_dir), ["y", "hour", "seq"], METHODS).withColumn("e", F.abs(F.col("pred") - F.col("y")))
    on = lambda c, n: F.avg(F.when(F.expr(c), F.col("e"))).alias(n)
    return rounded(lg.groupBy("method").agg(on("hour < 12", "early_s"), on("hour >= 12", "late_s"), on("seq <= 2", "first_stops_s")))


_EACH = "round(avg(abs({m} - y)) {f}, 6)"


@query("ev_19_leads", f"""WITH {PL}, vr AS (SELECT lead_min, since, y, pred_rt AS e_pred, 'pred_rt' AS variant FROM pl UNION ALL SELECT lead_min, since, y, pred, 'pred' FROM pl)
  SELECT variant, {', '.join(_EACH.format(m='e_pred', f=f'FILTER (WHERE {c})') + f' AS {n}' for c, n in (('lead_min <= 15', 'short_s'), ('lead_min > 15 AND lead_min <= 45', 'middle_s'), ('lead_min > 45', 'long_s'), ('since <= 5', 'first_minutes_s')))} FROM vr GROUP BY variant""")  # fmt: skip
def ev_19_leads(spark, sf_dir):
    """Each variant's error by group of leads, and in the first five minutes of a trip."""
    lg = ev.long_predictions(by_lead(spark, sf_dir), ["y", "lead_min", "since"], ["pred", "pred_rt"]).withColumnRenamed("method", "variant")
    e = F.abs(F.col("pred") - F.col("y"))
    on = lambda c, n: F.avg(F.when(F.expr(c), e)).alias(n)
    return rounded(lg.groupBy("variant").agg(on("lead_min <= 15", "short_s"), on("lead_min > 15 and lead_min <= 45", "middle_s"), on("lead_min > 45", "long_s"), on("since <= 5", "first_minutes_s")))


@query("ev_20")
def ev_20(spark, sf_dir):
    """How much the error of a model grows when one of its columns is shuffled. The model is a rule of two known columns."""
    t = test(spark, sf_dir).select("journey_id", "seq", "y", "baseline", "pred", "minute_of_day")
    score = lambda rows: rows.withColumn("p", F.col("baseline") * 0.75 + F.col("pred") * 0.25)
    return rounded(ev.permutation_importance(t, score, ["baseline", "pred", "minute_of_day"], ["journey_id", "seq"], pred="p"))


_SUMMED = ["baseline", "date", "hour", "journey_id", "line", "pred", "rt", "seq", "stop", "y"]
_AS_TEXT = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in _SUMMED) + ")"


@query("ev_22", f"WITH {P} SELECT count(*) AS n_rows, CAST(sum(CAST(CAST(concat('0x', left(md5({_AS_TEXT}), 15)) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR) AS checksum FROM p")
def ev_22(spark, sf_dir):
    return ev.row_checksum(test(spark, sf_dir), _SUMMED)


@query("ev_23", f"WITH {P}, {LONG}, z AS (SELECT avg(abs(baseline - y)) AS b FROM p) SELECT method, {metric_sql('e_pred')}, round((1 - avg(abs(e_pred - y)) / any_value(b)) * 100, 6) AS gain_pct FROM lg, z GROUP BY method")
def ev_23(spark, sf_dir):
    t = test(spark, sf_dir)
    m = ev.metrics_by_method(t, METHODS)
    b = t.agg(F.avg(F.abs(F.col("baseline") - F.col("y"))).alias("b"))
    return rounded(m.crossJoin(F.broadcast(b)).withColumn("gain_pct", (1 - F.col("mae_s") / F.col("b")) * 100).drop("b"))


@query("ev_23_intervals")
def ev_23_intervals(spark, sf_dir):
    """Each method's gain over the baseline with its interval, days and weeks as blocks."""
    t = test(spark, sf_dir)
    parts = [ev.mae_gain(t, [(m, "baseline") for m in METHODS[1:]], b).withColumn("block", F.lit(b)) for b in ("day", "week")]
    return parts[0].unionByName(parts[1])


_FINAL_PAST = ", ".join(tables_sql(x, p) for p, x in (("b", PAST_ROWS), ("r", RECENT_ROWS)))
#: Test rows with both baselines and the predictions of the day before and of each lead.
_FINAL = f"""{PL}, {_PERIODS}, {_FINAL_PAST}, fin AS (SELECT c.journey_id, c.seq, c.date, c.y, {BASELINE.format(p='b')} AS past, {BASELINE.format(p='r')} AS recent, c.pred, c.pred_rt, c.lead_min
   FROM pl c {lookups('c.month', 'b')} {lookups('c.month', 'r')}),
 fl AS (SELECT 'past' AS method, 0 AS lead_min, y, past AS e_pred, past FROM fin WHERE lead_min = 10 UNION ALL SELECT 'recent', 0, y, recent, past FROM fin WHERE lead_min = 10
   UNION ALL SELECT 'pred', 0, y, pred, past FROM fin WHERE lead_min = 10 UNION ALL SELECT 'pred_rt', lead_min, y, pred_rt, past FROM fin)"""


def _final(spark, sf_dir) -> DataFrame:
    rows = daily(spark, sf_dir)
    months = history.months("2001-01-01", "2001-08-01")
    t = by_lead(spark, sf_dir)
    t = history.expanding(rows, months).baseline(t, F.col("month"), "past")
    return history.recent(rows, months).baseline(t, F.col("month"), "recent")


@query("ev_23_final", f"WITH {_FINAL} SELECT method, lead_min, {metric_sql('e_pred')}, round((1 - sum(abs(e_pred - y)) / sum(abs(past - y))) * 100, 6) AS gain_pct FROM fl GROUP BY method, lead_min")
def ev_23_final(spark, sf_dir):
    """The final table: historical median, median of the last 8 weeks, the day before, and real time by lead."""
    t = _final(spark, sf_dir)
    once = t.filter(F.col("lead_min") == LEADS[0]).withColumn("lead_min", F.lit(0))
    parts = [(once, m) for m in ("past", "recent", "pred")] + [(t, "pred_rt")]
    out = None
    for df, m in parts:
        one = df.groupBy(F.lit(m).alias("method"), "lead_min").agg(*ev.error_metrics("y", m), ev.gain_pct(m, "past").alias("gain_pct"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("ev_23_final_intervals")
def ev_23_final_intervals(spark, sf_dir):
    """Gains of the real-time prediction over both medians and over the day before, for each lead, with day and week blocks."""
    t = stored(_final(spark, sf_dir).select("date", "y", "past", "recent", "pred", "pred_rt", "lead_min"))
    out = None
    for block in ("day", "week"):
        for lead in LEADS:
            one = ev.mae_gain(t.filter(F.col("lead_min") == lead), [("pred_rt", m) for m in ("past", "recent", "pred")], block)
            one = one.withColumns({"lead_min": F.lit(lead), "block": F.lit(block)})
            out = one if out is None else out.unionByName(one)
    return out


_KEYS = ["journey_id", "seq", "lead_min"]


def _against_round1(spark, sf_dir) -> DataFrame:
    """Real-time predictions beside those of a first round, which lacks the afternoons of the longest lead."""
    t = by_lead(spark, sf_dir)
    first = t.withColumn("pred_r1", F.col("baseline") + ((F.col("seq") * 31 + F.col("minute_of_day") * 7 + F.col("lead_min")) % 61 - 30).cast("double"))
    return ev.against_earlier(t, first.filter(f"lead_min < {LEADS[-1]} or hour < 12"), _KEYS, "pred_r1", "lead_min")


_ROUND1 = f"""{PL}, r1 AS (SELECT journey_id, seq, lead_min, baseline + CAST((seq * 31 + minute_of_day * 7 + lead_min) % 61 - 30 AS DOUBLE) AS pred_r1
   FROM pl WHERE lead_min < {LEADS[-1]} OR hour < 12), n AS (SELECT pl.*, pred_r1 FROM pl LEFT JOIN r1 USING ({', '.join(_KEYS)}))"""


@query("ev_23_round1", f"""WITH {_ROUND1} SELECT lead_min, count(*) AS n_rows, {metric_sql('pred_r1')}, round((1 - sum(abs(pred_rt - y)) / sum(abs(pred_r1 - y))) * 100, 6) AS gain_pct
  FROM n GROUP BY lead_min HAVING count(*) = count(pred_r1)""")  # fmt: skip
def ev_23_round1(spark, sf_dir):
    """The first round's metrics by lead and the gain over it, where it predicted every row of the lead."""
    t = _against_round1(spark, sf_dir)
    return rounded(t.groupBy("lead_min").agg(F.count("*").alias("n_rows"), *ev.error_metrics("y", "pred_r1"), ev.gain_pct("pred_rt", "pred_r1").alias("gain_pct")))


@query("ev_23_round1_intervals")
def ev_23_round1_intervals(spark, sf_dir):
    """The gain over the first round with its interval, days as blocks, for each lead that it predicted as a whole."""
    t = stored(_against_round1(spark, sf_dir).select("date", "y", "pred_rt", "pred_r1", "lead_min"))
    parts = [ev.mae_gain(t.filter(F.col("lead_min") == r[0]), [("pred_rt", "pred_r1")]).withColumn("lead_min", F.lit(r[0])) for r in t.select("lead_min").distinct().collect()]
    return reduce(DataFrame.unionByName, parts)


@query("jn_15", f"WITH {P} SELECT count(*) AS n_rows, count(*) FILTER (WHERE hour >= 12) AS unmatched FROM p")
def jn_15(spark, sf_dir):
    t = test(spark, sf_dir)
    _, check = ev.checked_join(t.select("journey_id", "seq", "pred"), t.filter("hour < 12").select("journey_id", "seq", "rt"), ["journey_id", "seq"])
    return check


@query("sort_01", f"WITH {P} SELECT journey_id, seq, date, row_number() OVER (PARTITION BY date ORDER BY journey_id, seq) AS place FROM p")
def sort_01(spark, sf_dir):
    w = Window.partitionBy("date").orderBy("journey_id", "seq")
    return test(spark, sf_dir).select("journey_id", "seq", "date", F.row_number().over(w).cast("long").alias("place"))


@query("sort_01_written", f"WITH {P} SELECT journey_id, seq, date, row_number() OVER (ORDER BY date, journey_id, seq) AS place FROM p")
def sort_01_written(spark, sf_dir):
    """A dataset written in order and read back by file and row."""
    path = temp_folder(spark) + "/ordered"
    io.write_split(test(spark, sf_dir).select("journey_id", "seq", "date"), path)
    return io.read_in_order(spark, path)


@query("sort_02", f"WITH {P} SELECT journey_id, seq FROM p ORDER BY md5(concat_ws('|', journey_id, CAST(seq AS VARCHAR), '7')), journey_id, seq LIMIT 500")
def sort_02(spark, sf_dir):
    return datasets.fixed_sample(test(spark, sf_dir), 500, ["journey_id", "seq"], 7).select("journey_id", "seq")


def _named(spark, sf_dir):
    t = test(spark, sf_dir)
    j = Window.partitionBy("journey_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.withColumns({"origin_name": F.first("stop").over(j), "dest_name": F.last("stop").over(j), "trip_start_min": F.first("minute_of_day").over(j)})


_TRIPS = "tp AS (SELECT journey_id, arg_min(line, seq) AS line, arg_min(direction, seq) AS direction, arg_min(date, seq) AS date, arg_min(minute_of_day, seq) AS trip_start_min, arg_min(stop, seq) AS origin_name, arg_max(stop, seq) AS dest_name, avg(y) AS mean_y FROM p GROUP BY journey_id)"


@query("sort_04", f"WITH {P}, {_TRIPS} SELECT line, direction, date, journey_id, round(mean_y, 6) AS mean_y FROM tp WHERE trip_start_min >= 840 AND trip_start_min < 1020 QUALIFY row_number() OVER (PARTITION BY line, direction, date ORDER BY mean_y DESC, journey_id) = 1")
def sort_04(spark, sf_dir):
    return rounded(browse.worst_rush_trip(browse.trip_table(_named(spark, sf_dir)), start=840).select("line", "direction", "date", "journey_id", "mean_y"))


@query("ds_10", f"WITH {P}, {_TRIPS} SELECT * REPLACE (round(mean_y, 6) AS mean_y) FROM tp")
def ds_10(spark, sf_dir):
    return rounded(browse.trip_table(_named(spark, sf_dir)))


@query("ds_10_profile", f"WITH {P} SELECT line, direction, CAST(minute_of_day // 60 AS INTEGER) AS time, round(median(y) / 60, 6) AS y_min, round(median(CASE WHEN seq % 2 = 0 THEN rt ELSE pred END) / 60, 6) AS pred_min, round(median(baseline) / 60, 6) AS baseline_min FROM p GROUP BY ALL")
def ds_10_profile(spark, sf_dir):
    t = test(spark, sf_dir)
    live = t.filter("seq % 2 = 0").select("journey_id", "seq", F.lit(30).alias("lead_min"), F.col("rt").alias("pred_rt"))
    return rounded(browse.hourly_profile(t, live, 30))


@query("ds_10_destination", f"WITH {P}, {_TRIPS} SELECT line, direction, dest_name FROM (SELECT line, direction, dest_name, count(*) AS n FROM tp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY line, direction ORDER BY n DESC, dest_name) = 1")
def ds_10_destination(spark, sf_dir):
    return browse.usual_destination(browse.trip_table(_named(spark, sf_dir)))


@query("ds_10_errors", f"WITH {P} SELECT journey_id, round(avg(abs(pred - y)), 6) AS mae_model, round(avg(abs(baseline - y)), 6) AS mae_base FROM p GROUP BY journey_id")
def ds_10_errors(spark, sf_dir):
    return rounded(browse.trip_errors(test(spark, sf_dir)))


_SERIES = " UNION ALL ".join(f"SELECT journey_id, seq, '{c}' AS series, round({c} / 60.0, 6) AS minutes, lpad(CAST(minute_of_day // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute_of_day % 60 AS VARCHAR), 2, '0') AS planned FROM p" for c in ("y", "pred", "baseline"))


@query("ds_10_series", f"WITH {P} {_SERIES}")
def ds_10_series(spark, sf_dir):
    return rounded(browse.trip_series(test(spark, sf_dir)).drop("shown"))
