"""AGG-04..11, JN-03, 04, EV-21, WIN-14: historical statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import fold
from ..operators import history
from ..sources import adapters
from .base import DAILY, LIVE, daily, live, query, rounded

SETUP = adapters.DAILY
MONTHS = history.months("1995-01-01", "2001-08-01")
_PERIODS = "m AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS hkey)"
_STATS = {"median": "median(y)", "mean": "round(avg(y), 6)", "std": "round(stddev_samp(y), 6)"}


def spec_sql(rows: str, name: str) -> str:
    """Direct aggregates over (hkey, row) pairs: independent of histograms."""
    keys, stats = history.SPECS[name]
    ks = "".join(f", {k}" for k in keys)
    return f"SELECT hkey{ks}, {', '.join(f'CAST({_STATS[how]} AS DOUBLE) AS {c}' for c, how in stats.items())} FROM {rows} GROUP BY hkey{ks}"


FOLD_ROWS = """(SELECT k AS hkey, c.* FROM c, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k) WHERE date BETWEEN DATE '1994-12-01' AND DATE '{end}' AND (k = 5 OR {fold} <> k))"""
DAY_FOLDS = FOLD_ROWS.format(end="1999-12-31", fold="dayofyear(date) % 5")
WEEK_FOLDS = FOLD_ROWS.format(end="1999-12-31", fold="(date_diff('day', DATE '1994-11-28', date) // 7) % 5")
PAST_ROWS = "(SELECT m.hkey, c.* FROM m JOIN c ON c.date < m.hkey)"
RECENT_ROWS = "(SELECT m.hkey, c.* FROM m JOIN c ON c.date < m.hkey AND c.date >= m.hkey - INTERVAL 56 DAY)"


@query("agg_04", f"WITH {DAILY} {spec_sql('(SELECT 0 AS hkey, c.* FROM c)', 'lsd')}")
def agg_04(spark, sf_dir):
    h = history.History(history.histogram(daily(spark, sf_dir), F.lit(0)), history.whole())
    return rounded(h.tables["lsd"].drop("hist_n"))


def _all_specs(h: history.History, spark_cols=("median", "mean", "std")):
    """One row per table and key: how many groups there are and what their statistics add up to."""
    out = None
    for name, t in h.tables.items():
        for c, how in history.SPECS[name][1].items():
            one = t.groupBy("hkey").agg(F.lit(name).alias("spec"), F.lit(c).alias("stat"), F.count("*").alias("n_groups"), F.count(c).alias("n_values"), F.round(F.sum(F.round(c, 6)), 3).alias("total"))
            out = one if out is None else out.unionByName(one)
    return out


def all_specs_sql(rows: str) -> str:
    parts = []
    for name, (_, stats) in history.SPECS.items():
        for c in stats:
            parts.append(f"SELECT hkey, '{name}' AS spec, '{c}' AS stat, count(*) AS n_groups, count({c}) AS n_values, round(sum({c}), 3) AS total FROM ({spec_sql(rows, name)}) GROUP BY hkey")
    return " UNION ALL ".join(parts)


@query("agg_05", f"WITH {DAILY} {spec_sql(DAY_FOLDS, 'lsdhd')}")
def agg_05(spark, sf_dir):
    return rounded(history.leave_fold_out(daily(spark, sf_dir), SETUP.data_start, SETUP.train.end).tables["lsdhd"].drop("hist_n"))


@query("agg_05_all", f"WITH {DAILY} {all_specs_sql(DAY_FOLDS)}")
def agg_05_all(spark, sf_dir):
    return _all_specs(history.leave_fold_out(daily(spark, sf_dir), SETUP.data_start, SETUP.train.end))


@query("agg_06", f"WITH {DAILY} {all_specs_sql(WEEK_FOLDS)}")
def agg_06(spark, sf_dir):
    return _all_specs(history.leave_fold_out(daily(spark, sf_dir), SETUP.data_start, SETUP.train.end, "week"))


@query("agg_07", f"WITH {DAILY}, {_PERIODS} {spec_sql(PAST_ROWS, 'lsd')}")
def agg_07(spark, sf_dir):
    return rounded(history.expanding(daily(spark, sf_dir), MONTHS).tables["lsd"].drop("hist_n"))


@query("agg_08", f"WITH {LIVE}, m AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-29', INTERVAL 7 DAY)) AS DATE) AS hkey) {spec_sql(PAST_ROWS, 'lhd')}")
def agg_08(spark, sf_dir):
    weeks = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
    return rounded(history.expanding(live(spark, sf_dir), weeks, "week").tables["lhd"].drop("hist_n"))


@query("agg_09", f"WITH {DAILY}, {_PERIODS} {spec_sql(RECENT_ROWS, 'lsd')}")
def agg_09(spark, sf_dir):
    return rounded(history.recent(daily(spark, sf_dir), MONTHS).tables["lsd"].drop("hist_n"))


@query("agg_10", f"""WITH {DAILY}, {_PERIODS} SELECT hkey, line, stop, direction, hour, daytype, median(y) AS hist_med_lsdhd, count(*) AS hist_n_lsdhd FROM {PAST_ROWS} GROUP BY ALL""")
def agg_10(spark, sf_dir):
    return rounded(history.with_counts(daily(spark, sf_dir), MONTHS))


def lookups(hkey: str, prefix: str = "h") -> str:
    """CTE-free joins of the five statistics to rows c, as subqueries over the same (hkey, row) pairs."""
    out = []
    for name, (keys, _) in history.SPECS.items():
        on = " AND ".join([f"{prefix}_{name}.hkey = {hkey}"] + [f"{prefix}_{name}.{k} = c.{k}" for k in keys])
        out.append(f"LEFT JOIN {prefix}_{name} ON {on}")
    return " ".join(out)


def tables_sql(rows: str, prefix: str = "h") -> str:
    return ", ".join(f"{prefix}_{name} AS ({spec_sql(rows, name)})" for name in history.SPECS)


BASELINE = "coalesce({p}_lsdhd.hist_med_lsdhd, {p}_lsd.med_lsd, {p}_lhd.med_lhd, {p}_l.med_l, {p}_g.med_g)"
FEATURE_SQL = "{p}_lsdhd.hist_med_lsdhd AS {x}hist_med_lsdhd, {p}_lsd.hist_mean_lsd AS {x}hist_mean_lsd, {p}_lsd.hist_std_lsd AS {x}hist_std_lsd, {p}_lhd.hist_mean_lhd AS {x}hist_mean_lhd, {p}_sh.hist_mean_sh AS {x}hist_mean_sh"


@query("jn_03", f"WITH {DAILY}, {tables_sql(DAY_FOLDS)} SELECT journey_id, c.seq, {FEATURE_SQL.format(p='h', x='')} FROM c {lookups('CAST(dayofyear(c.date) % 5 AS INTEGER)')} WHERE bucket < 20 AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'")
def jn_03(spark, sf_dir):
    from ..plans.datasets import sampled

    rows = daily(spark, sf_dir)
    h = history.leave_fold_out(rows, SETUP.data_start, SETUP.train.end)
    out = h.features(sampled(rows, SETUP, "train"), fold("date", "day", SETUP.data_start))
    return rounded(out.select("journey_id", "seq", *history.FEATURES))


@query("jn_04", f"WITH {DAILY}, {_PERIODS}, {tables_sql(PAST_ROWS)} SELECT journey_id, c.seq, {BASELINE.format(p='h')} AS baseline FROM c {lookups('c.month')} WHERE bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'")
def jn_04(spark, sf_dir):
    from ..plans.datasets import sampled

    rows = daily(spark, sf_dir)
    past = history.expanding(rows, history.months(SETUP.valid.start, SETUP.valid.end))
    return past.baseline(sampled(rows, SETUP, "valid"), F.col("month")).select("journey_id", "seq", "baseline")


@query("ev_21", f"WITH {DAILY} SELECT median(y) AS median_y FROM c WHERE date <= DATE '1999-12-31'")
def ev_21(spark, sf_dir):
    return history.global_median(daily(spark, sf_dir).filter("date <= DATE '1999-12-31'"))


@query("win_14", f"WITH {DAILY}, t AS (SELECT DISTINCT date, journey_id FROM c) SELECT date, journey_id, row_number() OVER (ORDER BY date, journey_id) - 1 AS trip FROM t")
def win_14(spark, sf_dir):
    return history.dense_trip_ids(daily(spark, sf_dir))
