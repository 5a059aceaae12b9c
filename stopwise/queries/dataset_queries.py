"""DS-03, 04, 06..08: train, valid, test, rolling and variant datasets on the daily visits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import history
from ..plans import datasets
from ..sources import adapters
from ..sources.scratch import stored
from .base import DAILY, daily, query, rounded
from .history_queries import _PERIODS, BASELINE, FEATURE_SQL, FOLD_ROWS, PAST_ROWS, RECENT_ROWS, lookups, tables_sql
from .live_queries import _FOLDS, _PAST, _WEEK, _WEEKS
from .trip_queries import CLEAN, clean_live

SETUP, LIVE = adapters.DAILY, adapters.LIVE
_P1 = FOLD_ROWS.format(end="1999-12-31", fold="dayofyear(date) % 5")
_P2 = FOLD_ROWS.format(end="2000-12-31", fold="dayofyear(date) % 5")
_OWN = "CAST(dayofyear(c.date) % 5 AS INTEGER)"
_TABLES = ", ".join(tables_sql(rows, p) for p, rows in (("b", PAST_ROWS), ("r", RECENT_ROWS), ("h0", _P1), ("h1", _P2)))
_IDS = "journey_id, c.seq, c.y, c.date"


def rows(spark, sf_dir):
    return daily(spark, sf_dir).withColumns({"stop_name": F.col("stop"), "origin_name": F.lit("o"), "dest_name": F.lit("d")})


def dataset_sql(split: str, plan: list[tuple[str, str, str]], pct: int, keep_id: bool, tables: str = _TABLES) -> str:
    p = SETUP.period(split)
    feats = ", ".join(FEATURE_SQL.format(p=a, x=x) for a, _, x in plan)
    joins = " ".join([lookups("c.month", "b"), lookups("c.month", "r"), *(lookups(key, a) for a, key, _ in plan)])
    ids = "journey_id, " if keep_id else ""
    return f"WITH {DAILY}, {_PERIODS}, {tables} SELECT {ids}c.y, c.date, c.line, c.stop, c.direction, c.seq, c.hour, c.daytype, c.minute_of_day, {BASELINE.format(p='b')} AS baseline, {BASELINE.format(p='r')} AS baseline_recent, {feats} FROM c {joins} WHERE bucket < {pct} AND date BETWEEN DATE '{p.start}' AND DATE '{p.end}'"


def _split(spark, sf_dir, split, setup=SETUP):
    r = rows(spark, sf_dir)
    out = datasets.split_dataset(r, datasets.Histories(r, setup), split)
    return rounded(out.drop("stop_name", "origin_name", "dest_name"))


@query("ds_03_train", dataset_sql("train", [("h0", _OWN, ""), ("h1", _OWN, "refit_")], 20, False))
def ds_03_train(spark, sf_dir):
    return _split(spark, sf_dir, "train")


@query("ds_03_valid", dataset_sql("valid", [("h0", "5", ""), ("h1", _OWN, "refit_")], 25, False))
def ds_03_valid(spark, sf_dir):
    return _split(spark, sf_dir, "valid")


@query("ds_03", dataset_sql("test", [("h1", "5", "")], 25, True))
def ds_03(spark, sf_dir):
    return _split(spark, sf_dir, "test")


@query("ds_04", dataset_sql("test", [("b", "c.month", "")], 25, True, ", ".join(tables_sql(x, p) for p, x in (("b", PAST_ROWS), ("r", RECENT_ROWS)))).replace(lookups("c.month", "b") + " " + lookups("c.month", "r") + " " + lookups("c.month", "b"), lookups("c.month", "b") + " " + lookups("c.month", "r")))
def ds_04(spark, sf_dir):
    return _split(spark, sf_dir, "test", replace(SETUP, after="monthly"))


_ROLL = "(SELECT k AS hkey, c.* FROM c, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k) WHERE date BETWEEN DATE '1994-12-01' AND DATE '1999-05-31' AND (k = 5 OR dayofyear(date) % 5 <> k))"


_DS_06 = f"""WITH {DAILY}, {tables_sql(_ROLL)}, q AS (SELECT *, CASE WHEN date < DATE '1999-05-01' THEN 'train' WHEN date < DATE '1999-06-01' THEN 'stop' ELSE 'test' END AS part FROM c WHERE month <= DATE '1999-06-01' AND date >= DATE '1995-01-01')
  SELECT {_IDS}, part, {FEATURE_SQL.format(p='h', x='')} FROM q c {lookups("CASE WHEN part = 'test' THEN 5 ELSE CAST(dayofyear(c.date) % 5 AS INTEGER) END")}"""  # fmt: skip


@query("ds_06", _DS_06 + " WHERE date >= DATE '1999-04-01'")
def ds_06(spark, sf_dir):
    out = datasets.rolling_dataset(rows(spark, sf_dir), "1999-06-01", SETUP).filter("date >= DATE '1999-04-01'")
    return rounded(out.select("journey_id", "seq", "y", "date", "part", *history.FEATURES))


@query("ds_06_all", _DS_06)
def ds_06_all(spark, sf_dir):
    """All rows of the rolling dataset; ds_06 shows those from April 1999 on."""
    out = datasets.rolling_dataset(rows(spark, sf_dir), "1999-06-01", SETUP)
    return rounded(out.select("journey_id", "seq", "y", "date", "part", *history.FEATURES))


_SAMPLE = "((bucket < 20 AND date <= DATE '1999-12-31') OR (bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'))"
_OTHER_DAY = "CASE WHEN isodow(date) = 7 OR date IN (DATE '1996-02-05', DATE '1997-07-04', DATE '1998-12-24') THEN 2 WHEN isodow(date) = 6 THEN 1 ELSE 0 END"
_SAMPLED_P1 = _P1.replace("FROM c,", "FROM s,").replace("c.*", "s.*")


@query("ds_07", f"""WITH {DAILY}, a AS (SELECT * REPLACE ({_OTHER_DAY} AS daytype) FROM c), s AS (SELECT * FROM a WHERE {_SAMPLE}), {tables_sql(_SAMPLED_P1)}
  SELECT {_IDS}, c.daytype, {FEATURE_SQL.format(p='h', x='')}, CAST(greatest(0, (year(c.date) - 1999) * 12 + month(c.date) - 12) AS INTEGER) AS hist_age_months FROM a c {lookups('5')} WHERE bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")  # fmt: skip
def ds_07(spark, sf_dir):
    out = datasets.variant(rows(spark, sf_dir), SETUP, "valid", ["1996-02-05", "1997-07-04", "1998-12-24"], all_rows=False, aged=True)
    return rounded(out.select("journey_id", "seq", "y", "date", "daytype", *history.FEATURES, "hist_age_months"))


_PAST_COUNT = "SELECT hkey, line, stop, direction, hour, daytype, count(*) AS hist_n_lsdhd FROM {} GROUP BY ALL"


@query("ds_08", f"""WITH {DAILY}, {_PERIODS}, {tables_sql(PAST_ROWS)}, n AS ({_PAST_COUNT.format(PAST_ROWS)}) SELECT {_IDS}, {FEATURE_SQL.format(p='h', x='')}, n.hist_n_lsdhd FROM c {lookups('c.month')}
  LEFT JOIN n ON n.hkey = c.month AND n.line = c.line AND n.stop = c.stop AND n.direction = c.direction AND n.hour = c.hour AND n.daytype = c.daytype WHERE bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")  # fmt: skip
def ds_08(spark, sf_dir):
    out = datasets.variant(rows(spark, sf_dir), SETUP, "valid", scheme="month", counted=True)
    return rounded(out.select("journey_id", "seq", "y", "date", *history.FEATURES, "hist_n_lsdhd"))




def _live_split_sql(split: str, plan: list[tuple[str, str, str]]) -> str:
    """A split of the cleaned live visits: all their columns, both baselines, history by plan."""
    p, pct = LIVE.period(split), dict(LIVE.sample_pct)[split]
    ids = "" if split == "test" else ", journey_id, stop_name, origin_name, dest_name"
    recent = RECENT_ROWS.replace("JOIN c ON", "JOIN clean c ON")
    tables = ", ".join([tables_sql(_PAST, "b"), tables_sql(recent, "r"), *(_FOLDS[x] for x in sorted({x for x, _, _ in plan}))])
    feats = ", ".join(FEATURE_SQL.format(p=a, x=x) for a, _, x in plan)
    joins = " ".join([lookups(_WEEK, "b"), lookups(_WEEK, "r"), *(lookups(key, a) for a, key, _ in plan)])
    exact = ", ".join(f"round(c.{c}, 6) AS {c}" for c in ("route_frac", "sched_min_from_start", "daylight_h", "temp", "wind"))
    return f"""WITH {CLEAN}, {_WEEKS}, {tables} SELECT c.* EXCLUDE (month, bucket{ids}) REPLACE ({exact}), {BASELINE.format(p='b')} AS baseline, {BASELINE.format(p='r')} AS baseline_recent, {feats}
 FROM clean c {joins} WHERE bucket < {pct} AND date >= DATE '{p.start}' AND date <= DATE '{p.end}'"""


def _live_split(spark, sf_dir, split):
    rows = stored(clean_live(spark, sf_dir))
    out = datasets.split_dataset(rows, datasets.Histories(rows, LIVE), split)
    return rounded(out.withColumn("sched_min_from_start", F.col("sched_min_from_start").cast("double")))


@query("ds_03_clean_train", _live_split_sql("train", [("h0", _OWN, ""), ("h1", _OWN, "refit_")]))
def ds_03_clean_train(spark, sf_dir):
    """Train rows from the cleaned visits, with plan, calendar, daylight and weather columns."""
    return _live_split(spark, sf_dir, "train")


@query("ds_03_clean_valid", _live_split_sql("valid", [("h0", "5", ""), ("h1", _OWN, "refit_")]))
def ds_03_clean_valid(spark, sf_dir):
    return _live_split(spark, sf_dir, "valid")


@query("ds_03_clean", _live_split_sql("test", [("h1", "5", "")]))
def ds_03_clean(spark, sf_dir):
    return _live_split(spark, sf_dir, "test")


@query("ds_06_baseline", f"""WITH {DAILY}, {_PERIODS}, {tables_sql(PAST_ROWS, 'b')} SELECT {_IDS}, {BASELINE.format(p='b')} AS baseline FROM c {lookups('c.month', 'b')} WHERE date >= DATE '1995-01-01' AND month <= DATE '1999-06-01'""")
def ds_06_baseline(spark, sf_dir):
    """The baseline of every row of the rolling dataset, from before the row's own month."""
    return datasets.rolling_dataset(rows(spark, sf_dir), "1999-06-01", SETUP).select("journey_id", "seq", "y", "date", "baseline")


_CV = [f"1995-{m:02d}-01" for m in range(3, 11)]
_CV_MONTHS = f"cv AS (SELECT CAST(unnest([{', '.join(repr(m) for m in _CV)}]) AS DATE) AS cv_month)"
_CV_ROWS = "(SELECT cv.cv_month || '/' || k AS hkey, c.* FROM cv JOIN c ON c.date < cv.cv_month AND c.date >= DATE '1994-12-01', (SELECT CAST(unnest(range(6)) AS INTEGER) AS k) WHERE k = 5 OR dayofyear(c.date) % 5 <> k)"


@query("ds_08_months", f"""WITH {DAILY}, {_CV_MONTHS}, {_PERIODS}, {tables_sql(_CV_ROWS)}, {tables_sql(PAST_ROWS, 'b')},
  parts AS (SELECT cv_month, c.*, CASE WHEN c.month = cv_month THEN 'test' WHEN c.month = cv_month - INTERVAL 1 MONTH THEN 'stop' ELSE 'train' END AS part FROM cv JOIN c ON c.month <= cv_month AND c.date >= DATE '1995-01-01')
  SELECT c.cv_month, {_IDS}, part, {FEATURE_SQL.format(p='h', x='')}, {BASELINE.format(p='b')} AS baseline
  FROM parts c {lookups("c.cv_month || '/' || CASE WHEN part = 'test' THEN 5 ELSE dayofyear(c.date) % 5 END")} {lookups('c.month', 'b')}""")  # fmt: skip
def ds_08_months(spark, sf_dir):
    """The datasets of the cross-validation months March to October, all in one pass."""
    out = datasets.cv_datasets(rows(spark, sf_dir), _CV, SETUP)
    return rounded(out.select("cv_month", "journey_id", "seq", "y", "date", "part", *history.FEATURES, "baseline"))


#: Rows of train and stop parts in the queries: few enough that the test tables have more.
_FEW = (("train", 400), ("stop", 60), ("test", None))


def _parts_sql(rows: str, months: list[str], most, share: int = 20, start: str = "1995-01-01", seed: int = 0) -> str:
    """CTEs cv and p: the rows of each month's parts, those with the smallest hashes."""
    size = " ".join(f"WHEN '{part}' THEN {'9223372036854775807' if n is None else n}" for part, n in most)
    return f"""cv AS (SELECT CAST(unnest([{', '.join(repr(m) for m in months)}]) AS DATE) AS cv_month),
  q AS (SELECT cv_month, r.*, CASE WHEN r.month = cv_month THEN 'test' WHEN r.month = cv_month - INTERVAL 1 MONTH THEN 'stop' ELSE 'train' END AS part FROM cv JOIN {rows} r ON r.month <= cv_month),
  p AS (SELECT * FROM q WHERE (part = 'train' AND bucket < {share} AND date >= DATE '{start}') OR (part <> 'train' AND bucket < 25)
    QUALIFY row_number() OVER (PARTITION BY cv_month, part ORDER BY md5(concat_ws('|', journey_id, CAST(seq AS VARCHAR), CASE WHEN part = 'train' THEN '{seed}' ELSE '0' END)), journey_id, seq) <= CASE part {size} END)"""


def _fold_rows_sql(rows: str, fold: str = "dayofyear({d}) % 5") -> str:
    """(history key, row) pairs: the rows before each month, but for a fold."""
    return f"""(SELECT cv.cv_month || '/' || k AS hkey, s.* FROM cv JOIN {rows} s ON s.date < cv.cv_month AND s.date >= DATE '1994-12-01', (SELECT CAST(unnest(range(6)) AS INTEGER) AS k) WHERE k = 5 OR {fold.format(d='s.date')} <> k)"""


def _fold_key(fold: str = "dayofyear({d}) % 5") -> str:
    return f"c.cv_month || '/' || CASE WHEN c.part = 'test' THEN 5 ELSE {fold.format(d='c.date')} END"


_ROLLED = ["1999-06-01", "1999-07-01", "2000-12-01"]


@query("ds_06_samples", f"""WITH {DAILY}, {_parts_sql('c', _ROLLED, _FEW)}, {_PERIODS}, {tables_sql(_fold_rows_sql('c'))}, {tables_sql(PAST_ROWS, 'b')}
  SELECT c.cv_month, {_IDS}, part, {FEATURE_SQL.format(p='h', x='')}, {BASELINE.format(p='b')} AS baseline FROM p c {lookups(_fold_key())} {lookups('c.month', 'b')}""")  # fmt: skip
def ds_06_samples(spark, sf_dir):
    """Rolling datasets of three months, their train and stop parts whole trips' rows of bounded number."""
    out = datasets.rolling_samples(stored(rows(spark, sf_dir)), _ROLLED, SETUP, _FEW)
    return rounded(out.select("cv_month", "journey_id", "seq", "y", "date", "part", *history.FEATURES, "baseline"))


_EIGHT = (("train", 300), ("stop", 40), ("test", 80))
_OLD_DAYS = ["1995-02-06", "1995-07-04", "1995-12-24"]
_WEEK_OF = "(date_diff('day', DATE '1994-11-28', {d}) // 7) % 5"
_COUNTED = "SELECT hkey, line, stop, direction, hour, daytype, count(*) AS hist_n_lsdhd FROM {} GROUP BY ALL"
_OLD_DAYTYPE = f"CASE WHEN isodow(date) = 7 OR date IN ({', '.join(f"DATE '{d}'" for d in _OLD_DAYS)}) THEN 2 WHEN isodow(date) = 6 THEN 1 ELSE 0 END"


def _variant_sql(name: str, seed: int) -> str:
    """One variant's months, with all extra columns (null where the variant has none)."""
    v = datasets.variants(SETUP, _OLD_DAYS)[name]
    days = f"SELECT * REPLACE ({_OLD_DAYTYPE} AS daytype) FROM c" if v.holidays else "SELECT * FROM c"
    basis = "TRUE" if v.all_rows else f"(bucket < {v.share} AND date <= DATE '1999-12-31') OR (bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')"
    fold = _WEEK_OF if v.folds == "week" else "dayofyear({d}) % 5"
    if v.scheme == "folds":
        pairs, key, ends = _fold_rows_sql("s", fold), _fold_key(fold), "c.cv_month"
    else:
        pairs = f"(SELECT u.hkey, s.* FROM (SELECT DISTINCT CAST(date_trunc('{v.scheme}', date) AS DATE) AS hkey FROM p) u JOIN s ON s.date < u.hkey)"
        key = ends = f"CAST(date_trunc('{v.scheme}', c.date) AS DATE)"
    n = "n.hist_n_lsdhd" if v.counted else "CAST(NULL AS BIGINT)"
    months = f"CAST(date_diff('month', DATE '1994-12-01', {ends}) AS INTEGER)" if v.aged else "CAST(NULL AS INTEGER)"
    same = " AND ".join(f"n.{k} = c.{k}" for k in history.ALL_KEYS)
    return f"""SELECT * FROM (WITH a AS ({days}), s AS (SELECT * FROM a WHERE {basis}), {_parts_sql('a', _CV, _EIGHT, v.share or 20, v.start or '1995-01-01', seed)}, {tables_sql(pairs)}, n AS ({_COUNTED.format(pairs)})
  SELECT '{name}' AS variant, c.cv_month, {_IDS}, part, c.daytype, {FEATURE_SQL.format(p='h', x='')}, {BASELINE.format(p='h')} AS baseline, {n} AS hist_n_lsdhd, {months} AS hist_months
  FROM p c {lookups(key)} LEFT JOIN n ON n.hkey = {key} AND {same})"""


def _variants(spark, sf_dir, names, seed):
    made, out = datasets.Variants(rows(spark, sf_dir), _CV, SETUP, _EIGHT, seed), None
    extra = {"hist_n_lsdhd": "long", "hist_months": "int"}
    for name in names:
        one = made.samples(datasets.variants(SETUP, _OLD_DAYS)[name])
        one = one.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in one.columns})
        one = one.select(F.lit(name).alias("variant"), "cv_month", "journey_id", "seq", "y", "date", "part", "daytype", *history.FEATURES, "baseline", *extra)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_BY_FOLDS, _BY_PAST = ["V0", "V1", "V2", "V3", "V4", "V4u"], ["V5", "V6", "C", "C2", "D"]


@query("ds_08_variants", f"WITH {DAILY} " + " UNION ALL ".join(_variant_sql(v, 3) for v in _BY_FOLDS))
def ds_08_variants(spark, sf_dir):
    """The months March to October of all variants whose history leaves folds out."""
    return _variants(spark, sf_dir, _BY_FOLDS, 3)


@query("ds_08_variants_past", f"WITH {DAILY} " + " UNION ALL ".join(_variant_sql(v, 0) for v in _BY_PAST))
def ds_08_variants_past(spark, sf_dir):
    """The same of all variants whose history is the past by weeks or months."""
    return _variants(spark, sf_dir, _BY_PAST, 0)
