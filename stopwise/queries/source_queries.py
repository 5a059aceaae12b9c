"""SRC, FLT, SCL, SET: sources, filters, projections, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalars as sc
from ..sources.scratch import temp_folder
from ..operators import history
from ..plans import datasets, live as live_plan, model
from ..schema import DEVIATION_RANGE
from ..sources import adapters, io
from .base import DAILY, HOLIDAYS, LIVE, V_DAILY, V_LIVE, bucket_sql, daily, daylight_sql, daytype_sql, live, query, rounded

FEED = """f AS (SELECT concat('J', CAST(user_id AS VARCHAR)) AS journey_id, CAST(ts AS DATE) AS operatingDate, concat('L', CAST(user_id % 5 AS VARCHAR)) AS lineRef, 'Outbound' AS directionRef,
  concat('S', CAST(event_id % 17 AS VARCHAR)) AS stopPointRef, concat('Stop ', CAST(event_id % 17 AS VARCHAR)) AS stopPointName, event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_type, value FROM events)"""


@query("src_01", f"""WITH {FEED} SELECT journey_id, operatingDate, lineRef, directionRef, stopPointRef, stopPointName, seq,
  CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS aimed_arrival_local, CAST(round(value) AS BIGINT) AS arrival_delay_s FROM f WHERE event_type <> 'signup' AND k % 10 NOT IN (0, 1, 2, 3)""")  # fmt: skip
def src_01(spark, sf_dir):
    return io.ingest(adapters.raw_feed(spark, sf_dir))


@query("src_02", f"""WITH {V_DAILY}, m AS (SELECT *, CAST(date_trunc('month', operatingDate) AS DATE) AS month FROM v),
  e AS (SELECT month FROM m GROUP BY month HAVING max(operatingDate) >= last_day(month) - 1 AND last_day(month) < DATE '2001-06-15' AND month <> DATE '1998-03-01')
  SELECT month, count(*) AS n_rows, CAST(sum(arrival_delay_s) AS BIGINT) AS total_s FROM m JOIN e USING (month) GROUP BY month""")  # fmt: skip
def src_02(spark, sf_dir):
    there = spark.sql("SELECT DATE '1998-03-01' AS month")
    new = io.months_to_load(adapters.visits_daily(spark, sf_dir), there, "2001-06-15")
    return new.groupBy("month").agg(F.count("*").alias("n_rows"), F.sum("arrival_delay_s").alias("total_s"))


@query("src_02_load", f"""WITH {V_DAILY}, m AS (SELECT *, make_date(year(operatingDate), month(operatingDate), 1) AS month FROM v), e AS (SELECT month FROM m GROUP BY month HAVING last_day(month) - max(operatingDate) <= 1 AND last_day(month) < DATE '2001-06-15')
  SELECT month, count(*) AS n_rows, CAST(sum(arrival_delay_s) AS BIGINT) AS total_s FROM m JOIN e USING (month) GROUP BY month""")  # fmt: skip
def src_02_load(spark, sf_dir):
    """Two loads, years apart: the second adds the months that the first did not have; none stands twice."""
    path, v = temp_folder(spark) + "/months", adapters.visits_daily(spark, sf_dir)
    io.load_months(v, path, "1998-03-20")
    return io.load_months(v, path, "2001-06-15").groupBy("month").agg(F.count("*").alias("n_rows"), F.sum("arrival_delay_s").alias("total_s"))


@query("src_03", f"""WITH {V_DAILY}, w AS (SELECT CAST(unnest(generate_series(DATE '1994-11-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS DATE) AS month),
  g AS (SELECT CAST(date_trunc('month', operatingDate) AS DATE) AS month, count(*) AS n_rows, max(operatingDate) AS newest FROM v GROUP BY 1)
  SELECT month, coalesce(n_rows, 0) AS n_rows, newest, n_rows IS NULL AS empty, coalesce(newest >= last_day(month) - 1, FALSE) AS complete FROM w LEFT JOIN g USING (month)""")  # fmt: skip
def src_03(spark, sf_dir):
    return io.audit_months(adapters.visits_daily(spark, sf_dir), "1994-11-01", "2001-10-01")


@query("src_04", "SELECT count(*) AS n_rows, count(o_orderkey) AS n_orders, count(l_orderkey) AS n_lines, CAST(sum(o_custkey) AS BIGINT) AS custs FROM (SELECT o_orderkey, o_custkey, NULL AS l_orderkey FROM orders UNION ALL SELECT NULL, NULL, l_orderkey FROM lineitem) x")
def src_04(spark, sf_dir):
    both = io.read_raw(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"])
    return both.agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_orders"), F.count("l_orderkey").alias("n_lines"), F.sum("o_custkey").alias("custs"))


@query("src_05", f"""WITH w AS ({adapters.duck(adapters.WEATHER)}) SELECT time, round(temperature_2m, 9) AS temperature_2m, precipitation, snowfall, snow_depth, round(wind_speed_10m, 9) AS wind_speed_10m,
  sum(precipitation) OVER (ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS precip_3h, 'measured' AS source FROM w""")  # fmt: skip
def src_05(spark, sf_dir):
    return rounded(io.prepare_weather(adapters.weather(spark, sf_dir)), 9)


@query("src_05_missing", f"""WITH w AS ({adapters.duck(adapters.WEATHER)}), g AS (SELECT temperature_2m, precipitation, CASE WHEN hour(time) % 3 = 0 THEN snowfall END AS snowfall, CASE WHEN hour(time) % 3 > 0 THEN snow_depth END AS snow_depth, wind_speed_10m FROM w)
  """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(1 - count({c}) / count(*), 6) AS missing, count({c}) < count(*) / 2.0 AS mostly_missing FROM g" for c in io.WEATHER))  # fmt: skip
def src_05_missing(spark, sf_dir):
    """Which weather columns lack more than half of their hours."""
    w = io.prepare_weather(adapters.weather(spark, sf_dir))
    third = F.hour("time") % 3 == 0
    return rounded(io.missing_share(w.withColumns({"snowfall": F.when(third, F.col("snowfall")), "snow_depth": F.when(~third, F.col("snow_depth"))})))


@query("src_06", f"WITH {DAILY} SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS total_s, min(date) AS first_day, max(date) AS last_day FROM c")
def src_06(spark, sf_dir):
    path = temp_folder(spark) + "/split"
    io.write_split(daily(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.sum("y").alias("total_s"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("src_07", f"WITH {DAILY} SELECT journey_id, seq, CAST(minute_of_day AS SMALLINT) AS minute_of_day, CAST(round_even(y / 7.0, 0) AS SMALLINT) AS pred FROM c")
def src_07(spark, sf_dir):
    path = temp_folder(spark) + "/predictions"
    p = daily(spark, sf_dir).select("journey_id", "seq", "minute_of_day", (F.col("y") / 7.0).alias("pred"))
    io.export_predictions(p, path, shorts=["minute_of_day"], rounded=["pred"])
    return spark.read.parquet(path)


@query("src_08", "SELECT o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_discount, o_totalprice FROM orders")
def src_08(spark, sf_dir):
    return io.read_optional(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"], {"o_discount": "double", "o_totalprice": "double"})


@query("src_09", f"WITH {V_DAILY} SELECT DISTINCT CAST(year(operatingDate) AS INTEGER) AS year FROM v WHERE year(operatingDate) NOT IN (1996, 1997)")
def src_09(spark, sf_dir):
    return cal.missing_years(adapters.visits_daily(spark, sf_dir), "operatingDate", [("1996-01-01", "1996-01-03"), ("1997-06-01", "1997-08-01")])


@query("src_10", f"WITH {DAILY} SELECT line, count(*) AS n_rows FROM c GROUP BY line")
def src_10(spark, sf_dir):
    path = temp_folder(spark) + "/report"
    io.write_report(daily(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n_rows")), path)
    return spark.read.option("header", True).schema("line string, n_rows bigint").csv(path)


@query("flt_01", f"WITH {DAILY} SELECT line, count(*) AS n_rows, CAST(min(y) AS INTEGER) AS lowest, CAST(max(y) AS INTEGER) AS highest FROM c GROUP BY line")
def flt_01(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n_rows"), F.min("y").alias("lowest"), F.max("y").alias("highest"))


@query("flt_02", f"WITH {V_DAILY} SELECT DISTINCT journey_id, {bucket_sql('journey_id')} AS bucket FROM v WHERE {bucket_sql('journey_id')} < 20")
def flt_02(spark, sf_dir):
    v = adapters.visits_daily(spark, sf_dir).select("journey_id").distinct()
    return v.withColumn("bucket", sc.hash_bucket("journey_id")).filter("bucket < 20")


@query("flt_03", f"""WITH {DAILY} SELECT CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'valid'
  WHEN date BETWEEN DATE '2001-01-01' AND DATE '2001-08-01' THEN 'test' END AS split, count(*) AS n_rows, CAST(count(DISTINCT month) AS INTEGER) AS months FROM c GROUP BY 1""")  # fmt: skip
def flt_03(spark, sf_dir):
    rows, s = daily(spark, sf_dir), adapters.DAILY
    name = None
    for part in ("train", "valid", "test"):
        p = s.period(part)
        cond = F.col("date").between(F.lit(p.start).cast("date"), F.lit(p.end).cast("date"))
        name = F.when(cond, part) if name is None else name.when(cond, part)
    return rows.groupBy(name.alias("split")).agg(F.count("*").alias("n_rows"), F.countDistinct("month").cast("int").alias("months"))


@query("flt_04", f"WITH {V_LIVE} SELECT DISTINCT journey_id, CAST(5 + {bucket_sql(chr(39) + chr(39) + ' || journey_id || ' + chr(39) + '#lead' + chr(39), 86)} AS INTEGER) AS lead_min FROM v")
def flt_04(spark, sf_dir):
    return adapters.visits_live(spark, sf_dir).select("journey_id").distinct().withColumn("lead_min", sc.random_lead("journey_id"))


@query("flt_05", f"WITH {LIVE} SELECT journey_id, seq, CAST(unnest([10, 30, 60]) AS INTEGER) AS lead_min FROM c")
def flt_05(spark, sf_dir):
    return live(spark, sf_dir).select("journey_id", "seq", F.explode(F.array(*[F.lit(x) for x in adapters.LIVE.test_leads])).alias("lead_min"))


@query("flt_06", f"""WITH {LIVE}, b AS (SELECT line, median(y) AS m FROM c WHERE line <> 'L2' GROUP BY line), d AS (SELECT journey_id, seq, CASE WHEN m IS NOT NULL THEN greatest(-600, least(900, y - m)) END AS anom FROM c LEFT JOIN b USING (line)),
  g AS (SELECT *, anom - lag(anom) OVER (PARTITION BY journey_id ORDER BY seq) AS x FROM d) SELECT journey_id, seq, CAST(anom AS DOUBLE) AS anom, CAST(CASE WHEN x IS NOT NULL THEN greatest(-300, least(600, x)) END AS DOUBLE) AS growth FROM g""")  # fmt: skip
def flt_06(spark, sf_dir):
    from pyspark.sql import Window

    rows = live(spark, sf_dir)
    base = rows.filter("line <> 'L2'").groupBy("line").agg(F.median("y").alias("m"))
    d = rows.join(base, "line", "left").withColumn("anom", sc.clipped(F.col("y") - F.col("m"), *DEVIATION_RANGE))
    w = Window.partitionBy("journey_id").orderBy("seq")
    return d.select("journey_id", "seq", F.col("anom").cast("double").alias("anom"), sc.clipped(F.col("anom") - F.lag("anom").over(w), -300, 600).cast("double").alias("growth"))


@query("flt_07", f"WITH {LIVE} SELECT journey_id, seq, line, y * 2 AS y, hour AS hist_hour FROM c")
def flt_07(spark, sf_dir):
    rows = live(spark, sf_dir).select("journey_id", "seq", "line", "y", "hour")
    return rows.withColumns({"y": F.col("y") * 2, "hist_hour": F.col("hour")}).drop("hour")


#: A dataset with columns of every kind, made from columns at hand: name -> expression.
_COLUMNS = {
    "y": "y", "date": "date", "line": "line", "baseline": "hour", "baseline_recent": "daytype", "journey_id": "journey_id", "refit_hist_mean_sh": "hour * 2", "hist_mean_sh": "minute_of_day", "rt_ld_n20": "seq * 3",
    "rt_prev_anom": "y * 2", "rt_in_delay": "y + 1", "lead_min": "bucket", "horizon_min": "bucket + seq", "stop_name": "stop",
}


def _selected_sql(*names: str) -> str:
    return f"WITH {LIVE} SELECT " + ", ".join(f"{_COLUMNS[n]} AS {n}" for n in names) + " FROM c"


def _selected(spark, sf_dir, names):
    rows = live(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])
    return rows.select(*names(datasets.feature_columns(rows.columns)))


@query("flt_08", _selected_sql("line", "hist_mean_sh", "rt_ld_n20", "lead_min", "horizon_min"))
def flt_08(spark, sf_dir):
    """The features of the first round."""
    return _selected(spark, sf_dir, datasets.round_one)


@query("flt_08_all", _selected_sql("line", "hist_mean_sh", "rt_ld_n20", "rt_prev_anom", "rt_in_delay", "lead_min", "horizon_min"))
def flt_08_all(spark, sf_dir):
    return _selected(spark, sf_dir, list)


@query("flt_08_static", _selected_sql("line", "hist_mean_sh"))
def flt_08_static(spark, sf_dir):
    """The features without real time."""
    return _selected(spark, sf_dir, datasets.without_realtime)


@query("flt_09", f"WITH {LIVE} SELECT journey_id, seq, hour + 1 AS hist_hour FROM c")
def flt_09(spark, sf_dir):
    rows = live(spark, sf_dir).select("journey_id", "seq", F.col("hour").alias("hist_hour"), (F.col("hour") + 1).alias("refit_hist_hour"))
    return datasets.with_refit(rows)


@query("flt_10", f"WITH {LIVE} SELECT date, count(*) AS n_rows FROM c WHERE date BETWEEN DATE '2024-01-09' AND DATE '2024-01-12' GROUP BY date")
def flt_10(spark, sf_dir):
    return live_plan.live_window(live(spark, sf_dir), "2024-01-10", "2024-01-12").groupBy("date").agg(F.count("*").alias("n_rows"))


_OTHER = ["1996-02-05", "1997-07-04", "1998-12-24"]


@query("flt_11", f"""WITH {DAILY} SELECT date, CAST(max(CASE WHEN date IN (DATE '1996-02-05', DATE '1997-07-04', DATE '1998-12-24') THEN 1 ELSE 0 END) AS INTEGER) AS is_holiday,
  max(CASE WHEN isodow(date) = 7 OR date IN (DATE '1996-02-05', DATE '1997-07-04', DATE '1998-12-24') THEN 2 WHEN isodow(date) = 6 THEN 1 ELSE 0 END) AS daytype FROM c GROUP BY date""")  # fmt: skip
def flt_11(spark, sf_dir):
    rows = datasets.other_calendar(daily(spark, sf_dir), _OTHER)
    return rows.groupBy("date").agg(F.max("is_holiday").alias("is_holiday"), F.max("daytype").alias("daytype"))


@query("flt_12", f"""WITH {DAILY} SELECT month, count(*) AS n_rows FROM c WHERE (bucket < 20 AND date <= DATE '1999-12-31') OR (bucket < 25 AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') GROUP BY month""")
def flt_12(spark, sf_dir):
    rows = datasets.source_rows(daily(spark, sf_dir), adapters.DAILY, False, "2000-12-31")
    return rows.groupBy("month").agg(F.count("*").alias("n_rows"))


DAYS = "d AS (SELECT DISTINCT operatingDate AS d FROM v)"


def _days(spark, sf_dir):
    return adapters.visits_daily(spark, sf_dir).select(F.col("operatingDate").alias("d")).distinct()


@query("scl_01", f"WITH {V_DAILY}, {DAYS} SELECT d, d IN ({HOLIDAYS}) AS is_holiday FROM d")
def scl_01(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("is_holiday", cal.is_holiday("d"))


@query("scl_02", f"WITH {V_DAILY}, {DAYS} SELECT d, {daytype_sql('d')} AS daytype FROM d")
def scl_02(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("daytype", cal.daytype("d"))


@query("scl_03", f"WITH {V_DAILY}, {DAYS} SELECT d, d BETWEEN DATE '1996-06-20' AND DATE '1996-08-18' OR d BETWEEN DATE '1997-12-20' AND DATE '1998-01-02' AS is_school_break FROM d")
def scl_03(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("is_school_break", cal.is_school_break("d", [("1996-06-20", "1996-08-18"), ("1997-12-20", "1998-01-02")]))


@query("scl_04", f"WITH {V_DAILY}, {DAYS} SELECT d, round({daylight_sql('d')}, 6) AS daylight_h FROM d")
def scl_04(spark, sf_dir):
    return rounded(_days(spark, sf_dir).withColumn("daylight_h", cal.daylight_hours("d")))


@query("scl_05", f"WITH {V_DAILY}, {DAYS} SELECT d, CAST(dayofyear(d) % 5 AS INTEGER) AS day_fold, CAST((date_diff('day', DATE '1994-11-28', d) // 7) % 5 AS INTEGER) AS week_fold FROM d")
def scl_05(spark, sf_dir):
    return _days(spark, sf_dir).withColumns({"day_fold": sc.fold("d", "day", "1994-12-01"), "week_fold": sc.fold("d", "week", "1994-12-01")})


@query("scl_06", f"""WITH {V_LIVE} SELECT journey_id, seq, CAST(hour(aimed_arrival_local) AS INTEGER) AS hour, CAST(hour(aimed_arrival_local) * 60 + minute(aimed_arrival_local) AS INTEGER) AS minute_of_day,
  CAST(isodow(operatingDate) AS INTEGER) AS weekday, CAST(date_trunc('month', operatingDate) AS DATE) AS month FROM v""")  # fmt: skip
def scl_06(spark, sf_dir):
    t, d = F.col("aimed_arrival_local"), F.col("operatingDate")
    return adapters.visits_live(spark, sf_dir).select("journey_id", "seq", F.hour(t).alias("hour"), sc.minute_of_day(t).alias("minute_of_day"), (F.weekday(d) + 1).alias("weekday"), sc.month_start(d).alias("month"))


_START = "s AS (SELECT *, min(aimed_arrival_local) OVER (PARTITION BY journey_id) AS t0, max(seq) OVER (PARTITION BY journey_id) AS n FROM v)"


def _started(spark, sf_dir):
    from pyspark.sql import Window

    j = Window.partitionBy("journey_id")
    return adapters.visits_live(spark, sf_dir).withColumns({"t0": F.min("aimed_arrival_local").over(j), "n": F.max("seq").over(j)})


@query("scl_07", f"""WITH {V_LIVE}, {_START} SELECT journey_id, seq, round(date_diff('second', t0, aimed_arrival_local) / 60.0, 6) AS from_start, round(seq / CAST(n AS DOUBLE), 6) AS route_frac,
  round(30 + date_diff('second', t0, aimed_arrival_local) / 60.0, 6) AS horizon_min FROM s""")  # fmt: skip
def scl_07(spark, sf_dir):
    m = (sc.seconds_between("t0", "aimed_arrival_local") / 60.0).cast("double")
    s = _started(spark, sf_dir).select("journey_id", "seq", m.alias("from_start"), sc.ratio(F.col("seq"), F.col("n").cast("double")).alias("route_frac"), (m + 30).alias("horizon_min"))
    return rounded(s)


@query("scl_08", f"WITH {V_LIVE}, {_START} SELECT journey_id, seq, aimed_arrival_local + to_seconds(arrival_delay_s) AS obs_ts, t0 - INTERVAL 32 MINUTE AS cutoff FROM s")
def scl_08(spark, sf_dir):
    s = _started(spark, sf_dir)
    return s.select("journey_id", "seq", sc.plus_seconds("aimed_arrival_local", F.col("arrival_delay_s")).alias("obs_ts"), sc.plus_minutes("t0", F.lit(-32)).alias("cutoff"))


@query("scl_09", f"WITH {V_LIVE}, {_START} SELECT DISTINCT journey_id, strftime(t0, '%H:%M') AS start_hm FROM s")
def scl_09(spark, sf_dir):
    return _started(spark, sf_dir).select("journey_id", sc.start_key("t0").alias("start_hm")).distinct()


@query("scl_10", f"WITH {LIVE} SELECT line, CAST(sum(y) AS DOUBLE) / nullif(count(CASE WHEN y < -100 THEN 1 END), 0) AS per_early, coalesce(CAST(max(CASE WHEN y > 5000 THEN y END) AS INTEGER), 0) AS none FROM c GROUP BY line")
def scl_10(spark, sf_dir):
    early = F.count(F.when(F.col("y") < -100, 1))
    return live(spark, sf_dir).groupBy("line").agg(sc.ratio(F.sum("y").cast("double"), early).alias("per_early"), F.coalesce(F.max(F.when(F.col("y") > 5000, F.col("y"))), F.lit(0)).alias("none"))


@query("scl_11", f"""WITH {LIVE}, m AS (SELECT journey_id, seq, CAST((minute_of_day - 1380 + 1440) % 1440 AS INTEGER) AS since FROM c)
  SELECT journey_id, seq, since, CASE WHEN since > -1 AND since <= 5 THEN '0-5' WHEN since > 5 AND since <= 60 THEN '5-60' WHEN since > 60 THEN '60+' END AS bin FROM m""")  # fmt: skip
def scl_11(spark, sf_dir):
    m = live(spark, sf_dir).select("journey_id", "seq", sc.minutes_since_start("minute_of_day", F.lit(1380)).alias("since"))
    return m.withColumn("bin", sc.binned("since", [-1, 5, 60, float("inf")], ["0-5", "5-60", "60+"]))


@query("scl_12", f"""WITH {LIVE} SELECT journey_id, seq, regexp_extract(stop, '[^_]*$') AS number, CASE WHEN y < 0 THEN '-' ELSE '' END || CASE WHEN abs(y) < 60 THEN abs(y) || ' s' ELSE abs(y) // 60 || ' min ' || lpad(CAST(abs(y) % 60 AS VARCHAR), 2, '0') || ' s' END AS delay,
  lpad(CAST(minute_of_day // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute_of_day % 60 AS VARCHAR), 2, '0') AS clock, replace(printf('%.1f', y / 10.0), '.', ',') AS tenths FROM c""")  # fmt: skip
def scl_12(spark, sf_dir):
    return live(spark, sf_dir).select("journey_id", "seq", sc.line_number("stop").alias("number"), sc.delay_text("y").alias("delay"), sc.clock_text("minute_of_day").alias("clock"), sc.number_text(F.col("y") / 10.0).alias("tenths"))


@query("set_01", f"WITH {DAILY} SELECT k AS hkey, line, count(*) AS n_rows FROM c, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k) WHERE k = 5 OR dayofyear(date) % 5 <> k GROUP BY ALL")
def set_01(spark, sf_dir):
    h = history.histogram(daily(spark, sf_dir), sc.day_fold("date"), ["line"])
    return h.withColumn("hkey", F.explode(history.fold_keys())).groupBy("hkey", "line").agg(F.sum("n").alias("n_rows"))


@query("set_02", f"WITH {DAILY} SELECT year(month) AS year, count(*) AS n_rows FROM c WHERE date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' GROUP BY 1")
def set_02(spark, sf_dir):
    rows = daily(spark, sf_dir)
    part = lambda a, b: rows.filter(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    both = part("1995-01-01", "1999-12-31").unionByName(part("2000-01-01", "2000-12-31"))
    return both.groupBy(F.year("month").cast("long").alias("year")).agg(F.count("*").alias("n_rows"))


@query("set_03", f"WITH {DAILY}, l AS (SELECT DISTINCT stop AS value, 'stop' AS column_name FROM c UNION SELECT DISTINCT line, 'line' FROM c UNION SELECT DISTINCT direction, 'direction' FROM c) SELECT column_name, value FROM l")
def set_03(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return model.vocabulary(rows.filter("hour < 12"), rows.filter("hour >= 12"))


@query("set_04", f"WITH {DAILY} SELECT month FROM c WHERE hour < 12 GROUP BY month HAVING count(*) > 100 INTERSECT SELECT month FROM c WHERE hour >= 12 GROUP BY month HAVING count(*) > 100")
def set_04(spark, sf_dir):
    rows = daily(spark, sf_dir)
    some = lambda cond: rows.filter(cond).groupBy("month").count().filter("count > 100").select("month")
    return some("hour < 12").intersect(some("hour >= 12"))
