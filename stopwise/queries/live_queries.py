"""JN-07..14, AGG-11, WIN-05, 07..10, DS-05, ST-01, 02: real-time features."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, trips
from ..plans import datasets, live
from ..sources import adapters, io
from ..sources.scratch import stored, temp_folder
from ..streaming import feed, latest
from .base import bucket_sql, query, rounded
from .history_queries import BASELINE, FEATURE_SQL, FOLD_ROWS, PAST_ROWS, lookups, tables_sql
from .trip_queries import CLEAN, visits

SETUP = adapters.LIVE


class _World:
    """The frames that the real-time jobs share. The live tables span one month, so their past is kept by weeks."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.visits = visits(spark, sf_dir)

    @cached_property
    def plan(self):
        return stored(trips.trip_plan(self.visits))

    @cached_property
    def rows(self):
        return stored(datasets.clean(self.visits, self.plan, io.prepare_weather(adapters.weather(self.spark, self.sf_dir))))

    @cached_property
    def times(self):
        return stored(live.trip_times(self.visits, self.plan))

    @cached_property
    def histories(self):
        return datasets.Histories(self.rows, SETUP)

    @cached_property
    def obs(self):
        return stored(live.observations(self.rows, self.times, self.histories))


_WEEKS = "m AS (SELECT DATE '2024-01-01' + CAST(7 * i AS INTEGER) AS hkey FROM range(5) AS n(i))"
_PAST = PAST_ROWS.replace("JOIN c ON", "JOIN clean c ON")
_WEEK = "c.date - CAST(isodow(c.date) - 1 AS INTEGER)"

#: tt: planned times of each journey; obs: each credible visit at its actual time, beside the visit before it.
OBS = f"""{CLEAN}, {_WEEKS}, {tables_sql(_PAST, 'b')},
 tt AS (SELECT k.journey_id, span.line, span.starts AS trip_start_ts, k.origin AS origin_name, plan.dest_name, plan.n_stops,
     span.starts + to_seconds(CAST(round(plan.dur_min * 60) AS BIGINT)) AS trip_end_ts FROM k JOIN span USING (journey_id) LEFT JOIN plan USING (journey_id)),
 seen AS (SELECT c.journey_id, c.seq, c.line, c.direction, c.stop, c.y, v.aimed_arrival_local + to_seconds(c.y) AS obs_ts, c.y - {BASELINE.format(p='b')} AS off,
     count(*) OVER (PARTITION BY c.journey_id ORDER BY c.seq) AS place FROM clean c JOIN v ON v.journey_id = c.journey_id AND v.seq = c.seq {lookups(_WEEK, 'b')}),
 dev AS (SELECT * EXCLUDE (off), CASE WHEN off > 900 THEN 900 WHEN off < -600 THEN -600 ELSE off END AS anom FROM seen),
 obs AS (SELECT now.*, former.stop AS prev_stop, CASE WHEN now.anom - former.anom > 600 THEN 600 WHEN now.anom - former.anom < -300 THEN -300 ELSE now.anom - former.anom END AS growth
   FROM dev now LEFT JOIN dev former ON former.journey_id = now.journey_id AND former.place = now.place - 1)"""


def closed_at(minutes: int) -> str:
    """The end of the bucket that an observation falls in: it is not seen before."""
    return f"epoch_ms((CAST(epoch(obs_ts) AS BIGINT) // {60 * minutes} + 1) * {60_000 * minutes})"


def bucket_sql_of(name: str) -> str:
    keys, minutes, value = live.SERIES[name]
    ks = "".join(k + ", " for k in keys)
    where = "WHERE prev_stop IS NOT NULL" if name == "seg" else ""
    return f"SELECT {ks}{closed_at(minutes)} AS t, count(*) AS n, count({value}) AS na, sum({value}) AS sa FROM obs {where} GROUP BY ALL"


def query_rows_sql(split: str) -> str:
    """q: rows of a split, their leads and times; tr: one row per trip and lead."""
    p, pct = SETUP.period(split), dict(SETUP.sample_pct)[split]
    drawn = bucket_sql("c.journey_id || '#lead'", 86)
    leads = "CAST(unnest([10, 30, 60]) AS INTEGER)" if split == "test" else f"CAST(5 + {drawn} AS INTEGER)"
    return f"""chosen AS (SELECT c.*, {leads} AS lead_min FROM clean c WHERE bucket < {pct} AND date >= DATE '{p.start}' AND date <= DATE '{p.end}'),
 q AS (SELECT h.journey_id, h.lead_min, h.seq, h.line, h.direction, h.stop, tt.trip_start_ts, tt.origin_name AS origin_stopname, tt.trip_start_ts - INTERVAL 1 MINUTE * (h.lead_min + 2) AS T,
     (SELECT max_by(g.stop, g.seq) FROM chosen g WHERE g.journey_id = h.journey_id AND g.lead_min = h.lead_min AND g.seq < h.seq) AS prev_stop FROM chosen h JOIN tt ON tt.journey_id = h.journey_id),
 tr AS (SELECT DISTINCT journey_id, lead_min, line, direction, T, trip_start_ts, origin_stopname FROM q)"""


QUERY_ROWS = query_rows_sql("test")


def windows_sql(source: str, rows: str, name: str, windows, prefix: str) -> str:
    """Straight from the observations whose buckets closed in (T - w, T]."""
    keys, minutes, value = live.SERIES[name]
    on = " AND ".join([f"o.{k} = x.{k}" for k in keys] + [f"o.t <= x.T AND o.t > x.T - INTERVAL {max(windows)} MINUTE"])
    inside = lambda w: f"FILTER (WHERE o.t > x.T - INTERVAL {w} MINUTE)"
    cols = [f"CAST(count(o.t) {inside(w)} AS INTEGER) AS rt_{prefix}_n{w}, round(avg(o.{value}) {inside(w)}, 6) AS rt_{prefix}_anom{w}" for w in windows]
    seen = f"(SELECT *, {closed_at(minutes)} AS t FROM obs{' WHERE prev_stop IS NOT NULL' if name == 'seg' else ''})"
    x = ", ".join("x." + c.strip() for c in rows.split(","))
    return f"SELECT {x}, {', '.join(cols)} FROM {source} x LEFT JOIN {seen} o ON {on} GROUP BY {x}"


def _q(w: _World):
    return live.query_rows(w.rows, w.times, SETUP, "test")


def _windows(rows, obs, name, ids, windows):
    keys = live.SERIES[name][0]
    got = asof.windowed_sums(rows.select(*dict.fromkeys([*ids, *keys, "T"])), live.series(obs, name), keys, windows, name)
    return rounded(got.select(*ids, *[c for c in got.columns if c.startswith("rt_")]))


def _tr(q):
    return q.select(*live.TRIP, "line", "direction", "T", "trip_start_ts", "origin_stopname").distinct()


@query("jn_07", f"WITH {OBS} SELECT journey_id, seq, obs_ts, CAST(anom AS DOUBLE) AS anom, CAST(growth AS DOUBLE) AS growth, prev_stop FROM obs")
def jn_07(spark, sf_dir):
    o = _World(spark, sf_dir).obs
    return o.select("journey_id", "seq", "obs_ts", F.col("anom").cast("double").alias("anom"), F.col("growth").cast("double").alias("growth"), "prev_stop")


def _buckets(name):
    keys, minutes, value = live.SERIES[name]

    @query(f"agg_11_{name}", f"WITH {OBS} SELECT {''.join(k + ', ' for k in keys)}t, n, na, CAST(sa AS DOUBLE) AS sa FROM ({bucket_sql_of(name)})")
    def run(spark, sf_dir):
        obs = _World(spark, sf_dir).obs
        rows = obs.filter("prev_stop is not null") if name == "seg" else obs
        return asof.bucket_sums(rows, keys, minutes, value).withColumn("sa", F.col("sa").cast("double"))


for _name in live.SERIES:
    _buckets(_name)


@query("win_05", f"WITH {OBS} SELECT line, direction, obs_ts, max(journey_id) AS journey_id, max_by(seq, (journey_id, seq)) AS seq FROM obs WHERE anom IS NOT NULL GROUP BY line, direction, obs_ts")
def win_05(spark, sf_dir):
    return live.last_by_line(_World(spark, sf_dir).obs).select("line", "direction", "obs_ts", "journey_id", "seq")


@query("win_07", f"WITH {OBS}, {QUERY_ROWS} SELECT journey_id, lead_min, seq, T, prev_stop FROM q")
def win_07(spark, sf_dir):
    return _q(_World(spark, sf_dir)).select("journey_id", "lead_min", "seq", "T", "prev_stop")


@query("win_08", f"""WITH {OBS}, bk AS ({bucket_sql_of('stop')}) SELECT a.stop, a.t, CAST(sum(b.n) AS BIGINT) AS cn, CAST(sum(b.na) AS BIGINT) AS cna, CAST(sum(b.sa) AS DOUBLE) AS csa
  FROM bk a JOIN bk b ON b.stop = a.stop AND b.t <= a.t GROUP BY a.stop, a.t""")  # fmt: skip
def win_08(spark, sf_dir):
    return live.series(_World(spark, sf_dir).obs, "stop").withColumn("csa", F.col("csa").cast("double"))


@query("jn_08", f"WITH {OBS}, {QUERY_ROWS} {windows_sql('tr', 'journey_id, lead_min', 'ld', [20, 60, 180], 'ld')}")
def jn_08(spark, sf_dir):
    w = _World(spark, sf_dir)
    return _windows(_tr(_q(w)), w.obs, "ld", live.TRIP, [20, 60, 180])


@query("jn_08_net", f"WITH {OBS}, {QUERY_ROWS} {windows_sql('tr', 'journey_id, lead_min', 'net', [15, 60], 'net')}")
def jn_08_net(spark, sf_dir):
    w = _World(spark, sf_dir)
    return _windows(_tr(_q(w)), w.obs, "net", live.TRIP, [15, 60])


@query("jn_08_stop", f"WITH {OBS}, {QUERY_ROWS} {windows_sql('q', 'journey_id, lead_min, seq', 'stop', [60], 'stop')}")
def jn_08_stop(spark, sf_dir):
    w = _World(spark, sf_dir)
    return _windows(_q(w), w.obs, "stop", [*live.TRIP, "seq"], [60])


@query("jn_08_seg", f"WITH {OBS}, {QUERY_ROWS} {windows_sql('q', 'journey_id, lead_min, seq', 'seg', [30, 90], 'seg')}")
def jn_08_seg(spark, sf_dir):
    w = _World(spark, sf_dir)
    return _windows(_q(w), w.obs, "seg", [*live.TRIP, "seq"], [30, 90])


_AGE = "round((epoch(x.T) - epoch({o})) / 60.0, 6)"
_LAST_LD = f"""SELECT x.journey_id, x.lead_min, CAST(max_by(o.anom, (o.obs_ts, o.journey_id, o.seq)) AS DOUBLE) AS {{anom}}, {_AGE.format(o='max(o.obs_ts)')} AS {{age}}
  FROM tr x LEFT JOIN obs o ON o.anom IS NOT NULL AND o.line = x.line AND o.direction = x.direction AND o.obs_ts <= x.T GROUP BY x.journey_id, x.lead_min, x.T"""
_LAST_STOP = f"""SELECT x.journey_id, x.lead_min, x.seq, CAST(max_by(o.anom, (o.obs_ts, o.journey_id, o.seq)) AS DOUBLE) AS rt_prev_anom, {_AGE.format(o='max(o.obs_ts)')} AS rt_prev_age_min
  FROM q x LEFT JOIN obs o ON o.anom IS NOT NULL AND o.line = x.line AND o.direction = x.direction AND o.stop = x.stop AND o.obs_ts <= x.T GROUP BY x.journey_id, x.lead_min, x.seq, x.T"""
_GAP = "CAST(epoch({b}) AS BIGINT) // 60 - CAST(epoch({a}) AS BIGINT) // 60"


def ended_sql(name: str, same_line: bool) -> str:
    """Of the planned trips that end at a trip's origin before it starts, the last one; ties to the highest id."""
    line = "e.line = x.line AND " if same_line else ""
    best = lambda c: f"max_by(e.{c}, (e.trip_end_ts, e.journey_id))"
    return f"""{name} AS (SELECT x.journey_id, x.lead_min, x.line, x.T, x.trip_start_ts, {best('journey_id')} AS j, max(e.trip_end_ts) AS e, {best('n_stops')} AS stops, {best('line')} AS l
   FROM tr x LEFT JOIN tt e ON {line}e.dest_name = x.origin_stopname AND e.trip_end_ts < x.trip_start_ts GROUP BY ALL)"""


#: inc: the incoming vehicle, where its gap is not too long.
IN_SAME = f"""{ended_sql('i1', True)}, inc AS (SELECT journey_id, lead_min, T, trip_start_ts, CASE WHEN {_GAP.format(a='e', b='trip_start_ts')} <= 90 THEN j END AS in_journey_id,
   CASE WHEN {_GAP.format(a='e', b='trip_start_ts')} <= 90 THEN e END AS in_trip_end_ts, stops AS in_n_stops FROM i1)"""


@query("jn_09", f"WITH {OBS}, {QUERY_ROWS} {_LAST_LD.format(anom='last_anom', age='age_min')}")
def jn_09(spark, sf_dir):
    w = _World(spark, sf_dir)
    f = live.line_features(_tr(_q(w)), w.obs)
    return rounded(f.select(*live.TRIP, F.col("rt_ld_last_anom").cast("double").alias("last_anom"), F.col("rt_ld_last_age_min").cast("double").alias("age_min")))


@query("jn_10", f"WITH {OBS}, {QUERY_ROWS}, {IN_SAME} SELECT journey_id, lead_min, in_journey_id, in_trip_end_ts FROM inc")
def jn_10(spark, sf_dir):
    w = _World(spark, sf_dir)
    return live.incoming(_tr(_q(w)), w.times, SETUP.incoming_max_gap).select(*live.TRIP, "in_journey_id", "in_trip_end_ts")


@query("jn_11", f"""WITH {OBS}, {QUERY_ROWS}, {ended_sql('i1', True)}, {ended_sql('i2', False)}, near AS (SELECT journey_id, lead_min, j, 1 AS same_line FROM i1 WHERE {_GAP.format(a='e', b='trip_start_ts')} <= 90),
  other AS (SELECT journey_id, lead_min, j, CAST(l = line AS INTEGER) AS same_line FROM i2 WHERE {_GAP.format(a='e', b='trip_start_ts')} <= 90),
  found AS (FROM near UNION ALL SELECT * FROM other WHERE (journey_id, lead_min) NOT IN (SELECT (journey_id, lead_min) FROM near))
  SELECT tr.journey_id, tr.lead_min, found.j AS in_journey_id, found.same_line AS rt_in_same_line FROM tr LEFT JOIN found ON found.journey_id = tr.journey_id AND found.lead_min = tr.lead_min""")  # fmt: skip
def jn_11(spark, sf_dir):
    w = _World(spark, sf_dir)
    return live.incoming(_tr(_q(w)), w.times, SETUP.incoming_max_gap, any_line=True).select(*live.TRIP, "in_journey_id", "rt_in_same_line")


_LEFT = "(epoch(trip_start_ts) - epoch(in_trip_end_ts)) / 60.0"
_IN = f"""SELECT x.journey_id, x.lead_min, round({_LEFT}, 6) AS rt_in_gap_min, CAST(delay AS DOUBLE) AS rt_in_delay, {_AGE.format(o='told_at')} AS rt_in_age_min, round(stop_no / CAST(in_n_stops AS DOUBLE), 6) AS rt_in_progress,
  round({_LEFT} - delay / 60.0, 6) AS rt_in_slack_min FROM inc x LEFT JOIN (SELECT i.journey_id, i.lead_min, max_by(o.y, (o.obs_ts, o.seq)) AS delay, max(o.obs_ts) AS told_at, max_by(o.seq, (o.obs_ts, o.seq)) AS stop_no
    FROM inc i JOIN obs o ON o.journey_id = i.in_journey_id AND o.obs_ts <= i.T GROUP BY ALL) s ON s.journey_id = x.journey_id AND s.lead_min = x.lead_min"""


@query("jn_12", f"WITH {OBS}, {QUERY_ROWS}, {IN_SAME} {_IN}")
def jn_12(spark, sf_dir):
    w = _World(spark, sf_dir)
    f = live.incoming_delay(live.incoming(_tr(_q(w)), w.times, SETUP.incoming_max_gap), w.obs)
    return rounded(f.select(*live.TRIP, *[F.col(c).cast("double").alias(c) for c in f.columns if c.startswith("rt_in_")]))


@query("jn_13", f"WITH {OBS}, {QUERY_ROWS} {_LAST_STOP}")
def jn_13(spark, sf_dir):
    w = _World(spark, sf_dir)
    f = asof.asof_join(_q(w).select(*live.TRIP, "seq", "line", "direction", "stop", "T"), live.last_by_stop(w.obs), ["line", "direction", "stop"], "T", "obs_ts", ["anom", "obs_ts"], "p_")
    return rounded(f.select(*live.TRIP, "seq", F.col("p_anom").cast("double").alias("rt_prev_anom"), live.minutes("p_obs_ts", "T").cast("double").alias("rt_prev_age_min")))


_SEG = f"sg AS ({windows_sql('q', 'journey_id, lead_min, seq', 'seg', [30, 90], 'seg')})"


def along_sql(w: int, digits: int) -> str:
    return f"""SELECT a.journey_id, a.lead_min, a.seq, round(sum(coalesce(b.rt_seg_anom{w}, 0)), {digits}) AS rt_segcum{w}, round(count(CASE WHEN b.rt_seg_n{w} > 0 THEN 1 END) / count(*), 6) AS rt_segcov{w}
  FROM sg a JOIN sg b ON b.journey_id = a.journey_id AND b.lead_min = a.lead_min AND b.seq <= a.seq GROUP BY a.journey_id, a.lead_min, a.seq"""


@query("win_09", f"WITH {OBS}, {QUERY_ROWS}, {_SEG} {along_sql(30, 4)}")
def win_09(spark, sf_dir):
    w = _World(spark, sf_dir)
    a = live.along_trip(_windows(_q(w), w.obs, "seg", [*live.TRIP, "seq"], [30, 90]))
    return a.select(*live.TRIP, "seq", (F.round("rt_segcum30", 4) + 0.0).alias("rt_segcum30"), F.round("rt_segcov30", 6).alias("rt_segcov30"))


@query("jn_14", f"""WITH {OBS}, {QUERY_ROWS}, n AS ({windows_sql('tr', 'journey_id, lead_min', 'net', [15, 60], 'net')}) SELECT q.journey_id, q.lead_min, q.seq, rt_net_n15, rt_net_anom15 FROM q JOIN n ON n.journey_id = q.journey_id AND n.lead_min = q.lead_min""")
def jn_14(spark, sf_dir):
    w = _World(spark, sf_dir)
    q = _q(w)
    n = _windows(_tr(q), w.obs, "net", live.TRIP, [15, 60])
    return q.select(*live.TRIP, "seq").join(n, live.TRIP).select(*live.TRIP, "seq", "rt_net_n15", "rt_net_anom15")


@query("win_10", f"WITH w AS ({adapters.duck(adapters.WEATHER)}) SELECT time, sum(precipitation) OVER (ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS precip_3h FROM w")
def win_10(spark, sf_dir):
    return io.prepare_weather(adapters.weather(spark, sf_dir)).select("time", "precip_3h")


_OWN = "CAST(dayofyear(c.date) % 5 AS INTEGER)"
_FOLDS = {p: tables_sql(FOLD_ROWS.format(end=end, fold="dayofyear(date) % 5").replace("FROM c,", "FROM clean c,"), p) for p, end in (("h0", SETUP.train.end), ("h1", SETUP.valid.end))}


def live_sql(split: str, plan: list[tuple[str, str, str]]) -> str:
    """A real-time set with history tables, keys and prefixes by plan."""
    parts = {
        "f1": windows_sql("tr", "journey_id, lead_min", "ld", [20, 60, 180], "ld"), "f2": windows_sql("tr", "journey_id, lead_min", "net", [15, 60], "net"), "f3": _IN,
        "f4": _LAST_LD.format(anom="rt_ld_last_anom", age="rt_ld_last_age_min"), "f5": windows_sql("q", "journey_id, lead_min, seq", "stop", [60], "stop"), "f6": _LAST_STOP, "f7": along_sql(90, 3),
    }
    ids = {"f5": ", seq", "f6": ", seq", "f7": ", seq", "sg": ", seq"}
    joins = " ".join(f"JOIN {f} ON {f}.journey_id = q.journey_id AND {f}.lead_min = q.lead_min" + (f" AND {f}.seq = q.seq" if f in ids else "") for f in ("f1", "f2", "f3", "f4", "f5", "sg", "f6", "f7"))
    cols = ", ".join(f"{f}.* EXCLUDE (journey_id, lead_min{ids.get(f, '')}{', rt_net_n60' if f == 'f2' else ''})" for f in ("f1", "f2", "f3", "f4", "f5", "sg", "f6", "f7"))
    feats = ", ".join(FEATURE_SQL.format(p=p, x=x) for p, _, x in plan)
    own = "q.journey_id, " if split == "test" else ""
    return f"""WITH {OBS}, {', '.join(_FOLDS[p] for p in sorted({p for p, _, _ in plan}))}, {query_rows_sql(split)}, {IN_SAME}, {_SEG}, {', '.join(f'{k} AS ({v})' for k, v in parts.items())}
 SELECT {own}q.lead_min, q.seq, c.y, c.date, c.n_stops, round(q.lead_min + c.sched_min_from_start, 6) AS horizon_min, {BASELINE.format(p='b')} AS baseline, {feats}, {cols}
 FROM q JOIN clean c ON c.journey_id = q.journey_id AND c.seq = q.seq {lookups(_WEEK, 'b')} {' '.join(lookups(key, p) for p, key, _ in plan)} {joins}"""


def _live_set(spark, sf_dir, split):
    w = _World(spark, sf_dir)
    out = live.live_dataset(w.visits, w.rows, w.plan, w.histories, split)
    cols = [c for c in out.columns if c.startswith(("rt_", "hist_", "refit_")) and c not in ("rt_segcum30", "rt_segcov30")]
    whole = ("rt_ld_n20", "rt_ld_n60", "rt_ld_n180", "rt_net_n15", "rt_stop_n60", "rt_seg_n30", "rt_seg_n90")
    ids = ["journey_id"] if split == "test" else []
    out = out.select(*ids, "lead_min", "seq", "y", "date", "n_stops", F.col("horizon_min").cast("double").alias("horizon_min"), "baseline", *[F.col(c) if c in whole else F.col(c).cast("double").alias(c) for c in cols])
    return rounded(out.withColumn("rt_segcum90", F.round("rt_segcum90", 3)))


@query("ds_05", live_sql("test", [("h1", "5", "")]))
def ds_05(spark, sf_dir):
    return _live_set(spark, sf_dir, "test")


@query("ds_05_train_rows", live_sql("train", [("h0", _OWN, ""), ("h1", _OWN, "refit_")]))
def ds_05_train_rows(spark, sf_dir):
    return _live_set(spark, sf_dir, "train")


@query("ds_05_valid", live_sql("valid", [("h0", "5", ""), ("h1", _OWN, "refit_")]))
def ds_05_valid(spark, sf_dir):
    return _live_set(spark, sf_dir, "valid")


@query("ds_05_train", f"""WITH {OBS} SELECT lead_min, count(*) AS n_rows FROM (SELECT CAST(5 + {bucket_sql("journey_id || '#lead'", 86)} AS INTEGER) AS lead_min FROM clean WHERE bucket < 20 AND date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20') GROUP BY lead_min""")
def ds_05_train(spark, sf_dir):
    w = _World(spark, sf_dir)
    return live.live_dataset(w.visits, w.rows, w.plan, w.histories, "train", any_line=True).groupBy("lead_min").agg(F.count("*").alias("n_rows"))


def _feed(spark, sf_dir):
    """The observations as a folder of Parquet that a stream reads."""
    obs = _World(spark, sf_dir).obs
    path = temp_folder(spark) + "/feed"
    obs.write.parquet(path)
    return feed.read_feed(spark, path, obs.schema)


@query("st_01", f"WITH {OBS} SELECT line, direction, t, n, na, CAST(sa AS DOUBLE) AS sa FROM ({bucket_sql_of('ld')}) WHERE t <= (SELECT max(obs_ts) FROM obs) - INTERVAL 2 MINUTE")
def st_01(spark, sf_dir):
    """Buckets that the watermark has closed when the feed ends."""
    got = feed.replay(feed.bucket_stream(_feed(spark, sf_dir)), temp_folder(spark))
    return got.withColumn("sa", F.col("sa").cast("double"))


@query("st_02", f"WITH {OBS} SELECT line, direction, CAST(max_by(anom, (obs_ts, journey_id, seq)) AS DOUBLE) AS anom, max(obs_ts) AS obs_ts FROM obs WHERE anom IS NOT NULL GROUP BY line, direction")
def st_02(spark, sf_dir):
    obs, folder = _feed(spark, sf_dir), temp_folder(spark)
    latest.upsert_latest(obs, folder)
    return latest.latest_table(spark, folder, latest.latest_changes(obs).schema)
