"""Point-in-time lookups, leakage, medians and metric properties on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stopwise.functions import calendar as cal
from stopwise.functions import scalars as sc
from stopwise.operators import evaluate as ev
from stopwise.operators import history, trips
from stopwise.operators import asof
from stopwise.operators.asof import asof_join
from stopwise.plans import model
from stopwise.sources import io

T0 = dt.datetime(2025, 3, 1)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, strict):
    rnd = random.Random(3)
    at = lambda: T0 + dt.timedelta(minutes=rnd.randrange(0, 6000))
    left = [(i, rnd.choice(["a", "b", None]), at()) for i in range(200)] + [(900, "a", None), (901, "zz", T0)]
    right = list({(k, t): (k, t, rnd.choice([None, 1, 2, 3])) for k, t in ((rnd.choice(["a", "b", None]), at()) for _ in range(60))}.values())
    right += [("a", left[0][2], 7)] if not any(r[:2] == ("a", left[0][2]) for r in right) else []
    lf = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    rf = spark.createDataFrame(right, "k string, u timestamp_ntz, v int")
    got = {r["i"]: (r["x_v"], r["x_u"]) for r in asof_join(lf, rf, ["k"], "t", "u", ["v", "u"], "x_", strict).collect()}
    for i, k, t in left:
        ok = [r for r in right if r[0] is not None and r[0] == k and t is not None and (r[1] < t or not strict and r[1] == t)]
        best = max(ok, key=lambda r: r[1], default=None)
        assert got[i] == ((best[2], best[1]) if best else (None, None))


def test_one_lookup_of_several_series_equals_brute_force(spark):
    rnd = random.Random(8)
    at = lambda: T0 + dt.timedelta(minutes=rnd.randrange(0, 6000))
    left = [(i, rnd.choice(["a", "b", None]), rnd.choice([at(), at(), None])) for i in range(150)] + [(0, "a", T0)] * 2
    one = list({(k, t): (k, t, rnd.choice([None, 1, 2])) for k, t in ((rnd.choice(["a", "b", None]), at()) for _ in range(50))}.values())
    two = list({(k, t): (k, t, rnd.random()) for k, t in ((rnd.choice(["a", "c"]), rnd.choice([at(), left[0][2] or T0])) for _ in range(50))}.values())
    lf = spark.createDataFrame(left, "i int, k string, t timestamp_ntz")
    series = [
        asof.Series(spark.createDataFrame(one, "k string, u timestamp_ntz, v int"), "u", ["v", "u"], "x_", lags=(0, 60, 2000)),
        asof.Series(spark.createDataFrame(two, "k string, w timestamp_ntz, v double"), "w", ["v"], "y_", strict=True),
    ]
    found = asof.asof_lookups(lf, ["k"], "t", series)
    assert found.columns == ["i", "k", "t", "x_v_0", "x_u_0", "x_v_60", "x_u_60", "x_v_2000", "x_u_2000", "y_v"]

    def last(rows, k, seen):
        return max((r for r in rows if r[0] is not None and r[0] == k and seen(r[1])), key=lambda r: r[1], default=(None, None, None))

    want = []
    for i, k, t in left:
        row = [i, k, t]
        for lag in (0, 60, 2000):
            hit = last(one, k, lambda u: t is not None and u + dt.timedelta(minutes=lag) <= t)
            row += [hit[2], hit[1]]
        want.append((*row, last(two, k, lambda u: t is not None and u < t)[2]))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    empty = asof.asof_lookups(lf, ["k"], "t", [asof.Series(series[0].rows.limit(0), "u", ["v"], "x_")])
    assert empty.filter("x_v is null").count() == len(left) and asof.asof_lookups(lf.limit(0), ["k"], "t", series).isEmpty()


def test_an_earlier_round_counts_only_where_it_is_whole(spark):
    rows = spark.createDataFrame([(1, 10, 5.0), (2, 10, 6.0), (1, 30, 7.0), (2, 30, 8.0), (3, None, 1.0)], "id int, lead int, p double")
    first = spark.createDataFrame([(1, 10, 1.0), (2, 10, 2.0), (1, 30, 3.0), (2, 30, None), (9, 10, 4.0)], "id int, lead int, old double")
    got = ev.against_earlier(rows, first, ["id", "lead"], "old", "lead")
    assert sorted(map(tuple, got.select("id", "lead", "p", "old").collect())) == [(1, 10, 5.0, 1.0), (2, 10, 6.0, 2.0)]
    assert ev.against_earlier(rows, first.limit(0), ["id", "lead"], "old", "lead").isEmpty()


@pytest.mark.parametrize("keys", [["k"], []])
def test_windowed_sums_equal_brute_force(spark, keys):
    rnd = random.Random(9)
    obs = [(rnd.choice("ab"), T0 + dt.timedelta(seconds=rnd.randrange(0, 200_000)), rnd.choice([None, 1.0, 2.0, 5.0])) for _ in range(300)]
    obs += [("c", T0 + dt.timedelta(minutes=5 * n), 1.0) for n in range(40)]  # at the very edges of buckets
    asks = [(i, rnd.choice(["a", "b", "c", None, "zz"]), T0 + dt.timedelta(minutes=rnd.randrange(-300, 4000))) for i in range(200)]
    cum = asof.running_sums(asof.bucket_sums(spark.createDataFrame(obs, "k string, obs_ts timestamp_ntz, v double"), keys, 5, "v"), keys)
    found = asof.windowed_sums(spark.createDataFrame(asks, "i int, k string, T timestamp_ntz"), cum, keys, [15, 60, 1500], "s")
    rows = {r["i"]: r for r in found.collect()}
    assert len(rows) == len(asks) == found.count()
    for i, k, at in asks:
        for w in (15, 60, 1500):
            ends = [((t - T0).total_seconds() // 300 + 1, v) for o, t, v in obs if not keys or o == k]
            inside = [v for e, v in ends if at - dt.timedelta(minutes=w) < T0 + dt.timedelta(minutes=5 * e) <= at]
            known = [v for v in inside if v is not None]
            mean = rows[i][f"rt_s_anom{w}"]
            assert rows[i][f"rt_s_n{w}"] == len(inside)
            assert mean is None if not known else abs(mean - sum(known) / len(known)) < 1e-9


def clean_rows(spark, change=None):
    rnd, rows = random.Random(5), []
    for n in range(119):
        day = dt.date(2024, 12, 3) + dt.timedelta(days=n)
        for line in "AB":
            for stop in "xyz":
                for hour in (8, 16):
                    y = rnd.randrange(-120, 600)
                    rows.append((y + (400 if change and change(day) else 0), day, day.replace(day=1), line, stop, "o", hour, int(day.weekday() >= 5)))
    return spark.createDataFrame(rows, "y int, date date, month date, line string, stop string, direction string, hour int, daytype int")


def test_history_never_sees_the_own_fold(spark):
    day = dt.date(2025, 2, 3)
    fold = day.timetuple().tm_yday % 5
    tables = [history.leave_fold_out(clean_rows(spark, c), "2024-12-03", "2025-03-31").tables["lsd"] for c in (None, lambda d: d == day)]
    a, b = ({(r["hkey"], r["line"], r["stop"]): r["hist_mean_lsd"] for r in t.collect()} for t in tables)
    assert all(a[k] == b[k] for k in a if k[0] == fold)
    assert all(a[k] != b[k] for k in a if k[0] == 5)


def test_past_never_sees_its_own_month(spark):
    tables = [history.expanding(clean_rows(spark, c), ["2025-01-01", "2025-03-01"]).tables["l"] for c in (None, lambda d: d >= dt.date(2025, 3, 1))]
    assert tables[0].exceptAll(tables[1]).isEmpty() and tables[1].exceptAll(tables[0]).isEmpty()
    other = history.expanding(clean_rows(spark, lambda d: d >= dt.date(2025, 2, 1)), ["2025-03-01"]).tables["l"]
    assert not other.exceptAll(tables[0]).isEmpty()


def test_plan_ignores_the_own_day(spark):
    def visits(cut):
        rows = []
        for n in range(20):
            day = dt.date(2025, 1, 6) + dt.timedelta(days=n)
            for s in range(1, 6 if not (cut and n == 19) else 3):
                rows.append((f"J{n}", day, "L", "o", f"s{s}", f"s{s}", s, dt.datetime.combine(day, dt.time(8, s)), 10))
        return spark.createDataFrame(rows, "journey_id string, operatingDate date, lineRef string, directionRef string, stopPointRef string, stopPointName string, seq long, aimed_arrival_local timestamp_ntz, arrival_delay_s long")

    a, b = trips.trip_plan(visits(False)), trips.trip_plan(visits(True))
    assert a.exceptAll(b).isEmpty()
    assert a.filter("journey_id = 'J19'").first()["n_stops"] == 5


def test_upper_median(spark):
    df = spark.createDataFrame([([9, 2, 7, 4, 1, 8],), ([],), ([6, 5, 5],)], "a array<int>")
    assert [r[0] for r in df.select(trips.upper_median(F.col("a"))).collect()] == [7, None, 5]


def test_minutes_are_boundaries_and_easter(spark):
    r = spark.sql("SELECT TIMESTAMP_NTZ '2024-02-29 23:58:30' AS a, TIMESTAMP_NTZ '2024-03-01 00:03:00' AS b, DATE '2038-09-01' AS d")
    got = r.select(sc.minutes_between("a", "b").alias("m"), cal.easter("d").alias("e"), sc.delay_text(F.lit(-754)).alias("t"), sc.date_text(F.lit("2027-08-15").cast("date")).alias("u")).first()
    assert (got["m"], got["e"], got["t"], got["u"]) == (5, dt.date(2038, 4, 25), "-12 min 34 s", "søndag 15. august 2027")


def test_daylight_at_the_equator_the_pole_and_the_equinox(spark):
    day = F.lit("2023-06-21").cast("date")
    got = spark.range(1).select(cal.daylight_hours(day, 0.0).alias("a"), cal.daylight_hours(day, 80.0).alias("b"), cal.daylight_hours(day, -80.0).alias("c"), cal.daylight_hours(F.lit("2023-03-22").cast("date"), 60.0).alias("d")).first()
    assert got["a"] == pytest.approx(12.0) and got["b"] == 24.0 and got["c"] == 0.0 and got["d"] == pytest.approx(12.0, abs=0.2)


def errors(spark, n_days, per_day, effect):
    """Errors of two methods; effect(day) is added to the base's error on all rows of a day."""
    rnd, rows = random.Random(11), []
    for n in range(n_days):
        for _ in range(per_day):
            y = rnd.uniform(-50, 250)
            rows.append((dt.date(2024, 4, 1) + dt.timedelta(days=n), y, y + rnd.choice((-1, 1)) * rnd.uniform(10, 20), y + 30 + effect(n)))
    return spark.createDataFrame(rows, "date date, y double, pred double, base double")


def test_metrics_by_hand(spark):
    hand = spark.createDataFrame([(10.0, 10.0), (10.0, -50.0), (10.0, 129.0), (10.0, 131.0), (10.0, -400.0)], "y double, pred double")
    m = hand.agg(*ev.error_metrics()).first()
    assert (m["mae_s"], m["within_1min_pct"], m["within_2min_pct"]) == (142.0, 40.0, 60.0) and m["rmse_s"] == pytest.approx(40100.4**0.5)


def test_bootstrap_intervals(spark):
    plain = errors(spark, 40, 25, lambda n: 0)
    gain = ev.mae_gain(plain, [("pred", "base")]).first()
    assert gain["value"] == pytest.approx(50, abs=2) and gain["low"] < gain["value"] < gain["high"] and gain["high"] - gain["low"] < 3
    assert gain == ev.mae_gain(plain, [("pred", "base")]).first() and (gain["days"], gain["blocks"]) == (40, 40)
    none = ev.mae_gain(plain, [("pred", "pred")], absolute=True).first()
    assert (none["value"], none["low"], none["high"]) == (0.0, 0.0, 0.0)
    weekly = errors(spark, 70, 10, lambda n: 60.0 * (n // 7 % 3))  # days of a week err alike
    by = {b: ev.mae_gain(weekly, [("pred", "base")], b).first() for b in ("day", "week")}
    assert by["week"]["high"] - by["week"]["low"] > by["day"]["high"] - by["day"]["low"] and by["week"]["blocks"] == 10
    assert by["week"]["value"] == pytest.approx(by["day"]["value"])
    with pytest.raises(ValueError):
        ev.block_totals(plain, "pred", "base", "year")


def test_bootstrap_equals_drawing_blocks_one_by_one(spark):
    totals = [(10.0 + i, 20.0 + (i * i) % 7, 5 + i % 3) for i in range(12)]
    df = spark.createDataFrame([("a", i, m, b, n, 1) for i, (m, b, n) in enumerate(totals)], "comparison string, block int, model_error double, base_error double, n_rows long, n_days long")
    got = ev.block_bootstrap(df, draws=4000, absolute=True).first()
    rnd, values = random.Random(5), []
    for _ in range(4000):
        drawn = [rnd.choice(totals) for _ in totals]
        values.append((sum(x[0] for x in drawn) - sum(x[1] for x in drawn)) / sum(x[2] for x in drawn))
    values.sort()
    assert got["low"] == pytest.approx(values[100], abs=0.05) and got["high"] == pytest.approx(values[3900], abs=0.05)


def test_statistics_of_millions_of_rows_do_not_overflow(spark):
    n = 4_000_000_000
    counts = spark.createDataFrame([("a", 0, -1800, n), ("a", 0, 3600, n), ("b", 0, 5, 1)], "line string, unit int, y int, n long")
    h = history.History(counts, history.whole(), {"t": (["line"], {"m": "mean", "s": "std", "d": "median"})})
    got = {r["line"]: r for r in h.tables["t"].collect()}
    assert got["a"]["m"] == 900.0 and got["a"]["s"] == pytest.approx(2700.0) and got["b"]["s"] is None and got["b"]["d"] == 5.0
    assert got["a"]["hist_n"] == 2 * n


PERIODS = ["2024-05-01", "2024-02-01", "2024-07-01", "2024-04-01", "2023-01-01"]
DAYS = {
    "past": (lambda: history.all_before(PERIODS), lambda p, day: str(day) < str(p)),
    "recent": (lambda: history.days_before(PERIODS, 40), lambda p, day: p - dt.timedelta(days=40) <= day < p),
    "folds": (lambda: history.other_folds(), lambda p, day: p != day.timetuple().tm_yday % 5),
    "all": (lambda: history.whole(), lambda p, day: True),
    "folds before": (lambda: history.folds_before(PERIODS[:4]), lambda p, day: str(day.replace(day=1)) < p[:10] and int(p[11:]) != day.timetuple().tm_yday % 5),
}


def _history(spark, name, chunk=None):
    rnd = random.Random(8)
    days = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(200))
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), days(), rnd.choice((0, 10, 20, 500, -7))) for _ in range(700)]
    df = spark.createDataFrame(rows, "line string, hour int, date date, y int")
    day_fold = F.dayofyear("date") % 5
    unit = {"folds": day_fold, "folds before": F.struct(F.trunc("date", "month").alias("month"), day_fold.alias("fold"))}.get(name, F.col("date"))
    stats = {"med": "median", "mean": "mean", "std": "std"}
    specs = {"lh": (["line", "hour"], stats), "l": (["line"], {k + "_l": v for k, v in stats.items()}), "g": ([], {k + "_g": v for k, v in stats.items()})}
    return rows, df, history.History(history.histogram(df, unit, ["line", "hour"]), DAYS[name][0](), specs)


@pytest.mark.parametrize("name", DAYS)
def test_running_statistics_equal_counting_anew(spark, name):
    import statistics as st

    rows, _, h = _history(spark, name)
    scheme, holds = h.scheme, DAYS[name][1]
    for spec, keys in (("lh", lambda r: r[:2]), ("l", lambda r: r[:1]), ("g", lambda r: ())):
        want = {}
        for p in scheme.periods:
            for r in rows:
                if holds(p, r[2]):
                    want.setdefault((p, *keys(r)), []).append(r[3])
        got = {tuple(r)[: 1 + len(h.specs[spec][0])]: tuple(r)[1 + len(h.specs[spec][0]) :] for r in h.tables[spec].collect()}
        assert got.keys() == want.keys()
        for k, ys in want.items():
            med, mean, std, n = got[k]
            assert (med, n) == (st.median(ys), len(ys)) and mean == pytest.approx(st.mean(ys))
            assert std == pytest.approx(st.stdev(ys)) if len(ys) > 1 else std is None


def test_lookups_ask_for_what_rows_have(spark):
    rows, df, h = _history(spark, "past")
    asked = df.limit(60).unionByName(spark.createDataFrame([("zz", 1, dt.date(2024, 4, 3), 1), (None, 1, dt.date(2024, 4, 3), 1), ("a", None, dt.date(1999, 4, 3), 1)], df.schema))
    asked = asked.withColumns({"step": F.lit("mine"), "n": F.lit("mine"), "spec": F.lit("mine"), "month": F.trunc("date", "month")})
    got = h.attach(asked, F.col("month"), {"med": "x", "std_l": "s", "mean_g": "g"})
    assert got.columns == [*asked.columns, "x", "s", "g"] and got.count() == 63
    tables = {spec: {tuple(r)[: 1 + len(h.specs[spec][0])]: r for r in t.collect()} for spec, t in h.tables.items()}
    for r in got.collect():
        known = lambda spec, *k: None if None in k else tables[spec].get((r["month"], *k))  # noqa: B023, E731
        lh, line, g = known("lh", r["line"], r["hour"]), known("l", r["line"]), known("g")
        assert (r["x"], r["s"], r["g"]) == (lh and lh["med"], line and line["std_l"], g and g["mean_g"])


def test_chunks_never_cut_a_key(spark, monkeypatch):
    from stopwise.operators import running

    monkeypatch.setattr(running, "CHUNK", 1)
    _, _, h = _history(spark, "recent")
    with_small = {tuple(r) for r in h.tables["lh"].collect()}
    monkeypatch.undo()
    assert with_small == {tuple(r) for r in h.tables["lh"].collect()}


def test_rows_are_shuffled_once_for_all_groupings(spark):
    _, df, h = _history(spark, "past")
    wide = df.withColumn("payload", F.lit("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = h.attach(wide, F.trunc("date", "month"), {"med": "a", "mean_l": "b", "std_g": "c"})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("payload") and out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 9
        # The rows' own side: one join above them, whatever the number of groupings.
        top = [line for line in plan.splitlines() if "Join LeftOuter" in line]
        assert sum("<=>" in line for line in top) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quantiles_and_auc_of_real_scores(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("xy"), rnd.random() if i % 3 else 0.5, rnd.random() < 0.4) for i in range(3000)] + [("z", 7.0, True), (None, 0.25, True), (None, 0.75, False)]
    df = spark.createDataFrame(rows, "g string, p double, late boolean")
    import numpy as np

    got = {r["g"]: r["q"] for r in ev.quantiles(df, F.col("p"), [0, 0.1, 0.5, 0.93, 1], "g").collect()}
    for g in "xyz":
        assert got[g] == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g], [0, 0.1, 0.5, 0.93, 1]).tolist())
    assert got[None] == pytest.approx([0.25, 0.3, 0.5, 0.715, 0.75])
    area = {r["g"]: r["auc"] for r in ev.auc(df, "p", F.col("late"), "g").collect()}
    for g in "xy":
        pos, neg = ([r[1] for r in rows if r[0] == g and r[2] is late] for late in (True, False))
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert area[g] == pytest.approx(wins / len(pos) / len(neg))
    assert area["z"] is None and area[None] == 0.0


def test_shuffle_deals_all_values_anew(spark):
    df = spark.range(2000).selectExpr("id", "id * 3 AS v", "id % 7 AS w")
    got = ev.shuffled_column(df, "v", ["id"], 5).collect()
    assert sorted(r["v"] for r in got) == [3 * i for i in range(2000)] and all(r["w"] == r["id"] % 7 for r in got)
    assert sum(r["v"] == 3 * r["id"] for r in got) < 20 and len({r["id"] for r in got}) == 2000
    assert ev.shuffled_column(df, "v", ["id"], 5).exceptAll(spark.createDataFrame(got)).isEmpty()


def test_importance_is_that_of_the_columns_a_model_uses(spark):
    df = spark.range(1500).selectExpr("id", "CAST(id % 50 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b", "CAST(id % 50 * 10 AS DOUBLE) AS y")
    got = {r["feature"]: r for r in ev.permutation_importance(df, lambda x: x.withColumn("pred", F.col("a") * 10), ["a", "b"], ["id"]).collect()}
    assert got["a"]["mean_increase_s"] > 100 and (got["b"]["mean_increase_s"], got["b"]["sd_s"]) == (0.0, 0.0)


def test_logistic_fit_finds_the_curve_it_was_made_from(spark):
    df = spark.range(40_000).selectExpr("CAST(id % 200 AS DOUBLE) / 50 - 2 AS x", "id").selectExpr("x", "pmod(hash(id, 3), 10000) / 10000.0 < 1 / (1 + exp(-(0.5 + 1.5 * x))) AS late")
    a, b = ev.fit_logistic(df, F.col("x"), F.col("late"))
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(1.5, abs=0.1)
    assert ev.brier(df.withColumn("p", ev.probability((a, b), F.col("x"))), "p", F.col("late")).first()["skill"] > 0.3


def test_checksum_tells_changed_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    same = ev.row_checksum(df.repartition(3), ["i", "s"]).first()
    assert same == ev.row_checksum(df, ["i", "s"]).first() and same["n_rows"] == 3
    assert same != ev.row_checksum(df.fillna("b"), ["i", "s"]).first()


def test_trees_stop_early_and_learn(spark):
    df = spark.range(600).selectExpr("concat('l', id % 80) AS line", "'s' AS stop", "'d' AS direction", "CAST(id % 10 AS DOUBLE) AS a", "IF(id % 5 = 0, NULL, 1.0D) AS b", "CAST(id % 10 * 20 AS DOUBLE) AS y", "50.0D AS baseline")
    m = model.fit_and_refit(df, df, df, ["a", "b"], rounds=4, depth=3)
    assert 1 <= model.rounds_used(m) <= 4
    out = model.predict(m, df.withColumn("line", F.lit("unseen")), numbers=["a", "b"])
    assert out.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 20 and set(out.columns) == {*df.columns, "pred"}
    top = model.importances(m, spark, ["a", "b"]).orderBy(F.desc("importance")).first()
    assert top["feature"] == "a"
    assert model.residual(df.withColumn("baseline", F.when(F.col("a") > 4, F.col("baseline")))).count() == 300


def test_time_zone_of_the_session_does_not_matter(spark):
    from stopwise.sources import adapters

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = io.ingest(adapters.raw_feed(spark, "/root/testdata/sf0.001")).collect(), adapters.visits_live(spark, "/root/testdata/sf0.001").collect()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = io.ingest(adapters.raw_feed(spark, "/root/testdata/sf0.001")).collect(), adapters.visits_live(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [sorted(map(str, x)) for x in got] == [sorted(map(str, x)) for x in want]


def test_weather_of_a_repeated_hour_does_not_depend_on_order(spark):
    t = dt.datetime(2024, 10, 27, 2)
    df = spark.createDataFrame([(t, None, 1.0), (t, 3.0, 2.0), (t, 2.5, 4.0)], "time timestamp_ntz, temperature_2m double, precipitation double")
    got = [io.prepare_weather(x).first() for x in (df, df.orderBy("precipitation"), df.orderBy(F.desc("precipitation")))]
    assert got[0] == got[1] == got[2] and (got[0]["temperature_2m"], got[0]["precip_3h"]) == (2.5, 4.0)


def test_written_dataset_is_in_order(spark, tmp_path):
    df = spark.range(5000).selectExpr("date_add(DATE '2024-01-01', CAST(id * 7919 % 90 AS INT)) AS date", "concat('j', id * 31 % 400) AS journey_id", "id AS seq")
    io.write_split(df, f"file://{tmp_path}/out")
    got = io.read_in_order(spark, f"file://{tmp_path}/out").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001)) and [(r["date"], r["journey_id"], r["seq"]) for r in got] == sorted((r["date"], r["journey_id"], r["seq"]) for r in got)


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as N

    from stopwise.sources import scratch

    with pytest.raises(RuntimeError):
        scratch.temp_folder(N(conf=N(get=lambda *a: None), sparkContext=N(master="spark://host:7077")))


def test_file_choice():
    names = [("feed_2019_12.parquet", 5000), ("feed_2020.parquet", 2000), ("feed_2020_07.parquet", 8000), ("feed_2021.parquet", 999), ("feed_2021_01.parquet", 1000)]
    assert io.chosen_files(names) == ["feed_2019_12.parquet", "feed_2020.parquet", "feed_2021_01.parquet"]


def test_incremental_load_adds_only_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2025, 1, 31), 1), (dt.date(2025, 2, 27), 2), (dt.date(2025, 3, 10), 3), (dt.date(2025, 4, 30), 4)], "operatingDate date, v int")
    path = f"file://{tmp_path}/months"
    assert io.load_months(rows, path, "2025-04-15").count() == 2  # March stops early, April has not ended
    assert io.load_months(rows, path, "2025-05-02").count() == 3
