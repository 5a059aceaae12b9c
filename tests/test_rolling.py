"""The rolling dataset against its SQL, all of its train months included."""

from test_oracle import SF, duck, entry, rows  # noqa: F401


def test_rolling_dataset_equals_sql_in_every_month(spark, duck):  # noqa: F811
    df = entry.queries()["ds_06_all"](spark, SF)
    want = duck.execute(entry.oracle_sql()["ds_06_all"])
    names = [d[0] for d in want.description]
    found = df.collect()
    assert rows(df.columns, found) == rows(names, want.fetchall())
    assert min(r["date"] for r in found).year == 1995 and {r["part"] for r in found} == {"train", "stop", "test"}
    assert sorted(df.columns) == sorted(names)
