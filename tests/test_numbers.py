"""Statistics on large values against NumPy, null keys in splits, blanks of other scripts."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.functions import text as X
from eventcast.operators import clean, forecast, sequences, split, stats
from eventcast.operators import windows as W

START = datetime.date(2001, 1, 1)


def large(spark, n=60):
    rng = np.random.default_rng(1)
    values = 1e9 + np.cumsum(rng.normal(size=n))
    rows = [("s", START + datetime.timedelta(weeks=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, week date, v double"), values


def test_rolling_std_of_large_values(spark):
    panel, values = large(spark)
    rows = W.rolling_statistics(panel, "v", (4,), by="series", time="week").orderBy("week").collect()
    assert rows[0]["v_rolling_std_4"] is None
    for i in range(1, 60):
        assert rows[i]["v_rolling_std_4"] == pytest.approx(np.std(values[max(0, i - 3):i + 1], ddof=1), rel=1e-5)
    events = panel.withColumn("id", F.row_number().over(Window.partitionBy("series").orderBy("week")))
    found = W.event_rolling(events, ["v"], 3, order=["week", "id"]).orderBy("week").collect()
    assert found[1]["v_rolling_std"] is None
    assert found[9]["v_rolling_std"] == pytest.approx(np.std(values[7:10], ddof=1), rel=1e-5)


def test_sequence_scaler_of_large_values(spark):
    panel, values = large(spark)
    windows = sequences.create_sequences(panel, ["v"], "v", 5, by="series", time="week")
    found = {r["feature"]: r for r in sequences.fit_sequence_scaler(windows, ["v"]).collect()}
    flat = np.concatenate([values[i - 5:i] for i in range(5, 60)])
    assert found["v"]["std_pop"] == pytest.approx(np.std(flat), rel=1e-6)
    assert found["v"]["mean"] == pytest.approx(flat.mean(), rel=1e-12)


def test_least_squares_on_large_values(spark):
    rng = np.random.default_rng(2)
    a, b = 1e9 + rng.normal(size=200), 1e9 + rng.normal(size=200)
    y = 3.0 * (a - 1e9) - 2.0 * (b - 1e9) + 5.0
    rows = spark.createDataFrame(list(zip(["g"] * 200, y.tolist(), a.tolist(), b.tolist())), "g string, y double, a double, b double")
    fit = forecast.product_sums(rows, ["g"], "y", ["a", "b"]).select(
        forecast.solve_least_squares(*forecast.SUMS).alias("c")).first()["c"]
    assert fit[1] == pytest.approx(3.0, abs=1e-3) and fit[2] == pytest.approx(-2.0, abs=1e-3)


def test_null_dates_have_no_place_in_a_split(spark):
    rows = [(i, START + datetime.timedelta(days=i) if i >= 3 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, day date")
    for ratio, train in ((0.2, 1), (0.5, 3)):
        found = split.two_way_split(df, "day", ["id"], ratio).collect()
        assert sum(r["split"] == "train" for r in found) == train
        assert sum(r["split"] == "test" for r in found) == 7 - train
        assert {r["split"] for r in found if r["day"] is None} == {None}
    found = split.chronological_split(df, "day", ["id"], (0.5, 0.25)).collect()
    assert [sum(r["split"] == s for r in found) for s in ("train", "val", "test", None)] == [3, 1, 3, 3]


def test_blanks_of_any_script_part_words(spark):
    texts = ["foo bar", "foo bar", "foo　bar", "foo\x1cbar", "foo\x85bar", "foo\tbar"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.clean_text(F.col("t")).alias("c")).collect()
    assert {r["c"] for r in rows} == {"foo bar"}


def test_whole_numbers_in_exponent_form(spark):
    texts = ["1e3", "3.0", "3.5", "2.5e1", "x", None, " 7 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clean.parse_whole(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [1000, 3, None, 25, None, None, 7]


def test_correlation_of_many_columns_equals_numpy(spark):
    rng = np.random.default_rng(3)
    k, n = 150, 3000
    values = rng.normal(size=(n, 8)) @ rng.normal(size=(8, k)) + rng.normal(size=(n, k)) + 1e6
    values[:, 7] = 5.0  # no spread
    missing = rng.random((n, k)) < 0.1
    rows = [[None if m else float(v) for v, m in zip(r, g)] for r, g in zip(values, missing)]
    names = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(9)
    cells = {(r["row_name"], r["column_name"]): r["correlation"] for r in stats.correlation_matrix(df, names).collect()}
    assert len(cells) == k * k
    for i in range(0, k, 3):
        for j in range(0, k, 7):
            both = ~missing[:, i] & ~missing[:, j]
            want = None if 7 in (i, j) else np.corrcoef(values[both, i], values[both, j])[0, 1]
            found = cells[names[i], names[j]]
            assert found is None if want is None else abs(found - want) < 1e-7


def test_percentiles_of_many_columns_and_groups_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(stats, "LAST_CELL_ROWS", 50)
    rng = np.random.default_rng(5)
    columns = {
        "wide": rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), "ties": rng.integers(0, 3, 2000) * 1.5,
        "close": 1e9 + rng.random(2000) * 1e-6, "signed": rng.normal(size=2000), "same": np.full(2000, -2.5),
        "infinite": np.where(rng.random(2000) < 0.5, np.inf, rng.normal(size=2000)),
    }
    groups = [None, "a", "b"]
    of = rng.integers(0, 3, 2000)
    gone = {c: rng.random(2000) < 0.05 for c in columns}
    rows = [(groups[of[i]], *[None if gone[c][i] else float(columns[c][i]) for c in columns], None) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in [*columns, "nothing"])).repartition(7)
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(r["g"], r["column_name"]): [r[f"p{i}"] for i in range(6)]
             for r in stats.percentiles(df, [*columns, "nothing"], p, ["g"]).collect()}
    assert set(found) == {(g, c) for g in groups for c in columns}
    for (g, c), values in found.items():
        mine = columns[c][(of == groups.index(g)) & ~gone[c]]
        with np.errstate(invalid="ignore"):
            want = np.sort(mine)
            low, high = [want[int(f((len(want) - 1) * q))] for q in p for f in [np.floor]], [want[int(f((len(want) - 1) * q))] for q in p for f in [np.ceil]]
            part = [(len(want) - 1) * q - np.floor((len(want) - 1) * q) for q in p]
            want = [a + (b - a) * f for a, b, f in zip(low, high, part)]
        assert all(x == pytest.approx(y, rel=1e-12, nan_ok=True) for x, y in zip(values, want)), (g, c)
    whole = stats.percentiles(df, ["signed"], [0.5]).collect()
    assert whole[0]["p0"] == pytest.approx(np.median(columns["signed"][~gone["signed"]]), rel=1e-12)


def test_sketches_unite_over_days(spark):
    rows = spark.range(30_000).selectExpr("id % 30 AS day", "id % 7000 AS a", "'x' AS b", "IF(id % 2 = 0, NULL, id) AS c")
    sketches = stats.distinct_sketches(rows, "day", ["a", "b", "c"])
    found = {r["column_name"]: r["n_distinct"] for r in stats.distinct_between(sketches, "day", F.lit(0), F.lit(29)).collect()}
    assert found["b"] == 1
    assert abs(found["a"] - 7000) <= 7000 * stats.sketch_error() and abs(found["c"] - 15000) <= 15000 * stats.sketch_error()
