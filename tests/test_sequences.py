import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcast.operators import encode, sequences as E, split
from eventcast.operators.attach import attach_codes


def series(spark, sizes):
    start = datetime.date(2001, 1, 1)
    rows = [(g, start + datetime.timedelta(weeks=i), float(i), float(10 * i + 1)) for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, t date, a double, b double")


def test_windows_of_short_series(spark):
    rows = E.create_sequences(series(spark, {"below": 3, "equal": 4, "above": 5, "long": 10}), ["a", "b"], "b", 4, by="g", time="t")
    found = rows.collect()
    assert {g: sum(r["g"] == g for r in found) for g in ("below", "equal", "above", "long")} == {
        "below": 0, "equal": 0, "above": 1, "long": 6}
    first = next(r for r in found if r["g"] == "above")
    assert first["x"] == [[0.0, 1.0], [1.0, 11.0], [2.0, 21.0], [3.0, 31.0]] and first["y"] == 41.0


def test_key_only_plans_do_not_build_windows(spark):
    rows = E.create_sequences(series(spark, {"long": 10}), ["a"], "b", 4, by="g", time="t").select("g", "target_date")
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sequence_scaling_and_inverse(spark):
    rows = E.create_sequences(series(spark, {"x": 12, "y": 9}), ["a", "b"], "b", 4, by="g", time="t")
    for kind in ("minmax", "standard"):
        params = E.fit_sequence_scaler(rows, ["a", "b"])
        scaled = E.scale_sequences(rows, params, ["a", "b"], kind)
        flat = np.array([r["x"] for r in scaled.collect()]).reshape(-1, 2)
        if kind == "minmax":
            assert flat.min(0) == pytest.approx([0, 0]) and flat.max(0) == pytest.approx([1, 1])
        else:
            assert flat.mean(0) == pytest.approx([0, 0], abs=1e-9) and flat.std(0) == pytest.approx([1, 1])
        back = encode.unscale(scaled, params, "y", ["y"], kind)
        assert sorted(r["y"] for r in back.collect()) == pytest.approx(sorted(r["y"] for r in rows.collect()))


def test_constant_feature_scales_to_zero(spark):
    rows = series(spark, {"x": 12}).withColumn("c", F.lit(0.1))
    params = encode.fit_scaler(rows, ["c", "a"])
    for kind in ("minmax", "standard"):
        assert {r["c"] for r in encode.apply_scaler(rows, params, ["c", "a"], kind).collect()} == {0.0}
    made = E.create_sequences(rows, ["c"], "a", 4, by="g", time="t")
    scaled = E.scale_sequences(made, E.fit_sequence_scaler(made, ["c"]), ["c"], "standard")
    assert {v for r in scaled.collect() for step in r["x"] for v in step} == {0.0}


def test_codes_round_trip(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "i int, city string")
    codes = encode.fit_label_codes(rows, ["city", "absent"])
    assert sorted((r["value"], r["code"]) for r in codes.collect()) == [("a", 0), ("b", 1)]
    coded = encode.apply_label_codes(rows, codes, ["city"])
    back = encode.decode_labels(coded.drop("city"), codes, "city", "city_encoded", "city")
    assert sorted(map(str, back.select("i", "city").collect())) == sorted(map(str, rows.collect()))


def test_one_hot_limits(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    hot = encode.one_hot(rows, encode.category_levels(rows, ["c"]))
    assert sorted((r["c_a"], r["c_b"]) for r in hot.collect()) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        encode.category_levels(rows, ["c"], limit=1)


def test_split_sizes_add_up(spark):
    rows = series(spark, {"x": 37, "y": 23, "z": 5})
    sizes = {r["split"]: r["count"] for r in split.chronological_split(rows, "t", ["g"]).groupBy("split").count().collect()}
    assert sizes == {"train": 45, "val": 9, "test": 11}
    two = split.two_way_split(rows, "t", ["g"], 0.8)
    assert two.filter("split = 'train'").count() == 52
    tail = {r["split"]: r["count"] for r in split.tail_validation(two, "t", ["g"]).groupBy("split").count().collect()}
    assert tail == {"train": 45, "val": 7, "test": 13}
    cut = split.chronological_split(rows, "t", ["g"])
    assert cut.filter("split = 'train'").agg(F.max("t")).first()[0] <= cut.filter("split = 'test'").agg(F.min("t")).first()[0]


def test_series_split(spark):
    found = split.series_split(series(spark, {"x": 20, "y": 1}), "g", "t")
    counts = {(r["g"], r["split"]): r["count"] for r in found.groupBy("g", "split").count().collect()}
    assert counts == {("x", "train"): 14, ("x", "val"): 3, ("x", "test"): 3, ("y", "test"): 1}


def test_random_split_is_exact_and_repeatable(spark):
    rows = spark.range(1003).withColumnRenamed("id", "eventid")
    once = split.random_split(rows, "eventid")
    assert once.filter("split = 'train'").count() == 802
    again = split.random_split(rows.repartition(3), "eventid")
    assert once.exceptAll(again).count() == 0
    other = split.random_split(rows, "eventid", seed=7)
    assert once.exceptAll(other).count() > 0


def test_one_hot_vectors_keep_every_level(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    encoded, _ = encode.one_hot_vectors(rows, ["c"])
    found = {r["c"]: r["c_vec"].toArray().tolist() for r in encoded.collect()}
    assert found == {"a": [1, 0, 0], "b": [0, 1, 0], None: [0, 0, 1]}


@pytest.mark.parametrize("size", [0, 1 << 26])
def test_many_columns_in_one_dictionary(spark, size):
    """Below and beyond the broadcast bound: the same codes for values, nulls, unknown values and a hot value."""
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"v{i % 7}", None if i % 5 == 0 else f"w{i % 11}", "x=y") for i in range(900)],
        "id long, a string, b string, c string").repartition(6)
    codes = encode.fit_label_codes(rows.filter("id < 800"), ["a", "b", "c", "absent"])
    known = {(r["column_name"], r["value"]): r["code"] for r in codes.collect()}
    assert sorted(v for (c, v) in known if c == "a") == sorted(["hot", *(f"v{i}" for i in range(7))])
    found = attach_codes(rows.unionByName(spark.createDataFrame([(-1, "new", None, None)], rows.schema)), codes,
                         {"a": "a_code", "b": "b_code", "c": "c_code", "absent": "z"}, broadcast_bytes=size).collect()
    assert len(found) == 901
    for r in found:
        for c in "abc":
            assert r[f"{c}_code"] == known.get((c, r[c]))


def test_only_the_wide_column_moves_rows(spark):
    """Columns of few values are probed where the rows lie though the dictionary as a whole is beyond the bound."""
    rows = spark.createDataFrame([(i, f"word {i % 300}" if i % 9 else None, f"k{i % 3}", "x") for i in range(900)],
                                 "id long, city string, kind string, flag string").repartition(4)
    codes = encode.fit_label_codes(rows, ["city", "kind", "flag"])
    found = attach_codes(rows, codes, {"city": "a", "kind": "b", "flag": "c"}, broadcast_bytes=1000)
    known = {(r["column_name"], r["value"]): r["code"] for r in codes.collect()}
    assert found.columns == ["id", "city", "kind", "flag", "a", "b", "c"]
    for r in found.collect():
        assert (r["a"], r["b"], r["c"]) == tuple(known.get((c, r[c])) for c in ("city", "kind", "flag"))
    assert "max(CASE" not in found._jdf.queryExecution().optimizedPlan().toString()  # no cells pivoted back


def test_codes_of_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, a string")
    codes = encode.fit_label_codes(rows, ["a"], null_value="nan")
    found = {r["id"]: r["a_encoded"] for r in encode.apply_label_codes(rows, codes, ["a"], null_value="nan").collect()}
    assert found == {1: 0, 2: 1, 3: 2}
    assert encode.apply_label_codes(rows, codes, ["a"]).filter("id = 2").first()["a_encoded"] is None


def test_node_block_positions(spark):
    rows = spark.createDataFrame([(1, "b", "x", 2.0, True, "p"), (2, "a", None, 4.0, False, "q"), (3, "b", "y", None, None, None)],
                                 "id long, k string, m string, v double, f boolean, w string")
    vectors = spark.createDataFrame([("p", [0.5, 0.0])], "word string, vector array<double>")
    block = encode.node_block(rows, "id", ["k", "m"], ["v"], ["f"], vectors, "w", 2)
    found = {r["id"]: (r["size"], r["indices"], r["values"]) for r in block.collect()}
    assert found == {1: (8, [1, 2, 4, 5, 6], [1.0, 1.0, -1.0, 1.0, 0.5]), 2: (8, [0, 4], [1.0, 1.0]), 3: (8, [1, 3], [1.0, 1.0])}
