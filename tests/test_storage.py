import random

import pytest
from pyspark.sql import types as T

from eventcast import schema as S
from eventcast.sources import files


def test_csv_round_trip_with_line_breaks_and_latin_text(spark, tmp_path):
    values = {c: None for c in S.RAW_INCIDENT_SCHEMA.fieldNames()}
    rows = spark.createDataFrame(
        [tuple({**values, "eventid": 1, "city": " Zürich ", "summary": 'two\nlines, "quoted"'}.values())], S.RAW_INCIDENT_SCHEMA
    )
    files.write_csv(rows, str(tmp_path / "raw"), "ISO-8859-1")
    back = files.read_raw_csv(spark, str(tmp_path / "raw")).first()
    assert back["city"] == " Zürich " and back["summary"] == 'two\nlines, "quoted"' and back["gname"] is None


NASTY = [
    "plain", "", None, 'say ""', "two\nlines", 'three\n"quoted"\nlines', "\n", "\n\n\n", '"', '""', ",", '",\n"', "é\nü", "tail\n",
    "x" * 300 + "\n" + "y" * 300, "\r\nreturn", " blank ", 'a"b"c',
]


@pytest.mark.parametrize("size", [61, 1000, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_that_span_lines_are_read_in_splits(spark, tmp_path, size, end):
    rng = random.Random(size)
    want = []
    for name in ("one", "two"):
        rows = [(i, rng.choice(NASTY), rng.choice(NASTY)) for i in range(50)]
        want += rows
        quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
        body = "".join(f"{i},{quoted(a)},{quoted(b)}{end}" for i, a, b in rows)
        (tmp_path / f"{name}.csv").write_bytes(f"i,a,b{end}{body}".encode("latin-1"))
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 1)
        found = files.read_raw_csv(spark, str(tmp_path), schema)
        tasks = files.csv_records(spark, str(tmp_path)).rdd.getNumPartitions()
        got = sorted(map(str, found.collect()))
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    plain = spark.read.csv(str(tmp_path), schema=schema, header=True, encoding="ISO-8859-1", multiLine=True, escape='"', nullValue="")
    assert got == sorted(map(str, plain.collect()))
    assert len(got) == len(want) and (size > 100 or tasks > 9)


def test_a_field_longer_than_several_splits(spark, tmp_path):
    long = ("word\n" * 400) + "end"
    (tmp_path / "f.csv").write_text(f'i,a\n1,"{long}"\n2,b\n3,"{long}"\n')
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("a", T.StringType())])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], 100)
        spark.conf.set(keys[1], 1)
        found = files.read_raw_csv(spark, str(tmp_path / "f.csv"), schema, "UTF-8").collect()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(1, long), (2, "b"), (3, long)]


def test_windows_are_stored_by_split(spark, tmp_path):
    rows = spark.createDataFrame([("a", [[1.0, 2.0]], 1.0, "train"), ("b", [[3.0, 4.0]], 2.0, "test")],
                                 "g string, x array<array<double>>, y double, split string")
    files.write_windows(rows, str(tmp_path / "w"))
    assert (tmp_path / "w" / "split=test").exists()
    assert files.read_stage(spark, str(tmp_path / "w")).filter("split = 'test'").first()["x"] == [[3.0, 4.0]]


def test_metrics_and_results_files(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.0, 2.0, 1.0, 0.5)], "model string, RMSE double, MAE double, MSE double, R2 double")
    files.write_metrics(rows, str(tmp_path / "m"))
    assert {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "m")).collect()}["R2"] == 0.5
    files.write_results(rows, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1


def test_shared_folder_comes_from_the_session(spark):
    from eventcast.session import CHECKPOINT_KEY, new_path, shared_dir

    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named is None:
        pytest.skip("no folder named in this session")
    assert shared_dir(spark) == named and new_path(spark, "x").startswith(named)
