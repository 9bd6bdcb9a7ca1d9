from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.operators import clean

FIELDS = ["eventid", "iyear", "imonth", "iday", "country_txt", "region_txt", "city", "gname",
          "latitude", "longitude", "nkill", "nwound"]
SCHEMA = "eventid long, " + ", ".join(f"{c} string" for c in FIELDS[1:])


def dirty(spark):
    good = (1, "2001", "9", "11", "A", "R", "X", "g", "1.5", "2.5", "3", "4")

    def row(i, **changes):
        return tuple({**dict(zip(FIELDS, good)), "eventid": i, **changes}[c] for c in FIELDS)

    return spark.createDataFrame([
        good, good,
        row(2, imonth="0"), row(3, iday="0"), row(4, imonth="2", iday="30"), row(5, country_txt=None),
        row(6, nkill="abc"), row(7, latitude="NaN"), row(8, latitude="91"), row(9, longitude="-181"),
        row(10, city=""), row(11, city="   "), row(12, city="nan"), row(13, city=None),
        row(14, nkill=None, nwound=None), row(15, iday="3.0"), row(16, iday="3.5"), row(17, gname=None),
        row(18, iyear=None), row(19, imonth="13"), row(20, iday="29", imonth="2", iyear="2000"),
        row(21, iday="29", imonth="2", iyear="1900"),
    ], SCHEMA)


def test_clean_data_rules(spark, day):
    rows = {r["eventid"]: r for r in clean.clean_data(dirty(spark)).collect()}
    assert sorted(rows) == [1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20]
    assert rows[2]["date"] == day("2001-01-11")
    assert rows[3]["date"] == day("2001-09-01")
    assert rows[15]["iday"] == 3
    assert rows[20]["date"] == day("2000-02-29")
    assert rows[6]["nkill"] == 0.0 and rows[6]["nwound"] == 4.0
    assert rows[14]["nkill"] == 0.0 and rows[14]["nwound"] == 0.0
    assert rows[7]["latitude"] is None and rows[7]["longitude"] == 2.5
    assert rows[8]["latitude"] is None and rows[8]["longitude"] is None
    assert rows[9]["latitude"] is None and rows[9]["longitude"] is None
    assert {rows[i]["city"] for i in (10, 11, 12, 13)} == {"Unknown"}
    assert rows[17]["gname"] == "Unknown"


def test_cleaning_twice_changes_nothing(spark):
    once = clean.clean_data(dirty(spark)).select("eventid", "nkill", "city", "latitude")
    again = once.transform(clean.handle_missing_values).transform(clean.validate_coordinates).transform(
        clean.standardize_text_fields
    )
    assert sorted(map(str, once.collect())) == sorted(map(str, again.select(once.columns).collect()))


def test_null_audit_counts_each_column(spark):
    audit = {r["column_name"]: r["nulls"] for r in clean.null_audit(dirty(spark)).collect()}
    assert audit["country_txt"] == 1 and audit["nkill"] == 1 and audit["eventid"] == 0


def test_median_and_mode(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, "b"), (2, 2.0, "b"), (3, 10.0, "a"), (4, 4.0, "a"), (5, None, None)], "i int, v double, c string"
    )
    assert clean.impute_median(rows, ["v"]).filter("i = 5").first()["v"] == 3.0
    assert clean.impute_mode(rows, ["c"]).filter("i = 5").first()["c"] == "a"


def test_column_helpers(spark, day):
    rows = spark.createDataFrame(
        [(day("2001-01-01"), "x", 1, None, 2.0), (day("2006-01-02"), "y", 2, 5.0, 3.0)],
        "d date, s string, y int, a double, b double",
    )
    assert clean.feature_columns(rows, "y") == ["a", "b"]
    assert clean.fill_feature_nulls(rows).filter("s = 'x'").first()["a"] == 0.0
    assert clean.drop_any_null(rows).count() == 1
    assert clean.recent_span(rows, "d").count() == 1
    assert clean.drop_columns(rows, "a", "none").columns == ["d", "s", "y", "b"]
    assert clean.select_relevant_columns(rows, ["s", "gone", "d"]).columns == ["s", "d"]
    assert clean.rename_columns(rows.withColumnRenamed("s", "city"), {"city": "City"}).columns[1] == "City"


def test_padded_date(spark):
    rows = spark.createDataFrame([("2001", "0", "7"), ("2001", "12", "00")], "Year string, Month string, Day string")
    assert [r["Date"] for r in clean.padded_date(rows).orderBy("Month").collect()] == ["2001-01-07", "2001-12-01"]


def test_remap_long_label(spark):
    rows = spark.createDataFrame([(S.LONG_VEHICLE_LABEL,), ("Other",)], "w string")
    found = clean.remap_values(rows, "w", {S.LONG_VEHICLE_LABEL: "Vehicle"}).agg(F.sort_array(F.collect_list("w"))).first()[0]
    assert found == ["Other", "Vehicle"]
