"""The incident view: star-schema tables read as dated, located events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcast.functions import calendar as C
from eventcast.session import spread

# Columns of the input tables. Declared, so that reading starts no inference job.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_COLUMNS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document ids and texts, spread over the cores: text work is bound by CPU, not by reading."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def order_casualties(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.groupBy(F.col("l_orderkey").alias("eventid")).agg(
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("nkill"),
        F.count_if(F.col("l_returnflag") == "A").cast("double").alias("nwound"),
    )


def incidents(
    spark: SparkSession, folder: str, casualties: bool = True, cpu_bound: bool = False
) -> DataFrame:
    """One row per order. Orders without lines have null casualties.

    ``cpu_bound`` spreads an order table of few partitions over the cores before the joins, for
    row work that outweighs the reading.

    No join carries a hint: nation and region fall under Spark's own broadcast size check,
    customers and line aggregates are shuffled on their keys and AQE splits skewed partitions.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("eventid"), "o_custkey",
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("attacktype1_txt"),
        F.col("o_orderstatus").alias("weaptype1_txt"),
        (F.col("o_totalprice") / 1000 - 200).alias("longitude"),
    )
    if cpu_bound:
        orders = spread(orders)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"),
        F.col("c_name").alias("city"), F.col("c_mktsegment").alias("targtype1_txt"),
        (F.col("c_acctbal") / 100).alias("latitude"),
    )
    nations = table(spark, folder, "nation").select(
        "n_nationkey", F.col("n_name").alias("country_txt"), F.col("n_regionkey").alias("r_regionkey")
    )
    regions = table(spark, folder, "region").select(
        "r_regionkey", F.col("r_name").alias("region_txt")
    )
    if casualties:
        orders = orders.join(order_casualties(spark, folder), "eventid", "left")
    columns = [
        "eventid", "date", "region_txt", "country_txt", "city",
        F.concat_ws("/", "country_txt", "targtype1_txt").alias("provstate"),
        "attacktype1_txt", "targtype1_txt", "weaptype1_txt",
        F.concat_ws("-", "weaptype1_txt", "targtype1_txt").alias("gname"),
        "latitude", "longitude",
    ]
    if casualties:
        columns += ["nkill", "nwound"]
    places = customers.join(nations, "n_nationkey").join(regions, "r_regionkey")
    return orders.join(places, "o_custkey").select(*columns)


def featured_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents with casualty nulls as 0 and their sum."""
    return incidents(spark, folder).fillna(0, subset=["nkill", "nwound"]).transform(
        with_casualties
    )


def with_casualties(events: DataFrame) -> DataFrame:
    return events.withColumn("casualties", F.col("nkill") + F.col("nwound"))


def raw_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The incident view in raw text form with the faults that cleaning repairs.

    Faults depend on the key only: repeated rows, bad and zero date parts, blanks, 'nan' texts,
    nulls, non-numbers and NaN.
    """
    key = F.col("eventid")

    def every(n: int):
        return key % n == 0

    def text(c):
        return F.col(c).cast("string")

    base = incidents(spark, folder, cpu_bound=True).select(
        "eventid",
        F.when(every(97), None).otherwise(F.year("date").cast("string")).alias("iyear"),
        F.when(every(31), "0").when(every(37), "2").otherwise(F.month("date").cast("string")).alias("imonth"),
        F.when(every(29), "0").when(every(37), "30").when(every(89), "abc")
        .otherwise(F.dayofmonth("date").cast("string")).alias("iday"),
        F.when(every(101), None).otherwise(F.col("country_txt")).alias("country_txt"),
        F.when(every(103), None).otherwise(F.col("region_txt")).alias("region_txt"),
        F.concat(F.lit(" "), F.col("provstate"), F.lit("  ")).alias("provstate"),
        F.when(every(11), "   ").when(every(13), "nan").when(every(17), None)
        .otherwise(F.col("city")).alias("city"),
        F.when(every(7), None).otherwise(F.col("gname")).alias("gname"),
        F.when(every(19), None).otherwise(F.col("attacktype1_txt")).alias("attacktype1_txt"),
        "targtype1_txt",
        F.when(every(23), "").otherwise(F.col("weaptype1_txt")).alias("weaptype1_txt"),
        F.when(every(41), "NaN").when(every(43), "abc").otherwise(text("latitude")).alias("latitude"),
        F.when(every(47), None).otherwise(text("longitude")).alias("longitude"),
        F.when(every(83), "abc").when(every(79), "NaN").otherwise(text("nkill")).alias("nkill"),
        text("nwound").alias("nwound"),
    )
    # Every tenth row comes twice; an array of copies keeps the source read once.
    copies = F.when(every(10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("_copy", F.explode(copies)).drop("_copy")


def holiday_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """(country_code, date): a calendar input derived from the nations and the order dates.

    Each country keeps the six rule holidays, and its own day: the (nation key + 1)th of March.
    """
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    codes = country_codes(spark, folder).filter(F.col("country_code").isNotNull())
    named = codes.agg(F.collect_list(F.struct("country_code", "own_day"))).scalar()
    own = (F.month("date") == 3) & (F.dayofmonth("date") == F.col("c.own_day"))
    return (
        days.withColumn("c", F.explode(named))
        .filter((C.us_holiday(F.col("date")) == 1) | own)
        .select(F.col("c.country_code").alias("country_code"), "date")
    )


def country_codes(spark: SparkSession, folder: str) -> DataFrame:
    """(country_txt, country_code, own_day); every fifth country has no code."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("country_txt"),
        F.when(key % 5 != 4, F.concat(F.lit("C"), key.cast("string"))).alias("country_code"),
        (key + 1).alias("own_day"),
    )
