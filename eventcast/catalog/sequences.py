"""Sequence, encoder, scaler and split queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.catalog.texts import VECTOR_SIZE
from eventcast.operators import embed, encode, panel, split
from eventcast.operators import sequences as E
from eventcast.plans import features
from eventcast.session import stage, stage_table
from eventcast.sources import tables as T

MEASURES = list(S.PANEL_MEASURES)


def dense(s, d, grain="region_txt"):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), grain)
    return panel.fill_missing_periods(
        weekly.drop("year", "week", "first_attack_date"), "week_start", grain, "week"
    )


def windows(s, d, length=S.SEQUENCE_LENGTH, grain="region_txt"):
    return E.create_sequences(dense(s, d, grain), MEASURES, "attack_count", length, by=grain, time="week_start")


def _whole(x):
    """Whole-number windows as text: steps by ';', features by ','."""
    return F.array_join(F.transform(x, lambda r: F.array_join(
        F.transform(r, lambda v: v.cast("bigint").cast("string")), ",")), ";")


WINDOW = "region_txt string, target_date date, x string, y double"
STEP = "concat_ws(',', attack_count, CAST(total_casualties AS BIGINT), CAST(total_killed AS BIGINT), CAST(total_wounded AS BIGINT))"


def _windows_sql(length: int, source: str = "panel", where: str = "", step: str = STEP) -> str:
    return f"""wins AS (SELECT series, week_start AS target_date, attack_count AS y,
      list({step}) OVER w AS l, count(*) OVER w AS have FROM {source} {where}
      WINDOW w AS (PARTITION BY series ORDER BY week_start ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)),
    samples AS (SELECT series AS region_txt, target_date, array_to_string(l, ';') AS x, l, y FROM wins WHERE have = {length})"""


@query("e1_sequences", WINDOW, f"WITH {Q.weekly()}, {_windows_sql(30)} SELECT * FROM samples")
def e1(s, d):
    return windows(s, d).withColumn("x", _whole("x"))


@query("e2_sequences_by_group", "country_txt string, target_date date, x string, y double",
       f"""WITH {Q.weekly('country_txt')}, {_windows_sql(30)} SELECT region_txt AS country_txt, target_date, x, y FROM samples""")
def e2(s, d):
    return windows(s, d, grain="country_txt").withColumn("x", _whole("x"))


LAGGED = """, lagged AS (SELECT * FROM (SELECT *, lag(attack_count, 52) OVER (PARTITION BY series ORDER BY week_start) AS l52
  FROM panel) WHERE l52 IS NOT NULL)"""


@query("e3_prepare_sequences", WINDOW, f"WITH {Q.weekly()}{LAGGED}, {_windows_sql(30, 'lagged')} SELECT * FROM samples")
def e3(s, d):
    return E.prepare_sequences(dense(s, d), "region_txt").withColumn("x", _whole("x"))


CALENDAR_STEP = "concat_ws(',', CAST(total_casualties AS BIGINT), month(week_start), weekofyear(week_start))"


@query("e4_all_feature_sequences", WINDOW,
       f"WITH {Q.weekly()}, {_windows_sql(30, step=CALENDAR_STEP)} SELECT * FROM samples")
def e4(s, d):
    timed = panel.add_time_features(dense(s, d), "week_start")
    return E.create_sequences(
        timed, ["total_casualties", "month", "week"], "attack_count", by="region_txt", time="week_start"
    ).withColumn("x", _whole("x"))


@query("e5_single_series_sequences", "target_date date, x string, y double",
       f"""WITH {Q.FEAT}, p AS (SELECT CAST(date_trunc('week', date) AS DATE) AS st, sum(nkill) AS nkill, sum(nwound) AS nwound,
         count(*) AS c FROM feat GROUP BY 1),
       g AS (SELECT CAST(t AS DATE) AS st FROM (SELECT unnest(generate_series(min(st), max(st), INTERVAL 7 DAY)) AS t FROM p)),
       r AS (SELECT st + 6 AS e, coalesce(nkill, 0) AS nkill, coalesce(nwound, 0) AS nwound, coalesce(c, 0) AS c FROM g LEFT JOIN p USING (st)),
       wn AS (SELECT e, c, list(concat_ws(',', CAST(nkill AS BIGINT), CAST(nwound AS BIGINT))) OVER w AS l, count(*) OVER w AS have FROM r
         WINDOW w AS (ORDER BY e ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
       SELECT e AS target_date, array_to_string(l, ';') AS x, c AS y FROM wn WHERE have = 12""")
def e5(s, d):
    weekly = panel.resample(T.featured_incidents(s, d), ["nkill", "nwound"], "week", "Weekly_Attacks")
    single = weekly.withColumn("series", F.lit("all"))
    return E.create_sequences(
        single, ["nkill", "nwound"], "Weekly_Attacks", 12, by="series", time="period_end"
    ).withColumn("x", _whole("x"))


@query("u1_combine_sequences", "series string, target_date date, x string, y double",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, b AS (SELECT region_txt AS series, target_date, x, y FROM samples)
       SELECT * FROM b UNION ALL SELECT 'again ' || series, target_date, x, y FROM b""")
def u1(s, d):
    rows = windows(s, d).select(F.col("region_txt").alias("series"), "target_date", "x", "y")
    both = E.combine_sequences([rows, rows.withColumn("series", F.concat(F.lit("again "), "series"))])
    return both.withColumn("x", _whole("x"))


# --- encoders -------------------------------------------------------------------------------

ENCODED = S.TEXT_COLUMNS
CODES = "codes AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code
    FROM (SELECT DISTINCT {c} FROM inc)""" for c in ENCODED) + ")"


@query("e6_label_codes", "column_name string, value string, code int", f"WITH {Q.INC}, {CODES} SELECT * FROM codes")
def e6(s, d):
    return encode.fit_label_codes(T.incidents(s, d, casualties=False), [*ENCODED, "absent"])


@query("e7_label_decode", "eventid long, attacktype1_txt_encoded int, decoded string",
       f"""WITH {Q.INC} SELECT eventid, dense_rank() OVER (ORDER BY attacktype1_txt) - 1 AS attacktype1_txt_encoded,
       attacktype1_txt AS decoded FROM inc""")
def e7(s, d):
    encoded, codes = features.apply_encoding(
        T.incidents(s, d, casualties=False).select("eventid", "attacktype1_txt"), ["attacktype1_txt"]
    )
    return encode.decode_labels(
        encoded.drop("attacktype1_txt"), codes, "attacktype1_txt", "attacktype1_txt_encoded", "decoded"
    )


@query("e6_codes_of_nulls", "eventid long, gname string, gname_encoded int, city_encoded int",
       f"""WITH {Q.RAW} SELECT eventid, gname, dense_rank() OVER (ORDER BY coalesce(gname, 'nan')) - 1 AS gname_encoded,
       dense_rank() OVER (ORDER BY coalesce(city, 'nan')) - 1 AS city_encoded FROM raw""")
def e6_nulls(s, d):
    raw = T.raw_incidents(s, d).select("eventid", "gname", "city")
    codes = encode.fit_label_codes(raw, ["gname", "city"], null_value="nan")
    return encode.apply_label_codes(raw, codes, ["gname", "city"], null_value="nan")


@query("e8_apply_encoding", "eventid long, " + ", ".join(f"{c}_encoded int" for c in ENCODED),
       f"WITH {Q.INC} SELECT eventid, " + ", ".join(
           f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_encoded" for c in ENCODED) + " FROM inc")
def e8(s, d):
    return features.apply_encoding(T.incidents(s, d, casualties=False), ENCODED)[0]


STATUSES = ["F", "O", "P"]


@query("e9_one_hot", "eventid long, " + ", ".join(f"weaptype1_txt_{v} int" for v in STATUSES),
       f"WITH {Q.INC} SELECT eventid, " + ", ".join(
           f"CASE WHEN weaptype1_txt = '{v}' THEN 1 ELSE 0 END AS weaptype1_txt_{v}" for v in STATUSES) + " FROM inc")
def e9(s, d):
    events = T.incidents(s, d, casualties=False)
    return encode.one_hot(events, encode.category_levels(events, ["weaptype1_txt"]))


# One position more than there are values: the one for nulls.
@query("e9_one_hot_vectors", "eventid long, position int, value double, size int",
       f"""WITH {Q.INC} SELECT eventid, dense_rank() OVER (ORDER BY city) - 1 AS position, 1.0 AS value,
       (SELECT count(DISTINCT city) + 1 FROM inc) AS size FROM inc""")
def e9_vectors(s, d):
    events = T.incidents(s, d, casualties=False).select("eventid", "city")
    encoded, model = encode.one_hot_vectors(events, ["city"])
    # Read from the vector itself, by its text form "(size,[positions],[values])", so it stays sparse.
    text = F.col("city_vec").cast("string")
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    return encoded.select(
        "eventid", part(r"^\((\d+),").alias("size"), part(r",\[(\d+)\],").alias("position"),
        part(r",\[([0-9.]+)\]\)$").alias("value"),
    )


# --- scalers --------------------------------------------------------------------------------

@query("e10_minmax", "region_txt string, week_start date, attack_count r6, total_casualties r6, constant r6",
       f"""WITH {Q.weekly()} SELECT series AS region_txt, week_start,
       (attack_count - min(attack_count) OVER ()) / (max(attack_count) OVER () - min(attack_count) OVER ()) AS attack_count,
       (total_casualties - min(total_casualties) OVER ()) / (max(total_casualties) OVER () - min(total_casualties) OVER ()) AS total_casualties,
       0.0 AS constant FROM panel""")
def e10(s, d):
    rows = dense(s, d).withColumn("constant", F.lit(7))
    columns = ["attack_count", "total_casualties", "constant"]
    return encode.apply_scaler(rows, encode.fit_scaler(rows, columns), columns)


@query("e11_standard", "region_txt string, week_start date, attack_count r6, total_casualties r6",
       f"""WITH {Q.weekly()} SELECT series AS region_txt, week_start,
       (attack_count - avg(attack_count) OVER ()) / stddev_pop(attack_count) OVER () AS attack_count,
       (total_casualties - avg(total_casualties) OVER ()) / stddev_pop(total_casualties) OVER () AS total_casualties FROM panel""")
def e11(s, d):
    rows = dense(s, d)
    columns = ["attack_count", "total_casualties"]
    return encode.apply_scaler(rows, encode.fit_scaler(rows, columns), columns, "standard")


# Values and steps of all samples, one row per (sample, step).
FLAT = """flat AS (SELECT p.series, w.target_date, p.attack_count AS a, p.total_casualties AS b, p.week_start
  FROM wins w JOIN panel p ON p.series = w.series AND p.week_start < w.target_date AND p.week_start >= w.target_date - 210
  WHERE w.have = 30)"""


@query("e12_scale_sequences", "region_txt string, target_date date, first_a r6, last_b r6, total r6, y r6",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, {FLAT},
       p AS (SELECT min(a) AS a0, max(a) - min(a) AS a1, min(b) AS b0, max(b) - min(b) AS b1 FROM flat),
       q AS (SELECT min(y) AS y0, max(y) - min(y) AS y1 FROM samples)
       SELECT f.series AS region_txt, f.target_date, arg_min((a - a0) / a1, week_start) AS first_a,
         arg_max((b - b0) / b1, week_start) AS last_b, sum((a - a0) / a1 + (b - b0) / b1) AS total, any_value((y - y0) / y1) AS y
       FROM flat f JOIN samples s ON s.region_txt = f.series AND s.target_date = f.target_date, p, q GROUP BY 1, 2""")
def e12(s, d):
    names = ["attack_count", "total_casualties"]
    rows = E.create_sequences(dense(s, d), names, "attack_count", by="region_txt", time="week_start")
    scaled = E.scale_sequences(rows, E.fit_sequence_scaler(rows, names), names)
    return scaled.select(
        "region_txt", "target_date", F.get(F.get("x", F.lit(0)), F.lit(0)).alias("first_a"),
        F.get(F.get("x", F.lit(29)), F.lit(1)).alias("last_b"),
        F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v).alias("total"), "y",
    )


@query("e12_sequence_ranges", "feature string, min r6, max r6, mean r6, std_pop r6",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, {FLAT}
       SELECT 'attack_count' AS feature, min(a) AS min, max(a) AS max, avg(a) AS mean, stddev_pop(a) AS std_pop FROM flat
       UNION ALL SELECT 'total_casualties', min(b), max(b), avg(b), stddev_pop(b) FROM flat
       UNION ALL SELECT 'y', min(y), max(y), avg(y), stddev_pop(y) FROM samples""")
def e12_ranges(s, d):
    names = ["attack_count", "total_casualties"]
    rows = E.create_sequences(dense(s, d), names, "attack_count", by="region_txt", time="week_start")
    return E.fit_sequence_scaler(rows, names)


@query("e13_inverse", "region_txt string, week_start date, attack_count r6",
       f"WITH {Q.weekly()} SELECT series AS region_txt, week_start, attack_count FROM panel")
def e13(s, d):
    rows = dense(s, d)
    params = encode.fit_scaler(rows, ["attack_count"])
    scaled = encode.apply_scaler(rows, params, ["attack_count"])
    return encode.unscale(scaled, params, "attack_count", ["attack_count"])


@query("e14_apply_scaling", "region_txt string, target_date date, total r6, y r6",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, {FLAT},
       p AS (SELECT avg(a) AS a0, stddev_pop(a) AS a1, avg(b) AS b0, stddev_pop(b) AS b1 FROM flat),
       q AS (SELECT avg(y) AS y0, stddev_pop(y) AS y1 FROM samples)
       SELECT f.series AS region_txt, f.target_date, sum((a - a0) / a1 + (b - b0) / b1) AS total, any_value((y - y0) / y1) AS y
       FROM flat f JOIN samples s ON s.region_txt = f.series AND s.target_date = f.target_date, p, q GROUP BY 1, 2""")
def e14(s, d):
    from eventcast.session import new_path
    from eventcast.sources import files

    names = ["attack_count", "total_casualties"]
    rows = E.create_sequences(dense(s, d), names, "attack_count", by="region_txt", time="week_start")
    windows_path, params_path = new_path(s, "windows"), new_path(s, "scaler")
    files.write_windows(rows, windows_path)
    stored = files.read_stage(s, windows_path)
    files.write_stage(E.fit_sequence_scaler(stored, names), params_path)
    scaled = E.scale_sequences(stored, files.read_stage(s, params_path), names, "standard")
    return scaled.withColumn("total", F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + v))


@query("e15_scaler_reuse", "period_end date, nkill r6, casualties r6",
       f"""WITH {Q.FEAT}, w AS (SELECT date_trunc('week', date) AS st, sum(nkill) AS k, sum(casualties) AS c FROM feat GROUP BY 1),
       z AS (SELECT CASE WHEN count(*) < date_diff('week', min(st), max(st)) + 1 THEN 0 ELSE min(k) END AS k0, max(k) AS k1,
         CASE WHEN count(*) < date_diff('week', min(st), max(st)) + 1 THEN 0 ELSE min(c) END AS c0, max(c) AS c1 FROM w),
       m AS (SELECT last_day(date) AS period_end, sum(nkill) AS k, sum(casualties) AS c FROM feat GROUP BY 1)
       SELECT period_end, (k - k0) / (k1 - k0) AS nkill, (c - c0) / (c1 - c0) AS casualties FROM m, z""")
def e15(s, d):
    events = T.featured_incidents(s, d)
    weekly = panel.resample(events, ["nkill", "casualties"], "week", "n")
    monthly = panel.resample(events, ["nkill", "casualties"], "month", "n")
    params = encode.fit_scaler(weekly, ["nkill", "casualties"])
    return encode.apply_scaler(monthly, params, ["nkill", "casualties"])


# --- splits ---------------------------------------------------------------------------------

def _ranked(source: str, order: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {source}),
    c AS (SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS t,
      CAST(floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS v FROM r),
    s AS (SELECT *, CASE WHEN pos < t THEN 'train' WHEN pos < v THEN 'val' ELSE 'test' END AS split FROM c)"""


@query("e16_chronological_split", "region_txt string, target_date date, x string, y double, split string",
       f"WITH {Q.weekly()}, {_windows_sql(30)}, {_ranked('samples', 'target_date, region_txt')} SELECT * FROM s")
def e16(s, d):
    return split.chronological_split(windows(s, d), "target_date", ["region_txt"]).withColumn("x", _whole("x"))


@query("e16_event_split", "eventid long, date date, split string",
       f"WITH {Q.INC}, {_ranked('inc', 'date, eventid')} SELECT * FROM s")
def e16_events(s, d):
    return split.chronological_split(T.incidents(s, d, casualties=False), "date", ["eventid"])


@query("e17_split_summary", "split string, n long, first_date date, last_date date",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, {_ranked('samples', 'target_date, region_txt')}
       SELECT split, count(*) AS n, min(target_date) AS first_date, max(target_date) AS last_date FROM s GROUP BY 1""")
def e17(s, d):
    return split.split_summary(
        split.chronological_split(windows(s, d), "target_date", ["region_txt"]), "target_date"
    )


@query("e18_series_split", "region_txt string, week_start date, attack_count long, split string",
       f"WITH {Q.weekly()}{Q.SERIES_SPLIT} SELECT series AS region_txt, week_start, y AS attack_count, split FROM splitted")
def e18(s, d):
    return split.series_split(dense(s, d), "region_txt", "week_start")


@query("e19_two_way_split", "region_txt string, week_start date, split string",
       f"""WITH {Q.weekly()}, r AS (SELECT *, row_number() OVER (ORDER BY week_start, series) - 1 AS pos, count(*) OVER () AS n FROM panel)
       SELECT series AS region_txt, week_start, CASE WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r""")
def e19(s, d):
    return split.two_way_split(dense(s, d), "week_start", ["region_txt"], 0.8)


@query("e20_tail_validation", "region_txt string, week_start date, split string",
       f"""WITH {Q.weekly()}, r AS (SELECT *, row_number() OVER (ORDER BY week_start, series) - 1 AS pos, count(*) OVER () AS n FROM panel),
       q AS (SELECT *, floor(n * CAST(0.8 AS DOUBLE)) AS t FROM r)
       SELECT series AS region_txt, week_start, CASE WHEN pos < t - floor(t * CAST(0.15 AS DOUBLE)) THEN 'train' WHEN pos < t THEN 'val'
       ELSE 'test' END AS split FROM q""")
def e20(s, d):
    rows = split.two_way_split(dense(s, d), "week_start", ["region_txt"], 0.8)
    return split.tail_validation(rows, "week_start", ["region_txt"])


@query("e21_random_split", "eventid long, split string",
       """WITH r AS (SELECT o_orderkey AS eventid, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) - 1 AS pos,
       count(*) OVER () AS n FROM orders)
       SELECT eventid, CASE WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r""")
def e21(s, d):
    return split.random_split(T.table(s, d, "orders").select(F.col("o_orderkey").alias("eventid")), "eventid")


@query("e22_assembled_vectors", "eventid long, size int, total r6",
       f"""WITH {Q.FEAT}, p AS (SELECT avg(nkill) AS k0, stddev_pop(nkill) AS k1 FROM feat)
       SELECT eventid, 5 AS size, 1 + (nkill - k0) / k1 + CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS total FROM feat, p""")
def e22(s, d):
    # One-hot, scaled and binary blocks in one vector.
    events = features.temporal(T.featured_incidents(s, d)).select("eventid", "weaptype1_txt", "nkill", "is_weekend")
    hot = encode.one_hot(events, {"weaptype1_txt": STATUSES})
    scaled = encode.apply_scaler(hot, encode.fit_scaler(hot, ["nkill"]), ["nkill"], "standard")
    blocks = [*[f"weaptype1_txt_{v}" for v in STATUSES], "nkill", "is_weekend"]
    values = encode.assemble(scaled, blocks).withColumn("v", vector_to_array("features"))
    return values.select(
        "eventid", F.size("v").alias("size"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")
    )


NODE_CLASSES = ["attacktype1_txt", "targtype1_txt", "weaptype1_txt", "country_txt"]
NODE_NUMBERS = ["latitude", "longitude", "nkill", "nwound"]
NODE_FLAGS = {"is_weekend": "isodow(date) >= 6", "claimed": "eventid % 2 = 0", "suicide": "eventid % 7 = 0", "success": "nkill > 0"}


def _node_block_sql() -> str:
    """One row per event: its entries as index:value, values in millionths."""
    offset, parts = "0", []
    for c in NODE_CLASSES:
        parts.append(f"{{'i': {offset} + dense_rank() OVER (ORDER BY {c}) - 1, 'v': CAST(1 AS DOUBLE)}}")
        offset += f" + n_{c}"
    for k, c in enumerate(NODE_NUMBERS):
        parts.append(f"{{'i': {offset} + {k}, 'v': CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END}}")
    for k, c in enumerate(NODE_FLAGS):
        parts.append(f"{{'i': {offset} + {len(NODE_NUMBERS) + k}, 'v': CAST(CAST({NODE_FLAGS[c]} AS INTEGER) AS DOUBLE)}}")
    first = f"{offset} + {len(NODE_NUMBERS) + len(NODE_FLAGS)}"
    start = "CAST('0x' || substr(md5(city || ':' || k), 1, 8) AS BIGINT) / 2147483648.0 - 1.0"
    facts = ", ".join([*(f"count(DISTINCT {c}) AS n_{c}" for c in NODE_CLASSES), *(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NODE_NUMBERS)])
    return f"""WITH {Q.FEAT}, facts AS (SELECT {facts} FROM feat),
      entries AS (SELECT eventid, {first} + {VECTOR_SIZE} AS size, [{", ".join(parts)}]
        || list_transform(range({VECTOR_SIZE}), lambda k: {{'i': {first} + k, 'v': {start}}}) AS l FROM feat, facts)
      SELECT eventid, size, array_to_string(list_transform(list_filter(l, lambda x: x.v IS NOT NULL AND x.v <> 0),
        lambda x: x.i || ':' || CAST(round(x.v * 1000000) AS BIGINT)), ' ') AS entries FROM entries"""


@query("e22_node_block", "eventid long, size int, entries string", _node_block_sql())
def e22_block(s, d):
    events = features.temporal(T.featured_incidents(s, d)).withColumns({
        "claimed": F.col("eventid") % 2 == 0, "suicide": F.col("eventid") % 7 == 0, "success": F.col("nkill") > 0})
    events = stage_table(events.select("eventid", "city", *NODE_CLASSES, *NODE_NUMBERS, *NODE_FLAGS))
    vectors = embed.fit_word_vectors(events.select(F.array("city").alias("tokens")), "tokens", VECTOR_SIZE)
    block = encode.node_block(events, "eventid", NODE_CLASSES, NODE_NUMBERS, list(NODE_FLAGS), vectors, "city", VECTOR_SIZE)
    cells = F.zip_with("indices", "values", lambda i, v: F.concat(
        i.cast("string"), F.lit(":"), F.round(v * 1000000).cast("long").cast("string")))
    return block.select("eventid", "size", F.array_join(cells, " ").alias("entries"))


@query("e23_non_finite", "column_name string, has_nan boolean, has_infinity boolean",
       """SELECT 'clean' AS column_name, false AS has_nan, false AS has_infinity UNION ALL
       SELECT 'with_nan', (SELECT bool_or(o_orderkey % 50 = 0) FROM orders), false UNION ALL
       SELECT 'with_infinity', false, (SELECT bool_or(o_orderkey % 70 = 0) FROM orders)""")
def e23(s, d):
    price = F.col("o_totalprice")
    key = F.col("o_orderkey")
    rows = T.table(s, d, "orders").select(
        price.alias("clean"), F.when(key % 50 == 0, float("nan")).otherwise(price).alias("with_nan"),
        F.when(key % 70 == 0, float("-inf")).otherwise(price).alias("with_infinity"),
    )
    return encode.non_finite_check(rows, ["clean", "with_nan", "with_infinity"])
