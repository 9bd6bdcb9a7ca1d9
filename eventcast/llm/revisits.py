"""Not-modified revisit records of web archives, resolved to the responses they confirm.

An as-of join by canonical URL finds the latest earlier full response of every revisit. The revisit is
resolved if its validators agree with that response; then it takes over the payload, and the stored
headers are updated with those a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.session import stage_table

# Headers that describe the stored body or one connection; a 304 answer must not replace them.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding",
                "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "set-cookie")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, query parameters
    sorted and without tracking ones; scheme and fragment do not count. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def latest_before(events: DataFrame, key: str, order: list[str], offers: Column, carry: list[str]) -> DataFrame:
    """``events`` with ``_slot``, ``_latest`` (the ``order`` and ``carry`` columns, as a struct, of the latest
    earlier row of the same ``key`` for which ``offers`` holds, or null) and ``_far`` (that row is in another slot).

    ``order`` must be unique within a key. Rows are laid out by range of (key, order) into a written table, so a key
    of any size spreads over slots. Only the first key of a slot can continue from earlier slots, hence
    there are at most as many carried values as slots, and broadcasting them is bounded if ``carry`` is of fixed size.
    """
    slots = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    laid = stage_table(events.repartitionByRange(slots, key, *order).withColumn("_slot", F.spark_partition_id()))
    offered = F.when(offers, F.struct(*order, *carry))
    per_slot = laid.groupBy(key, "_slot").agg(F.max(offered).alias("_most"))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.withColumn("_carried", F.max("_most").over(earlier)).filter("_carried is not null").select(
        F.col(key).alias("_key"), F.col("_slot").alias("_at"), "_carried")
    inside = Window.partitionBy("_slot", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = laid.withColumn("_own", F.max(offered).over(inside))
    found = found.join(F.broadcast(carried), (F.col("_slot") == F.col("_at")) & (F.col(key) == F.col("_key")), "left")
    return found.withColumn("_latest", F.coalesce("_own", "_carried")).withColumn(
        "_far", F.col("_own").isNull() & F.col("_carried").isNotNull()).drop("_own", "_carried", "_key", "_at")


def _digest(value: Column) -> Column:
    """A validator of any length as 32 bytes; null stays null."""
    return F.unhex(F.sha2(value, 256))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def _entries(headers: Column) -> Column:
    return F.array_sort(F.map_entries(headers))


def _lower_names(headers: Column) -> Column:
    """Headers by name in lower case; of names that differ by case only, the first in order counts. Null is empty."""
    named = F.transform(_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    named = F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>"))
    names = F.transform(named, lambda e: e["key"])
    return F.map_from_entries(F.filter(named, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def _judged(named: DataFrame) -> DataFrame:
    """Revisits with outcome, refers_to and the slot and distance of the as-of join; no payload moves here."""
    known = F.col("canonical").isNotNull() & F.col("captured").isNotNull() & F.col("record_id").isNotNull()
    is_revisit = F.col("kind") == "revisit"
    keys = named.filter(known).select(
        "record_id", "canonical", "captured", "kind", "_same", _digest(_weak(F.col("etag"))).alias("_tag"),
        _digest(F.col("last_modified")).alias("_date"), F.when(is_revisit, F.col("headers")).alias("headers"))
    matched = latest_before(keys, "canonical", ["captured", "record_id", "_same"], F.col("kind") == "response", ["_tag", "_date"])
    tagged, dated = F.col("_tag").isNotNull(), F.col("_date").isNotNull()
    agrees = F.when(tagged, F.col("_tag") == F.col("_latest._tag")).otherwise(F.col("_date") == F.col("_latest._date"))
    outcome = (F.when(F.col("_latest").isNull(), "no_earlier_response").when(~tagged & ~dated, "no_validator")
               .when(agrees, "resolved").otherwise("validator_mismatch"))
    matched = matched.filter(is_revisit).select(
        "record_id", "canonical", "captured", "kind", outcome.alias("outcome"),
        F.col("_latest.record_id").alias("refers_to"), F.col("_latest.captured").alias("_from"),
        F.col("_latest._same").alias("_as"), "headers", "_slot", "_far")
    return stage_table(matched)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (record_id, url, captured, kind, etag, last_modified, headers map, payload) with outcomes, a row for a row.

    Returns record_id, canonical, captured, kind, outcome, refers_to, headers, payload. Outcomes are ``original`` for
    kind ``response``; for kind ``revisit`` they are ``resolved``, ``no_earlier_response``, ``no_validator`` or
    ``validator_mismatch``; rows of other kinds or none stay as they are, as ``other_kind``. Entity tags compare weakly; a
    tag decides over the date. Only resolved revisits get a payload and merged headers, whose names are in lower case;
    the others keep their own headers. Equal capture times are ordered by record_id, and records that repeat an id by a
    digest of their content; equal records stand for each other. Rows without url, time or id take no part in the
    join: responses stay as they are, revisits have no earlier response.

    The as-of join moves no payloads: it compares digests of the validators. Payloads are shuffled once, for the
    revisits that take them over.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "captured", "kind", "etag",
                           "last_modified", "headers", "payload")
    # Tells apart records that repeat an id: equal only for equal records.
    same = F.sha2(F.concat_ws(",", *[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in (
        "canonical", "kind", "etag", "last_modified", "payload")], F.sha2(F.to_json(_entries(F.col("headers"))), 256)), 256)
    named = named.withColumn("_same", F.unhex(same))
    columns = ["record_id", "canonical", "captured", "kind", "outcome", "refers_to", "headers", "payload"]
    judged = _judged(named)

    # A response that revisits of other slots confirm goes to each of these slots too, so no task gets more than
    # a slot holds. There are fewer such pairs than slots: each is the first key of its slot.
    resolved = judged.filter("outcome = 'resolved'").withColumn("_part", F.when(F.col("_far"), F.col("_slot")).otherwise(-1))
    which = ["refers_to", "_from", "_as"]
    far = resolved.filter("_far").groupBy(*which).agg(F.collect_set("_slot").alias("_parts"))
    responses = named.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("captured").alias("_from"), F.col("_same").alias("_as"),
        F.col("headers").alias("_stored"), F.col("payload").alias("_body"))
    responses = responses.join(F.broadcast(far), which, "left").withColumn("_part", F.explode(
        F.concat(F.array(F.lit(-1)), F.coalesce("_parts", F.array().cast("array<int>"))))).drop("_parts")
    # The hint keeps the plan the same at every size.
    once = responses.groupBy(*which, "_part").agg(F.first("_stored").alias("_stored"), F.first("_body").alias("_body"))
    joined = resolved.join(once.hint("merge"), [*which, "_part"], "left")
    fresh = F.map_filter(_lower_names(F.col("headers")), lambda name, _: ~name.isin(*KEPT_HEADERS))
    stays = F.map_filter(_lower_names(F.col("_stored")), lambda name, _: ~F.array_contains(F.map_keys(fresh), name))
    joined = joined.withColumn("headers", F.map_concat(stays, fresh)).withColumnRenamed("_body", "payload").select(*columns)

    no_id = F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to")
    no_payload = F.lit(None).cast(records.schema["payload"].dataType).alias("payload")
    others = judged.filter("outcome <> 'resolved'").withColumn("payload", no_payload).select(*columns)
    unknown = F.col("canonical").isNull() | F.col("captured").isNull() | F.col("record_id").isNull()
    apart = named.filter("kind = 'revisit'").filter(unknown).select(
        "record_id", "canonical", "captured", "kind", F.lit("no_earlier_response").alias("outcome"), no_id, "headers",
        no_payload)
    originals = named.filter("kind = 'response'").select(
        "record_id", "canonical", "captured", "kind", F.lit("original").alias("outcome"), no_id, "headers", "payload")
    strange = named.filter(F.col("kind").isNull() | ~F.col("kind").isin("response", "revisit")).select(
        "record_id", "canonical", "captured", "kind", F.lit("other_kind").alias("outcome"), no_id, "headers", "payload")
    return originals.unionByName(joined).unionByName(others).unionByName(apart).unionByName(strange)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from (page_id, url, html): a full response per page and a later not-modified answer.

    The answer names the page by another form of its URL. Of some pages it carries another entity tag, of some
    it was captured before the response, of some it has only a date or no validator.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    page = F.col("page_id")
    date = F.concat(F.lit("day "), page % 1000)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    response = pages.select(
        (2 * page).alias("record_id"), "url", (10 * page).alias("captured"), F.lit("response").alias("kind"),
        tag.alias("etag"), date.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60"),
                     F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string")).alias("headers"),
        F.col("html").alias("payload"))
    sent = F.when(page % 7 == 3, F.concat(F.lit('"'), F.reverse(F.substring(digest, 1, 16)), F.lit('"'))).when(
        page % 13 == 5, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (2 * page + 1).alias("record_id"),
        F.concat(F.lit("HTTPS://WWW."), F.regexp_replace("url", r"^[a-z]+://|#.*$", ""), F.lit("#seen")).alias("url"),
        (10 * page + F.when(page % 11 == 4, -5).otherwise(5)).alias("captured"), F.lit("revisit").alias("kind"),
        sent.alias("etag"), F.when(page % 26 != 5, date).alias("last_modified"),
        F.create_map(F.lit("date"), date, F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"),
                     F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)
