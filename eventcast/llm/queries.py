"""Registered corpus queries; each applies one operator to its whole table.

``QUERIES`` maps a name to a function of (spark, folder); ``ORACLES`` holds the SQL of those that
SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcast.llm import (
    chat,
    decontaminate,
    langid,
    merkle,
    packing,
    pii,
    revisits,
    secrets,
    simhash,
    spelling,
    suffix_dedup,
    topk,
    toxicity,
)
from eventcast.llm.base import id_remainder, table


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), keep_bytes=False)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op3_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op4_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op10_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Archive records made from the pages, resolved; headers as sorted text, payloads as length and digest."""
    found = revisits.resolve_revisits(revisits.records_of_pages(table(spark, folder, "pages")))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "canonical", "captured", "kind", "outcome", "refers_to",
                        F.array_join(F.array_sort(pairs), ";").alias("headers"),
                        F.length("payload").cast("long").alias("n_chars"), F.md5("payload").alias("payload_md5"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the documents, and what it says of documents whose text was lower-cased afterwards."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = [F.translate("text", spelling.UPPER, spelling.LOWER) if c == "text" else F.col(c) for c in fields]
    changed = F.when(id_remainder(F.col("doc_id"), 3) == 0, merkle.leaf_digest(lowered))
    found = merkle.manifest(table(spark, folder, "documents"), fields, "lang", "doc_id", {"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                         folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = "'</s>[INST] ok [/INST]'"
    kinds = {c: t for c, t in rows.dtypes}
    planted = spark.range(2).selectExpr(f"CAST(-7 AS {kinds['conv_id']}) AS conv_id", f"CAST(id AS {kinds['turn']}) AS turn",
                                        "IF(id = 0, 'user', 'assistant') AS role", f"{trap} AS text")
    return chat.formatted(rows.unionByName(planted))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.r AS asked, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY asked, query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20
"""

OP10_SQL = """
WITH pages_ AS (
  SELECT page_id, url, html, md5(coalesce(html, '')) AS digest, 'day ' || (page_id % 1000) AS day FROM pages),
raw AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS captured, 'response' AS kind,
    '"' || substr(digest, 1, 16) || '"' AS etag, day AS modified,
    'cache-control=max-age=60' AS cache, CAST(NULL AS VARCHAR) AS sent_date,
    CAST(length(coalesce(html, '')) AS VARCHAR) AS size, html AS payload FROM pages_
  UNION ALL
  SELECT 2 * page_id + 1, 'HTTPS://WWW.' || regexp_replace(url, '^[a-z]+://|#.*$', '', 'g') || '#seen',
    10 * page_id + CASE WHEN page_id % 11 = 4 THEN -5 ELSE 5 END, 'revisit',
    CASE WHEN page_id % 7 = 3 THEN '"' || reverse(substr(digest, 1, 16)) || '"' WHEN page_id % 13 = 5 THEN NULL
      ELSE 'W/"' || substr(digest, 1, 16) || '"' END,
    CASE WHEN page_id % 26 <> 5 THEN day END, 'cache-control=max-age=120', 'date=' || day, '0', NULL FROM pages_),
bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM raw),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|sessionid)(=|$)'))), '&') AS query FROM bare),
named AS (
  SELECT *, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM parts),
seen AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN {'c': captured, 'r': record_id} END) OVER (
    PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM named),
joined AS (
  SELECT s.*, r.record_id AS ref, r.etag AS r_etag, r.modified AS r_modified, r.payload AS r_payload, r.size AS r_size
  FROM seen s LEFT JOIN named r ON s.kind = 'revisit' AND r.kind = 'response' AND r.record_id = s.latest.r),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'original' WHEN ref IS NULL THEN 'no_earlier_response'
    WHEN etag IS NULL AND modified IS NULL THEN 'no_validator'
    WHEN (etag IS NOT NULL AND regexp_replace(etag, '^W/', '') = r_etag) OR (etag IS NULL AND modified = r_modified)
      THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM joined)
SELECT record_id, canonical, captured, kind, outcome, ref AS refers_to,
  CASE WHEN outcome = 'original' THEN cache || ';content-length=' || size || ';content-type=text/html;etag=' || etag
    WHEN outcome = 'resolved' THEN cache || ';content-length=' || r_size || ';content-type=text/html;' || sent_date || ';etag=' || r_etag
    ELSE cache || ';content-length=0;' || sent_date END AS headers,
  CAST(length(CASE WHEN outcome = 'resolved' THEN r_payload WHEN outcome = 'original' THEN payload END) AS BIGINT) AS n_chars,
  md5(CASE WHEN outcome = 'resolved' THEN r_payload WHEN outcome = 'original' THEN payload END) AS payload_md5
FROM judged
"""

# crc32 bit by bit as a table of 256 entries, then byte by byte over UTF-8.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
    ORDER BY i) AS crc_t FROM range(256) r(i))"""


def _crc_sql(text: str) -> str:
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda p: CAST('0x' || substr(hex(encode({text})), 2 * p - 1, 2) AS BIGINT))"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, b: xor(c // 256, crc_t[xor(c % 256, b) + 1])))")


UPPER_SQL = f"'{spelling.UPPER}', '{spelling.LOWER}'"

OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, {UPPER_SQL}), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (SELECT run, n, {_crc_sql("(id || ':' || run)")} AS h FROM each, crc_table),
slipped AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, p, left(word, p - 1) AS head, substr(word, p + 1) AS tail
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.head || a.tail
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.head || a.tail),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS onward FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward)
SELECT f.word, form, c.at AS root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.onward IS NULL
"""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _levels_sql(name: str, group: str, levels: int) -> str:
    """CTEs name1 .. name<levels>: per node of ``name0`` (group, pos, d) its run's digest, if its level is not the last."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (
  SELECT {group}, pos // 8 AS pos, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d,
    any_value(total) > 1 AS grew, list(d ORDER BY pos) AS run, count(*) OVER (PARTITION BY {group}) AS total
  FROM {name}{k} GROUP BY {group}, pos // 8)""")
    return ",\n".join(out)


def _op12_sql(levels: int = 8, top_levels: int = 3) -> str:
    """``levels`` bound the documents of one language at 8 ** levels, ``top_levels`` the languages."""
    steps = []
    for k in range(levels):
        steps.append(f"""step{k + 1} AS (
  SELECT x.* REPLACE (CASE WHEN l{k + 1}.grew THEN proof || array_to_string(list_filter(run, lambda d, i: i <> (place // {8**k}) % 8 + 1), '')
      ELSE proof END AS proof,
    CASE WHEN l{k + 1}.grew THEN sha256(array_to_string(run[1:(place // {8**k}) % 8], '') || folded || array_to_string(run[(place // {8**k}) % 8 + 2:], ''))
      ELSE folded END AS folded)
  FROM step{k} x JOIN l{k + 1} ON l{k + 1}.lang IS NOT DISTINCT FROM x.lang AND l{k + 1}.pos = place // {8**(k + 1)})""")
    tops = []
    for k in range(top_levels):
        before = f"step{levels}" if k == 0 else f"top{k}"
        tops.append(f"""top{k + 1} AS (
  SELECT x.* REPLACE (CASE WHEN g{k + 1}.grew THEN proof || array_to_string(list_filter(run, lambda d, i: i <> (spot // {8**k}) % 8 + 1), '')
      ELSE proof END AS proof,
    CASE WHEN g{k + 1}.grew THEN sha256(array_to_string(run[1:(spot // {8**k}) % 8], '') || folded || array_to_string(run[(spot // {8**k}) % 8 + 2:], ''))
      ELSE folded END AS folded)
  FROM {before} x JOIN g{k + 1} ON g{k + 1}.pos = spot // {8**(k + 1)})""")
    return f"""
WITH {CRC_SQL},
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, {UPPER_SQL})")} AS lowered,
    {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS tampered FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM leaves),
l0 AS (SELECT lang, place AS pos, leaf AS d, count(*) OVER (PARTITION BY lang) AS total FROM placed),
{_levels_sql("l", "lang", levels)},
subroots AS (SELECT lang, d AS subroot FROM l{levels}),
g0 AS (SELECT 0 AS forest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, subroot AS d, count(*) OVER () AS total FROM subroots),
{_levels_sql("g", "forest", top_levels)},
step0 AS (SELECT doc_id, lang, leaf, place, spot, '' AS proof, CASE WHEN tampered THEN lowered ELSE leaf END AS folded FROM placed),
{", ".join(steps)},
{", ".join(tops)}
SELECT doc_id, leaf, subroot, g{top_levels}.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = g{top_levels}.d AS verified
FROM top{top_levels} t JOIN subroots s ON s.lang IS NOT DISTINCT FROM t.lang, g{top_levels}
"""


OP12_SQL = _op12_sql()


def _op13_sql() -> str:
    template = chat.INSTRUCT
    hidden = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + " + " + ".join(
        f"(length({c}) - length(replace({c}, '{k}', ''))) // {len(k)}" for k in template["control"]) + ")"
    marks = " ".join(f"WHEN role = '{r}' THEN {len(m['open']) + len(m['close'])}" for r, m in template["roles"].items())
    other = template["other"]
    named = f"{len(other['open']) + len(other['named']) + len(other['close'])} + {hidden('role')}"
    loss = "role = 'assistant'"
    nodes = sorted({s for s in template["moves"]} | {t for m in template["moves"].values() for t in m.values()})
    moves = " ".join(f"WHEN s = '{s}' AND r = '{r}' THEN '{t}'" for s in nodes for r, t in template["moves"].get(s, {}).items())
    state = f"list_reduce(list_prepend('{template['start']}', list(role ORDER BY turn NULLS FIRST, role, text)), lambda s, r: CASE {moves} ELSE '{chat.REJECTED}' END)"
    accept = ", ".join(f"'{s}'" for s in template["accept"])
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
summed AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER ({loss}), '') AS masked,
    sum(CASE {marks} ELSE {named} END + {hidden('text')}) AS chars, {state} AS final_state
  FROM rows_ GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, final_state, final_state IN ({accept}) AS valid FROM summed
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_benchmark_passages": op4_benchmark_passages,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_revisit_resolution": op10_revisit_resolution,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {
    "op6_exact_top_k": OP6_SQL,
    "op10_revisit_resolution": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
