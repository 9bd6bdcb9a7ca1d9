"""Text queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.functions import text as X
from eventcast.operators import embed
from eventcast.plans import features
from eventcast.session import spread, stage_table
from eventcast.sources import tables as T

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
CLEAN = r"""cleaned AS (
  SELECT doc_id, text, CASE WHEN text IS NULL OR text = 'Unknown' THEN '' ELSE
    trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g')) END AS t
  FROM documents)"""
COUNTED = CLEAN + """,
counted AS (
  SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS text_word_count,
    length(t) AS text_char_count, CASE WHEN length(t) > 0 THEN 1 ELSE 0 END AS has_text FROM cleaned)"""
KEYED = COUNTED + f""",
kept AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda w: length(w) > 3 AND w NOT IN ({STOP})) AS l FROM counted),
firsts AS (
  SELECT doc_id, list_filter(l, lambda w, i: list_position(l, w) = i)[1:5] AS keywords FROM
    (SELECT doc_id, l FROM kept WHERE len(l) < 2000)
  UNION ALL
  SELECT doc_id, list(w ORDER BY i)[1:5] FROM (
    SELECT doc_id, w, min(i) AS i FROM (
      SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM kept WHERE len(l) >= 2000)
    GROUP BY 1, 2) GROUP BY 1),
keyed AS (SELECT * FROM counted LEFT JOIN firsts USING (doc_id))"""


def _docs(s, d):
    return T.documents(s, d)


@query("t1_clean_text", "doc_id long, cleaned string", f"WITH {CLEAN} SELECT doc_id, t AS cleaned FROM cleaned")
def t1(s, d):
    return _docs(s, d).withColumn("cleaned", X.clean_text(F.col("text")))


@query("t2_text_stats", "doc_id long, text_word_count int, text_char_count int, has_text int",
       f"WITH {COUNTED} SELECT * FROM counted")
def t2(s, d):
    return features.text_statistics(_docs(s, d), "text")


@query("t3_keywords", "doc_id long, n_keywords int, first_keyword string, last_keyword string",
       f"WITH {KEYED} SELECT doc_id, len(keywords) AS n_keywords, keywords[1] AS first_keyword, keywords[-1] AS last_keyword FROM keyed")
def t3(s, d):
    found = _docs(s, d).withColumn("k", X.keywords(X.clean_text(F.col("text"))))
    return found.select(
        "doc_id", F.size("k").alias("n_keywords"), F.get("k", F.lit(0)).alias("first_keyword"),
        F.try_element_at("k", F.lit(-1)).alias("last_keyword"),
    )


@query("t4_summary_keywords", "doc_id long, keywords_text string",
       f"WITH {KEYED} SELECT doc_id, coalesce(array_to_string(keywords, ', '), '') AS keywords_text FROM keyed")
def t4(s, d):
    return _docs(s, d).transform(features.text_statistics, "text").transform(features.summary_keywords)


@query("t5_vocabulary_size", "vocabulary long",
       f"WITH {KEYED} SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(keywords) AS w FROM keyed)")
def t5(s, d):
    found = _docs(s, d).transform(features.text_statistics, "text").transform(features.summary_keywords)
    return features.vocabulary_size(found)


@query("t6_process_text", "doc_id long, text_word_count int, text_char_count int, has_text int, keywords_text string",
       f"""WITH {KEYED} SELECT doc_id, text_word_count, text_char_count, has_text,
       coalesce(array_to_string(keywords, ', '), '') AS keywords_text FROM keyed""")
def t6(s, d):
    return features.process_text(_docs(s, d), "text")


@query("d11_text_flags", "flag string, total double, rate r6",
       f"""WITH {COUNTED} SELECT 'has_text' AS flag, sum(has_text) AS total, avg(has_text) AS rate FROM counted
       UNION ALL SELECT 'text_word_count', sum(text_word_count), avg(text_word_count) FROM counted""")
def text_flags(s, d):
    from eventcast.operators.stats import flag_summary

    return flag_summary(features.text_statistics(_docs(s, d), "text"), ["has_text", "text_word_count"])


VECTOR_SIZE = 100


def _start(word: str, k: int) -> str:
    return f"CAST('0x' || substr(md5({word} || ':{k}'), 1, 8) AS BIGINT) / 2147483648.0 - 1.0"


def _vectors(tokens: str, components: list[int], rounds: int = 2, window: int = 5) -> str:
    """CTEs that end in ``vectors`` (word, v<k> ...) from ``tokens`` (text, i, w)."""
    first = ", ".join(f"{_start('word', k)} AS v{k}" for k in components)
    steps = [f"round0 AS (SELECT word, {first} FROM (SELECT DISTINCT word FROM shares))"]
    for r in range(1, rounds + 1):
        sums = ", ".join(f"sum(weight * v{k}) AS v{k}" for k in components)
        steps.append(f"round{r} AS (SELECT s.word, {sums} FROM shares s JOIN round{r - 1} v ON v.word = s.other GROUP BY 1)")
    means = ", ".join("(" + " + ".join(f"round{r}.v{k}" for r in range(1, rounds + 1)) + f") / {rounds} AS v{k}" for k in components)
    joins = " ".join(f"JOIN round{r} USING (word)" for r in range(2, rounds + 1))
    return f"""{tokens},
pairs AS (SELECT a.w AS word, b.w AS other, count(*) AS n FROM tokens a JOIN tokens b ON a.text = b.text AND b.i BETWEEN a.i AND a.i + {window}
  GROUP BY 1, 2),
counts AS (SELECT word, other, sum(n) AS n FROM (SELECT * FROM pairs UNION ALL SELECT other, word, n FROM pairs WHERE word <> other) GROUP BY 1, 2),
sums AS (SELECT word, sum(n) AS total FROM counts GROUP BY 1),
weighed AS (SELECT c.word, c.other, greatest(0.0, ln(CAST(n AS DOUBLE) * (SELECT sum(n) FROM counts) / (CAST(a.total AS DOUBLE) * b.total))) AS weight
  FROM counts c JOIN sums a ON a.word = c.word JOIN sums b ON b.word = c.other),
shares AS (SELECT * FROM (SELECT word, other, CASE WHEN sum(weight) OVER (PARTITION BY word) > 0 THEN weight / sum(weight) OVER (PARTITION BY word)
  WHEN word = other THEN 1.0 ELSE 0.0 END AS weight FROM weighed) WHERE weight > 0),
{", ".join(steps)},
vectors AS (SELECT word, {means} FROM round1 {joins})"""


TOKENS = CLEAN + """, tokens AS (SELECT doc_id AS text, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (
  SELECT doc_id, list_filter(string_split(t, ' '), lambda w: w <> '') AS l FROM cleaned))"""
SHOWN = [0, 1, VECTOR_SIZE - 1]


@query("t7_word_vectors", "word string, size int, " + ", ".join(f"v{k} r6" for k in SHOWN),
       f"WITH {_vectors(TOKENS, SHOWN)} SELECT word, {VECTOR_SIZE} AS size, {', '.join(f'v{k}' for k in SHOWN)} FROM vectors")
def t7(s, d):
    tokens = _docs(s, d).select(X.words(X.clean_text(F.col("text"))).alias("tokens"))
    found = embed.fit_word_vectors(tokens, "tokens", size=VECTOR_SIZE, window=5, staged=False)
    return found.select("word", F.size("vector").alias("size"), *[F.col("vector")[k].alias(f"v{k}") for k in SHOWN])


@query("j6_embedding_lookup", "eventid long, city string, size int, is_zero boolean, v0 r6, v99 r6",
       f"""WITH {Q.INC}, tokens AS (SELECT eventid AS text, 1 AS i, city AS w FROM inc), {_vectors("one AS (SELECT 1)", [0, 99])}
       SELECT eventid, city, {VECTOR_SIZE} AS size, false AS is_zero, v0, v99 FROM inc JOIN vectors ON word = city
       UNION ALL SELECT -eventid, 'no ' || city, {VECTOR_SIZE}, true, 0, 0 FROM inc""")
def j6(s, d):
    # One token per event, as a place name; every vector is looked up by the place, and so are
    # places that no event has.
    events = spread(stage_table(T.incidents(s, d, casualties=False).select("eventid", "city")))
    vectors = embed.fit_word_vectors(events.select(F.array("city").alias("tokens")), "tokens", size=VECTOR_SIZE)
    absent = events.select((-F.col("eventid")).alias("eventid"), F.concat(F.lit("no "), "city").alias("city"))
    found = embed.attach_vectors(events.unionByName(absent), vectors, "city", VECTOR_SIZE)
    return found.withColumns({
        "size": F.size("vector"), "is_zero": F.forall("vector", lambda v: v == 0),
        "v0": F.col("vector")[0], "v99": F.col("vector")[99],
    })
