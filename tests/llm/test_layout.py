"""Packing, exact search and revisit resolution."""

import datetime
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import prose, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventcast.llm import packing, revisits, topk


def test_plan_fills_sequences_without_gaps():
    rng = np.random.default_rng(1)
    for size, top in ((1, 1), (50, 64), (3000, 64), (3000, 20)):
        counts = Counter(rng.integers(1, top + 1, size).tolist())
        used, ranks = defaultdict(list), defaultdict(list)
        for length, first, end, sequence, offset in packing.plan_slots(dict(counts), 64):
            ranks[length] += range(first, end)
            for k in range(end - first):
                used[sequence + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        total = sum(k * n for k, n in counts.items())
        assert len(used) <= max(1, 1.05 * total / 64 + 2)


def test_cut_texts_have_the_ids_of_whole_texts():
    rng = random.Random(3)
    pieces = ["the", " ", "  ", "\n", " \n", "'s", "don't", "é", "漢字", "😀", "12", "...", " ", "　", "<|endoftext|>", "Ünd", "\t", "_x"]
    texts = ["".join(rng.choice(pieces) for _ in range(40)) for _ in range(400)] + [prose(rng, 300), ""]
    path = public_tokenizers.path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    for encoder in (packing.Encoder(path, public_tokenizers.path(packing.RANKS)), packing.Encoder(path)):
        found = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
        assert found == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_plain_texts_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    rng = random.Random(4)
    texts = [prose(rng, 200, "de") + "\n \n  x" + prose(rng, 50) + "y" * 300, "z" * 400, "  a" * 100, "\n" * 200 + " b"]
    path = public_tokenizers.path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    found = packing.Encoder(path, public_tokenizers.path(packing.RANKS)).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_documents(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(80)] + [prose(rng, 3000), None]
    rows = packing.pack(table(spark, texts).repartition(7), keep_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist()
        assert ids == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
        assert all(r["length"] == 1024 for r in mine[1:])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(places)]])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(sequences) <= sum(r["length"] for r in rows) // 1024 + 2


def plain_top(rows, k, asks=lambda q: q % 20 == 0):
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if asks(q):
            scored = sorted((-int(a @ b), i) for n, (i, b) in enumerate(good) if n != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block, scale", [(8192, 1.0), (40, 0.05), (40, 50.0)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, scale):
    monkeypatch.setattr(topk, "INDEX_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * scale).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(240, None), (260, [1.0, None] * 4), (280, [float("nan")] * 8), (None, [1.0] * 8), (301, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("number", F.lit("x"))
    found = topk.top_k(table, F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == plain_top(rows, 20)


def test_top_k_of_repeated_ids_and_of_texts_as_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 50, rng.normal(size=6).astype(np.float32).tolist()) for i in range(130)]
    rows += rows[:5]
    for name, ids in (("long", lambda i: i), ("int", lambda i: i), ("string", lambda i: f"k{i}"), ("date", lambda i: datetime.date(2001, 1, 1 + i % 28))):
        mine = [(ids(i), v) for i, v in rows]
        asked = {ids(i) for i in range(0, 50, 20)}
        df = spark.createDataFrame(mine, f"vec_id {name}, embedding array<float>").repartition(4)
        found = topk.top_k(df, F.col("vec_id").isin(*asked))
        assert dict(found.dtypes)["vec_id"] == df.dtypes[0][1] == dict(found.dtypes)["query_id"]
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
        assert got == plain_top(mine, 20, lambda q, asked=asked: q in asked)


def test_top_k_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 32 + 32 * 32)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2", "http://example.com/a/?",
            "http://example.com", None, "http://h:8080//x//"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select(
        "i", revisits.canonical_url(F.col("url")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com/a", "example.com", None, "h:8080//x"]


RECORDS = ("record_id long, url string, captured long, kind string, etag string, last_modified string, "
           "headers map<string,string>, payload string, outcome string")


def test_revisits_take_the_latest_earlier_response(spark):
    r = lambda i, at, kind, etag, day, headers, body: (i, "http://e.com/x", at, kind, etag, day, headers, body, "old")
    rows = [r(1, 10, "response", '"a"', "d1", {"etag": '"a"', "content-type": "t", "age": "1"}, "one"),
            r(2, 20, "response", '"b"', "d2", None, "two"),
            r(3, 15, "revisit", 'W/"a"', None, {"age": "2", "content-type": "bad", "date": "now"}, None),
            r(4, 25, "revisit", '"a"', None, None, None), r(5, 20, "revisit", None, "d2", None, None),
            r(6, 5, "revisit", '"a"', None, None, None), r(7, 30, "revisit", None, None, None, None),
            r(8, None, "revisit", '"b"', None, None, None), r(None, 40, "revisit", '"b"', None, None, None),
            (9, None, 50, "response", None, None, None, "nine", None)]
    found = {x["record_id"]: x for x in revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert len(found) == len(rows)
    assert {k: (v["outcome"], v["refers_to"], v["payload"]) for k, v in found.items()} == {
        1: ("original", None, "one"), 2: ("original", None, "two"), 3: ("resolved", 1, "one"),
        4: ("validator_mismatch", 2, None), 5: ("resolved", 2, "two"), 6: ("no_earlier_response", None, None),
        7: ("no_validator", 2, None), 8: ("no_earlier_response", None, None), None: ("no_earlier_response", None, None),
        9: ("original", None, "nine")}
    assert found[3]["headers"] == {"etag": '"a"', "content-type": "t", "age": "2", "date": "now"}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).collect() == []


def test_repeated_records_other_kinds_and_header_case(spark):
    r = lambda i, at, kind, etag, headers, body: (i, "http://e.com/x", at, kind, etag, None, headers, body, "old")
    response = r(1, 10, "response", '"a"', {"Content-Length": "3", "ETag": '"a"', "etag": "x", "Age": "1"}, "one")
    twin = r(1, 10, "response", '"a"', {"Content-Length": "3"}, "two")
    revisit = r(2, 20, "revisit", '"a"', {"CONTENT-LENGTH": "0", "AGE": "2"}, None)
    rows = [response, response, revisit, revisit, r(3, 30, "request", None, {"X": "y"}, "ask"), r(4, None, None, None, None, "odd")]
    found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert sorted((x["record_id"], x["outcome"], x["payload"]) for x in found) == [
        (1, "original", "one"), (1, "original", "one"), (2, "resolved", "one"), (2, "resolved", "one"),
        (3, "other_kind", "ask"), (4, "other_kind", "odd")]
    assert all(x["headers"] == {"content-length": "3", "etag": '"a"', "age": "2"} for x in found if x["record_id"] == 2)
    assert next(x for x in found if x["record_id"] == 3)["headers"] == {"X": "y"}
    # Two different responses of one id and time: one of them, the same for both revisits.
    found = revisits.resolve_revisits(spark.createDataFrame([response, twin, revisit, revisit], RECORDS)).collect()
    assert len(found) == 4 and len({x["payload"] for x in found if x["record_id"] == 2}) == 1


def test_one_url_with_most_captures(spark):
    rng = random.Random(2)
    rows, want, last = [], {}, None
    for i in range(3000):
        kind = "response" if rng.random() < 0.1 else "revisit"
        rows.append((i, "http://hot.com/", i // 3, kind, '"t"', None, {}, f"body{i}" if kind == "response" else None, None))
        want[i] = last if kind == "revisit" else None
        last = i if kind == "response" else last
    found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(8)).collect()
    assert {x["record_id"]: x["refers_to"] for x in found} == want
    assert all(x["payload"] == f"body{x['refers_to']}" for x in found if x["outcome"] == "resolved")


@pytest.mark.parametrize("key", ["op6_exact_top_k", "op10_revisit_resolution", "op11_spelling_variants", "op12_merkle_manifest",
                                 "op13_chat_format"])
def test_queries_match_their_sql(spark, key):
    from check_oracle import compare, open_tables

    from eventcast.llm import queries

    folder = "/root/testdata/sf0.001"
    outcome = compare(queries.QUERIES[key](spark, folder), open_tables(folder), queries.ORACLES[key])
    assert outcome.startswith("ok") and outcome != "ok 0", outcome
