"""Spelling variants against edit distance by hand; the bit-sliced index against plain comparison."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import edge_texts, prose, table

from eventcast.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows) -> Counter:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    return Counter({w: n for w, n in counts.items() if n >= 3})


def plain_variants(words: Counter) -> dict:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found_variants(df) -> dict:
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("alphabet, count", [("ab", 300), ("abé÷ÿ", 600), ("abcdefghijklmnopqrstuvwxyz", 900)])
def test_index_equals_comparison(alphabet, count):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 11))) for _ in range(count)})
    words += [w[:2] + w[3:] for w in words if len(w) > 6 and w[:2] + w[3:] not in set(words)][:40]
    words = sorted(set(words))
    index = spelling.Index(words)
    for size in range(5, 12):
        asked = [w for w in words if len(w) == size]
        if not asked:
            continue
        letters = np.array([[ord(c) for c in w] for w in asked], np.int64)
        query, word = spelling._members(index.near(letters))
        got = sorted((asked[q], words[w]) for q, w in zip(query.tolist(), word.tolist()))
        assert got == sorted((a, w) for a in asked for w in words if one_edit(a, w))


@pytest.mark.parametrize("block_letters", [1 << 14, 400])
def test_variants_equal_brute_force(spark, block_letters):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    base += ["prefix" * 3 + a + b for a in "abc" for b in "xyz"]  # one hot beginning
    counts = Counter()
    for w in base:
        counts[w] += rng.randrange(3, 200)
        for _ in range(8):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcdéz")
            counts[rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]])] += rng.randrange(3, 40)
    words = Counter({w: n for w, n in counts.items() if len(w) >= 5})
    assert any(n == words[v] for w, n in words.items() for v in words if v != w)  # ties of frequency
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(df, block_letters).collect()}
    want = {}
    for w in words:
        found = [v for v in words if one_edit(w, v)]
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            want[w] = (len(found), words[best], best)
    assert near == want
    assert found_variants(spelling.variants(df.cache())) == plain_variants(words)


def test_documents(spark):
    rng = random.Random(3)
    texts = edge_texts() + [prose(rng, 400, lang) for lang in ("en", "de", "fr")] * 3
    texts += ["Straße STRASSE strasse Strasse strase strase strase"] * 4 + ["abcd abcde abcdef"] * 3
    ids = [*range(len(texts) - 2), None, 3]
    docs = table(spark, texts, ids=ids)
    assert found_variants(spelling.group_variants(docs)) == plain_variants(plain_words(list(zip(ids, texts))))


def test_one_word_slips_in_one_of_97_documents(spark):
    docs = table(spark, ["slipping"] * 500)
    words = {r["word"]: r["n"] for r in spelling.vocabulary(docs, rarest=1).collect()}
    assert words == dict(Counter(
        "slipping" if (h := zlib.crc32(f"{i}:slipping".encode())) % 97 else "slipping"[:h % 8] + "slipping"[h % 8 + 1:]
        for i in range(500)))
    assert len(words) > 1


def test_chains_of_forms(spark):
    words = [("a" * k, 2**k) for k in range(5, 30)]
    found = found_variants(spelling.variants(spark.createDataFrame(words, "word string, n long").cache()))
    assert {w: f[1] for w, f in found.items()} == {w: "a" * 29 for w, _ in words}
    assert found["a" * 29] == (None, "a" * 29, 2**29, 1, None)


def test_nothing(spark):
    assert spelling.group_variants(table(spark, []).limit(0)).collect() == []
    assert spelling.group_variants(table(spark, [None, "", "abcd abcd abcd", "lonely"])).collect() == []
