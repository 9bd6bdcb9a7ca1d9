"""Repeated strings, near-duplicates and benchmark passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from corpus import prose, table

from eventcast.llm import components, decontaminate, simhash, suffix_dedup


def plain_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[s:s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if count[r[s:s + length]] > 1:
                gone[s:s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(11)
    passage, other = prose(rng, 40), prose(rng, 30)
    texts = [prose(rng, 60) + passage + prose(rng, 30) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1][:-3] + "é" + texts[1][-3:], None, "", "short", "ab" * 900, "z" * 1200]
    texts += [prose(rng, 10) + other + prose(rng, 20) + other, other[:120], passage[5:210] + "!", texts[3][7:]]
    return texts


@pytest.mark.parametrize("split, shard, merge", [(2000, 2 << 20, 1 << 20), (3, 4000, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, split, shard, merge):
    monkeypatch.setattr(suffix_dedup, "SPLIT_KINDS", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "MERGE_WINDOWS", merge)
    texts = repeat_texts()
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, texts), length=200).collect()}
    for i, want in enumerate(plain_repeats(texts, 200)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_passages_of_many_words_stay_below_the_length_of_a_string(spark):
    # Repeats of 399, 400 and 401 bytes, all of over 50 words: the contract removes the last two and leaves the first.
    rng = random.Random(21)
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    texts, lost = [], []
    for size in (399, 400, 401):
        passage = words[:size - 1] + chr(ord("p") + size - 399)
        assert len(passage.split()) > 50
        words = words[::-1]
        for _ in range(2):
            texts.append(prose(rng, 70) + str(len(texts)) + passage + str(len(texts)) + prose(rng, 30))
            lost.append(size if size >= 400 else 0)
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    for i, want in enumerate(plain_repeats(texts, 400)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert (r["n_bytes"], r["n_removed"], len(r["text"])) == (len(texts[i]), lost[i], len(texts[i]) - lost[i])


def test_shard_classes_equal_brute_force():
    # Long common passages that go on differently, so that neighbours in suffix order change from one place to the next.
    rng = random.Random(4)
    for letters in ("ab", "abcd "):
        for _ in range(6):
            text = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()  # noqa: B023, E731
            common = [text(rng.randint(100, 400)) for _ in range(4)]
            contents = [b"".join(rng.choice(common)[: rng.randint(1, 400)] + text(rng.randint(1, 9)) for _ in range(4)) + text(60)
                        for _ in range(12)]
            windows = np.array([len(c) - 59 for c in contents])
            times = Counter(c[i:i + 60] for c, n in zip(contents, windows) for i in range(n))
            for segment, at, _, size in zip(*suffix_dedup.shard_repeats(contents, windows, 60)):
                assert size == times[contents[segment][at:at + 60]]


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 600).astype(np.uint8)
    raw[300:500] = raw[:200]
    order, word = suffix_dedup.suffix_array(raw, 100)
    content = raw.tobytes()
    pad = content + bytes(200)
    heads = [pad[i:i + 100] for i in order.tolist()]
    assert heads == sorted(heads)
    found = suffix_dedup.common_prefixes(order, word, np.array([0, 250, 430]), 100)
    for k in range(1, 600):
        a, b = pad[order[k - 1]:order[k - 1] + 100], pad[order[k]:order[k] + 100]
        assert found[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
    ones = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def test_fingerprints_equal_the_plain_ones():
    rng = random.Random(1)
    for text in [prose(rng, n) for n in (1, 3, 4, 5, 40)] + ["", " \n", "É Ä a\tB\nc d", "a b c d " * 30]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def plain_groups(keys, radius):
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if bin(keys[i] ^ keys[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_ball_links_find_every_pair(spark, monkeypatch):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    keys = []
    for c in centres:
        keys.append(c)
        for _ in range(rng.randrange(5)):
            k = rng.choice(keys)
            for _ in range(rng.randrange(1, 6)):
                k ^= 1 << rng.randrange(64)
            keys.append(k)
    keys = sorted(set(keys))
    want = plain_groups(keys, 4)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    nodes = spark.createDataFrame([(k,) for k in signed], "fp long").repartition(5)
    # one pass a bucket; many buckets; several passes in each of many buckets
    for limits in ((4_000_000, 2_000_000), (10, 500), (60, 1)):
        monkeypatch.setattr(simhash, "BUCKET_KEYS", limits[0])
        monkeypatch.setattr(simhash, "PASS_VARIANTS", limits[1])
        roots = {r["key"]: r["root"] for r in components.components(simhash.ball_links(nodes, 4)).collect()}
        got = [roots.get(k, k) for k in signed]
        groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
        assert groups(got) == groups(want)


def test_near_groups_and_the_document_that_stays(spark):
    rng = random.Random(7)
    base = prose(rng, 400)
    texts = [base, base.replace(base.split()[7], "zz", 1), base.upper(), prose(rng, 300), None, "", prose(rng, 200)]
    docs = table(spark, texts, ids=[5, 3, 9, 1, 8, 7, None])
    found = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    assert found[5]["component_id"] == found[9]["component_id"] <= 5
    assert found[7]["component_id"] == found[8]["component_id"] == 7
    assert found[8]["fingerprint"] == "0" * 16
    kept = simhash.keep_one(docs).collect()
    labels = plain_groups([plain_fingerprint(t or "") for t in texts[:6]], 4)
    assert len(kept) == len(set(labels)) + 1  # the row without an id stays
    twice = simhash.keep_one(docs.unionByName(docs)).filter("doc_id is not null").collect()
    assert sorted(r["doc_id"] for r in twice) == sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    found = {r["key"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


def plain_edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def spoiled(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, how = rng.randrange(len(out)), rng.randrange(3)
        if how == 0:
            out[at] = "#"
        elif how == 1:
            del out[at]
        else:
            out.insert(at, "~")
    return "".join(out)


def test_passages_equal_brute_force(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (3, 6, 9, 15, 40)] + ["tiny", "öäü straße ünd wéiter gehts"]
    texts = ["tiny", "not tiny"]
    for _ in range(60):
        item = rng.choice(items[:5] + items[6:])
        part = spoiled(rng, item, rng.randrange(0, max(2, len(item) // 7)))
        texts.append(prose(rng, rng.randrange(30)) + " " + part + " " + prose(rng, rng.randrange(30)))
    texts += [prose(rng, 80) for _ in range(10)] + [None, ""]
    index = decontaminate.build_index(items)
    want = {(0, 5)}
    for row, text in enumerate(texts):
        for stretch, item, budget in zip(index.stretches, index.items, index.budgets):
            pattern = "".join(map(chr, stretch))
            if plain_edits(pattern, "".join(map(chr, decontaminate.characters(text or "")))) <= budget:
                want.add((row, int(item)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, texts)
    rows = decontaminate.passages(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


@pytest.mark.parametrize("kind", ["int", "short", "string", "long"])
def test_short_items_in_padded_texts_and_ids_of_other_types(spark, kind):
    ids = [str(i) if kind == "string" else i for i in range(2)]
    bench = spark.createDataFrame([(ids[0], " tiny "), (ids[1], "a longer item of the benchmark")], f"item_id {kind}, text string")
    texts = ["tiny", " " * 70 + "tiny" + "\n" * 70, "tiny!", " tiny", "x a longer item of the benchmark y"]
    found = decontaminate.passages(table(spark, texts), bench)
    assert dict(found.dtypes)["item_id"] == bench.dtypes[0][1]
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in found.collect() if r["doc_id"] < 4) == [
        (0, ids[0], 0, 4), (1, ids[0], 70, 74), (3, ids[0], 1, 5)]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(table(spark, texts), bench).collect()} == {2}


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    items = [prose(rng, 30) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, [prose(rng, 20) + " " + i + " " + prose(rng, 20) for i in items])
    whole = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.passages(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    monkeypatch.setattr(decontaminate, "TEXT_BLOCK", 128)
    parts = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.passages(docs, bench).collect()}
    assert whole == parts >= {(i, i, 0) for i in range(12)}
