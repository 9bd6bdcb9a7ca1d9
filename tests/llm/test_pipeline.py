"""The five stages end to end against a plain version of each, document by document."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import prose, table
from test_dedup import plain_edits, plain_fingerprint, plain_groups
from tokenizers import Tokenizer

from eventcast.llm import decontaminate, langid, simhash

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    items = [prose(rng, 18, lang) for lang in ("en", "de", "fr")]
    texts, langs = [], []
    for i in range(66):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(rng, rng.randrange(60, 140), lang)
        if i % 11 == 4:
            text += " " + rng.choice(items) + " " + prose(rng, 20, lang)
        if i % 9 == 2:
            text = f"{text} jane.doe{'x' * (i % 4)}@mail.example.org {prose(rng, 5, lang)}"
        texts.append(text)
        langs.append(lang)
    for i in (3, 3, 7, 20):
        texts.append(texts[i])
        langs.append(langs[i])
    for i in (5, 9):  # near copies
        texts.append(texts[i] + " " + texts[i].split(" ")[0])
        langs.append(langs[i])
    texts += [None, "", "123 456 !!!", prose(rng, 3000, "en")]
    langs += [None, "en", "en", "en"]
    return items, texts, langs


def plain(docs, items, texts):
    """(doc_id -> tokens) of what the stages keep."""
    net = langid.train(docs)
    kept = {}
    for i, text in enumerate(texts):
        if text and re.search(r"[^\W\d_]", text):
            p = langid.document_probabilities(net, pa.array([text]))[0]
            if p.max() >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
                kept[i] = text
    ids = sorted(kept)
    groups = plain_groups([plain_fingerprint(kept[i]) for i in ids], simhash.RADIUS)
    first = {}
    for i, g in zip(ids, groups):
        first.setdefault(g, i)
    kept = {i: kept[i] for i in first.values()}
    index = decontaminate.build_index(items)
    shown = lambda codes: "".join(map(chr, codes))
    kept = {i: t for i, t in kept.items() if not any(
        plain_edits(shown(s), shown(decontaminate.characters(t))) <= b for s, b in zip(index.stretches, index.budgets))}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: len(whole.encode(EMAIL.sub("<EMAIL>", t), add_special_tokens=False).ids) + 1 for i, t in kept.items()}


def test_run_equals_the_plain_stages(spark, corpus, tmp_path):
    items, texts, langs = corpus
    docs = table(spark, texts, langs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain(docs, items, texts)
    assert 30 < len(want) < len(texts) - 10
    found, sequences = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(want.values()) // 1024 + 2
