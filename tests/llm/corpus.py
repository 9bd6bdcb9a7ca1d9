"""Small document tables of the corpus tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, key string, fp long, row long, spans string"
WORDS = {
    "en": "the and of that with this from have thing water stone under river bright".split(),
    "de": "der die und nicht mit eine werden straße über schön zeit heute wieder".split(),
    "fr": "le la les des une avec être élève où jour pour très encore".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "ing", "ed", "er", str(rng.randrange(3)) * 0]) for _ in range(n))


def rows(texts, langs=None, ids=None):
    langs = langs or ["en"] * len(texts)
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, lang, "s", None if t is None else len(t), 0.5, 7, "k", 1, 2, "x") for i, t, lang in zip(ids, texts, langs)]


def table(spark, texts, langs=None, ids=None):
    return spark.createDataFrame(rows(texts, langs, ids), SCHEMA)


def edge_texts() -> list:
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [None, "", " \n\t ", "a", "ß é 漢字 😀", "123 !!!", long, long, prose(rng, 120), "x" * 5000, "0" * 3000,
            "same text again", "same text again", "<|endoftext|> in a text", "\x00\x01 nul"]
