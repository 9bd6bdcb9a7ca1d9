"""The manifest against a plain tree, row by row."""

import hashlib
import random

import pytest
from corpus import edge_texts, table
from pyspark.sql import functions as F

from eventcast.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in FIELDS)))


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    level, proofs, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 8 * 8:place // 8 * 8 + 8]
            proofs[i].append((place % 8, run[:place % 8] + run[place % 8 + 1:]))
        level = [digest(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return level[0], proofs


def plain_manifest(rows) -> list[tuple]:
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name])
        trees[name] = (members, *plain_tree([m[2] for m in members]))
    root, upper = plain_tree([trees[n][1] for n in names])
    return [(str(m[3]), m[2], trees[n][1], root, proof + upper[i])
            for i, n in enumerate(names) for m, proof in zip(trees[n][0], trees[n][2])]


def found_manifest(df) -> list[tuple]:
    return [(str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [(p["at"], p["others"]) for p in r["proof"]]) for r in df.collect()]


@pytest.mark.parametrize("fanned", [8, 512])
def test_equals_plain_trees(spark, monkeypatch, fanned):
    """With chunks of 8 leaves the butterfly runs over several rounds and ragged ends."""
    monkeypatch.setattr(merkle, "LOCAL_LEVELS", 1 if fanned == 8 else 3)
    monkeypatch.setattr(merkle, "CHUNK", fanned)
    rng = random.Random(1)
    rows = []
    for name, count in (("en", 700), ("de", 65), ("fr", 64), ("é", 9), ("z", 8), (None, 1), ("", 3)):
        rows += [(len(rows) + i, f"t{rng.random()}", name, "s", 5) for i in range(count)]
    rows += [(5, "again", "en", "s", 5), (5, "again", "en", "s", 5), (None, None, "en", None, None), (None, None, "fr", None, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"leaf": F.lit("x"), "root": F.lit(1), "at": F.lit(2)}).repartition(5)
    found = found_manifest(merkle.manifest(docs, FIELDS, "lang", "doc_id"))
    assert sorted(found) == sorted(plain_manifest(docs.collect()))


def test_many_groups_of_one_row(spark):
    docs = spark.createDataFrame([(i, "t", f"l{i}", "s", 1) for i in range(75)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = found_manifest(merkle.manifest(docs, FIELDS, "lang", "doc_id"))
    assert sorted(found) == sorted(plain_manifest(docs.collect()))
    assert {len(f[4]) for f in found} == {3}


def test_fold_and_tampering(spark):
    docs = table(spark, edge_texts() + ["Upper", "lower"], ["en", None, "de"] * 5 + ["en", "en"])
    changed = merkle.leaf_digest([F.lower("text") if c == "text" else F.col(c) for c in FIELDS])
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"changed": changed})
    rows = found.select("doc_id", "leaf", "changed", "root", merkle.fold(F.col("leaf"), F.col("proof")).alias("kept"),
                        merkle.fold(F.col("changed"), F.col("proof")).alias("folded"),
                        merkle.proof_digest(F.col("proof")).alias("digest"), "proof").collect()
    assert all(r["kept"] == r["root"] for r in rows)
    assert all((r["folded"] == r["root"]) == (r["changed"] == r["leaf"]) for r in rows)
    assert {r["doc_id"] for r in rows if r["folded"] != r["root"]} >= {15}
    assert all(r["digest"] == digest(*(o for p in r["proof"] for o in p["others"])) for r in rows)


def test_lone_row_and_no_row(spark):
    one = table(spark, [None], [None])
    (row,) = merkle.manifest(one, FIELDS, "lang", "doc_id").collect()
    assert row["root"] == row["subroot"] == row["leaf"] and row["proof"] == []
    assert merkle.manifest(one.limit(0), FIELDS, "lang", "doc_id").collect() == []
