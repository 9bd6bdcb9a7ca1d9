"""Every operator on empty tables, null and extreme texts, repeated rows, null ids and clashing columns."""

import corpus_pipeline
import pytest
from corpus import SCHEMA, edge_texts, table

from eventcast.llm import decontaminate, langid, packing, pii, secrets, simhash, suffix_dedup, toxicity

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def edges(spark):
    texts = edge_texts()
    ids = [*range(len(texts) - 2), None, 3]  # a null and a repeated id
    return table(spark, texts, ["en", None] * 7 + ["de"], ids).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "same te"), (None, "a benchmark item without an id here")], BENCH)


@pytest.fixture(scope="module")
def net():
    return pii.fit(*pii.labelled_windows(["some text to read"], count=60), steps=2)


PER_ROW = {
    "suffix": lambda d, b, n: suffix_dedup.remove_repeats(d),
    "secrets": lambda d, b, n: secrets.scan(d),
    "simhash": lambda d, b, n: simhash.report(d),
    "toxicity": lambda d, b, n: toxicity.assess(d, d.sparkSession.createDataFrame([(0, 0, 1), (None, 1, None)], LABELS)),
    "pii": lambda d, b, n: pii.scan(d, n),
    "redact": lambda d, b, n: pii.redact(d, n),
    "langid": lambda d, b, n: langid.identify(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(edges, bench, net, name):
    found = PER_ROW[name](edges, bench, net).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in edges.collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(nothing, bench, net, name):
    assert PER_ROW[name](nothing, bench, net).collect() == []


def test_filters_keep_columns(spark, edges, nothing, bench):
    for docs in (edges, nothing):
        for out in (simhash.keep_one(docs), decontaminate.drop_contaminated(docs, bench)):
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
    empty = spark.createDataFrame([], BENCH)
    assert decontaminate.drop_contaminated(edges, empty).count() == edges.count()
    assert decontaminate.passages(nothing, bench).collect() == []
    assert decontaminate.passages(edges, empty).collect() == []


def test_packing_edges(edges, nothing):
    assert packing.pack(nothing).collect() == []
    found = packing.pack(edges).collect()
    whole = [r for r in found if r["start"] == 0]
    assert len(whole) == edges.count()
    assert sum(1 for r in found if r["length"] == 1) >= 2  # null and empty texts: the end token alone


def test_stages_keep_columns(spark, edges, nothing, tmp_path):
    bench = spark.createDataFrame([(1, "some benchmark item of enough length")], BENCH)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes, name
            out.collect()


def test_fits_do_not_depend_on_the_layout_of_repeated_texts(spark, monkeypatch):
    """One text repeated far beyond the sample's bound neither fills the sample nor changes it with the layout."""
    texts = edge_texts() + ["call 0151 or write to a@b.example now"] * 400 + [f"text number {i} about rivers" for i in range(30)]
    docs = table(spark, texts, [["en", "de", "fr"][i % 3] for i in range(len(texts))])
    seen = []
    monkeypatch.setattr(pii, "fit", lambda windows, tags, **more: seen.append((list(windows), None)))
    monkeypatch.setattr(pii, "labelled_windows", lambda texts, **more: (list(texts), None))
    monkeypatch.setattr(langid, "fit", lambda windows, labels, **more: seen.append((list(windows), list(labels))))
    for parts in (1, 7):
        pii.train(docs.repartition(parts), sample=20)
        langid.train(docs.repartition(parts), sample=60)
    assert seen[0] == seen[2] and seen[1] == seen[3]
    assert len(set(seen[0][0])) == len(seen[0][0]) and len(set(zip(*seen[1]))) == len(seen[1][0])
