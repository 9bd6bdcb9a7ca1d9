import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcast.operators import ablate, embed, regress
from eventcast.operators.sequences import to_vectors
from eventcast.sources import files


@pytest.fixture(scope="module")
def panel(spark):
    start = datetime.date(2001, 1, 1)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        level = 0.0
        for i in range(120):
            level = 0.8 * level + float(rng.normal())
            rows.append((f"s{g}", start + datetime.timedelta(weeks=i), level, float(rng.normal()), level + float(rng.normal()) * 0.1))
    return spark.createDataFrame(
        rows, "g string, t date, attack_count double, total_killed double, noisy_lag_1 double"
    ).persist()


def test_scaler_sees_train_rows_only(panel):
    windows, names, params = regress.model_windows(panel, "g", "t", length=5)
    assert names == ["total_killed", "noisy_lag_1"]
    last = windows.filter("split = 'train'").agg(F.max("target_date")).first()[0]
    seen = panel.filter(F.col("t") <= last).agg(F.max("noisy_lag_1")).first()[0]
    assert params.filter("feature = 'noisy_lag_1'").first()["max"] == seen
    everything = regress.model_windows(panel, "g", "t", length=5, fit_on="all")[2]
    assert everything.filter("feature = 'noisy_lag_1'").first()["max"] == panel.agg(F.max("noisy_lag_1")).first()[0]


def test_learned_model_finds_the_signal_and_survives_storage(spark, panel, tmp_path):
    from pyspark.ml.regression import LinearRegressionModel

    metrics, model = regress.learned_model(panel, "g", "t", length=5)
    # The series is 0.8 times its last value plus noise of deviation 1.
    assert 0.7 < metrics.first()["RMSE"] < 1.3
    windows = to_vectors(regress.model_windows(panel, "g", "t", length=5)[0])
    files.save_model(model, str(tmp_path / "m"))
    again = files.load_model(LinearRegressionModel, str(tmp_path / "m"))
    a = regress.predict(model, windows).agg(F.sum("predicted")).first()[0]
    assert regress.predict(again, windows).agg(F.sum("predicted")).first()[0] == pytest.approx(a)


def test_feature_ablation(panel):
    rows = {r["Feature_Group"]: r for r in ablate.feature_ablation(panel, "g", "t", length=5).collect()}
    assert rows[ablate.BASELINE]["Features_Count"] == 2 and rows[ablate.BASELINE]["RMSE_Impact"] == 0
    assert rows["Lag Features"]["Features_Count"] == 1 and rows["Lag Features"]["RMSE_Impact"] > 0


def test_span_and_length_ablation(panel):
    span = {r["Configuration"]: r for r in ablate.span_ablation(panel, "g", "t", length=5, months=24).collect()}
    assert set(span) == {"Full History", "Recent Only (Last 2 Years)"}
    assert span["Full History"]["Sequences"] == 4 * 115
    assert ablate.span_ablation(panel, "g", "t", length=5, months=1).count() == 0
    lengths = ablate.length_ablation(panel, "g", "t", lengths=[3, 5], baseline=5).collect()
    assert [r["Sequences"] for r in lengths] == [4 * 117, 4 * 115] and lengths[1]["RMSE_Impact"] == 0


def test_setting_sweep_is_ranked(panel):
    settings = [ablate.SETTINGS[0], ablate.SETTINGS[1], ablate.SETTINGS[6]]
    rows = ablate.setting_sweep(panel, "g", "t", length=5, settings=settings).collect()
    assert [r["RMSE"] for r in rows] == sorted(r["RMSE"] for r in rows) and len(rows) == 3


def test_missing_word_gets_the_zero_vector(spark):
    vectors = embed.fit_word_vectors(spark.createDataFrame([(["x"],), (["y"],)], "tokens array<string>"), "tokens", size=8)
    rows = spark.createDataFrame([("x",), ("q",)], "city string")
    found = {r["city"]: r["vector"] for r in embed.attach_vectors(rows, vectors, "city", 8).collect()}
    assert found["q"] == [0.0] * 8 and any(found["x"]) and len(found["x"]) == 8


def plain_vectors(texts, size, window, least, rounds):
    import hashlib
    from collections import Counter

    seen = Counter(w for t in texts for w in t)
    texts = [[w for w in t if seen[w] >= least] for t in texts]
    words = sorted({w for t in texts for w in t})
    at = {w: i for i, w in enumerate(words)}
    n = np.zeros((len(words), len(words)))
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i:i + window + 1]:
                n[at[a], at[b]] += 1
    n = n + n.T - np.diag(np.diag(n))
    sums = n.sum(1)
    with np.errstate(divide="ignore"):
        weights = np.where(n > 0, np.maximum(0, np.log(n * n.sum() / np.outer(sums, sums))), 0)
    whole = weights.sum(1)
    shares = np.where(whole[:, None] > 0, weights / np.where(whole > 0, whole, 1)[:, None], np.eye(len(words)))
    v = np.array([[int(hashlib.md5(f"{w}:{k}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for k in range(size)] for w in words])
    total = 0
    for _ in range(rounds):
        v = shares @ v
        total = total + v
    return {w: total[i] / rounds for w, i in at.items()}


@pytest.mark.parametrize("least", [1, 3])
def test_word_vectors_equal_numpy(spark, least):
    rng = np.random.default_rng(6)
    texts = [[f"w{min(int(x), 40)}" for x in rng.pareto(0.6, rng.integers(0, 30))] for _ in range(80)] + [[], ["only"], ["w0"] * 50]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "tokens array<string>").repartition(5)
    found = {r["word"]: r["vector"] for r in embed.fit_word_vectors(rows, "tokens", size=6, window=3, min_count=least).collect()}
    want = plain_vectors(texts, 6, 3, least, embed.ROUNDS)
    assert set(found) == set(want)
    assert all(np.allclose(found[w], want[w], atol=1e-9) for w in want)


def test_word_vectors_in_many_tiles(spark, monkeypatch):
    """No tile, sum or batch needs all words at once: small ones give the same vectors."""
    for name, value in (("TILE_WORDS", 5), ("TILE_WEIGHTS", 11), ("SUM_WORDS", 4), ("SUM_ROWS", 3)):
        monkeypatch.setattr(embed, name, value)
    texts = [["a", "b", "c"], ["b", "a"], ["d"], ["é", "f", "a", "f"], ["g", "h", "i", "j", "k", "l"], ["l", "a"]]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    found = {r["word"]: r["vector"] for r in embed.fit_word_vectors(rows, "tokens", size=6, window=3).collect()}
    want = plain_vectors(texts, 6, 3, 1, embed.ROUNDS)
    assert set(found) == set(want)
    assert all(np.allclose(found[w], want[w], atol=1e-9) for w in want)


def test_word_vectors_keep_only_their_result_on_disk(spark):
    """Counts, weights and the vectors of single rounds are gone afterwards, and so are the shuffles."""
    from pathlib import Path

    from eventcast import session

    rng = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rng.integers(0, 2000, 40)] for _ in range(150)]
    words = len({w for t in texts for w in t})
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    scratch = Path(session.new_path(spark, "x").removeprefix("file://")).parent
    held = lambda: sum(f.stat().st_size for f in scratch.rglob("*") if f.is_file())
    before = held()
    found = embed.fit_word_vectors(rows, "tokens", size=64, window=3)
    assert held() - before < 1.2 * words * 64 * 8
    assert found.count() == words and found.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == spark.conf.get(
        "spark.sql.execution.arrow.maxBytesPerBatch")


def test_word_vectors_read_once_are_the_same(spark, monkeypatch):
    """Unstaged vectors, by parts of their components and over any number of rounds, are those of the plain version."""
    for name, value in (("TILE_WORDS", 5), ("START_BYTES", 1), ("START_SIZE", 3), ("LONG_ROW", 2), ("SUM_WORDS", 2), ("HASHES", 3)):
        monkeypatch.setattr(embed, name, value)
    texts = [["a", "b", "c", "a"], ["b", "a"], ["d"], ["é" * 50, "f", "a", "f"], ["g", "h", "i", "j", "k", "l"], ["l", "a"]]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    for rounds in (0, 1, 3):
        found = {r["word"]: r["vector"] for r in embed.fit_word_vectors(rows, "tokens", size=7, window=3, rounds=rounds, staged=False).collect()}
        want = plain_vectors(texts, 7, 3, 1, rounds) if rounds else {w: embed._start_values([w.encode()], 0, 7)[0] / 2.0**31 - 1 for t in texts for w in t}
        assert set(found) == set(want)
        assert all(np.allclose(found[w], want[w], atol=1e-9) for w in want)


def test_classifier_learns_a_separable_label(spark):
    from eventcast.operators.encode import assemble

    rows = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 3 * 10.0 + F.col("id") % 7 * 0.1).alias("v"),
        F.when(F.col("id") < 200, "train").otherwise("test").alias("split"),
    )
    found = regress.classify(assemble(rows, ["v"]), "features", "y")
    assert found.filter("y = predicted_code").count() == found.count() == 100
