import pytest
from pyspark.sql import functions as F

from eventcast.operators import ablate, evaluate

PAIRS = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "a"), ("b", "z")]


def matrix(spark):
    return evaluate.confusion_matrix(spark.createDataFrame(PAIRS, "t string, p string"), "t", "p")


def test_confusion_has_every_label_and_row_sums(spark):
    rows = matrix(spark).collect()
    assert len(rows) == 16
    support = {label: sum(r["n"] for r in rows if r["truth"] == label) for label in "abcz"}
    assert support == {"a": 3, "b": 2, "c": 1, "z": 0}


def test_normalized_rows_sum_to_one(spark):
    sums = evaluate.normalized_confusion(matrix(spark)).groupBy("truth").agg(F.sum("share").alias("s")).collect()
    found = {r["truth"]: r["s"] for r in sums}
    assert found["a"] == pytest.approx(1) and found["z"] is None


def test_class_report_and_scores(spark):
    report = {r["label"]: r for r in evaluate.class_report(matrix(spark)).collect()}
    assert report["a"]["precision"] == 1.0 and report["a"]["recall"] == pytest.approx(2 / 3)
    assert report["c"]["precision"] == 0.0 and report["c"]["f1"] == 0.0 and report["z"]["support"] == 0
    assert report["weighted avg"]["recall"] == pytest.approx(0.5)
    scores = evaluate.classification_scores(matrix(spark)).first()
    assert scores["accuracy"] == pytest.approx(0.5) and scores["recall"] == pytest.approx(0.5)


def results(spark):
    return spark.createDataFrame(
        [("m1", 10.0, 5.0, 0.1), ("m2", 8.0, 4.0, 0.3), ("m3", 8.05, 4.0, 0.3)], "model string, RMSE double, MAE double, R2 double"
    )


def test_improvement_and_ranking(spark):
    rows = results(spark)
    union = evaluate.compare_models(rows.filter("model <> 'm2'"), rows.filter("model = 'm2'"))
    found = {r["model"]: r["improvement"] for r in evaluate.improvement_over_best_baseline(union).collect()}
    assert found == {"m1": None, "m3": None, "m2": 0.6}
    assert [r["model"] for r in evaluate.rank_by_rmse(rows).collect()] == ["m2", "m3", "m1"]
    assert evaluate.best_row(rows, "model").first()["best_model"] == "m2"
    best = evaluate.best_per_family(
        rows.withColumn("f", F.when(F.col("model") == "m2", "x").otherwise("y")), "f", "model", "x", "y"
    ).first()
    assert best["verdict"] == "similar" and best["second_best"] == "m3"


@pytest.mark.parametrize("delta, meaning", [
    (1.5, "Critical feature group"), (-0.7, "Important feature group"), (0.3, "Moderate contribution"), (0.1, "Minimal impact")])
def test_impact_levels(spark, delta, meaning):
    rows = spark.createDataFrame([("Baseline", 5.0, 2.0), ("x", 5.0 + delta, 2.0)], "g string, RMSE double, MAE double")
    found = {r["g"]: r["Interpretation"] for r in evaluate.impact_of_removal(rows, "g", "Baseline").collect()}
    assert found == {"Baseline": "Baseline", "x": meaning}


def test_summary_report_skips_missing_studies(spark):
    data = spark.createDataFrame([("Full History", 1.0, 10)], "Configuration string, RMSE double, Samples int")
    rows = evaluate.summary_report(None, None, data).collect()
    assert [(r["study"], r["value"], r["note"]) for r in rows] == [("data", 1.0, 10.0)]


def test_feature_groups():
    names = ["month_sin", "is_us_holiday", "attack_count_lag_52", "y_seasonal_lag_4", "y_rolling_mean_4", "days_since_last",
             "region_avg", "attacktype_x", "TargetType_x", "weapontype_y", "total_casualties", "nkill_lag1", "year"]
    groups = ablate.feature_groups(names)
    assert groups["Lag Features"] == ["attack_count_lag_52", "nkill_lag1"]
    assert groups["Seasonal Lag Features"] == ["y_seasonal_lag_4"]
    assert groups["Casualty Features"] == ["total_casualties"]
    assert groups["AttackType Dummies"] == ["attacktype_x"] and "Target Type Dummies" not in groups
    assert not any("year" in members for members in groups.values())
