"""Regression and classification metrics, rankings and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.operators.attach import attach
from eventcast.session import stage

# RMSE change above which a feature group has each label, and its labels.
IMPACT_LEVELS = [
    (1.0, "Critical feature group"),
    (0.5, "Important feature group"),
    (0.2, "Moderate contribution"),
]
LOWEST_IMPACT = "Minimal impact"
SIMILAR_RMSE = 0.1


# --- regression -----------------------------------------------------------------------------

def score(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """n, RMSE, MAE, MSE and R2 per group from one aggregation.

    R2 of a constant actual is 1 for an exact prediction and 0 otherwise.
    """
    error = F.col(actual).cast("double") - F.col(predicted).cast("double")
    sums = [
        F.count(error).alias("n"),
        F.sum(error * error).alias("_ss"),
        F.sum(F.abs(error)).alias("_sa"),
        (F.var_pop(F.when(error.isNotNull(), F.col(actual).cast("double"))) * F.count(error)).alias("_st"),
    ]
    row = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    mse = F.try_divide(F.col("_ss"), F.col("n"))
    r2 = F.when(F.col("_st") != 0, 1 - F.try_divide(F.col("_ss"), F.col("_st"))).otherwise(
        F.when(F.col("_ss") == 0, 1.0).when(F.col("_ss").isNotNull(), 0.0)
    )
    return row.select(
        *by, "n", F.sqrt(mse).alias("RMSE"),
        F.try_divide(F.col("_sa"), F.col("n")).alias("MAE"), mse.alias("MSE"), r2.alias("R2"),
    )


def prediction_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))


def metrics_long(metrics: DataFrame, names: Sequence[str] = ("RMSE", "MAE", "MSE", "R2")) -> DataFrame:
    ids = [c for c in metrics.columns if c not in names]
    return metrics.unpivot(ids, list(names), "metric", "value")


def actual_vs_predicted(
    forecasts: DataFrame, by: str, time: str, models: Sequence[str] | None = None
) -> DataFrame:
    """One row per series and date, one prediction column per model."""
    pivoted = forecasts.groupBy(by, time, "actual").pivot("model", list(models) if models else None)
    return pivoted.agg(F.first("predicted"))


# --- rankings and comparisons ---------------------------------------------------------------

def rank_by_rmse(results: DataFrame) -> DataFrame:
    return results.orderBy("RMSE")


def rank_by_impact(results: DataFrame, impact: str = "RMSE_Impact") -> DataFrame:
    return results.orderBy(F.desc(impact))


def top_rows(results: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return results.orderBy(*order).limit(k)


def best_row(results: DataFrame, label: str, value: str = "RMSE") -> DataFrame:
    return results.agg(
        F.min_by(label, value).alias(f"best_{label}"), F.min(value).alias(f"best_{value}")
    )


def best_per_family(
    results: DataFrame, family: str, label: str, first: str, second: str, value: str = "RMSE"
) -> DataFrame:
    """Best of two families side by side, their absolute difference and a verdict."""
    row = results.agg(
        F.min_by(label, F.when(F.col(family) == first, F.col(value))).alias("first_best"),
        F.min(F.when(F.col(family) == first, F.col(value))).alias("first_value"),
        F.min_by(label, F.when(F.col(family) == second, F.col(value))).alias("second_best"),
        F.min(F.when(F.col(family) == second, F.col(value))).alias("second_value"),
    )
    gap = F.abs(F.col("first_value") - F.col("second_value"))
    verdict = (
        F.when(gap < SIMILAR_RMSE, "similar")
        .when(F.col("first_value") < F.col("second_value"), f"{first} better")
        .when(gap.isNotNull(), f"{second} better")
    )
    return row.select("*", gap.alias("difference"), verdict.alias("verdict"))


def compare_models(baselines: DataFrame, learned: DataFrame) -> DataFrame:
    """Both result tables with a type tag."""
    columns = ["model", "RMSE", "MAE", "R2"]
    return baselines.select(*columns, F.lit("Baseline").alias("type")).unionByName(
        learned.select(*columns, F.lit("Learned").alias("type"))
    )


def improvement_over_best_baseline(comparison: DataFrame) -> DataFrame:
    """Percent below the best baseline RMSE, one decimal; null for the baselines."""
    best = comparison.filter(F.col("type") == "Baseline").agg(F.min("RMSE")).scalar()
    gain = F.round((best - F.col("RMSE")) / best * 100, 1)
    return comparison.withColumn(
        "improvement", F.when(F.col("type") != "Baseline", gain)
    )


def improvement_over(results: DataFrame, reference: str) -> DataFrame:
    """Percent change of every model against a stored result, with a verdict."""
    base = results.filter(F.col("model") == reference).agg(F.min("RMSE")).scalar()
    return results.filter(F.col("model") != reference).select(
        "model", "RMSE", F.lit(reference).alias("reference"), base.alias("reference_RMSE"),
        ((base - F.col("RMSE")) / base * 100).alias("improvement"),
        F.when(F.col("RMSE") < base, "better").otherwise("not better").alias("verdict"),
    )


def impact_of_removal(results: DataFrame, label: str, baseline: str) -> DataFrame:
    """Change in RMSE and MAE against the baseline row, and what it means."""
    base = results.filter(F.col(label) == baseline).agg(
        F.struct(F.min("RMSE").alias("RMSE"), F.min("MAE").alias("MAE"))
    ).scalar()
    delta = F.col("RMSE") - base.getField("RMSE")
    meaning = reduce(
        lambda chain, level: chain.when(F.abs(delta) > level[0], level[1]),
        IMPACT_LEVELS,
        F.when(F.col(label) == baseline, "Baseline"),
    ).otherwise(LOWEST_IMPACT)
    return results.select(
        "*", delta.alias("RMSE_Impact"),
        (F.col("MAE") - base.getField("MAE")).alias("MAE_Impact"),
        meaning.alias("Interpretation"),
    )


def is_baseline(label: str) -> Column:
    return F.coalesce(F.lower(F.col(label)).contains("baseline"), F.lit(False))


def summary_report(
    feature: DataFrame | None, architecture: DataFrame | None, data: DataFrame | None, k: int = 5
) -> DataFrame:
    """Long form (study, item, value, note) of the three studies' headlines.

    ``feature`` has Feature_Group, RMSE, RMSE_Impact; ``architecture`` has Architecture, RMSE, MAE;
    ``data`` has Configuration, RMSE, Samples. A missing study adds no rows.
    """
    def rows(df: DataFrame, study: str, item: str, value: str, note: Column) -> DataFrame:
        return df.select(
            F.lit(study).alias("study"), F.col(item).alias("item"),
            F.col(value).cast("double").alias("value"), note.cast("double").alias("note"),
        )

    parts = []
    if feature is not None:
        parts.append(rows(feature.filter(is_baseline("Feature_Group")), "feature baseline",
                          "Feature_Group", "RMSE", F.lit(None)))
        others = top_rows(feature.filter(~is_baseline("Feature_Group")), k,
                          F.desc("RMSE_Impact"), "Feature_Group")
        parts.append(rows(others, "feature impact", "Feature_Group", "RMSE_Impact", F.lit(None)))
    if architecture is not None:
        best = top_rows(architecture, k, "RMSE", "Architecture")
        parts.append(rows(best, "architecture", "Architecture", "RMSE", F.col("MAE")))
    if data is not None:
        parts.append(rows(data, "data", "Configuration", "RMSE", F.col("Samples")))
    return reduce(DataFrame.unionByName, parts)


def span_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("Configuration").rlike("History|Recent"))


def length_rows(results: DataFrame) -> DataFrame:
    """Sequence-length rows with the length taken from the label; the best one is flagged."""
    rows = results.filter(F.col("Configuration").contains("Sequence")).withColumn(
        "length", F.regexp_extract("Configuration", r"(\d+)", 1).cast("int")
    )
    best = rows.agg(F.min_by("length", F.struct("RMSE", "length"))).scalar()
    return rows.withColumn("is_best", F.col("length") == best)


def without_baseline(results: DataFrame, label: str) -> DataFrame:
    return results.filter(~is_baseline(label)).orderBy("RMSE_Impact")


def impact_sign(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "sign", F.when(F.col("RMSE_Impact") < 0, "negative").otherwise("non-negative")
    )


def with_interpretation(results: DataFrame) -> DataFrame:
    """Null interpretation becomes empty; best rows are highlighted."""
    text = F.coalesce(F.col("Interpretation"), F.lit(""))
    highlight = (text != "") & (
        text.contains("Optimal") | text.contains("BEST") | F.col("Configuration").contains("20")
    )
    return results.withColumns({"Interpretation": text, "highlight": highlight})


# --- classification -------------------------------------------------------------------------

def label_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts per (truth, predicted) pair; everything below works on this small table."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long-form matrix over every label seen on either side, zeros included."""
    pairs = stage(label_pairs(df, truth, predicted))
    labels = pairs.select(F.explode(F.array("truth", "predicted")).alias("truth")).distinct()
    # The matrix itself has one row per label pair, so the label array is as small as its side.
    every = labels.agg(F.array_sort(F.collect_set("truth"))).scalar()
    grid = labels.withColumn("predicted", F.explode(every))
    return grid.join(pairs, ["truth", "predicted"], "left").fillna(0, subset=["n"])


def normalized_confusion(matrix: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("truth"))
    return matrix.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def class_report(matrix: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, plus macro and weighted averages."""
    hit = F.col("truth") == F.col("predicted")
    sides = matrix.select(
        F.inline(F.array(
            F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                     F.lit(0).cast("long").alias("chosen"), F.when(hit, F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hits")),
        ))
    ).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("chosen")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), zero)
    classes = sides.select(
        "label", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        "support",
    )
    names = ["precision", "recall", "f1"]
    macro = classes.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return (
        classes.unionByName(macro.select(F.lit("macro avg").alias("label"), *names, "support"))
        .unionByName(weighted.select(F.lit("weighted avg").alias("label"), *names, "support"))
    )


def classification_scores(matrix: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    weighted = class_report(matrix).filter(F.col("label") == "weighted avg")
    accuracy = matrix.agg(F.try_divide(
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double"),
        F.sum("n"),
    )).scalar()
    return weighted.select(accuracy.alias("accuracy"), "precision", "recall", "f1")


def attach_predictions(rows: DataFrame, predictions: DataFrame, row_id: str) -> DataFrame:
    """Predictions joined to their source rows by a stable, unique row id."""
    return rows.join(predictions, row_id)


def attach_holidays(events: DataFrame, codes: DataFrame, holidays: DataFrame) -> DataFrame:
    """Country code by lookup, then 1 when (code, date) is in the holiday calendar, else 0."""
    coded = attach(events, codes, "country_txt")
    marked = holidays.select("country_code", "date").distinct().withColumn("is_holiday", F.lit(1))
    return attach(coded, marked, ["country_code", "date"]).fillna(0, subset=["is_holiday"])
