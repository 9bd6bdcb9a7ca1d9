"""Evaluation, ranking, comparison and classification queries.

The result tables under test come from scoring simple lag models on the weekly panel: model
``lag_k`` predicts the count of k weeks before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.catalog import sqltext as Q
from eventcast.catalog.cleaning import PREDICTED, predicted_type
from eventcast.catalog.registry import query
from eventcast.operators import evaluate, panel
from eventcast.session import stage
from eventcast.sources import tables as T

LAGS = [1, 4, 12, 20, 30, 40, 52]
FEATURE_LABELS = {1: "Baseline (All Features)", 4: "Lag Features", 12: "Rolling Statistics",
                  52: "Seasonal Lag Features"}
DATA_LABELS = {1: "Full History", 52: "Recent Only (Last 5 Years)", 20: "Sequence Length 20",
               30: "Sequence Length 30", 40: "Sequence Length 40"}


def _forecasts(s, d, lags=tuple(LAGS)) -> DataFrame:
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "region_txt")
    dense = panel.fill_missing_periods(weekly, "week_start", "region_txt", "week")
    ordered = Window.partitionBy("region_txt").orderBy("week_start")
    actual = F.col("attack_count").cast("double")
    models = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lag(actual, k).over(ordered).alias("predicted")) for k in lags
    ])
    return (
        dense.select("region_txt", "week_start", actual.alias("actual"), models.alias("m"))
        .select("region_txt", "week_start", "actual", F.inline("m"))
        .filter(F.col("predicted").isNotNull())
        .withColumn("model", F.concat(F.lit("lag_"), F.col("k")))
    )


def _scores(s, d) -> DataFrame:
    return stage(evaluate.score(_forecasts(s, d), by=["k", "model"]))


PREDICTIONS = Q.weekly() + """,
preds AS (""" + " UNION ALL ".join(f"""
  SELECT * FROM (SELECT series, week_start, {k} AS k, 'lag_{k}' AS model, CAST(attack_count AS DOUBLE) AS actual,
    CAST(lag(attack_count, {k}) OVER (PARTITION BY series ORDER BY week_start) AS DOUBLE) AS predicted FROM panel)
  WHERE predicted IS NOT NULL""" for k in LAGS) + ")"
SCORES = PREDICTIONS + f""",
scores AS (SELECT 'lag_' || k AS model, * FROM ({Q.metrics('preds', 'k')}))"""


def _labelled(labels: dict[int, str], name: str) -> str:
    cases = " ".join(f"WHEN k = {k} THEN '{v}'" for k, v in labels.items())
    return f"(SELECT CASE {cases} END AS {name}, * FROM scores WHERE k IN ({', '.join(map(str, labels))}))"


def _label(scores: DataFrame, labels: dict[int, str], name: str) -> DataFrame:
    mapping = reduce(lambda c, kv: c.when(F.col("k") == kv[0], kv[1]), labels.items(), F.when(F.lit(False), ""))
    return scores.filter(F.col("k").isin(list(labels))).withColumn(name, mapping)


FEATURE = f"""feature AS (SELECT f.*, "RMSE" - (SELECT "RMSE" FROM scores WHERE k = 1) AS "RMSE_Impact",
  "MAE" - (SELECT "MAE" FROM scores WHERE k = 1) AS "MAE_Impact"
  FROM {_labelled(FEATURE_LABELS, 'Feature_Group')} f)"""
DATA = f"data AS {_labelled(DATA_LABELS, 'Configuration')}"


def _feature(s, d) -> DataFrame:
    return evaluate.impact_of_removal(
        _label(_scores(s, d), FEATURE_LABELS, "Feature_Group"), "Feature_Group", FEATURE_LABELS[1]
    )


def _data(s, d) -> DataFrame:
    return _label(_scores(s, d), DATA_LABELS, "Configuration")


METRICS = "n long, RMSE r6, MAE r6, MSE r6, R2 r6"


@query("h1_score", f"model string, {METRICS}", f"WITH {SCORES} SELECT * FROM scores")
def h1(s, d):
    return _scores(s, d)


@query("h1_score_by_series", f"region_txt string, model string, {METRICS}",
       f"WITH {PREDICTIONS} SELECT series AS region_txt, * FROM ({Q.metrics('preds', 'series, model')})")
def h1_series(s, d):
    return evaluate.score(_forecasts(s, d), by=["region_txt", "model"])


TYPED = """comparison AS (SELECT model, "RMSE", "MAE", "R2",
  CASE WHEN k IN (1, 4, 12) THEN 'Baseline' ELSE 'Learned' END AS type FROM scores)"""


def _comparison(s, d):
    scores = _scores(s, d)
    early = F.col("k").isin(1, 4, 12)
    return evaluate.compare_models(scores.filter(early), scores.filter(~early))


@query("u2_model_comparison", "model string, type string, RMSE r6, MAE r6, R2 r6",
       f"WITH {SCORES}, {TYPED} SELECT * FROM comparison")
def u2(s, d):
    return _comparison(s, d)


@query("h2_improvement", "model string, type string, RMSE r6, improvement double",
       f"""WITH {SCORES}, {TYPED}, best AS (SELECT min("RMSE") AS b FROM comparison WHERE type = 'Baseline')
       SELECT model, type, "RMSE", CASE WHEN type <> 'Baseline' THEN round((b - "RMSE") / b * 100, 1) END AS improvement
       FROM comparison, best""")
def h2(s, d):
    return evaluate.improvement_over_best_baseline(_comparison(s, d))


@query("h3_model_to_model", "model string, reference string, reference_RMSE r6, improvement r6, verdict string",
       f"""WITH {SCORES} SELECT model, 'lag_4' AS reference, b AS "reference_RMSE", (b - "RMSE") / b * 100 AS improvement,
       CASE WHEN "RMSE" < b THEN 'better' ELSE 'not better' END AS verdict
       FROM scores, (SELECT "RMSE" AS b FROM scores WHERE k = 4) WHERE k <> 4""")
def h3(s, d):
    return evaluate.improvement_over(_scores(s, d), "lag_4")


MEANING = """CASE WHEN "Feature_Group" = 'Baseline (All Features)' THEN 'Baseline'
  WHEN abs("RMSE_Impact") > 1.0 THEN 'Critical feature group' WHEN abs("RMSE_Impact") > 0.5 THEN 'Important feature group'
  WHEN abs("RMSE_Impact") > 0.2 THEN 'Moderate contribution' ELSE 'Minimal impact' END"""


@query("h6_impact", "Feature_Group string, RMSE_Impact r6, MAE_Impact r6, Interpretation string",
       f'WITH {SCORES}, {FEATURE} SELECT *, {MEANING} AS "Interpretation" FROM feature')
def h6(s, d):
    return _feature(s, d)


@query("h10_summary_report", "study string, item string, value r6, note r6",
       f"""WITH {SCORES}, {FEATURE}, {DATA}
       SELECT 'feature baseline' AS study, "Feature_Group" AS item, "RMSE" AS value, NULL AS note FROM feature WHERE k = 1
       UNION ALL SELECT * FROM (SELECT 'feature impact', "Feature_Group", "RMSE_Impact", NULL FROM feature WHERE k <> 1
         ORDER BY "RMSE_Impact" DESC, "Feature_Group" LIMIT 5)
       UNION ALL SELECT * FROM (SELECT 'architecture', model, "RMSE", "MAE" FROM scores ORDER BY "RMSE", model LIMIT 5)
       UNION ALL SELECT 'data', "Configuration", "RMSE", n FROM data""")
def h10(s, d):
    scores = _scores(s, d)
    feature = evaluate.impact_of_removal(
        _label(scores, FEATURE_LABELS, "Feature_Group"), "Feature_Group", FEATURE_LABELS[1])
    return evaluate.summary_report(
        feature, scores.withColumnRenamed("model", "Architecture"),
        _label(scores, DATA_LABELS, "Configuration").withColumnRenamed("n", "Samples"),
    )


@query("h11_span_rows", "Configuration string, RMSE r6",
       f"""WITH {SCORES}, {DATA} SELECT * FROM data WHERE regexp_matches("Configuration", 'History|Recent')""")
def h11_span(s, d):
    return evaluate.span_rows(_data(s, d))


@query("h11_length_rows", "Configuration string, length int, RMSE r6, is_best boolean",
       f"""WITH {SCORES}, {DATA} SELECT *, k AS length, k = (SELECT arg_min(k, "RMSE") FROM data WHERE k IN (20, 30, 40)) AS is_best
       FROM data WHERE k IN (20, 30, 40)""")
def h11_length(s, d):
    return evaluate.length_rows(_data(s, d))


@query("h11_without_baseline", "Feature_Group string, RMSE_Impact r6",
       f"WITH {SCORES}, {FEATURE} SELECT * FROM feature WHERE k <> 1")
def h11_plain(s, d):
    return evaluate.without_baseline(_feature(s, d), "Feature_Group")


@query("h12_impact_sign", "Feature_Group string, sign string",
       f"""WITH {SCORES}, {FEATURE} SELECT *, CASE WHEN "RMSE_Impact" < 0 THEN 'negative' ELSE 'non-negative' END AS sign FROM feature""")
def h12(s, d):
    return evaluate.impact_sign(_feature(s, d))


@query("h13_interpretation", "Configuration string, Interpretation string, highlight boolean",
       f"""WITH {SCORES}, {DATA}, i AS (SELECT *, CASE WHEN k = 1 THEN 'Baseline' WHEN k = 20 THEN 'short' ELSE '' END AS "Interpretation" FROM data)
       SELECT *, "Interpretation" <> '' AND contains("Configuration", '20') AS highlight FROM i""")
def h13(s, d):
    told = _data(s, d).withColumn(
        "Interpretation", F.when(F.col("k") == 1, "Baseline").when(F.col("k") == 20, "short")
    )
    return evaluate.with_interpretation(told)


@query("h14_actual_vs_predicted", "region_txt string, week_start date, actual double, lag_1 double, lag_4 double, lag_52 double",
       f"""WITH {PREDICTIONS} SELECT series AS region_txt, week_start, actual,
       max(predicted) FILTER (WHERE k = 1) AS lag_1, max(predicted) FILTER (WHERE k = 4) AS lag_4,
       max(predicted) FILTER (WHERE k = 52) AS lag_52 FROM preds WHERE k IN (1, 4, 52) GROUP BY 1, 2, 3""")
def h14(s, d):
    return evaluate.actual_vs_predicted(
        _forecasts(s, d, (1, 4, 52)), "region_txt", "week_start", ["lag_1", "lag_4", "lag_52"]
    )


@query("h19_error_figures", "model string, MAE r6, RMSE r6", f"WITH {SCORES} SELECT * FROM scores WHERE k IN (1, 52)")
def h19(s, d):
    return evaluate.score(_forecasts(s, d, (1, 52)), by=["model"])


# --- rankings -------------------------------------------------------------------------------

@query("k2_rank_by_rmse", "model string, RMSE r6", f"WITH {SCORES} SELECT * FROM scores")
def k2(s, d):
    return evaluate.rank_by_rmse(_scores(s, d))


@query("k3_rank_by_impact", "Feature_Group string, RMSE_Impact r6", f"WITH {SCORES}, {FEATURE} SELECT * FROM feature")
def k3(s, d):
    return evaluate.rank_by_impact(_feature(s, d))


@query("k4_top_rows", "model string, RMSE r6",
       f'WITH {SCORES} SELECT * FROM scores ORDER BY "RMSE" DESC, model LIMIT 5')
def k4(s, d):
    return evaluate.top_rows(_scores(s, d), 5, F.desc("RMSE"), "model")


@query("k5_best_row", "best_model string, best_RMSE r6",
       f'WITH {SCORES} SELECT arg_min(model, "RMSE") AS best_model, min("RMSE") AS "best_RMSE" FROM scores')
def k5(s, d):
    return evaluate.best_row(_scores(s, d), "model")


@query("k6_best_per_family", """first_best string, first_value r6, second_best string, second_value r6,
difference r6, verdict string""",
       f"""WITH {SCORES}, f AS (SELECT arg_min(model, "RMSE") FILTER (WHERE k <= 12) AS first_best,
         min("RMSE") FILTER (WHERE k <= 12) AS first_value, arg_min(model, "RMSE") FILTER (WHERE k > 12) AS second_best,
         min("RMSE") FILTER (WHERE k > 12) AS second_value FROM scores)
       SELECT *, abs(first_value - second_value) AS difference, CASE WHEN abs(first_value - second_value) < 0.1 THEN 'similar'
         WHEN first_value < second_value THEN 'short better' ELSE 'long better' END AS verdict FROM f""")
def k6(s, d):
    families = _scores(s, d).withColumn("family", F.when(F.col("k") <= 12, "short").otherwise("long"))
    return evaluate.best_per_family(families, "family", "model", "short", "long")


# --- classification -------------------------------------------------------------------------

PAIRS = Q.INC + f""",
pairs AS (SELECT attacktype1_txt AS truth, {PREDICTED} AS predicted, count(*) AS n FROM inc GROUP BY 1, 2),
labels AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs),
matrix AS (SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n
  FROM labels a CROSS JOIN labels b LEFT JOIN pairs p ON p.truth = a.label AND p.predicted = b.label)"""
REPORT = PAIRS + """,
base AS (SELECT label, (SELECT sum(n) FROM matrix WHERE truth = label) AS support,
  (SELECT sum(n) FROM matrix WHERE predicted = label) AS chosen,
  (SELECT sum(n) FROM matrix WHERE truth = label AND predicted = label) AS hits FROM labels),
ratios AS (SELECT label, CASE WHEN chosen = 0 THEN 0 ELSE hits / chosen END AS p,
  CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r, support FROM base),
classes AS (SELECT label, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1,
  support FROM ratios),
weighted AS (SELECT 'weighted avg' AS label, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support) AS support FROM classes)"""


def _pairs(s, d):
    events = T.incidents(s, d, casualties=False).withColumn("predicted_label", predicted_type())
    return evaluate.label_pairs(events, "attacktype1_txt", "predicted_label")


def _matrix(s, d):
    events = T.incidents(s, d, casualties=False).withColumn("predicted_label", predicted_type())
    return evaluate.confusion_matrix(events, "attacktype1_txt", "predicted_label")


@query("h15_classification_scores", "accuracy r6, precision r6, recall r6, f1 r6",
       f"""WITH {REPORT} SELECT (SELECT sum(n) FILTER (WHERE truth = predicted) / sum(n) FROM matrix) AS accuracy,
       precision, recall, f1 FROM weighted""")
def h15(s, d):
    return evaluate.classification_scores(_pairs(s, d))


@query("h16_confusion", "truth string, predicted string, n long", f"WITH {PAIRS} SELECT * FROM matrix")
def h16(s, d):
    return _matrix(s, d)


@query("h17_normalized_confusion", "truth string, predicted string, n long, share r6",
       f"WITH {PAIRS} SELECT *, n / sum(n) OVER (PARTITION BY truth) AS share FROM matrix")
def h17(s, d):
    return evaluate.normalized_confusion(_matrix(s, d))


@query("h18_class_report", "label string, precision r6, recall r6, f1 r6, support long",
       f"""WITH {REPORT} SELECT * FROM classes UNION ALL
       SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes UNION ALL SELECT * FROM weighted""")
def h18(s, d):
    return evaluate.class_report(_pairs(s, d))
