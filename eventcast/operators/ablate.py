"""Ablation studies: loops on the driver around distributed fits, results as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.operators import evaluate
from eventcast.operators.clean import recent_span
from eventcast.operators.regress import (
    Regressor,
    evaluate_regressor,
    kept,
    model_windows,
    train_regressor,
)
from eventcast.operators.sequences import keep_features, to_vectors
from eventcast.session import result_table

# Smallest panel and window counts for which the recent span is studied.
MIN_ROWS, MIN_TRAIN, MIN_TEST = 100, 50, 10
BASELINE = "Baseline (All Features)"
TWO_WAY = (0.70, 0.0)

# The regressor settings compared with each other, in order.
SETTINGS = [
    Regressor("boosted-depth3", "boosted", {"maxDepth": 3}, "three levels per tree"),
    Regressor("linear-l2", "linear", {"regParam": 0.1}, "ridge penalty"),
    Regressor("boosted-depth2", "boosted", {"maxDepth": 2}, "shallower trees"),
    Regressor("linear-plain", "linear", {"regParam": 0.0}, "penalty 0"),
    Regressor("boosted-few", "boosted", {"maxIter": 5}, "five trees"),
    Regressor("boosted-many", "boosted", {"maxIter": 20}, "twenty trees"),
    Regressor("linear-l1l2", "linear", {"regParam": 0.1, "elasticNetParam": 0.5, "solver": "auto"}, "mixed penalty"),
    Regressor("boosted-slow", "boosted", {"stepSize": 0.05}, "smaller step"),
]


# Feature groups as (name, any part of the lower-cased name, none of these parts),
# or (name, any start of the name as written, None).
GROUP_PARTS = [
    ("Temporal Encoding", ["_sin", "_cos"], []),
    ("IsHoliday", ["holiday"], []),
    ("Lag Features", ["lag"], ["seasonal", "rolling"]),
    ("Seasonal Lag Features", ["seasonal_lag"], []),
    ("Rolling Statistics", ["rolling"], []),
    ("Days Since Last", ["days_since"], []),
    ("Geographic Features", ["region_", "country_"], []),
    ("AttackType Dummies", ["attacktype_"], None),
    ("Target Type Dummies", ["target_type_", "targettype_"], None),
    ("Weapon Type Dummies", ["weapon_type_", "weapontype_"], None),
    ("Casualty Features", ["casualt", "killed", "wounded", "nkill", "nwound"], ["rolling"]),
]
NOT_SHARED = {"Casualty Features": "Lag Features"}  # plain lags stay out of the first; seasonal ones are in


def feature_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns per feature group, by name; empty groups are left out."""
    groups = {}
    for name, parts, barred in GROUP_PARTS:
        if barred is None:
            members = [c for c in columns if c.startswith(tuple(parts))]
        else:
            members = [
                c for c in columns
                if any(p in c.lower() for p in parts) and not any(p in c.lower() for p in barred)
            ]
        members = [c for c in members if c not in groups.get(NOT_SHARED.get(name), [])]
        if members:
            groups[name] = members
    return groups


def _fit_row(vectors: DataFrame, regressor: Regressor) -> dict:
    with kept(vectors):
        model = train_regressor(vectors, regressor)
        return evaluate_regressor(model, vectors, regressor.name).first().asDict()


def feature_ablation(
    panel: DataFrame, by: str, time: str, target: str = "attack_count",
    length: int = S.SEQUENCE_LENGTH, regressor: Regressor = Regressor("Windowed linear"),
) -> DataFrame:
    """All features, then each group left out once: metrics, impact and interpretation."""
    windows, names, _ = model_windows(panel, by, time, target, length, ratios=TWO_WAY)
    rows = []
    with kept(windows):
        for group, members in [(BASELINE, []), *feature_groups(names).items()]:
            positions = [i for i, c in enumerate(names) if c not in members]
            if not positions:
                continue
            metrics = _fit_row(to_vectors(keep_features(windows, positions)).drop("x"), regressor)
            rows.append((group, len(positions), metrics["RMSE"], metrics["MAE"], metrics["R2"]))
    results = result_table(
        panel.sparkSession, rows, "Feature_Group string, Features_Count int, RMSE double, MAE double, R2 double"
    )
    return evaluate.rank_by_impact(evaluate.impact_of_removal(results, "Feature_Group", BASELINE))


def _data_row(panel: DataFrame, by: str, time: str, target: str, length: int, name: str,
              regressor: Regressor, least: Sequence[int] = (0, 1, 1)) -> tuple:
    """(name, samples, sequences, RMSE, MAE, R2); the figures are null with fewer than ``least``
    rows, train windows or test windows."""
    samples = panel.count()
    nothing = (None, None, None)
    if samples < least[0]:
        return name, samples, 0, *nothing
    windows, _, _ = model_windows(panel, by, time, target, length, ratios=TWO_WAY)
    vectors = to_vectors(windows).drop("x")
    with kept(vectors):
        sizes = {r["split"]: r["count"] for r in vectors.groupBy("split").count().collect()}
        if sizes.get("train", 0) < least[1] or sizes.get("test", 0) < least[2]:
            return name, samples, sum(sizes.values()), *nothing
        model = train_regressor(vectors, regressor)
        m = evaluate_regressor(model, vectors, name).first()
        return name, samples, sum(sizes.values()), m["RMSE"], m["MAE"], m["R2"]


_DATA_SCHEMA = "Configuration string, Samples long, Sequences long, RMSE double, MAE double, R2 double"


def span_ablation(
    panel: DataFrame, by: str, time: str, target: str = "attack_count",
    length: int = S.SEQUENCE_LENGTH, months: int = 60,
    regressor: Regressor = Regressor("Windowed linear"),
    least: Sequence[int] = (MIN_ROWS, MIN_TRAIN, MIN_TEST), report_skipped: bool = False,
) -> DataFrame:
    """Full history against the last ``months``. A recent part with fewer than ``least`` rows, train
    windows or test windows has nothing to compare: no rows, or with ``report_skipped`` both rows,
    the recent one without figures and marked as skipped."""
    full = _data_row(panel, by, time, target, length, "Full History", regressor)
    recent = _data_row(recent_span(panel, time, months), by, time, target, length,
                       f"Recent Only (Last {months // 12} Years)", regressor, least)
    rows = [full, recent] if report_skipped or recent[3] is not None else []
    results = result_table(panel.sparkSession, rows, _DATA_SCHEMA)
    base = results.filter(F.col("Configuration") == "Full History").agg(F.min("RMSE")).scalar()
    impact = F.col("RMSE") - base
    return results.withColumns({
        "RMSE_Impact": impact,
        "Interpretation": F.when(F.col("Configuration") == "Full History", "Baseline")
        .when(F.col("RMSE").isNull(), "Skipped: too few rows").when(impact < 0, "Recent patterns")
        .otherwise("Long history needed"),
    })


def length_ablation(
    panel: DataFrame, by: str, time: str, target: str = "attack_count",
    lengths: Sequence[int] = (20, 30, 40), baseline: int = S.SEQUENCE_LENGTH,
    regressor: Regressor = Regressor("Windowed linear"),
) -> DataFrame:
    """Window lengths compared with the study's own baseline length."""
    rows = [
        _data_row(panel, by, time, target, n, f"Sequence Length {n}", regressor) for n in lengths
    ]
    results = result_table(panel.sparkSession, rows, _DATA_SCHEMA)
    label = f"Sequence Length {baseline}"
    base = results.filter(F.col("Configuration") == label).agg(F.min("RMSE")).scalar()
    return results.withColumns({
        "RMSE_Impact": F.col("RMSE") - base,
        "Interpretation": F.when(F.col("RMSE").isNull(), "Skipped: no windows")
        .when(F.col("Configuration") == label, "Baseline").otherwise(""),
    })


def setting_sweep(
    panel: DataFrame, by: str, time: str, target: str = "attack_count",
    length: int = S.SEQUENCE_LENGTH, settings: Sequence[Regressor] = tuple(SETTINGS),
) -> DataFrame:
    """Every regressor setting on the same windows, ranked by RMSE."""
    windows, _, _ = model_windows(panel, by, time, target, length)
    vectors = to_vectors(windows).drop("x")
    rows = []
    with kept(vectors):
        for s in settings:
            m = evaluate_regressor(train_regressor(vectors, s), vectors, s.name).first()
            rows.append((s.name, s.family, str(s.settings), m["RMSE"], m["MAE"], m["R2"], s.description))
    results = result_table(
        panel.sparkSession,
        rows,
        "Architecture string, Model_Type string, Settings string, RMSE double, MAE double, "
        "R2 double, Description string",
    )
    return evaluate.rank_by_rmse(results)
