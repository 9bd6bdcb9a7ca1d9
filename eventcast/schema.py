"""Column roles, explicit schemas and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# Column lists and defaults of the incident model.
CRITICAL_COLUMNS = ["iyear", "imonth", "iday", "country_txt", "region_txt"]
UNKNOWN_FILLED_COLUMNS = ["gname", "attacktype1_txt", "targtype1_txt", "weaptype1_txt"]
TEXT_COLUMNS = [
    "country_txt", "region_txt", "provstate", "city",
    "gname", "attacktype1_txt", "targtype1_txt", "weaptype1_txt",
]
KEPT_COLUMNS = [
    "eventid", "date", "iyear", "imonth", "iday", "country_txt", "region_txt", "provstate",
    "city", "latitude", "longitude", "attacktype1_txt", "targtype1_txt", "weaptype1_txt",
    "gname", "nkill", "nwound", "summary",
]
LEGACY_NAMES = {
    "iyear": "Year", "imonth": "Month", "iday": "Day", "country_txt": "Country",
    "region_txt": "Region", "attacktype1_txt": "AttackType", "target1": "Target",
    "nkill": "Killed", "nwound": "Wounded", "summary": "Summary", "gname": "Group",
    "targtype1_txt": "Target_type", "weaptype1_txt": "Weapon_type", "motive": "Motive",
}
LONG_VEHICLE_LABEL = (
    "Vehicle (not to include vehicle-borne explosives, i.e., car or truck bombs)"
)
GRAINS = {"region": "region_txt", "country": "country_txt", "attack_type": "attacktype1_txt"}
PANEL_MEASURES = ["attack_count", "total_casualties", "total_killed", "total_wounded"]
SPLIT_RATIOS = (0.70, 0.15, 0.15)
SEQUENCE_LENGTH = 30
SEASONAL_LAG = 52
SEED = 42

RAW_INCIDENT_SCHEMA = T.StructType(
    [T.StructField("eventid", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("iyear", "imonth", "iday")]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in ("latitude", "longitude", "nkill", "nwound")]
    + [T.StructField("summary", T.StringType())]
)


def grain_column(grain: str) -> str:
    """Column of a named grain; anything unknown means region."""
    return GRAINS.get(grain, GRAINS["region"])


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
