"""Item vocabulary, unit conversions and validity bounds as small lookup DataFrames.

Features are named by category for chart items (several item ids pooled into one category) and by item id
for lab items. Lookup tables are of fixed size (49 chart items, 90 lab items, 47 bounds), so broadcasting
them is safe at any data scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's for identical results.
# Chart categories in output order.
CHART_CATEGORIES = [
    "WEIGHT", "HEIGHT", "SYSTOLIC BP", "DIASTOLIC BP",
    "TEMPERATURE", "RESPIRATORY RATE", "HEART RATE", "SPO2",
]
# Chart item id -> unit, grouped by category.
CHART_ITEM_UNITS = {
    "WEIGHT": {762: "kg", 763: "kg", 3580: "kg", 3581: "lbs", 3582: "oz", 226512: "kg", 226531: "lbs", 224639: "kg"},
    "HEIGHT": {920: "in", 1394: "in", 4187: "in", 4188: "cm", 3485: "cm", 3486: "in", 226707: "in", 226730: "cm"},
    "SYSTOLIC BP": {455: "mmHg", 51: "mmHg", 225309: "mmHg", 442: "mmHg", 6701: "mmHg"},
    "DIASTOLIC BP": {8441: "mmHg", 8368: "mmHg", 225310: "mmHg", 8440: "mmHg", 8555: "mmHg"},
    "TEMPERATURE": {678: "F", 677: "C", 223761: "F", 679: "F", 676: "C", 223762: "C", 226329: "C", 227054: "F"},
    "RESPIRATORY RATE": {614: "bpm", 618: "bpm", 619: "bpm", 1635: "bpm", 1884: "bpm", 220210: "bpm",
                         224688: "bpm", 224689: "bpm", 224690: "bpm"},
    "HEART RATE": {211: "bpm", 220045: "bpm"},
    "SPO2": {646: "%", 834: "%", 6719: "%", 220277: "%"},
}
# Unit conversions: (category, unit, scale, shift) -> converted = (value + shift) * scale. Unlisted pairs are unchanged.
#   WEIGHT lbs x 0.453592; WEIGHT oz x 0.0283495; HEIGHT in x 2.54; TEMPERATURE F -> (v - 32) * 5/9
UNIT_CONVERSIONS = [
    ("WEIGHT", "lbs", 0.453592, 0.0),
    ("WEIGHT", "oz", 0.0283495, 0.0),
    ("HEIGHT", "in", 2.54, 0.0),
    ("TEMPERATURE", "F", 5.0 / 9.0, -32.0),
]
# Lab item ids in output order (the 90 most frequent lab items).
LAB_ITEMS = [
    50912, 51006, 51221, 51265, 51301, 51222, 51249, 51248, 51250, 51279, 51277,
    50971, 50983, 50902, 50882, 50868, 50931, 50960, 50970, 50893, 51237, 51274,
    51275, 50820, 51491, 51498, 51244, 51254, 51256, 51146, 51200, 50802, 50804,
    50821, 50818, 50813, 50861, 50878, 51492, 50885, 50863, 51484, 51514, 51478,
    50862, 51508, 51506, 51466, 51464, 51487, 51519, 51516, 51493, 51486, 51476,
    50822, 50808, 50910, 50809, 50911, 50800, 51463, 50954, 50810, 50811, 50824,
    50817, 50812, 50956, 51003, 50806, 50825, 50816, 50867, 51144, 51214, 50826,
    51087, 50828, 50920, 51233, 51082, 51246, 50819, 51143, 51251, 51255, 51137,
    51252, 51100,
]
# Lab items that the modelling data leaves out: estimated GFR, urine bilirubin and blood, ventilator, macrocytes,
# specimen type, urine appearance, microcytes, intubated, nitrite.
LEFT_OUT_ITEMS = [50920, 51464, 51466, 50828, 51246, 50800, 51506, 51252, 50812, 51487]
# Validity bounds [low, high] by chart category or lab item id; None = no bound on that side.
VALIDITY_BOUNDS = {
    "WEIGHT": (None, None), "HEIGHT": (None, None), "SYSTOLIC BP": (30, 305), "DIASTOLIC BP": (20, 180),
    "TEMPERATURE": (29.5, 41.5), "RESPIRATORY RATE": (6, 60), "HEART RATE": (None, None), "SPO2": (60, 100),
    50806: (98, 106), 50902: (98, 106), 50893: (9, 10.5), 50821: (80, 100), 51250: (80, 100),
    51006: (8, 20), 50820: (7.38, 7.44), 50954: (60, 160), 50817: (60, 100), 51279: (4.2, 5.9),
    50863: (36, 92), 50810: (36, 52), 51221: (36, 51), 50818: (35, 45), 50910: (30, 170),
    51301: (3.9, 10.7), 50862: (3.5, 5.5), 50822: (3.5, 5), 50971: (3.5, 5), 51248: (28, 32),
    51275: (25, 35), 50804: (23, 28), 50882: (23, 28), 51265: (150, 350), 50824: (136, 145),
    50983: (136, 145), 50811: (13, 17), 51222: (12, 17), 51274: (11, 13), 50960: (1.5, 2.4),
    50912: (0.7, 1.3), 50885: (0.3, 1.2), 50861: (0, 35), 50878: (0, 35), 50867: (0, 130),
    51003: (0.03, None), 50956: (95, None),
}
# Normal (reference) value per feature, in feature order: 8 chart categories, then the 90 lab items above.
# None = no normal value given.
_NORMALS_IN_ORDER = [
    None, None, 120, 80, 37, 16, 80, 97.5,
    1, 14, 43.75, 250, 7.3, 14.75, 34, 30, 90, 5.05, 13, 4.25, 140.5, 102, 25.5, 10,
    None, 1.95, 3.75, 9.75, 0.95, 12, 37.5, 7.41, 6, 1.016, None, None, None, None,
    None, None, 25.5, 90, 40, None, 17.5, 17.5, 80, 0.75, 64, None, 0.6, None, 4.5,
    None, None, None, None, None, None, 2.5, 4, None, None, 4.25, None, 100,
    None, None, None, None, 110, None, 14.75, 140.5, 97.5, None, 90, 0.03, 102, 37,
    None, 65, None, 250, 500, None, None, None, None, 160, None, None, None,
    None, None, None, None, 20,
]
VALIDITY_MARGIN = 0.5
CREATININE_ITEM = 50912
LABEL_HORIZONS = [6, 12, 24, 36, 48, 72]
# ---------------------------------------------------------------------------------------------------------


def feature_name(key) -> str:
    """Column-safe feature name: chart categories lower-snake, lab items by id."""
    return str(key).lower().replace(" ", "_")


CHART_FEATURES = [feature_name(c) for c in CHART_CATEGORIES]
LAB_FEATURES = [feature_name(i) for i in LAB_ITEMS]
ALL_FEATURES = CHART_FEATURES + LAB_FEATURES
assert len(_NORMALS_IN_ORDER) == len(ALL_FEATURES)
NORMAL_VALUES = {f: (None if v is None else float(v)) for f, v in zip(ALL_FEATURES, _NORMALS_IN_ORDER)}


def normals_table(spark: SparkSession) -> DataFrame:
    """feature, normal (98 fixed rows; null when the feature has no normal value)."""
    return spark.createDataFrame([(f, NORMAL_VALUES[f]) for f in ALL_FEATURES], "feature string, normal double")

_VOCAB_SCHEMA = T.StructType([
    T.StructField("itemid", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
    T.StructField("unit", T.StringType(), True),
    T.StructField("scale", T.DoubleType(), False),
    T.StructField("shift", T.DoubleType(), False),
])


def vocab_rows() -> list[tuple]:
    conv = {(c, u): (s, o) for c, u, s, o in UNIT_CONVERSIONS}
    rows = []
    for cat in CHART_CATEGORIES:
        for item, unit in CHART_ITEM_UNITS[cat].items():
            s, o = conv.get((cat, unit), (1.0, 0.0))
            rows.append((item, "chart", feature_name(cat), unit, s, o))
    for item in LAB_ITEMS:
        rows.append((item, "lab", feature_name(item), None, 1.0, 0.0))
    return rows


def item_vocab(spark: SparkSession) -> DataFrame:
    """itemid, source, feature, unit, scale, shift (139 rows); converted = (value + shift) * scale."""
    return spark.createDataFrame(vocab_rows(), _VOCAB_SCHEMA)


_BOUNDS_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType(), False),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
])


def bounds_rows(margin: float = VALIDITY_MARGIN) -> list[tuple]:
    """feature, accepted low (= low * margin), accepted high (= high * (1 + margin))."""
    out = []
    for k, (lo, hi) in VALIDITY_BOUNDS.items():
        out.append((feature_name(k),
                    None if lo is None else float(lo) * margin,
                    None if hi is None else float(hi) * (1 + margin)))
    return out


def bounds_table(spark: SparkSession, margin: float = VALIDITY_MARGIN) -> DataFrame:
    return spark.createDataFrame(bounds_rows(margin), _BOUNDS_SCHEMA)


def sql_values(rows: list[tuple], cols: list[str], name: str) -> str:
    """Render rows as a SQL ``VALUES`` derived table (for the DuckDB oracle)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return repr(v) + "::DOUBLE"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({', '.join(cols)})"
