"""Scalar column expressions (inventory F1–F14). All are native Spark expressions — no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions.vocab import LABEL_HORIZONS

# FIXED VALUES — staging cut points on the creatinine ratio (stage 1, 2, 3), baseline equation constants.
STAGE_CUTS = (1.5, 2.0, 3.0)
FEMALE_FACTOR = 0.742
BLACK_FACTOR = 1.21


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def convert_unit(value, scale, offset) -> Column:
    """converted = (value + offset) * scale (vocabulary columns; identity is scale 1, offset 0)."""
    return (_c(value) + _c(offset)) * _c(scale)


def baseline_creatinine(age, ethnicity, sex) -> Column:
    """F2: (75 / (s * e * 186 * age^-0.203)) ^ (-1/1.154); s = 0.742 for F, e = 1.21 if ethnicity has BLACK."""
    s = F.when(_c(sex) == "F", F.lit(FEMALE_FACTOR)).otherwise(F.lit(1.0))
    e = F.when(_c(ethnicity).contains("BLACK"), F.lit(BLACK_FACTOR)).otherwise(F.lit(1.0))
    denom = s * e * F.lit(186.0) * F.pow(_c(age).cast("double"), F.lit(-0.203))
    return F.pow(F.lit(75.0) / denom, F.lit(-1.0 / 1.154))


def stage_from_ratio(ratio, cuts=STAGE_CUTS) -> Column:
    """ratio >= 3 -> 3, >= 2 -> 2, >= 1.5 -> 1, else 0."""
    r = _c(ratio)
    c1, c2, c3 = cuts
    return (F.when(r >= c3, 3).when(r >= c2, 2).when(r >= c1, 1).otherwise(0)).cast("int")


def gender_code(sex) -> Column:
    """F -> 0, anything else -> 1."""
    return F.when(_c(sex) == "F", 0).otherwise(1).cast("int")


def is_valid(value, low, high) -> Column:
    """accepted when within [low, high] (already widened by the margin); a null bound is open.

    Features without bounds are always valid (both bounds null)."""
    v = _c(value)
    return (F.coalesce(v >= _c(low), F.lit(True)) & F.coalesce(v <= _c(high), F.lit(True)))


def status(value, valid) -> Column:
    """'missing' when no observation, 'invalid' when out of range, else 'ok'."""
    return (F.when(_c(value).isNull(), "missing")
            .when(~_c(valid), "invalid").otherwise("ok"))


def sentinel(value, valid) -> Column:
    """F6 textual form: '?' when empty, '!' when invalid, else the value as text."""
    return (F.when(_c(value).isNull(), "?")
            .when(~_c(valid), "!").otherwise(_c(value).cast("string")))


def concat_ids(a, b) -> Column:
    """CONCAT(a, b), null if either is null."""
    return F.concat(_c(a).cast("string"), _c(b).cast("string"))


def parse_number(c, kind: str = "double") -> Column:
    """F8: int()/float() that yields null instead of failing on a bad value."""
    return F.expr(f"try_cast({c} as {kind})") if isinstance(c, str) else c.try_cast(kind)


def one_hot(label, n: int = 4) -> Column:
    """n-wide 0/1 array of a class index."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x == _c(label)).cast("int"))


def binarize(stage) -> Column:
    """stage > 0."""
    return (_c(stage) > 0).cast("int")


def parse_visit_file(name) -> tuple[Column, Column]:
    """'S12_H34.csv' -> (12, 34)."""
    n = _c(name)
    return (F.regexp_extract(n, r"S(\d+)_H(\d+)", 1).cast("long"),
            F.regexp_extract(n, r"S(\d+)_H(\d+)", 2).cast("long"))


def parse_trial_file(name) -> tuple[Column, Column]:
    """'hpo_<data>_<label hour>.db.csv' -> (data name, label hour)."""
    n = _c(name)
    return (F.regexp_extract(n, r"^hpo_(.+)_(\d+)\.db\.csv$", 1),
            F.regexp_extract(n, r"^hpo_(.+)_(\d+)\.db\.csv$", 2).cast("int"))


def clear_sentinel(c) -> Column:
    """F14 / S2: '?', '!' and '!<value>' -> null, everything else parsed as double."""
    s = _c(c).cast("string")
    return F.when(s.rlike(r"^(\?|!.*)$"), F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def label_columns(horizons=LABEL_HORIZONS, previous: bool = False) -> list[str]:
    p = "p" if previous else ""
    return [f"{p}{k}_{h}" for h in horizons for k in ("tstage", "stage")]
