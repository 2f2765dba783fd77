"""Loads every query module so that the registry is complete."""

from __future__ import annotations

from wardspark.plans import q_align, q_io, q_models, q_prep, q_profile, q_score, q_snapshot, q_tables  # noqa: F401
from wardspark.plans.registry import ORACLES, QUERIES


def _prepared(fn):
    def run(spark, sf_dir):
        # event times are zone-less (TIMESTAMP_NTZ); hour/week arithmetic must not depend on the caller's
        # zone
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    return {k: _prepared(v) for k, v in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """The hour-by-hour visit snapshot with labels (per-hour file form)."""
    return _prepared(lambda spark, d: q_snapshot.snapshot_df(spark, d, emit_empty=False))(spark, sf_dir)
