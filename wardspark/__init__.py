"""wardspark: visit-anchored event time-series analytics as Spark DataFrame operators.

Modules
-------
functions/   scalar column expressions (unit conversion, baseline creatinine, stage, validity, sentinels)
sources/     scans and sinks (CSV with schema, snapshot files with sentinels, per-hour / per-visit sinks)
operators/   align, staging, snapshot, profile, prep, score, models
plans/       composite pipelines and the registered query catalog (Spark + equivalent SQL)
"""

from wardspark.session import get_session, checkpoint_dir, materialize  # noqa: F401

VISIT = ["subject_id", "hadm_id"]
