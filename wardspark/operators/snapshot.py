"""Hour-by-hour visit snapshots (inventory W1–W6, W8, J5, J9–J11, A17, F5/F6).

For every visit and hour h = 1..H the snapshot holds, per feature (chart category or lab item):
  * current  — mean of all values at the greatest time <= h, taken per item id and pooled over the items of
               a category after unit conversion (W1; labs only from time >= 1, the reference's ``time > 0``);
  * prior    — mean of all values of the same visit with time < h plus all values of the subject's earlier
               admissions (strictly smaller start time) (W2, J5);
  * labels   — first non-zero stage event at or after h within each horizon (W3) and the previous label (W4);
and a visit without any current observation at h gets no prior either (W5).

Physical design. Events are first pre-aggregated to (visit, item, hour) with map-side partial aggregation, so
even a visit that holds a large share of all events becomes items x hours rows before any window runs. The
as-of steps are windows over (visit, item) or (visit) ordered by time with ``lead``/``lag``; each row becomes the
interval of hours it is valid for. Intervals are what is shuffled, by visit; hours are exploded behind the shuffle,
where all later grouping by (visit, hour, ...) finds its rows in place. The wide snapshot is one grouping of long rows, cells,
labels and the spine with demographics, by visit and run of hours without a change; hours are exploded from its rows, so
no wide table is joined or shuffled.
Lookup tables (vocabulary, bounds) have a fixed size and are broadcast; nothing that grows with data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.clinical import gender_code, is_valid, label_columns, sentinel
from wardspark.functions.vocab import ALL_FEATURES, LABEL_HORIZONS, bounds_table, item_vocab

VISIT = ["subject_id", "hadm_id"]
DEFAULT_HOURS = 200
ADMISSION_BUCKET_US = 30 * 86400 * 1_000_000   # 30 days, the bucket of the earlier-admissions prefix
LEAST_TASKS = 4
HOURS_PER_TASK = 1_000_000                     # rows of single hours that a task makes of its intervals


def _cols(keys):
    return [F.col(k) for k in keys]


# ---- inputs ------------------------------------------------------------------------------------------------

def convert_events(timed: DataFrame, vocab: DataFrame | None = None, item="itemid", value="valuenum") -> DataFrame:
    """keep vocabulary items, attach feature and source, convert the value (broadcast of a fixed table).

    Output adds ``feature``, ``source`` ('chart'/'lab') and ``cv`` (converted value)."""
    if vocab is None:
        vocab = item_vocab(timed.sparkSession)
    v = vocab.select(F.col("itemid").alias(item), "feature", "source", "scale", "shift")
    return (timed.where(F.col(value).isNotNull())
            .join(F.broadcast(v), on=item, how="inner")
            .withColumn("cv", (F.col(value) + F.col("shift")) * F.col("scale"))
            .drop("scale", "shift"))


def hour_spine(visits: DataFrame, hours: int, keys=VISIT, first: int = 1) -> DataFrame:
    """Every visit x hours first..H (narrow explode, no shuffle)."""
    return visits.withColumn("hour", F.explode(F.sequence(F.lit(first), F.lit(hours))))


def write_intervals(intervals: DataFrame) -> tuple[DataFrame, int]:
    """(rows with ``lo`` <= ``hi``, written once, the number of hours in them)."""
    from wardspark.session import materialize
    held = materialize(intervals.where(F.col("lo") <= F.col("hi")), "intervals")
    return held, held.agg(F.sum(F.col("hi").cast("long") - F.col("lo") + 1)).first()[0] or 0


def tasks_of(rows: int) -> int:
    """Tasks for so many rows of single hours; never one task for all."""
    return max(LEAST_TASKS, -(-rows // HOURS_PER_TASK))


def explode_hours(intervals: DataFrame, keys=VISIT, tasks: int | None = None) -> DataFrame:
    """Rows with ``lo`` and ``hi`` to one row per ``hour``, behind a shuffle of the intervals by visit.

    An interval of a few bytes becomes up to ``hours`` rows, so the shuffle's partitions follow the rows to come and
    not the bytes of the intervals: about ``HOURS_PER_TASK`` rows each. They are counted on the written intervals;
    ``tasks`` gives their number for intervals that ``write_intervals`` has written."""
    if tasks is None:
        intervals, rows = write_intervals(intervals)
        tasks = tasks_of(rows)
    cols = [c for c in intervals.columns if c not in ("lo", "hi")]
    return (intervals.where(F.col("lo") <= F.col("hi")).repartition(tasks, *keys)
            .select(*cols, F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("hour")))


# ---- W1 latest value -----------------------------------------------------------------------------------------

def snapshot_latest(conv: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT, time="time",
                    lab_min_time: int | None = 1) -> DataFrame:
    """Per (visit, hour, feature): sum and count of the values at the latest time <= hour, per item.

    Returns keys, hour, feature, cur_sum, cur_n."""
    ev = conv.where(F.col(time) <= hours)
    if lab_min_time is not None:
        ev = ev.where((F.col("source") != "lab") | (F.col(time) >= lab_min_time))
    # after pre-aggregation a visit holds at most items x hours rows: one repartition by visit is skew-safe
    pre = ev.groupBy(*keys, "itemid", "feature", time).agg(F.sum("cv").alias("s"), F.count("cv").alias("n")) \
        .repartition(*keys)
    w = Window.partitionBy(*keys, "itemid").orderBy(time)
    nxt = F.lead(time).over(w)
    lo = F.greatest(F.col(time), F.lit(1))
    hi = F.least(F.coalesce(nxt - 1, F.lit(hours)), F.lit(hours))
    iv = pre.select(*keys, "feature", "s", "n", lo.alias("lo"), hi.alias("hi"))
    return explode_hours(iv, keys).groupBy(*keys, "hour", "feature").agg(F.sum("s").alias("cur_sum"), F.sum("n").alias("cur_n"))


# ---- W2 prior mean -------------------------------------------------------------------------------------------

def earlier_admission_totals(conv: DataFrame, visits: DataFrame, keys=VISIT, subject="subject_id",
                             start="admittime") -> DataFrame:
    """Per (visit, feature), sum and count of all values of the subject's admissions that started strictly
    earlier. Returns keys, feature, e_sum, e_n (only rows with e_n > 0).

    Per-visit totals are aggregated first (one row per admission and feature, not per event); the sum over
    strictly earlier starts is an exclusive prefix over the start time in microseconds (equal starts are
    excluded), bucketed by 30 days so that a subject with very many admissions is spread over partitions."""
    return earlier_from_hourly(hourly_sums(conv, keys), visits, keys, subject, start)


def snapshot_prior(conv: DataFrame, visits: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT, time="time",
                   subject="subject_id", start="admittime", earlier: bool = True) -> DataFrame:
    """Per (visit, hour, feature): sum and count of same-visit values with time < hour plus all values of
    earlier admissions of the subject. Returns keys, hour, feature, prior_sum, prior_n."""
    from wardspark.session import materialize
    hourly = materialize(hourly_sums(conv, keys, time), "hourly_sums") if earlier else hourly_sums(conv, keys, time)
    cur = (hourly.where(F.col(time) < hours).groupBy(*keys, "feature", time)
           .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).repartition(*keys))
    w = Window.partitionBy(*keys, "feature").orderBy(time)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lo = F.greatest(F.col(time) + 1, F.lit(1))
    hi = F.least(F.coalesce(F.lead(time).over(w), F.lit(hours)), F.lit(hours))
    parts = cur.select(*keys, "feature", F.sum("s").over(run).alias("s"), F.sum("n").over(run).alias("n"),
                       lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    if earlier:
        e = earlier_from_hourly(hourly, visits, keys, subject, start)
        parts = parts.unionByName(e.select(*keys, "feature", F.col("e_sum").alias("s"), F.col("e_n").alias("n"),
                                           F.lit(1).alias("lo"), F.lit(hours).alias("hi")))
    return explode_hours(parts, keys).groupBy(*keys, "hour", "feature").agg(
        F.sum("s").alias("prior_sum"), F.sum("n").alias("prior_n"))


# ---- W3/W4 labels ----------------------------------------------------------------------------------------------

def _first_per_time(nonzero: DataFrame, keys, time, value, stage):
    # First row at each time in storage order (time, value): the smallest value's stage.
    return nonzero.groupBy(*keys, time).agg(F.min_by(stage, value).alias("stage"))


def label_next(nonzero: DataFrame, hours: int = DEFAULT_HOURS, horizons=LABEL_HORIZONS, keys=VISIT,
               time="time", value="valuenum", stage="stage", first_hour: int = 1) -> DataFrame:
    """W3 / J11 core: per visit, the intervals of hours [lo, hi] whose first non-zero staged event at or after is
    at ``t`` (any distance). Returns keys, t, stage, lo, hi. The horizon test ``t <= hour + L`` is applied by the
    caller, so one pass serves every horizon."""
    max_h = max(horizons) if horizons else 0
    ev = nonzero.where((F.col(time) >= first_hour) & (F.col(time) <= hours + max_h))
    first = _first_per_time(ev, keys, time, value, stage)
    w = Window.partitionBy(*keys).orderBy(time)
    lo = F.coalesce(F.lag(time).over(w) + 1, F.lit(first_hour))
    hi = F.least(F.col(time), F.lit(hours))
    return first.select(*keys, F.col(time).alias("t"), "stage", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def label_before_start(nonzero: DataFrame, keys=VISIT, time="time", value="valuenum", stage="stage",
                       before: int = 1) -> DataFrame:
    """W4 at hour 1: the last non-zero staged event with time < 1 (storage order time, value)."""
    ev = nonzero.where(F.col(time) < before)
    last = ev.groupBy(*keys).agg(F.max_by(F.struct(F.col(time).alias("t"), F.col(stage).alias("stage")),
                                          F.struct(time, value)).alias("m"))
    return last.select(*keys, "m.t", "m.stage")


def label_parts(nonzero, hours=DEFAULT_HOURS, horizons=LABEL_HORIZONS, keys=VISIT, time="time",
                value="valuenum", stage="stage", sides=("next", "prev"), first_hour: int = 1) -> DataFrame:
    """Label intervals (keys, kind, t, stage, lo, hi): kind 'next' (first event at/after the hour), 'prev' (the
    'next' of the hour before) and 'prev1' (last event before hour 1, for hour 1), for the sides asked for."""
    nxt = label_next(nonzero, hours, horizons, keys, time, value, stage, first_hour)
    # one generator emits the interval for its own hours and for the hours after them, so the as-of window is
    # evaluated once
    shift = {"next": 0, "prev": 1}
    ivs = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("lo") + shift[k]).alias("lo"),
                             F.least(F.col("hi") + shift[k], F.lit(hours)).alias("hi")) for k in sides])
    out = nxt.select(*keys, "t", "stage", F.explode(ivs).alias("e")).select(
        *keys, F.col("e.kind").alias("kind"), "t", "stage", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))
    if "prev" in sides:
        one = F.lit(1)
        out = out.unionByName(label_before_start(nonzero, keys, time, value, stage).select(
            *keys, F.lit("prev1").alias("kind"), "t", "stage", one.alias("lo"), one.alias("hi")))
    return out


def spine_parts(visits: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT, first_hour=1) -> DataFrame:
    """The spine as intervals in the form of ``label_parts``: kind 'spine', hours first..H of every visit."""
    first = first_hour if not isinstance(first_hour, int) else F.lit(first_hour)
    return visits.select(*keys, F.lit("spine").alias("kind"), F.lit(None).cast("long").alias("t"),
                         F.lit(None).cast("int").alias("stage"), first.cast("int").alias("lo"), F.lit(hours).alias("hi"))


def label_aggs(horizons=LABEL_HORIZONS, sides=("next", "prev")):
    k, t, s, h = F.col("kind"), F.col("t"), F.col("stage"), F.col("hour")
    out = []
    if "prev" in sides:
        for L in horizons:
            inw = (k == "prev") & (t <= h - 1 + L)
            out.append(F.coalesce(F.max(F.when(inw, t)), F.max(F.when(k == "prev1", t)), F.lit(0))
                       .cast("long").alias(f"ptstage_{L}"))
            out.append(F.coalesce(F.max(F.when(inw, s)), F.max(F.when(k == "prev1", s)), F.lit(0))
                       .cast("int").alias(f"pstage_{L}"))
    for L in horizons if "next" in sides else ():
        inw = (k == "next") & (t <= h + L)
        out.append(F.coalesce(F.max(F.when(inw, t)), F.lit(0)).cast("long").alias(f"tstage_{L}"))
        out.append(F.coalesce(F.max(F.when(inw, s)), F.lit(0)).cast("int").alias(f"stage_{L}"))
    return out


# ---- validity (F5, A17) ----------------------------------------------------------------------------------------

def with_validity(df: DataFrame, mean_col: str, out_valid: str, bounds: DataFrame | None = None,
                  feature="feature") -> DataFrame:
    """Flag the mean of a feature as valid against its (margin-widened) bounds; features without
    bounds are always valid. The bounds table is fixed-size and broadcast."""
    if bounds is None:
        bounds = bounds_table(df.sparkSession)
    b = bounds.select(F.col("feature").alias(feature), "low", "high")
    return (df.join(F.broadcast(b), on=feature, how="left")
            .withColumn(out_valid, is_valid(mean_col, "low", "high")).drop("low", "high"))


# ---- W5 + assembly --------------------------------------------------------------------------------------------

def hourly_sums(conv: DataFrame, keys=VISIT, time="time") -> DataFrame:
    """Pre-aggregate converted events to (visit, item, feature, source, hour): s = sum, n = count.

    The single reduction every snapshot part reads; map-side partial aggregation bounds what a hot visit
    sends through the shuffle to items x hours rows per task."""
    return conv.groupBy(*keys, "itemid", "feature", "source", time).agg(F.sum("cv").alias("s"),
                                                                       F.count("cv").alias("n"))


def snapshot_sums(hourly: DataFrame, visits: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT, time="time",
                  lab_min_time: int | None = 1, subject="subject_id", start="admittime",
                  earlier: bool = True, gate: DataFrame | None = None) -> DataFrame:
    """W1 + W2 in one pass over the hourly sums: keys, hour, name ('cur_<f>' / 'prior_<f>'), s, n.

    One window over (visit, item) ordered by time yields, per row at time t, both the latest-value interval
    [max(t,1), next-1] (W1, labs only from ``lab_min_time``) and the running sums valid for hours
    [t+1, next] (W2, same visit, time < h); a single generator emits both intervals. Earlier admissions (J5)
    are added per (visit, feature)."""
    stored = snapshot_intervals(hourly.where(F.col(time) <= hours), visits, keys, time, lab_min_time, subject, start, earlier)
    return expand_intervals(stored if gate is None else behind_gate(stored, gate, keys), hours, keys)


def snapshot_intervals(hourly: DataFrame, visits: DataFrame, keys=VISIT, time="time", lab_min_time: int | None = 1,
                       subject="subject_id", start="admittime", earlier: bool = True) -> DataFrame:
    """The snapshot as it is stored: keys, name, valid_from, valid_to (null: open), s, n.

    A cell at an hour is the sum of the rows valid then. A measurement gives two rows and an earlier admission one per
    feature, so the size does not depend on how many hours are looked at."""
    w = Window.partitionBy(*keys, "itemid").orderBy(time)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    win = hourly.select(*keys, "feature", "source", time, "s", "n", F.lead(time).over(w).cast("int").alias("nxt"),
                        F.sum("s").over(run).alias("cs"), F.sum("n").over(run).alias("cn"))
    cur_ok = F.lit(True) if lab_min_time is None else ((F.col("source") != "lab") | (F.col(time) >= lab_min_time))
    c_to = F.when(cur_ok, F.col("nxt") - 1).otherwise(-1)
    ivs = F.array(
        F.struct(F.concat(F.lit("cur_"), F.col("feature")).alias("name"),
                 F.greatest(F.col(time), F.lit(1)).cast("int").alias("valid_from"), c_to.alias("valid_to"),
                 F.col("s").alias("s"), F.col("n").alias("n")),
        F.struct(F.concat(F.lit("prior_"), F.col("feature")).alias("name"),
                 F.greatest(F.col(time) + 1, F.lit(1)).cast("int").alias("valid_from"), F.col("nxt").alias("valid_to"),
                 F.col("cs").alias("s"), F.col("cn").alias("n")))
    out = win.select(*keys, F.explode(ivs).alias("iv")).select(*keys, "iv.*").where(
        "valid_to is null or valid_from <= valid_to")
    if earlier:
        e = earlier_from_hourly(hourly, visits, keys, subject, start)
        out = out.unionByName(e.select(*keys, F.concat(F.lit("prior_"), F.col("feature")).alias("name"),
                                       F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"),
                                       F.col("e_sum").alias("s"), F.col("e_n").alias("n")))
    return out


def within_hours(stored: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT) -> DataFrame:
    """Stored intervals in the form of ``explode_hours``, cut to hours 1..H."""
    upto = F.least(F.coalesce("valid_to", F.lit(hours)), F.lit(hours))
    return stored.select(*keys, "name", "s", "n", F.col("valid_from").alias("lo"), upto.alias("hi"))


def expand_intervals(stored: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT) -> DataFrame:
    """Hours 1..H of stored intervals: keys, hour, name, s, n, one row per interval and hour."""
    return explode_hours(within_hours(stored, hours, keys), keys)


def intervals_at(stored: DataFrame, hour: int, keys=VISIT) -> DataFrame:
    """The stored intervals that are valid at one hour, in the form of ``expand_intervals``; no hours are expanded."""
    at = stored.where((F.col("valid_from") <= hour) & (F.col("valid_to").isNull() | (F.col("valid_to") >= hour)))
    return at.select(*keys, "name", "s", "n", F.lit(hour).alias("hour"))


def gate_of_intervals(stored: DataFrame, keys=VISIT) -> DataFrame:
    """``gate_hours`` from stored intervals: keys, _gate."""
    return stored.where(F.col("name").startswith("cur_")).groupBy(*keys).agg(F.min("valid_from").alias("_gate"))


def behind_gate(stored: DataFrame, gate: DataFrame, keys=VISIT) -> DataFrame:
    """W5 on stored intervals: prior ones start at the visit's gate at the earliest, and go where a visit has none.

    ``gate``: keys, _gate. Intervals are joined, which are few beside the hours in them."""
    prior = F.col("name").startswith("prior_")
    start = F.when(prior, F.greatest("valid_from", "_gate")).otherwise(F.col("valid_from"))
    return (stored.join(gate, on=keys, how="left").where(~prior | F.col("_gate").isNotNull())
            .withColumn("valid_from", start).drop("_gate").where("valid_to is null or valid_from <= valid_to"))


def earlier_from_hourly(hourly: DataFrame, visits: DataFrame, keys=VISIT, subject="subject_id",
                        start="admittime") -> DataFrame:
    """J5 from hourly sums (see ``earlier_admission_totals``): keys, feature, e_sum, e_n."""
    tot = hourly.groupBy(*keys, "feature").agg(F.sum("s").alias("t_s"), F.sum("n").alias("t_n"))
    subj_feats = tot.select(subject, "feature").distinct()
    probes = (visits.select(*keys, start).join(subj_feats, on=subject, how="inner")
              .join(tot, on=[*keys, "feature"], how="left"))
    # strictly earlier admissions of the same subject: exclusive prefix over the start time, bucketed by
    # 30 days so that a subject with very many admissions is not one window partition
    from wardspark.operators.prep import exclusive_prefix_sums
    probes = probes.withColumn("_us", F.unix_micros(F.col(start).cast("timestamp")))
    pre = exclusive_prefix_sums(probes, [subject, "feature"], "_us", ["t_s", "t_n"], ADMISSION_BUCKET_US)
    out = pre.select(*keys, "feature", F.col("pre_t_s").alias("e_sum"), F.col("pre_t_n").alias("e_n"))
    return out.where(F.col("e_n") > 0)


def cell_names(features=ALL_FEATURES) -> list[tuple[str, str]]:
    """(side, feature) of all cells in order."""
    return [(k, n) for k in ("prior", "cur") for n in features]


def snapshot_cells(hourly: DataFrame, visits: DataFrame, hours: int = DEFAULT_HOURS, features=ALL_FEATURES,
                   keys=VISIT, time="time", lab_min_time: int | None = 1, margin: float | None = None,
                   gate: DataFrame | None = None) -> DataFrame:
    """W1 + W2 + F5 in long form: keys, hour, name ('cur_<f>' / 'prior_<f>'), mean, pos (the name's place in
    ``cell_names``), ok (within its bounds). With ``gate`` (keys, _gate) prior cells start there.

    Bounds by name are a fixed table and broadcast."""
    return cells_of(snapshot_sums(hourly, visits, hours, keys, time, lab_min_time, gate=gate), features, keys, margin)


def cells_of(sums: DataFrame, features=ALL_FEATURES, keys=VISIT, margin: float | None = None, also=()) -> DataFrame:
    """Means and validity of (keys, hour, name, s, n) rows: the columns of ``snapshot_cells``, and ``also``, which
    are alike in all rows of a cell."""
    from wardspark.functions.vocab import VALIDITY_MARGIN, bounds_rows
    bnd = {f: (lo, hi) for f, lo, hi in bounds_rows(VALIDITY_MARGIN if margin is None else margin)}
    by_name = sums.sparkSession.createDataFrame(
        [(f"{k}_{n}", i, *bnd.get(n, (None, None))) for i, (k, n) in enumerate(cell_names(features))],
        "name string, pos int, low double, high double")
    return (sums.groupBy(*keys, "hour", "name", *also).agg((F.sum("s") / F.sum("n")).alias("mean"))
            .join(F.broadcast(by_name), on="name", how="left")
            .withColumn("ok", is_valid("mean", "low", "high")).drop("low", "high"))


def gate_hours(hourly: DataFrame, hours: int = DEFAULT_HOURS, keys=VISIT, time="time",
               lab_min_time: int | None = 1) -> DataFrame:
    """Keys, _gate: the first hour at which a visit has any current observation, valid or not (labs only from
    ``lab_min_time``); visits without one have no row."""
    src = hourly.where(F.col(time) <= hours)
    if lab_min_time is not None:
        src = src.where((F.col("source") != "lab") | (F.col(time) >= lab_min_time))
    return src.groupBy(*keys).agg(F.min(F.greatest(F.col(time), F.lit(1))).cast("int").alias("_gate"))


def snapshot_runs(hourly: DataFrame, visits: DataFrame, nonzero: DataFrame, hours: int = DEFAULT_HOURS,
                  horizons=LABEL_HORIZONS, features=ALL_FEATURES, keys=VISIT, emit_empty: bool = False,
                  as_text: bool = False, lab_min_time: int | None = 1, margin: float | None = None,
                  time="time", shape=None) -> DataFrame:
    """The snapshot (see ``snapshot``, also for the parameters) in runs of hours, ``first_hour`` to ``last_hour``, in
    which no cell and no label event of a visit changes: a row has all cells, and the events that labels depend on.

    Plan: cells, label intervals and the spine (with the W5 gate) are shuffled by visit once. A visit's runs start where
    an interval starts or has ended, at most one per hour, and an interval is joined to the runs in it. Mean and validity
    of each cell are computed there in long form (bounds by name are a fixed 196-row broadcast); one grouping by (visit,
    run) then makes a map of a run's cells, at most one entry per name, and the columns are read from it."""
    vis = visits.select(*keys, "age", "gender", "ethnicity").join(
        gate_hours(hourly, hours, keys, time, lab_min_time), on=keys, how="left")
    if not emit_empty:
        vis = vis.where(F.col("_gate").isNotNull())
    demo = F.struct(F.col("age").cast("int").alias("age"), gender_code("gender").alias("gender"), "ethnicity", "_gate")
    spine = vis.select(
        *keys, F.lit("spine").alias("kind"), F.lit(None).cast("long").alias("t"),
        F.lit(None).cast("int").alias("stage"), (F.lit(1) if emit_empty else F.col("_gate")).alias("lo"),
        F.lit(hours).alias("hi"), demo.alias("demo"))
    others, rows = write_intervals(
        label_parts(nonzero, hours, horizons, keys).unionByName(spine, allowMissingColumns=True))
    stored = snapshot_intervals(hourly.where(F.col(time) <= hours), visits, keys, time, lab_min_time)
    together = within_hours(stored, hours, keys).where(F.col("lo") <= F.col("hi")).unionByName(others.select(
        *keys, F.struct("kind", "t", "stage", "demo").alias("other"), "lo", "hi"), allowMissingColumns=True)

    # a struct of keys equals another in which the same keys are null
    together = together.select(F.struct(*keys).alias("visit"), "name", "s", "n", "other", F.col("lo").cast("int"),
                               F.col("hi").cast("int"))
    tasks = tasks_of(rows)
    marks = together.select("visit", F.explode(F.array("lo", F.col("hi") + 1, "other.demo._gate")).alias("hour"))
    ends = Window.partitionBy("visit").orderBy("hour")
    runs = marks.where(F.col("hour") <= hours).repartition(tasks, "visit").distinct().withColumn(
        "last_hour", F.coalesce(F.lead("hour").over(ends) - 1, F.lit(hours)))
    long = together.repartition(tasks, "visit").join(runs.hint("merge"), "visit").where(F.col("hour").between(
        F.col("lo"), F.col("hi")))
    means = cells_of(long, features, ["visit"], margin, also=["other", "last_hour"])
    if as_text:
        value = F.when(F.col("ok"), F.col("mean").cast("string")).otherwise(F.lit("!"))
    else:
        value = F.when(F.col("ok"), shape(F.col("mean")) if shape else F.col("mean"))
    cell = F.when(F.col("other").isNull(), F.struct("pos", value.alias("v")))

    def event(kind):
        return [F.max(F.when(F.col("other.kind") == kind, F.col(f"other.{c}"))).alias(f"{kind}_{c}") for c in ("t", "stage")]

    wide = means.groupBy("visit", "hour", "last_hour").agg(
        F.max("other.demo").alias("demo"),
        F.map_from_entries(F.collect_list(cell)).alias("cells"), *event("next"), *event("prev"), *event("prev1")
    ).where(F.col("demo").isNotNull()).select("*", "demo.*", "visit.*")

    place = {x: i for i, x in enumerate(cell_names(features))}
    gate = F.col("_gate").isNotNull() & (F.col("hour") >= F.col("_gate"))
    missing = F.lit("?") if as_text else F.lit(None).cast("double")

    def prior(n):
        c = F.try_element_at("cells", F.lit(place["prior", n]))
        return F.when(gate, F.coalesce(c, missing) if as_text else c).otherwise(missing).alias(f"prior_{n}")

    def cur(n):
        c = F.try_element_at("cells", F.lit(place["cur", n]))
        return (F.coalesce(c, missing) if as_text else c).alias(f"cur_{n}")

    return wide.select(F.col("hour").alias("first_hour"), "last_hour", *keys, "ethnicity", "age", "gender",
                       *[prior(n) for n in features], *[cur(n) for n in features], *_EVENTS)


_EVENTS = [f"{kind}_{c}" for kind in ("next", "prev", "prev1") for c in ("t", "stage")]


def run_hours(runs: DataFrame, horizons=LABEL_HORIZONS, keys=VISIT) -> DataFrame:
    """``snapshot_runs`` to one row per hour with its labels, in the columns of ``snapshot``; columns that were added
    to the runs come last."""
    h = F.col("hour")

    def label(name):
        what, horizon = name.rsplit("_", 1)
        side, shift = ("prev", 1) if what.startswith("p") else ("next", 0)
        c = "t" if "tstage" in what else "stage"
        found = [F.when(F.col(f"{side}_t") <= h - shift + int(horizon), F.col(f"{side}_{c}"))]
        if side == "prev":
            found.append(F.col(f"prev1_{c}"))
        return F.coalesce(*found, F.lit(0)).cast("long" if c == "t" else "int").alias(name)

    each = runs.withColumn("hour", F.explode(F.sequence("first_hour", "last_hour")))
    first = ["hour", *keys, "ethnicity", "age", "gender"]
    prior, cur = ([c for c in runs.columns if c.startswith(f"{side}_")] for side in ("prior", "cur"))
    rest = [c for c in runs.columns if c not in {*first, *prior, *cur, *_EVENTS, "first_hour", "last_hour"}]
    return each.select(*first, *prior, *[label(c) for c in label_columns(horizons, previous=True)], *cur,
                       *[label(c) for c in label_columns(horizons)], *rest)


def snapshot(hourly: DataFrame, visits: DataFrame, nonzero: DataFrame, hours: int = DEFAULT_HOURS,
             horizons=LABEL_HORIZONS, features=ALL_FEATURES, keys=VISIT, emit_empty: bool = False,
             as_text: bool = False, lab_min_time: int | None = 1, margin: float | None = None,
             time="time", shape=None, in_order: bool = False) -> DataFrame:
    """Wide hour-by-hour snapshot (the reference's per-visit / per-hour files).

    ``hourly``: output of ``hourly_sums`` (keys, itemid, feature, source, time, s, n) — compute it once and
    materialise it when several snapshots read it. ``visits``: keys, admittime, age, gender, ethnicity.
    ``nonzero``: staged events with stage > 0 (keys, time, valuenum, stage). ``emit_empty``: True emits every
    hour 1..H (per-visit file form), False omits hours without any current observation (per-hour file form,
    W5). ``as_text``: render '?' (missing) and '!' (out of range) like the reference's CSV files; otherwise
    missing/invalid are NULL doubles. ``shape``: a function of columns applied to every mean in long form, e.g. rounding.
    ``in_order``: a partition's rows are in order of (visit, hour); runs are sorted, which are few beside their hours.

    Plan: W1 and W2 share one window; all is put together in runs of equal hours (``snapshot_runs``), which become
    hours at the end.

    Columns: hour, keys, ethnicity, age, gender, prior_<f>..., ptstage_L/pstage_L..., cur_<f>...,
    tstage_L/stage_L...
    """
    runs = snapshot_runs(hourly, visits, nonzero, hours, horizons, features, keys, emit_empty, as_text, lab_min_time,
                         margin, time, shape)
    return run_hours(runs.sortWithinPartitions(*keys, "first_hour") if in_order else runs, horizons, keys)


def visit_table(admissions: DataFrame, patients: DataFrame, keys=VISIT) -> DataFrame:
    """Visits with demographics for the snapshot: keys, admittime, ethnicity, age, gender (letter)."""
    from wardspark.operators.align import admissions_with_age
    return admissions_with_age(admissions, patients).select(*keys, "admittime", "ethnicity", "age", "gender")


# ---- W8 exact-hour snapshot -------------------------------------------------------------------------------------

def snapshot_exact(hourly: DataFrame, visits: DataFrame, nonzero: DataFrame, hour: int, items: list,
                   keys=VISIT, horizon: int = 48, item="itemid", value="average") -> DataFrame:
    """Per visit, the hourly average of each listed item at exactly ``hour`` (null when absent),
    age, gender code, and the first non-zero stage within [hour, hour + horizon] (tstage, stage; 0 when none).

    ``hourly`` is the A1 hourly aggregate (keys, itemid, time, average). A visit's items of the hour become a map,
    one entry per item, and the columns are read from it, so the plan doesn't grow with the item list."""
    h = hourly.where((F.col("time") == hour) & F.col(item).isin(items)).groupBy(*keys, item).agg(
        F.max(value).alias(value))
    wide = h.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(item).cast("long"), value))).alias("m_i"))
    ev = nonzero.where((F.col("time") >= hour) & (F.col("time") <= hour + horizon))
    lab = ev.groupBy(*keys).agg(F.min_by(F.struct(F.col("time").alias("t"), F.col("stage").alias("s")),
                                         F.struct("time", "valuenum")).alias("m"))
    v = visits.select(*keys, "age", gender_code("gender").alias("gender"))
    out = v.join(wide, on=keys, how="left").join(lab, on=keys, how="left")
    return out.select(*keys, "age", "gender", F.coalesce(F.col("m.t"), F.lit(0)).cast("long").alias("tstage"),
                      *[F.try_element_at("m_i", F.lit(i).cast("long")).alias(f"item_{i}") for i in items],
                      F.coalesce(F.col("m.s"), F.lit(0)).cast("int").alias("stage"))


# ---- W6 last write wins ----------------------------------------------------------------------------------------

def last_write_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """For each key, the value of the row that comes last in ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
