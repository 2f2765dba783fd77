"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the expected number of its copies. Of all rates that give each source its target number of
words, the ones nearest to 1 in relative entropy are exponentially tilted: rate = exp(lambda * size), limited to
``max_copies``, with one multiplier per source. The multipliers solve the convex dual; each Newton iteration is one
aggregation over the histogram (source, size, documents), and a bracket kept beside it makes it safe. Rates then become
whole copies by systematic rounding along the sizes of a source, so that the words taken stay near the target.

Scale: documents are counted per (source, size) before anything else, so a source with a third of all documents is as
many rows as it has distinct sizes. Its documents of one size are numbered in chunks of about ``chunk`` rows.
Multipliers stay in a table, one row per source; nothing is broadcast by hint or collected but one row per iteration.

Targets: sources in order of name by code point, null last, weigh ``weights`` in turn and share the words of all
documents in proportion; a target stops at ``max_ratio`` times its source's words, and the excess is reshared by weight
among the rest until none is above.

Defined cases: null or empty text has size 0; such a document's rate is 1. A null source is a source of its own. A
source without words has target 0. Rows of equal id and text are told apart only by a running number. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import join_checked
from wardspark.session import materialize

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_ratio: float = 3.0) -> DataFrame:
    """(source, source_size, target) of a table (source, size, n); one row per source, sorted by one task.

    Sorted by room, max_ratio * size / weight, the capped sources come first: source i is capped if its room is below
    what the words left over give each unit of the weights left over. That prefix condition replaces repeated rounds.
    """
    total = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    ranked = total.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(max_ratio))
    room = cap / F.col("weight")
    before = Window.orderBy(room, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    share = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    placed = (ranked.withColumn("cap", cap).withColumn("room", room).withColumn("share", share)
              .withColumn("full", F.col("room") <= F.col("share")))
    # the share of the first source that isn't full holds for all after it; theirs, which count its cap, are smaller
    level = F.max(F.when(~F.col("full"), F.col("share"))).over(whole)
    return placed.select("source", "source_size",
                         F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def rates(sizes: DataFrame, targets: DataFrame, max_copies: float = 3.0, tolerance: float = 1e-7,
          iterations: int = 60) -> DataFrame:
    """(source, lam, mean_size): the multiplier of each source; rate = min(max_copies, exp(lam * size / mean_size)).

    ``lam`` is null where the target can only be met by the limit itself.
    """
    n_words = F.sum(F.col("size") * F.col("n"))
    means = sizes.groupBy("source").agg((n_words / F.greatest(F.sum("n"), F.lit(1))).alias("mean_size"))
    state = (targets.join(means, targets["source"].eqNullSafe(means["source"])).drop(means["source"])
             .where((F.col("source_size") > 0) & (F.col("target") > 0))
             .withColumn("done", F.col("target") >= F.col("source_size") * (max_copies * (1 - 1e-12)))
             .withColumn("lam", F.when(~F.col("done"), F.lit(0.0)))
             .withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")))
    state = materialize(state, "mix-state")
    for _ in range(iterations):
        if not state.where(~F.col("done")).limit(1).count():
            break
        z = F.col("h.size") / F.col("s.mean_size")
        tilt = F.least(F.exp(F.least(F.col("s.lam") * z, F.lit(50.0))), F.lit(max_copies))
        words = F.col("h.size") * F.col("h.n") * tilt
        now = (sizes.alias("h").join(state.where(~F.col("done")).alias("s"),
                                     F.col("h.source").eqNullSafe(F.col("s.source")))
               .groupBy(F.col("s.source").alias("source"))
               .agg(F.sum(words).alias("taken"),
                    F.sum(F.when(tilt < max_copies, words * z).otherwise(0.0)).alias("slope")))
        s = state.alias("s").join(now.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
        over = F.col("w.taken") > F.col("s.target")
        lo = F.when(over, F.col("s.lo")).otherwise(F.col("s.lam"))
        hi = F.when(over, F.col("s.lam")).otherwise(F.col("s.hi"))
        newton = F.col("s.lam") + (F.col("s.target") - F.col("w.taken")) / F.nullif(F.col("w.slope"), F.lit(0.0))
        # outside the bracket the middle is taken, or a doubled step while one side is open
        middle = F.when(lo.isNull(), F.least(2 * F.col("s.lam"), F.lit(0.0)) - 1).when(
            hi.isNull(), F.greatest(2 * F.col("s.lam"), F.lit(0.0)) + 1).otherwise((lo + hi) / 2)
        inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi)) & (
            F.abs(newton - F.col("s.lam")) < 5)
        near = F.abs(F.col("w.taken") - F.col("s.target")) <= tolerance * F.col("s.target")
        old = F.col("s.done") | F.col("w.taken").isNull()
        stay = old | near
        state = materialize(s.select(
            "s.source", "s.source_size", "s.target", "s.mean_size", stay.alias("done"),
            F.when(stay, F.col("s.lam")).when(inside, newton).otherwise(middle).alias("lam"),
            F.when(old, F.col("s.lo")).otherwise(lo).alias("lo"),
            F.when(old, F.col("s.hi")).otherwise(hi).alias("hi")), "mix-state")
    return state.select("source", "lam", "mean_size")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (1, 2, 3), max_ratio: float = 3.0, max_copies: int = 3,
        chunk: int = 100_000) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, rate, copies, taken) for every row of ``df``.

    ``h`` is the hash of id and text by which rows are ordered.
    """
    docs = materialize(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                 size_of(F.col(text_col)).alias("size"),
                                 F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")), "mix-docs")
    sizes = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_ratio), "mix-targets")
    tilt = rates(sizes, targets, float(max_copies))
    t, r = targets.alias("t"), tilt.alias("r")
    per_source = t.join(r, F.col("t.source").eqNullSafe(F.col("r.source")), "left").select(
        "t.*", "r.lam", "r.mean_size")
    raw = F.least(F.exp(F.least(F.col("p.lam") * F.col("c.size") / F.col("p.mean_size"), F.lit(50.0))),
                  F.lit(float(max_copies)))
    rate = (F.when(F.col("c.size") == 0, F.lit(1.0)).when(F.col("p.target") <= 0, F.lit(0.0))
            .when(F.col("p.lam").isNull(), F.lit(float(max_copies))).otherwise(raw))
    # documents of one source and size are numbered in chunks, by hash; a chunk begins where the one before ends
    n_chunks = F.ceil(F.col("n") / F.lit(chunk))
    of = F.pmod(F.col("h"), n_chunks).cast("long")
    one_size = docs.alias("d").join(sizes.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (
        F.col("d.size") == F.col("c.size"))).select(
        "d.doc_id", "d.source", "d.size", "d.h", of.alias("part"))
    parts = one_size.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    rated = parts.alias("c").join(per_source.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select(
        "c.*", "p.source_size", "p.target", rate.alias("rate"))
    along = Window.partitionBy("source").orderBy("size", "part")
    begins = F.sum(F.col("n") * F.col("rate")).over(along) - F.col("n") * F.col("rate")
    placed = rated.withColumn("begins", begins).drop("n")
    number = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    a = one_size.withColumn("number", number).alias("a")
    b = placed.alias("b")
    at = F.col("b.begins") + F.col("b.rate") * F.col("a.number") + 0.5
    copies = (F.floor(at + 1e-9) - F.floor(at - F.col("b.rate") + 1e-9)).cast("long")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (
        F.col("a.part") == F.col("b.part")))
    out = joined.select("a.doc_id", "a.source", "a.size", "a.h", "b.source_size", "b.target", "b.rate",
                        F.least(copies, F.lit(max_copies)).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **options) -> DataFrame:
    """``df`` with every row as often as the mix takes it.

    Rows that repeat id, text and source share the copies that fall to them: each gets their mean, rounded.
    """
    plan = mix(df, id_col, text_col, source_col, **options).groupBy("doc_id", "h", "source").agg(
        F.round(F.avg("copies")).cast("int").alias("_llm_copies")).where("_llm_copies > 0")
    plan = materialize(plan.select(F.col("h").alias("_llm_h"), F.xxhash64("source").alias("_llm_source"),
                                   "_llm_copies"), "mix-plan")
    keyed = df.withColumns({"_llm_h": F.xxhash64(F.col(id_col), F.col(text_col)),
                            "_llm_source": F.xxhash64(F.col(source_col))})
    taken = join_checked(keyed, plan, ["_llm_h", "_llm_source"])
    return taken.withColumn("_llm_n", F.explode(F.sequence(F.lit(1), F.col("_llm_copies")))).select(*df.columns)
