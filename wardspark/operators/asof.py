"""As-of join of two tables at any time stamps (inventory J10, J11).

Each left row gets the right row of its keys with the greatest time that is not later (backward), or the least that is not
earlier (forward). Both sides are cut into buckets of time. Inside a bucket a running window finds the match; where the
bucket has none yet, the last value of an earlier bucket is carried over, from a table of one row per key and bucket. So a
key that holds a third of all rows is as many groups as it has buckets, and no range join is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _micros(df: DataFrame, name: str) -> Column:
    """Time as a long: microseconds of a time stamp or date, a number as it is."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("long")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              direction: str = "backward", tolerance: int | None = None, bucket: int = 86_400_000_000,
              tie: list[str] = ()) -> DataFrame:
    """Every left row with the columns of its match, null where there is none.

    ``bucket`` and ``tolerance`` in the unit of the time, microseconds for time stamps; a match further away than
    ``tolerance`` is none. Of right rows at one time the one that is greatest in ``tie``, then in all its columns, counts.
    Rows with a null key or time match nothing; left ones stay. Right columns may not be named like left ones."""
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    given = [c for c in right.columns if c not in keys]
    clash = set(given) & set(left.columns)
    if clash:
        raise ValueError(f"right columns named like left ones: {sorted(clash)}")
    sign = 1 if direction == "backward" else -1
    known = " and ".join(f"`{k}` is not null" for k in keys)
    r = right.select(*keys, (_micros(right, right_time) * sign).alias("_t"), F.struct(*given).alias("_r"),
                     F.struct(*tie, *given).alias("_o")).where(f"{known} and _t is not null")
    r = r.groupBy(*keys, "_t").agg(F.max_by("_r", "_o").alias("_r"))
    l_all = left.select(*keys, (_micros(left, left_time) * sign).alias("_t"), F.struct(*left.columns).alias("_l"))
    cut = F.floor(F.col("_t") / F.lit(bucket)).alias("_b")
    both = (l_all.where(f"{known} and _t is not null").select(*keys, "_t", cut, F.lit(1).alias("_side"), "_l")
            .unionByName(r.select(*keys, "_t", cut, F.lit(0).alias("_side"), F.struct("_t", "_r").alias("_m")),
                         allowMissingColumns=True))
    running = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.select(*keys, "_b", "_t", "_side", "_l", F.last("_m", ignorenulls=True).over(running).alias("_near")).where("_side = 1")
    per_bucket = both.groupBy(*keys, "_b").agg(F.max_by("_m", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")
    joined = near.join(carried, [*keys, "_b"], "left").withColumn("_hit", F.coalesce("_near", "_carry"))
    close = F.lit(True) if tolerance is None else (F.col("_t") - F.col("_hit._t") <= tolerance)
    found = joined.select("_l", F.when(close, F.col("_hit._r")).alias("_r"))
    rest = l_all.where(f"not ({known} and _t is not null)").select("_l", F.lit(None).cast(found.schema["_r"].dataType).alias("_r"))
    return found.unionByName(rest).select("_l.*", *[F.col("_r")[c].alias(c) for c in given])
