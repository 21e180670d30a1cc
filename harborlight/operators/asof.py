"""As-of joins: of each left row the newest right row of its key that is not later, within a look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions.markdown import should_replace


def newest_before(left: DataFrame, right: DataFrame, key: str, left_id: str, left_time: str, right_time: str, lookback_ms: int, bucket_ms: int) -> DataFrame:
    """left with `hit`: the struct of right's columns but the key, of the newest row in [left_time - lookback_ms, left_time]; null without any.

    Times are whole milliseconds; of right rows of one time the greatest struct wins. Rows meet by (key, bucket of time), so a key that holds a third of
    all rows is spread over its buckets, and no key is sorted. In the left row's own bucket all right rows are asked; of the earlier buckets of the look-back
    only the newest row each, which is aggregated map-side. Null keys and times have no hit; left_id names each left row.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(bucket_ms)).cast("long")
    rest = [right_time, *(c for c in right.columns if c not in (key, right_time))]
    rows = right.where(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), at(right_time).alias("_b"), F.struct(*rest).alias("_r"))
    newest = rows.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    asks = left.where(F.col(left_time).isNotNull() & F.col(key).isNotNull()).select(F.col(left_id).alias("_id"), F.col(key).alias("_k"), F.col(left_time).alias("_t"))
    own = asks.withColumn("_b", at("_t")).join(rows, ["_k", "_b"])
    first = F.floor((F.col("_t") - lookback_ms) / F.lit(bucket_ms)).cast("long")
    earlier = asks.withColumn("_b", F.explode(F.when(first < at("_t"), F.sequence(first, at("_t") - 1)).otherwise(F.array().cast("array<long>")))).join(newest, ["_k", "_b"])
    found = own.select("_id", "_t", "_r").union(earlier.select("_id", "_t", "_r")).where(F.col(f"_r.{right_time}").between(F.col("_t") - lookback_ms, F.col("_t")))
    best = found.groupBy("_id").agg(F.max("_r").alias("hit"))
    return left.join(best, left[left_id] == best["_id"], "left").drop("_id")


def guarded(old: Column, new: Column) -> Column:
    """new where it says more than old, else old."""
    return F.when(F.coalesce(should_replace(new, old), F.lit(False)), new).otherwise(old)
