"""Joins and running totals that hold when one key carries a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys, whatever the size of the data.
HOT_SHARE = 1 / 2000
#: Rows of one key that a task takes along without being late: about a tenth of a partition of 64 MB at 32 bytes a row. Below it no key is hot.
HOT_LEAST = 20_000
#: Parts in which the rows of hot keys are spread, each row by its own hash.
SPREAD = 4096


def hot_split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], count_col: str, how: str = "inner", total: int | None = None, least: int | None = None) -> DataFrame:
    """Join left to right, which has one row for each key and, in count_col, the number of left rows of that key.

    A key is hot that has at least `least` rows (HOT_LEAST by default) and HOT_SHARE of all. Hot keys' rows of right come by broadcast, at most 1 / HOT_SHARE (twice
    that many at most when total is an estimate); all others meet by a shuffle, in which rows of hot keys are spread evenly, as they need nothing more. left is
    read once. No key is dropped. how is 'inner' or 'left'. count_col isn't in the result. Null keys match nothing.
    """
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys and c != count_col]
    if total is None:
        total = right.agg(F.sum(count_col)).first()[0] or 0
    least = HOT_LEAST if least is None else least
    if total < least:  # no key can be hot
        return left.join(right.drop(count_col), keys, how)
    limit = max(least, int(total * HOT_SHARE))
    hot = right.filter(F.col(count_col) >= limit).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in rest], F.lit(True).alias("_hot"))
    cold = right.filter(F.coalesce(F.col(count_col), F.lit(0)) < limit).select(*keys, *rest, F.lit(0).alias("_salt"), F.lit(True).alias("_cold"))
    plain = [f.name for f in left.schema.fields if not isinstance(f.dataType, MapType)]
    salt = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int")).otherwise(0)
    met = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    if how == "inner":
        met = met.filter("_hot or _cold")
    others = [c for c in left.columns if c not in keys]
    return met.select(*keys, *others, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def parted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], part_rows: int = HOT_LEAST, counts: DataFrame | None = None) -> DataFrame:
    """left and right joined on keys, of which both may have many rows of one key.

    right's rows of a key are dealt out by their hash in parts of about part_rows, and left's rows of the key go to every part, spread by their own
    hash over as many tasks again; so no task has more than some part_rows of a key, and small keys have one part. counts (keys..., n), the rows of right by
    key, is worked out where it isn't given. Null keys match nothing.
    """
    keys = list(keys)
    n = right.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    parts = n.filter(F.col("n") > part_rows).select(*keys, F.ceil(F.col("n") / part_rows).cast("int").alias("_parts"))
    # Keys of more than part_rows rows are as many as right has parts of that size; they are met by a join of their own kind.
    plain = [f.name for f in right.schema.fields if not isinstance(f.dataType, MapType)]
    one = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = right.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*plain), one).cast("int")).drop("_parts")
    spread = left.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return spread.join(dealt, [*keys, "_part"]).drop("_part")


def running_total(df: DataFrame, value: str, bucket: Column, order: Sequence[Column], partition: Sequence[str] = (), out: str = "running") -> DataFrame:
    """The sum of value over all rows up to and including this one, in the order bucket, then order, within partition.

    A global running sum needs one task for each partition; here only the sums of the buckets go through one window, and the rows
    of a bucket through another. bucket must not decrease along the order; make it so fine that a bucket fits into a task. Nulls in
    value count as 0.
    """
    p = list(partition)
    d = df.withColumn("_b", bucket).withColumn("_v", F.coalesce(F.col(value), F.lit(0)))
    sums = d.groupBy(*p, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*p).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*p, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*p, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_in", F.sum("_v").over(within)).join(starts, [*p, "_b"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_v", "_in", "_start")
