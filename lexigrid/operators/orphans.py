"""References to records that do not exist: dictionary codes, compressed bitmaps per key range and period, AND-NOT."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.skew import hot_split_join
from lexigrid.session import cut

#: Codes in a key range: a bitmap of a range has so many bits, 8 KB uncompressed.
RANGE_BITS = 1 << 16
#: A bitmap with at most so many bits set is kept as the sorted positions, a denser one as deflated words.
SPARSE_MOST = 4096


class Bitmap:
    """A compressed bitmap over one key range: sorted 16-bit positions while sparse, deflated words beyond."""

    __slots__ = ("dense", "packed")

    def __init__(self, positions: np.ndarray):
        positions = np.unique(positions.astype(np.uint16))
        self.dense = len(positions) > SPARSE_MOST
        if self.dense:
            bits = np.zeros(RANGE_BITS, dtype=np.uint8)
            bits[positions] = 1
            self.packed = zlib.compress(np.packbits(bits).tobytes(), 1)
        else:
            self.packed = positions.tobytes()

    def words(self) -> np.ndarray:
        if self.dense:
            return np.frombuffer(zlib.decompress(self.packed), dtype=np.uint8)
        bits = np.zeros(RANGE_BITS, dtype=np.uint8)
        bits[np.frombuffer(self.packed, dtype=np.uint16)] = 1
        return np.packbits(bits)

    def and_not(self, other: Bitmap | None) -> np.ndarray:
        """Positions set here and not in other."""
        if other is None or not other.packed:
            words = self.words()
        elif not self.dense and not other.dense:
            return np.setdiff1d(np.frombuffer(self.packed, dtype=np.uint16), np.frombuffer(other.packed, dtype=np.uint16), assume_unique=True)
        else:
            words = self.words() & ~other.words()
        return np.flatnonzero(np.unpackbits(words)).astype(np.uint16)


def _key(c: Column) -> Column:
    """Keys are equal when they differ only in case or surrounding white space; blank keys are none."""
    k = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(F.length(k) > 0, k)


def _period(c: Column) -> Column:
    """Months since year 0: the number of a period."""
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def _and_not(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """One key range: for each period the referenced codes that no parent covers from its first to its last moment."""
    out_pos, out_period = [], []
    first = parents["first_full"].to_numpy()
    last = parents["last_full"].to_numpy()
    code = parents["pos"].to_numpy()
    for period, rows in refs.groupby("period", sort=True):
        here = code[(first <= period) & (last >= period)]
        left = Bitmap(rows["pos"].to_numpy()).and_not(Bitmap(here) if len(here) else None)
        out_pos.append(left.astype(np.int32))
        out_period.append(np.full(len(left), period, dtype=np.int32))
    rng = int(refs["rng"].iloc[0]) if len(refs) else 0
    pos = np.concatenate(out_pos) if out_pos else np.zeros(0, dtype=np.int32)
    return pd.DataFrame({"rng": np.full(len(pos), rng, dtype=np.int64), "pos": pos, "period": np.concatenate(out_period) if out_period else np.zeros(0, dtype=np.int32)})


def orphan_references(
    refs: DataFrame,
    ref_columns: Sequence[str],
    ref_id: str,
    ref_time: str,
    parents: DataFrame,
    parent_key: str,
    parent_from: str,
    parent_to: str,
) -> DataFrame:
    """The references in ref_columns of refs that name no parent alive at ref_time: (ref_id, endpoint, key, period).

    A parent row is alive from parent_from (inclusive) to parent_to (exclusive; null: still alive).

    1. Keys (trimmed, lower case) of both sides are encoded as integers: a hash bucket, the key range, and a rank in it.
    2. References are first reduced to distinct (key, period), so a key that holds a third of all rows leaves each map task once.
    3. For each range, bitmaps of the codes referenced in a period and of the codes alive for all of it; reference AND-NOT parent.
    4. The bits left are decoded and, as a parent may be alive for part of a period, checked against the exact times.

    Null or blank references are no case. A null ref_time names no moment at which a parent could be alive: every such reference is a
    case, of period null. Parents with null key or null parent_from are never alive. Repeated rows count once. Empty tables are fine:
    without parents every reference is a case.
    """
    ends = F.array(*[F.struct(F.lit(c).alias("endpoint"), _key(F.col(c)).alias("key")) for c in ref_columns])
    long = (
        refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_time).alias("at"), F.explode(ends).alias("e"))
        .select("ref_id", "at", "e.endpoint", "e.key", _period(F.col("at")).alias("period"))
        .filter(F.col("key").isNotNull())
    )
    alive = parents.select(_key(F.col(parent_key)).alias("key"), F.col(parent_from).alias("start"), F.col(parent_to).alias("stop")).filter("key is not null and start is not null and (stop is null or stop > start)").distinct()

    used = cut(long.filter("at is not null").groupBy("key", "period").agg(F.count("*").alias("n")))
    codes = cut(_codes(used.select("key").union(alive.select("key")).distinct(), 2 * refs.count() + parents.count()))

    by_range = used.join(codes, "key").select("rng", "pos", "period")
    stop_period = _period(F.col("stop"))
    start_period = _period(F.col("start"))
    cover = alive.select(
        "key",
        F.when(F.col("start") == F.date_trunc("month", "start"), start_period).otherwise(start_period + 1).alias("first_full"),
        F.coalesce(stop_period - 1, F.lit(2**31 - 1)).alias("last_full"),
    ).filter("first_full <= last_full")
    parent_ranges = cover.join(codes, "key").select("rng", "pos", "first_full", "last_full")
    left = by_range.groupBy("rng").cogroup(parent_ranges.groupBy("rng")).applyInPandas(_and_not, "rng long, pos int, period int")
    suspects = cut(left.join(codes, ["rng", "pos"]).join(used, ["key", "period"]).select("key", "period", "n"))
    maybe = hot_split_join(long.filter("at is not null"), suspects, ["key", "period"], "n")
    # A key's lives in one row, so a key that many references name is met like any other hot key.
    lives = alive.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("lives")).join(suspects.groupBy("key").agg(F.sum("n").alias("n")), "key")
    lived = F.exists("lives", lambda p: (p["start"] <= F.col("at")) & (p["stop"].isNull() | (p["stop"] > F.col("at"))))
    found = hot_split_join(maybe, cut(lives), ["key"], "n", "left").filter(~F.coalesce(lived, F.lit(False)))
    never = long.filter("at is null")
    return found.select("ref_id", "endpoint", "key", "period").union(never.select("ref_id", "endpoint", "key", "period")).distinct()


def orphans_by_period(orphans: DataFrame, table_name: str) -> DataFrame:
    """Counts of orphan references and of the keys they name per table, endpoint and month (yyyy-MM; null where the time is)."""
    month = F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int"))
    return orphans.groupBy(F.lit(table_name).alias("tbl"), "endpoint", F.when(F.col("period").isNotNull(), month).alias("month")).agg(
        F.count("*").alias("orphans"), F.countDistinct("key").alias("keys")
    )


def _codes(keys: DataFrame, most_keys: int) -> DataFrame:
    """(key, rng, pos): ranges are hash buckets of about half as many keys as a bitmap has bits, cut further should one be larger."""
    buckets = max(1, -(-2 * most_keys // RANGE_BITS))
    spot = F.row_number().over(Window.partitionBy("_b").orderBy("key")) - 1
    return (
        keys.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .withColumn("_n", spot)
        .select("key", (F.col("_b") * F.lit(1 << 20) + F.floor(F.col("_n") / RANGE_BITS)).cast("long").alias("rng"), (F.col("_n") % RANGE_BITS).cast("int").alias("pos"))
    )
