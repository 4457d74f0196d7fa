"""Analytics of event logs: limits, latencies, streaks, sessions, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.operators import kernels


def nearest_rank(values: Column, q: float) -> Column:
    """The value at ``int(q * (n - 1))`` of a sorted array."""
    return F.get(values, F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def latency(df: DataFrame, group: str, value: str, ranges: int = 64) -> DataFrame:
    """p50 and p95 by nearest rank, exactly, without bringing a group into one task.

    Approximate quantiles cut each group into ranges; values are counted per range, and only within
    the ranges that hold a wanted rank are they counted up one by one.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    cuts = v.groupBy(group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("cuts"))
    v = v.join(cuts, group).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    per = v.groupBy(group, "range").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"base": F.coalesce(F.sum("m").over(before), F.lit(0)), "total": F.sum("m").over(Window.partitionBy(group))})
    at = lambda q: F.floor(F.lit(q) * (F.col("total") - 1))
    holds = lambda q: (F.col("base") <= at(q)) & (at(q) < F.col("base") + F.col("m"))
    v = v.join(per.where(holds(0.5) | holds(0.95)), [group, "range"])
    v = v.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy(group, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    rank = lambda q: F.min(F.when(holds(q) & (F.col("upto") > at(q)), F.col(value)))
    return v.groupBy(group).agg(F.max("total").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def tumbling_limit(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Events beyond ``limit`` in their window per key, in time order."""
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    w = Window.partitionBy(key, "slot").orderBy(at, "event_id")
    return events.withColumn("slot", slot).withColumn("i", F.row_number().over(w)).where(F.col("i") > limit)


def sliding_limit(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """``event_id, allowed``: an event is denied when ``limit`` allowed ones lie in the window before it (denied ones don't count)."""

    def decide(_: tuple, g: pd.DataFrame) -> list[tuple]:
        g = g.sort_values([at, "event_id"])
        kept: list = []
        out = []
        for e, t in zip(g["event_id"], g[at], strict=True):
            kept = [k for k in kept if (t - k).total_seconds() < seconds]
            ok = len(kept) < limit
            if ok:
                kept.append(t)
            out.append((int(e), ok))
        return out

    return kernels.per_group(events.select(key, at, "event_id"), [key], "event_id bigint, allowed boolean", decide)


def streaks(events: DataFrame, key: str, at: str, bad: Column) -> DataFrame:
    """Longest run of bad events per key and the run it ends with."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    e = events.withColumn("bad", bad.cast("int")).withColumn("group", F.sum(1 - F.col("bad")).over(w))
    runs = e.groupBy(key, "group").agg(F.sum("bad").alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"), F.max(F.struct("group", "run"))["run"].alias("trailing"))


def newest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row per key, with partial aggregation."""
    others = [c for c in df.columns if c not in (key, at, tie)]
    best = df.groupBy(key).agg(F.max(F.struct(at, tie, *others)).alias("r"))
    return best.select(key, "r.*")


def upsert(current: DataFrame, changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Insert or replace by key: the newest of old and new rows."""
    return newest(current.unionByName(changes), key, at, tie)
