"""Queries on event logs and reference tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.operators import service as S
from folioscope.runtime import table


def events_of(spark, d):
    return table(spark, d, "events")


def latency_nearest_rank(spark, d):
    return S.latency(events_of(spark, d), "event_type", "value")


def event_metrics(spark, d):
    return events_of(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


def rate_limit_tumbling(spark, d):
    return S.tumbling_limit(events_of(spark, d), "user_id", "ts", 3600, 1).select("event_id")


def rate_limit_sliding(spark, d):
    return S.sliding_limit(events_of(spark, d), "user_id", "ts", 3600, 1).where("NOT allowed").select("event_id")


def error_streaks(spark, d):
    return S.streaks(events_of(spark, d), "user_id", "ts", F.col("event_type") == "error")


def latest_event(spark, d):
    return S.newest(events_of(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


def upserted_state(spark, d):
    """State per user after the second half of the log was merged into the first."""
    e = events_of(spark, d).select("user_id", "ts", "event_id", "event_type")
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def job_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def newest_jobs(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus")


def stored_quota(spark, d):
    """Orders of each customer against the number allowed for its segment, unknown segments by a default."""
    plan = F.when(F.col("c_mktsegment") == "BUILDING", 20).when(F.col("c_mktsegment") == "MACHINERY", 10)
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", F.coalesce(plan, F.lit(15)).alias("most"))
    return c.join(n, "c_custkey", "left").select("c_custkey", "most", F.coalesce("n", F.lit(0)).alias("n")).where("n > most")


def policy_resolution(spark, d):
    """Left joins with precedence: the customer's own value, else its nation's, else a default."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 5000, F.lit("own")).alias("own"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, F.col("n_name")).alias("theirs"))
    return c.join(F.broadcast(n), "c_nationkey", "left").select("c_custkey", F.coalesce("own", "theirs", F.lit("default")).alias("policy"))  # 25 nations at any scale


def audit_search(spark, d):
    e = events_of(spark, d).where((F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & F.contains(F.lower("props"), F.lit("1")) & F.col("event_type").isin("error", "purchase"))
    return e.select("event_id", "event_type")


def snapshot_delta(spark, d):
    """Counts by type of the first and second half of the log, and the difference; a missing side is 0."""
    e = events_of(spark, d)
    a = e.where("event_id % 2 = 0").groupBy("event_type").agg(F.count("*").alias("a"))
    b = e.where("event_id % 2 = 1").groupBy("event_type").agg(F.count("*").alias("b"))
    j = a.join(b, "event_type", "full")
    return j.select("event_type", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


def resume_pending(spark, d):
    """Orders without any line yet returned: what a resumed run still has to do."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


def sessions(spark, d):
    """Sessions of a user: events less than a day apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events_of(spark, d).withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 1 DAY")).cast("int"), F.lit(1)))
    return e.withColumn("s", F.sum("new").over(w)).groupBy("user_id", "s").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def hourly_windows(spark, d):
    e = events_of(spark, d).groupBy(F.date_trunc("hour", F.col("ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stage_history(spark, d):
    """Per type of event: how many, how many failed (no value or below zero), the slowest one."""
    e = events_of(spark, d)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("value", F.lit(-1.0)) < 0).alias("failed"), F.max(F.struct("value", (-F.col("event_id")).alias("k")))["value"].alias("slowest"))


def moving_mean(spark, d):
    """Mean of the last five values of a user, and the change to the value before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events_of(spark, d).select("event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("mean5"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


def as_of_rate(spark, d):
    """For each error the last purchase of the same user before it (as-of join by one window over both)."""
    e = events_of(spark, d).where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", "purchase")


def event_cube(spark, d):
    return events_of(spark, d).withColumn("month", F.date_format("ts", "yyyy-MM")).cube("event_type", "month").agg(F.count("*").alias("n"))


def vote_bias(spark, d):
    """Weighted mean of positive values by type."""
    e = events_of(spark, d).where("value IS NOT NULL")
    weight = F.greatest(F.col("value"), F.lit(0.0))
    return e.groupBy("event_type").agg(F.round(F.sum(weight * F.col("value")) / F.sum(weight), 6).alias("bias"))


QUERIES = {
    f.__name__: f
    for f in (
        latency_nearest_rank, event_metrics, rate_limit_tumbling, rate_limit_sliding, error_streaks, latest_event, upserted_state, job_counts, newest_jobs, stored_quota, policy_resolution, audit_search,
        snapshot_delta, resume_pending, sessions, hourly_windows, stage_history, moving_mean, as_of_rate, event_cube, vote_bias,
    )
}

_W = "PARTITION BY user_id ORDER BY ts, event_id"
ORACLE = {
    "latency_nearest_rank": "WITH l AS (SELECT event_type, list(value ORDER BY value) AS a FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(a) AS n, a[1 + floor(0.5 * (len(a) - 1))::INT] AS p50, a[1 + floor(0.95 * (len(a) - 1))::INT] AS p95 FROM l",
    "event_metrics": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "rate_limit_tumbling": "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id) AS i FROM events) WHERE i > 1",
    "error_streaks": f"WITH e AS (SELECT user_id, (event_type = 'error')::INT AS bad, sum(1 - (event_type = 'error')::INT) OVER ({_W}) AS g FROM events), r AS (SELECT user_id, g, sum(bad) AS run FROM e GROUP BY ALL) SELECT user_id, max(run)::BIGINT AS longest, arg_max(run, g)::BIGINT AS trailing FROM r GROUP BY user_id",
    "latest_event": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "upserted_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "job_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "newest_jobs": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "stored_quota": "WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 20 WHEN c_mktsegment = 'MACHINERY' THEN 10 ELSE 15 END AS most FROM customer) SELECT c_custkey, most, n FROM c JOIN n USING (c_custkey) WHERE n > most",
    "policy_resolution": "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN 'own' END, CASE WHEN n_regionkey = 1 THEN n_name END, 'default') AS policy FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "audit_search": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND contains(lower(props), '1') AND event_type IN ('error', 'purchase')",
    "snapshot_delta": "SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 1) - count(*) FILTER (WHERE event_id % 2 = 0) AS delta FROM events GROUP BY event_type",
    "resume_pending": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "sessions": f"WITH e AS (SELECT *, coalesce((ts - lag(ts) OVER ({_W}) > INTERVAL 1 DAY)::INT, 1) AS new FROM events), s AS (SELECT *, sum(new) OVER ({_W}) AS s FROM e) SELECT user_id, s::BIGINT AS s, count(*) AS n, min(ts) AS first FROM s GROUP BY ALL",
    "hourly_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stage_history": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(value, -1) < 0) AS failed, max(value) AS slowest FROM events GROUP BY event_type",
    "moving_mean": f"SELECT event_id, round(avg(value) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, round(value - lag(value) OVER ({_W}), 6) AS change FROM events",
    "as_of_rate": f"SELECT event_id, purchase FROM (SELECT event_id, event_type, last(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase FROM events WHERE event_type IN ('error', 'purchase')) WHERE event_type = 'error'",
    "event_cube": "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m'))",
    "vote_bias": "SELECT event_type, round(sum(greatest(value, 0) * value) / sum(greatest(value, 0)), 6) AS bias FROM events WHERE value IS NOT NULL GROUP BY event_type",
}
