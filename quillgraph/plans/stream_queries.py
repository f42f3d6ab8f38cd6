"""Stateful and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.registry import query
from quillgraph.session import table
from quillgraph.streaming import metrics
from quillgraph.streaming import operators as S


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, floor(epoch(ts))::DOUBLE AS ts, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
    r AS (SELECT key, id, ts, n, true AS allowed, [ts] AS w FROM e WHERE n = 1
        UNION ALL SELECT key, id, ts, n, len(f) < 10, CASE WHEN len(f) < 10 THEN list_append(f, ts) ELSE f END FROM (SELECT e.*, list_filter(r.w, lambda x: x >= e.ts - 86400) AS f FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
    SELECT key, id, ts, allowed FROM r""")
def rate_limiter(spark, d):
    """Ten requests a user and day; rejected ones are not recorded, so no plain window counts them."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_id").alias("id"))
    return S.rate_limit(e, 10, 86400.0)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def metric_windows(spark, d):
    return S.metric_windows(table(spark, d, "events"), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def metric_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.percentile("value", 0.5).alias("median"))


@query("SELECT event_type AS label, le, count(*) FILTER (le IS NULL OR value / 20 <= le) AS n, round(sum(value / 20), 4) AS total FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, NULL])::DOUBLE AS le) GROUP BY ALL")
def latency_histogram(spark, d):
    """Cumulative buckets of a duration by event type."""
    e = table(spark, d, "events").select("event_type", (F.col("value") / 20).alias("seconds"))
    return metrics.histogram(e, "event_type", "seconds").withColumn("total", F.round("total", 4))
