"""Queries that run the feeds over the event table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import table
from ledgerlift.catalog.registry import query
from ledgerlift.session import stage_path
from ledgerlift.streaming import feeds


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # event time needs an instant; the files hold wall-clock times in UTC
    return feeds.file_stream(spark, sf, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _change_type():
    return F.when(F.col("event_type") == "signup", "ADDED").when(F.col("event_type") == "error", "DELETED").otherwise("UPDATED")


@query("sm_01_change_upsert", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def _(spark, sf):
    target, checkpoint = stage_path(spark, "state"), stage_path(spark, "checkpoint")
    changes = _stream(spark, sf).withColumn("change_type", _change_type())
    feeds.run_available(changes.writeStream.foreachBatch(feeds.upsert_sink(target, "user_id", ["ts", "event_id"])), checkpoint)
    return feeds.current_rows(spark, target).select("user_id", "event_id", "value")


@query("sm_02_version_history", """
SELECT user_id, event_id, row_number() OVER w AS version, (lead(ts) OVER w)::TIMESTAMP AS valid_to, lead(ts) OVER w IS NULL AND event_type <> 'error' AS is_current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(spark, sf):
    changes = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return feeds.version_history(changes, "user_id", "ts", "event_id", deleted=F.col("event_type") == "error").select("user_id", "event_id", "version", "valid_to", "is_current")


@query("sm_03_stream_months", """
SELECT event_type, date_trunc('month', d)::DATE AS month, sum(n)::BIGINT AS row_count, round(sum(v), 2) AS total_value FROM (SELECT event_type, ts::DATE AS d, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    out, checkpoint = stage_path(spark, "days"), stage_path(spark, "checkpoint")
    days = feeds.daily_sums(_stream(spark, sf), "ts", ["event_type"], "value")
    feeds.run_available(days.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return feeds.months_from_days(spark.read.schema(days.schema).parquet(out), ["event_type"]).withColumn("total_value", F.round("total_value", 2))


@query("sm_04_repeat_suppression", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    out, checkpoint = stage_path(spark, "unique"), stage_path(spark, "checkpoint")
    doubled = _stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = feeds.without_repeats(doubled, "ts", ["event_id"])
    feeds.run_available(unique.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return spark.read.schema(unique.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
