"""The streaming form of a batch aggregate, over several micro-batches of the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.catalog.registry import query
from tidecast.session import new_path
from tidecast.sources import star
from tidecast.streaming import weekly

#: Slices of the events by time, one micro-batch each, before a last one that comes too late.
SLICES = 3
LATENESS_DAYS = 14


@query("e01_weekly_stream", f"""
SELECT accessed_disease, date, access_count FROM (SELECT accessed_disease, CAST(date_trunc('week', access_date) AS DATE) + 6 AS date,
CAST(sum(access_count) AS BIGINT) AS access_count FROM v_access GROUP BY ALL)
WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL {LATENESS_DAYS} DAY""")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that the watermark has closed: state lives across micro-batches, and a last batch of old events is dropped."""
    events = star.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("accessed_disease"))
    source, out, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    first, last = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    share = F.least(F.floor((F.col("ts").cast("double") - first) / max(last - first, 1.0) * SLICES), F.lit(SLICES - 1))
    # one job a slice, so that files arrive in order of time
    for part in [*(events.filter(share == k) for k in range(SLICES)), events.filter(share == 0)]:
        part.write.mode("append").parquet(source)
        arrived = weekly.read_events(spark, source, "ts TIMESTAMP, accessed_disease STRING")
        weekly.run_available(weekly.weekly_access(arrived, f"{LATENESS_DAYS} days"), out, state).awaitTermination()
    return spark.read.schema("accessed_disease STRING, date DATE, access_count BIGINT").parquet(out)
