"""Structured Streaming forms of two compliance operators.

* ``suppress_erased``: a stream of rows loses every row of a subject whose
  erasure is COMPLETED -- a stream-static left-anti join against the request
  table (re-planned per micro-batch), so an erasure takes effect on data
  that arrives after it.
* ``audit_daily``: the daily audit summary as a watermarked 1-day tumbling
  window with bounded state: distinct counts are HLL sketches whatever the
  skew, and in append mode a window leaves the state once it is final.
* ``audit_daily_counts``: the first level of the exact form, one state row
  per (window, event type, customer, user) instead of a set in one row;
  ``audit_daily_exact`` adds the levels up in batch.

``run_to_table`` drives a query with ``trigger(availableNow=True)`` into a
Parquet folder under the shared checkpoint root and reads the result back,
so a batch caller (tests, the registry) gets a plain DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import not_in
from ..session import scratch_path
from ..sources.tables import DRIVER_SCHEMAS


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A driver table as a file stream (schema declared, not inferred)."""
    return (spark.readStream.schema(DRIVER_SCHEMAS[name])
            .option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir.rstrip("/")))


def suppress_erased(stream: DataFrame, email_col: str, requests: DataFrame) -> DataFrame:
    """Rows of ``stream`` whose e-mail is NOT IN the completed subjects.

    The same operator as the batch policy: a stream-static left-anti join
    plus the NOT IN flags as scalar subqueries.  Run it by ``run_batches``,
    which plans it for every micro-batch: an erasure completed while the query
    runs takes effect on the next batch, and the size of the completed subjects
    is measured again before they are broadcast."""
    done = requests.where(F.col("status") == "COMPLETED").select("customer_email")
    return not_in(stream, email_col, done, "customer_email")


def run_batches(stream: DataFrame, name: str, step) -> DataFrame:
    """Run ``step`` (DataFrame -> DataFrame) on every micro-batch of ``stream``
    and return all results.  A batch is written under its number, so one that
    is run again after a failure replaces its own output."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def audit_daily(audit_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per (day, event type): events, distinct customers and users (sketches),
    first and last event time; late rows beyond the watermark are dropped."""
    return (audit_stream.withWatermark("event_timestamp", watermark)
            .groupBy(F.window("event_timestamp", "1 day").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.approx_count_distinct("customer_email", 0.01).alias("unique_customers"),
                 F.approx_count_distinct("user_name", 0.01).alias("unique_users"),
                 F.min("event_timestamp").alias("first_event"),
                 F.max("event_timestamp").alias("last_event"))
            .select(F.to_date(F.col("w.start")).alias("audit_date"), "event_type",
                    "event_count", F.col("unique_customers").cast("long").alias("unique_customers"),
                    F.col("unique_users").cast("long").alias("unique_users"),
                    "first_event", "last_event"))


#: Size of a distinct sketch as a power of two; 12 errs by about 2 %.
SKETCH_BITS = 12


def audit_day_sketches(batch: DataFrame) -> DataFrame:
    """Per (day, event type) of one micro-batch: events, first and last time, and sketches of
    the distinct customers and users.  ``run_batches`` stores each batch's rows."""
    return (batch.groupBy(F.to_date("event_timestamp").alias("audit_date"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.hll_sketch_agg("customer_email", SKETCH_BITS).alias("customers"),
                 F.hll_sketch_agg("user_name", SKETCH_BITS).alias("users"),
                 F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event")))


def audit_days(stored: DataFrame) -> DataFrame:
    """The daily summary from stored sketches of any number of batches: a day's sketches
    are united, so rows that come late, in a batch of their own, are counted like any other."""
    return (stored.groupBy("audit_date", "event_type")
            .agg(F.sum("events").cast("long").alias("event_count"),
                 F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"),
                 F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
                 F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event")))


def audit_daily_counts(audit_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per (day, event type, customer, user): events, first and last event time."""
    return (audit_stream.withWatermark("event_timestamp", watermark)
            .groupBy(F.window("event_timestamp", "1 day").alias("w"), "event_type", "customer_email", "user_name")
            .agg(F.count(F.lit(1)).alias("events"), F.min("event_timestamp").alias("first_event"),
                 F.max("event_timestamp").alias("last_event"))
            .select(F.to_date(F.col("w.start")).alias("audit_date"), "event_type", "customer_email", "user_name",
                    "events", "first_event", "last_event"))


def audit_daily_exact(counts: DataFrame) -> DataFrame:
    """The daily summary with exact distinct counts, from ``audit_daily_counts``."""
    return counts.groupBy("audit_date", "event_type").agg(
        F.sum("events").cast("long").alias("event_count"),
        F.count_distinct("customer_email").alias("unique_customers"),
        F.count_distinct("user_name").alias("unique_users"),
        F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query to completion into the shared checkpoint root
    and return its output as a batch DataFrame.

    ``append`` writes each micro-batch's new rows; ``complete`` rewrites the
    whole result each micro-batch (finite inputs, where the last watermark
    never closes the open windows)."""
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    if output_mode == "append":
        q = (df.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
    else:
        def _write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = (df.writeStream.foreachBatch(_write).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
