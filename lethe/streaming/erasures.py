"""Suppression of erased subjects when the erasures arrive as a stream of their own.

Rows and completed erasures are one query, so that both advance together.  What the query
keeps between micro-batches is a table of spans: a subject's rows vanish from an erasure
on until ``keep`` after it (from then on the table of requests holds it, see
``operators.suppress_erased``).  Erasures of a subject in one stretch of length ``keep``
are one span, as their times overlap, so the table has a few rows a subject, however
many erasures come.  A span that ended ``delay`` before the newest time seen is dropped:
the state is bounded by the subjects erased in the last ``keep`` and ``delay``.

Every micro-batch reads the state of the one before and writes its own beside it, so one
that is run again after a failure gives the same result.  All of it is joins and
aggregates; a subject with very many rows is dealt over many tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import is_small
from ..operators.skew import salted_join
from ..session import scratch_path

SPAN = "who string, stretch long, first long, last long"


def _micros(d: dt.timedelta) -> int:
    return d // dt.timedelta(microseconds=1)


def with_erasures(rows: DataFrame, email_col: str, time_col: str, erasures: DataFrame,
                  erased_email: str, erased_at: str) -> DataFrame:
    """Both streams (or tables) as one: ``row`` (NULL for an erasure), ``who``, ``at`` (microseconds)."""
    r = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(email_col).alias("who"),
                    F.unix_micros(F.col(time_col).cast("timestamp")).alias("at"))
    e = erasures.select(F.lit(None).cast(r.schema["row"].dataType).alias("row"), F.col(erased_email).alias("who"),
                        F.unix_micros(F.col(erased_at).cast("timestamp")).alias("at"))
    return r.unionByName(e)


class LiveSuppression:
    """Micro-batches of ``with_erasures``; results and state lie in folders below ``root``.

    * ``kept``: rows no erasure of the same or an earlier batch covers.  An erasure at t covers
      times from t up to, not including, t + ``keep``.  Rows without an e-mail are nobody's and kept.
    * ``late``: rows more than ``delay`` older than the newest time of the batches before, whose
      spans may be gone, and rows without a time: they are not judged but laid apart, none is lost.
    * Erasures without an e-mail or a time cover nothing; without any batch both tables are empty.
    """

    def __init__(self, spark: SparkSession, root: str, row_schema, keep: dt.timedelta, delay: dt.timedelta):
        if keep <= dt.timedelta(0) or delay < dt.timedelta(0):
            raise ValueError("keep must be positive and delay not negative")
        self.spark, self.root, self.row_schema = spark, root.rstrip("/"), row_schema
        self.keep, self.delay = _micros(keep), _micros(delay)
        for folder in ("kept", "late"):  # a table without batches has its columns
            self._none(f"row struct<{row_schema.simpleString()[7:]}").write.mode("overwrite").parquet(self._at(folder, -1))

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _at(self, folder: str, number: int) -> str:
        return f"{self.root}/{folder}/micro_batch={number}"

    def _delete(self, folder: str, number: int) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(folder, number))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def state(self, number: int) -> DataFrame:
        """The spans that batch ``number`` leaves to the next one."""
        if number < 0:
            return self._none(SPAN)
        spans = self.spark.read.schema(SPAN).parquet(self._at("spans", number))
        newest = self._newest(number)
        return spans if newest is None else spans.where(F.col("last") + self.keep > newest - self.delay)

    def _newest(self, number: int) -> int | None:
        if number < 0:
            return None
        return self.spark.read.schema("newest long").parquet(self._at("clock", number)).first()[0]

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; may be run again."""
        batch = batch.persist()
        try:
            before = self._newest(number - 1)
            newest = batch.agg(F.max("at").alias("newest")).select(F.greatest("newest", F.lit(before).cast("long")).alias("newest"))
            newest.write.mode("overwrite").parquet(self._at("clock", number))
            new = batch.where(F.col("row").isNull() & F.col("who").isNotNull() & F.col("at").isNotNull()).select(
                "who", (F.col("at") - F.pmod("at", F.lit(self.keep))).alias("stretch"), F.col("at").alias("first"), F.col("at").alias("last"))
            (self.state(number - 1).unionByName(new).groupBy("who", "stretch")
             .agg(F.min("first").alias("first"), F.max("last").alias("last"))
             .write.mode("overwrite").parquet(self._at("spans", number)))
            spans = self.spark.read.schema(SPAN).parquet(self._at("spans", number))
            rows = batch.where(F.col("row").isNotNull())
            late = F.col("at").isNull()
            if before is not None:
                late = late | (F.col("at") < before - self.delay)
            rows.where(late).select("row").write.mode("overwrite").parquet(self._at("late", number))
            # a subject has a few spans: one row a subject keeps the join on equal keys
            covers = spans.groupBy(F.col("who").alias("__who")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
            todo = rows.where(~late)
            if is_small(spans):
                judged = todo.join(F.broadcast(covers), todo["who"] == covers["__who"], "left")
            else:
                judged = salted_join(todo, covers, "who", "__who", "left")
            erased = F.exists("spans", lambda s: (s["first"] <= F.col("at")) & (F.col("at") < s["last"] + self.keep))
            (judged.where(~F.coalesce(erased, F.lit(False))).select("row")
             .write.mode("overwrite").parquet(self._at("kept", number)))
            for folder in ("spans", "clock"):  # the batch before may run again, those before it may not
                self._delete(folder, number - 2)
        finally:
            batch.unpersist()

    def read(self, folder: str) -> DataFrame:
        """``kept`` or ``late`` of all batches so far."""
        return self.spark.read.parquet(f"{self.root}/{folder}").select("row.*")


def suppress_live(rows: DataFrame, email_col: str, time_col: str, erasures: DataFrame, erased_email: str,
                  erased_at: str, keep: dt.timedelta, delay: dt.timedelta) -> tuple[DataFrame, DataFrame]:
    """Run both streams to their present end; returns the kept and the late rows (see ``LiveSuppression``)."""
    spark = rows.sparkSession
    root = scratch_path(spark, "live-suppression")
    job = LiveSuppression(spark, f"{root}/tables", rows.schema, keep, delay)
    q = (with_erasures(rows, email_col, time_col, erasures, erased_email, erased_at).writeStream
         .foreachBatch(job.step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return job.read("kept"), job.read("late")
