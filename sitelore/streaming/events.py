"""Job progress as a stream: the event log folded into counters per job, in batch and in Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "job_id string, seq bigint, event string, domain string, n_email int, n_phone int, n_social int, stage string, error string, at timestamp"


def fold(events: DataFrame) -> DataFrame:
    """One row per job: counts of outcomes and of contacts, state. Works on batch and streaming tables (update mode)."""
    is_ = lambda e: F.col("event") == e
    done = is_("completed")
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    return events.groupBy("job_id").agg(
        F.count_if(is_("started")).alias("started"),
        F.count_if(done).alias("completed"),
        F.count_if(is_("failed")).alias("failed"),
        total("n_email").alias("emails"),
        total("n_phone").alias("phones"),
        total("n_social").alias("socials"),
        F.count_if(done & (F.col("n_email") + F.col("n_phone") + F.col("n_social") > 0)).alias("extracted"),
        F.count_if(done & (F.col("stage") == "fallback")).alias("recovered"),
        F.max_by("event", F.when(F.col("event").isin("running", "paused", "resumed", "stopped", "finished"), F.col("seq"))).alias("state"),
    )


def progress(completed: Column, failed: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """percent (one decimal), remaining and eta in seconds (null before the first result)."""
    done = completed + failed
    left = F.greatest(total - done, F.lit(0))
    return {"percent": F.when(total > 0, F.round(done * 100.0 / total, 1)).otherwise(F.lit(0.0)), "remaining": left, "eta": F.when(done > 0, elapsed / done * left)}


def active_seconds(events: DataFrame) -> DataFrame:
    """(job_id, seconds): time from the first to the last event, without pauses."""
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("seq")
    gap = F.unix_micros(F.lead("at").over(order)) - F.unix_micros("at")
    # a pause lasts until the next resumed event
    paused = F.last(F.when(F.col("event").isin("paused", "resumed"), F.col("event")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return events.select("job_id", F.when(F.coalesce(paused, F.lit("")) == "paused", 0).otherwise(F.coalesce(gap, F.lit(0))).alias("us")).groupBy("job_id").agg((F.sum("us") / 1e6).alias("seconds"))


def start_fold(events: DataFrame, path: str, checkpoint: str):
    """Runs the fold over a streaming event table; each micro-batch writes the jobs that changed under ``path``, by its number.

    Nothing comes to the driver. A batch that is run again after a failure replaces its own rows, and a query that is started again with the same checkpoint goes on.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return fold(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """The counters that ``start_fold`` wrote last for each job."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("job_id", "r.*")


def new_pages(pages: DataFrame, *, url: str = "url", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Extension: the first copy of each URL in a stream of fetched pages, with bounded state."""
    return pages.withWatermark(at, delay).dropDuplicatesWithinWatermark([url])
