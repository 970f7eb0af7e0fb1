"""Job events as a stream: the latest state of each job, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriloom.operators.jobs import latest


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_states(events: DataFrame) -> DataFrame:
    """Streaming aggregate: job_id, last (ts, event_id, state, progress). State holds one row a job."""
    keep = F.struct("ts", "event_id", "state", "progress")
    return events.groupBy("job_id").agg(F.max_by(keep, F.struct("ts", "event_id")).alias("last"))


def follow_states(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest state of all jobs in versioned folders under `table`, the newest named by the batch.

    foreachBatch may see a batch again after a failure; it writes that batch's folder anew from the one before it, so
    reruns agree. Older folders than that are deleted. Batches come one at a time, which is the serial order that the
    queue keeps. Each batch rewrites all jobs; where those are many, `latest_states` keeps them as state instead.
    """

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("job_id", "ts", "event_id", "state", "progress")
        if k:
            rows = rows.union(spark.read.parquet(f"{table}/batch={k - 1}").select(*rows.columns))
        latest(rows).write.mode("overwrite").parquet(f"{table}/batch={k}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch={k - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
