"""Structured Streaming over job and progress events: windows, deduplication, state by job, incremental ingestion."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from docloom.session import checkpoint_dir


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", time: str = "ts", files_per_trigger: int = 4) -> DataFrame:
    """File stream of a Parquet table, a single file or a folder of files; event time without a zone is read in the session's."""
    still = spark.read.parquet(f"{folder}/{name}")
    reader = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files_per_trigger)
    first = (still.inputFiles() or [""])[0]
    stream = reader.option("pathGlobFilter", name).parquet(folder) if first.endswith("/" + name) else reader.parquet(f"{folder}/{name}")
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling windows under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """At-least-once delivery made once by key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_state(events: DataFrame, key: str = "user_id", state: str = "event_type") -> DataFrame:
    """Last state of each job; run in update or complete mode."""
    return events.groupBy(key).agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("n_events"))


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Processes what is there and returns the result as a table in the shared folder.

    Append mode writes Parquet files. Complete mode replaces the table at each micro-batch. Update mode needs the ``keys`` of
    a row and merges the changed rows of each micro-batch into the table by them. A repeated micro-batch changes nothing.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    if mode == "complete":
        writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out") if _exists(spark, f"{base}/out") else spark.createDataFrame([], stream.schema)
    if not keys:
        raise ValueError("update mode needs the keys of a row")
    writer.outputMode("update").foreachBatch(lambda df, n: upsert_batch(base, keys, ["_batch"])(df.withColumn("_batch", F.lit(n)), n)).start().awaitTermination()
    return last_version(spark, base, stream.schema).drop("_batch")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS"))


def last_version(spark: SparkSession, path: str, schema=None) -> DataFrame:
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def upsert_batch(path: str, keys: list[str], order: list[str]):
    """foreachBatch function that keeps the latest row by key in a table, written beside it and swapped in by version.

    A batch that is repeated after a failure starts from the same earlier version and writes the same one again. A read that
    fails is an error: only a table without any earlier version starts empty.
    """
    from docloom.operators.relational import latest

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < number]
        both = spark.read.parquet(f"{path}/v{before[-1]}").unionByName(batch, allowMissingColumns=True) if before else batch
        latest(both, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return apply


def job_progress(events: DataFrame, terminal: list[str], job: str = "user_id", state: str = "event_type", idle: str = "7 days", late: str = "1 day") -> DataFrame:
    """The events of each job with their number and its percentage of steps, up to the first terminal one; what comes later is not delivered.

    One small state a job: its counter and whether it has ended. An ended or idle job's state is dropped by a timeout on event
    time, so that state does not grow with the number of jobs ever seen. Events of a micro-batch are put in order by time and id.
    """
    kind = events.schema[job].dataType.simpleString()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, frames, memory: GroupState):
        if memory.hasTimedOut:
            memory.remove()
            return
        done, closed = memory.get if memory.exists else (0, False)
        part = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows = []
        for event, when, s in zip(part["event_id"], part["ts"], part[state]):
            if not closed:
                done, closed = done + 1, s in terminal
                rows.append((key[0], event, when, s, done, closed))
        memory.update((done, closed))
        memory.setTimeoutTimestamp(max(int(part["ts"].max().timestamp() * 1000), memory.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(rows, columns=[job, "event_id", "ts", state, "step", "closed"])

    given = events.withWatermark("ts", late).select(job, "event_id", "ts", state)
    out = f"{job} {kind}, event_id long, ts timestamp, {state} string, step long, closed boolean"
    return given.groupBy(job).applyInPandasWithState(run, out, "done long, closed boolean", "append", "EventTimeTimeout")


def with_failures(stream: DataFrame, work: Column, name: str = "result", fault: str = "error_message") -> DataFrame:
    """The outcome of a step for each row, or why it failed; a failed page does not end the job.

    ``work`` gives null for a row it cannot do; the rows go on with status ``done`` or ``failed``.
    """
    out = stream.withColumn(name, work)
    bad = F.col(name).isNull()
    return out.withColumn("status", F.when(bad, "failed").otherwise("done")).withColumn(fault, F.when(bad, F.lit("no result")))


def split_failures(path: str):
    """foreachBatch function that writes finished rows and dead letters to two tables; a repeated batch overwrites its own part."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.where("status = 'done'").write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        batch.where("status = 'failed'").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")

    return apply


def run_split(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs what is there through ``split_failures``: (finished rows, dead letters)."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(split_failures(base)).start().awaitTermination()
    read = lambda part: spark.read.schema(stream.schema).parquet(f"{base}/{part}").drop("batch") if _exists(spark, f"{base}/{part}") else spark.createDataFrame([], stream.schema)
    return read("done"), read("dead")


def progress_list(progress: DataFrame, n: int, job: str = "user_id") -> DataFrame:
    """The last ``n`` messages of each job, as a poll reads them from the progress table."""
    w = W.partitionBy(job).orderBy(F.desc("ts"), F.desc("event_id"))
    return progress.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def expired(jobs: DataFrame, now, days: int = 7, column: str = "ts") -> DataFrame:
    """Rows older than the retention time."""
    return jobs.where(F.col(column) < now - F.expr(f"INTERVAL {days} DAYS"))
