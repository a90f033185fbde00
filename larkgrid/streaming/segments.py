"""Live ingest: a recorder's segment index as a stream, job rows, completions, and a priority queue with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INDEX = "file string, start_s double, end_s double"
#: priority: smaller first; n: order of arrival.
JOB = "session string, job string, priority int, n long"


def segment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the index files in a folder as they arrive, each once."""
    return spark.readStream.schema(INDEX).csv(folder)


def job_rows(segments: DataFrame, session: str, clock_offset: float, origin: tuple[float, float] | None) -> DataFrame:
    """Segments as jobs on the flight's clock, with the session's pinned origin."""
    lat, lon = origin or (None, None)
    return segments.select(
        F.lit(session).alias("session"), F.col("file").alias("job"), (F.col("start_s") + clock_offset).alias("t0"), (F.col("end_s") + clock_offset).alias("t1"),
        F.lit(lat).cast("double").alias("lat0"), F.lit(lon).cast("double").alias("lon0"),
    )


def first_fix(track: DataFrame) -> DataFrame:
    """The earliest position with both coordinates, per source."""
    return track.where("lat is not null and lon is not null").groupBy("source").agg(F.min_by(F.struct("lat", "lon"), "t").alias("f")).select("source", "f.lat", "f.lon")


def completions(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs with latency and realtime factor once done; a failure that says there was no depth is no-3d, not failed."""
    joined = jobs.join(results.select("job", "state", "message", "done_s"), "job")
    status = F.when((F.col("state") == "failed") & F.lower("message").contains("no 3d"), "no-3d").otherwise(F.col("state"))
    return joined.select(*jobs.columns, status.alias("status"), F.round(F.col("done_s") - F.col("t1"), 3).alias("latency_s"), F.round((F.col("done_s") - F.col("t1")) / (F.col("t1") - F.col("t0")), 3).alias("realtime"))


def resource_series(samples: DataFrame, window: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Mean and peak per device and window of event time; works on streams and tables."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", window), "device").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))


def start_jobs(jobs: DataFrame, slots: int) -> DataFrame:
    """Of a stream of JOB rows (and rows `priority is null`: a job of that name has ended) per session: the jobs that start, in order.

    At most `slots` run at a time. Waiting jobs start by priority, then by arrival; the queue is state, so it outlives restarts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, running, count = state.get if state.exists else ([], [], 0)
        waiting, running = [tuple(w) for w in waiting], list(running)
        rows = pd.concat(list(batches)).sort_values("n")
        for r in rows.itertuples(index=False):
            if pd.isna(r.priority):
                running = [j for j in running if j != r.job]
            else:
                waiting.append((int(r.priority), int(r.n), r.job))
        started = []
        waiting.sort()
        while waiting and len(running) < slots:
            _, n, job = waiting.pop(0)
            running.append(job)
            started.append((key[0], job, count))
            count += 1
        state.update((waiting, running, count))
        yield pd.DataFrame(started, columns=["session", "job", "position"])

    return jobs.groupBy("session").applyInPandasWithState(
        step, "session string, job string, position long", "waiting array<struct<priority:int,n:long,job:string>>, running array<string>, count long", "append", GroupStateTimeout.NoTimeout
    )


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, appended to Parquet exactly once, and stop; a restart goes on where this ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
