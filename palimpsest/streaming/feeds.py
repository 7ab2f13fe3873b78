"""Feeds that can be stopped and resumed, as Structured Streaming.

The append log of processed keys becomes a checkpoint, chunked reading a limit of files a trigger, saving
every so many items a trigger interval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import INDEX, LINKS, OrphanState, advance, references, snapshot
from ..session import cut


def lines(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """JSON lines of a folder, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def once_each(feed: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies `work` to every row whose key isn't in `out` yet, and appends the results. What is there when it
    starts is processed, then it ends; a new start goes on where the last ended, and a batch that is repeated
    after a failure writes nothing twice."""
    def batch(df: DataFrame, n: int) -> None:
        new = df.dropDuplicates([key])
        try:
            done = df.sparkSession.read.parquet(out).select(key).distinct()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(done, key, "left_anti")
        work(new).write.mode("append").parquet(out)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(feed: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time; rows later than `late` are left out."""
    return feed.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def orphan_feed(feed: DataFrame, fields: dict[str, str], parents: Callable[[], tuple[DataFrame, DataFrame]], store: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of orphan references for a stream of links. parents gives the rows that arrived and were
    removed since it was asked last; a batch writes them down before it uses them, so that a repeated batch has
    the same ones. Batch n appends its part to the logs of the state as version n, which a repeated batch
    replaces."""
    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession

        def logs(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(*[f"{store}/{i}/{name}" for i in range(n)]) if n else spark.createDataFrame([], schema)

        came, gone = f"{store}/{n}/came", f"{store}/{n}/gone"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{gone}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            for part, path in zip(parents(), (came, gone)):
                part.write.mode("overwrite").parquet(path)
        state = advance(OrphanState(logs("index", INDEX), logs("links", LINKS), n), references(df, fields), spark.read.parquet(came), spark.read.parquet(gone), keep=cut)
        for log, name in ((state.index_log, "index"), (state.link_log, "links")):
            log.where(F.col("seq") == n + 1).write.mode("overwrite").parquet(f"{store}/{n}/{name}")
        snapshot(state).write.mode("overwrite").parquet(f"{store}/{n}/counts")

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
