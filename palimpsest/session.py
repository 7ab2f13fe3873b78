"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. It's read from the session; only a session on the local
    master, as in tests, may get one of its own."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(known)
        return known
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, without its lineage. The files survive the loss of
    an executor. A checkpoint keeps the estimated size and the constraints of its plan, which over the rounds
    of a loop grow to numbers of millions of digits; so the result is made anew from the rows alone, and joins
    are planned from measured sizes at run time. What df shuffled is deleted."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    unshuffle(df)
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
    out._files = kept.queryExecution().logical().rdd().getCheckpointFile()
    return out


def unshuffle(df: DataFrame) -> None:
    """Deletes the shuffle files of df's own run, whose result is kept elsewhere; else they stay on the executors' disks
    until the driver happens to collect its garbage. A later run of the same df makes them anew."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        made = df.sparkSession._jsc.sc().shuffleDriverComponents()
        for i in list(plan.context().shuffleIds().keySet()):
            made.removeShuffle(i, False)


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of results of ``cut`` that nothing reads any more, as the rounds of a loop before the
    last; anything else is left alone."""
    for df in dfs:
        files = getattr(df, "_files", None)
        if files is not None and files.isDefined():
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(files.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            df._files = None


def sieve(df: DataFrame, column: str, most: int = 1 << 22) -> Callable[[Column], Column]:
    """A test that every value of a string column passes and few others do: a Bloom filter of at most `most`
    bits (512 KB), whatever the number of values. It keeps rows that can't match from a shuffle; a join must
    follow."""
    jvm = df.sparkSession._jvm
    values = df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    n = values.count()
    if not n:
        return lambda c: F.lit(False)
    made = values._jdf.stat().bloomFilter("h", n, min(most, max(1 << 10, 12 * n)))
    out = jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    raw = F.lit(bytes(out.toByteArray()))
    make = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def test(c: Column) -> Column:
        return Column(make.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(make.expression(raw._jc), make.expression(F.xxhash64(c)._jc))))

    return test


def partitions(df: DataFrame, copies: int = 1, each: int = 64 << 20) -> int:
    """A number of partitions that follows the bytes of df (what a cut wrote, else what the plan's leaves hold) times
    `copies`, and gives every core some work."""
    files = getattr(df, "_files", None)
    if files is not None and files.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files.get())
        size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    else:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join is estimated at the product of its sides
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size = sum(x for x in sizes if x < 1 << 60)  # else not known
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, copies * size // each + 1)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for Python work on a few large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
