"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, AQE with skew-join handling."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's spark.checkpoint.dir, else (tests only) a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "rosterlake-checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage with a reliable checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle(df: DataFrame, **conf: str) -> DataFrame:
    """As ``cut``, and the shuffle files of the computation go as soon as its result is written, not when the driver collects
    its garbage. ``conf``: session settings for this computation only."""
    spark = df.sparkSession
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | conf
    checkpoint_dir(spark)
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        return df.select("*").checkpoint()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def trim_driver(spark: SparkSession) -> bool:
    """Collect the driver's garbage and hand the memory that its JVM has freed, but the C library still holds, back to the
    system; compiling the code of many plans leaves hundreds of MB so. False where the JVM has no such command: then
    only garbage is collected."""
    jvm = spark._jvm
    jvm.System.gc()
    array, lang = spark.sparkContext._gateway.new_array, jvm.java.lang
    kinds = array(lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = lang.Class.forName(kind)
    given = array(lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return "Trim native heap" in invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False


def settle_lean(df: DataFrame, **conf: str) -> DataFrame:
    """As ``settle``, and what planning it left in the driver goes at once, for queries of many large plans: else the driver
    grows by the garbage of all of them."""
    out = settle(df, **conf)
    trim_driver(df.sparkSession)
    return out


def settle_small(df: DataFrame) -> DataFrame:
    """As ``settle_lean``, for frames made only of lists with a proven bound, each read as one partition: one job of one task
    computes them, with no exchange, broadcast or planning anew in the driver. The result is one partition."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    return settle_lean(df, **conf).coalesce(1)


def drop(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition by columns for stages that are heavy in CPU but light in bytes, which AQE would coalesce."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def widen(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is spread over all of them; larger ones stay as they are read."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)
