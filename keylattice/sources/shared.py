"""Tables that a plan needs more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tasks(spark: SparkSession) -> int:
    """Into how many parts to deal small tables of which much is made: a number that is given stays, whatever their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def settled(df: DataFrame) -> DataFrame:
    """`df`, computed once, without its lineage, and safe from lost executors.

    It is a compressed table of columns, so that a plan reads those it needs and knows its size. The folder is the session's
    (spark.checkpoint.dir); only a session on this machine alone gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-keylattice-"))
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of `spread` has, more or less.
TASK_ROWS = 1 << 20


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of at most `rows` rows, dealt by `keys` to so many tasks that what one of them puts in order doesn't grow with the table; what
    one task can have is left to Spark."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys) if rows > TASK_ROWS else df


def hashed(df: DataFrame) -> DataFrame:
    """`df`, of few rows beside those that it is joined to and one for each key: Spark broadcasts it while it is small enough; after that its
    share of each task is hashed, so that the many rows on the other side are not put in order."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size <= most else df.hint("shuffle_hash")


#: Keys that are counted together by `places`.
RUN = 1 << 14


def places(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """`df` with the place, from 0 up, of each row among those of its group by the whole number `key`.

    Rows are numbered in runs of neighbouring keys, behind the number of rows in the runs before, so a group of any size is no
    single task. Equal keys stand in any order.
    """
    cut = df.withColumn("_run", F.floor(F.col(key) / RUN))
    own = F.row_number().over(Window.partitionBy(group, "_run").orderBy(key)) - 1
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut.groupBy(group, "_run").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = cut.withColumn("_own", own).join(runs.select(group, "_run", "_before"), [group, "_run"])
    return out.select(*df.columns, (F.col("_before") + F.col("_own")).cast("int").alias(name))
