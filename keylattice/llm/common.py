"""What the operators of this subpackage share: the shared folder, tables, and bounded training samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; fixed values.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a folder of this machine does, but only for a session that runs on this machine alone; a
    cluster without a shared folder is refused.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(shared_root, "own", None) or "file://" + tempfile.mkdtemp(prefix="spark-keylattice-")
        shared_root.own = root
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then deletes an execution's shuffle files when the execution ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, partitioned_by: str | None = None, **options) -> None:
    """Write a table to `path`; nothing reads its shuffles after it, so they go with the write."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        writer = df.write.options(**({"compression": "zstd"} | options))
        (writer.partitionBy(partitioned_by) if partitioned_by else writer).parquet(path)
    finally:
        conf.set(CLEAN, before)


def materialise(df: DataFrame, name: str, partitioned_by: str | None = None, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    `release` deletes it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    written(df, path, partitioned_by, **options)
    out = spark.read.schema(schema).parquet(path)
    out._keylattice_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialise` made, through Spark's file system layer. Only when nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._keylattice_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus: the fold of a labelled row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_docs: int, max_chars: int, positive: int = 1, share: float = 0.5) -> tuple[list[tuple[int, str, int]], float]:
    """(id, text, label) of at most max_docs labelled training documents, chosen by their ids alone, up to `share` of them of the
    rarer class `positive`; and the share of that class among all training labels that have a document.

    Labels meet the documents, by id, before the draw, so a label without a document takes no place. Of a text longer than max_chars the
    sample has a window of that length, at a place that depends on the id: only what is fitted is cut. Null texts count as empty;
    rows whose id or label is null are left out; of labels that repeat an id the largest counts, of texts the smallest. This is the one place where
    labels are read; everything that is fitted comes from this bounded sample, whatever the corpus size.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    want = int(max_docs * share)
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    order = [F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("doc_id")]
    ids = [r for part, n in ((F.col("label") == positive, want), (F.col("label") != positive, max_docs - want)) for r in known.where(part).orderBy(*order).limit(n).collect()]
    small = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in ids], "doc_id long, label int")
    text = F.coalesce("text", F.lit(""))
    size = F.char_length(text)
    start = 1 + F.pmod(F.xxhash64(F.col("doc_id"), F.lit(18)), F.greatest(size - max_chars, F.lit(0)) + 1)
    cut = F.when(size > max_chars, F.substring(text, start.cast("int"), F.lit(max_chars))).otherwise(text)
    got = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").groupBy("doc_id", "label").agg(F.min(cut).alias("text")).collect()
    return sorted(((r.doc_id, r.text, r.label) for r in got), key=lambda r: (r[2] != positive, r[0])), counts.get(positive, 0) / total if total else 0.0
