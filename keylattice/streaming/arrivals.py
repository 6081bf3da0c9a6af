"""Import of files as they arrive in a folder: an extension, on Structured Streaming's file source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keylattice.sources import versions as V
from keylattice.sources.domain import Domain
from keylattice.sources.shared import settled

FILES = "path string, modificationTime timestamp, length long, content binary"


def import_arrivals(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Hands new files (path, length, content) to `handle(files, batch_id)`, each file in one batch, and ends when all
    that was there is handled. Files without a byte have no row. A batch may be handed over again after a failure, so `handle` writes by batch_id."""
    arriving = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return arriving.select("path", "length", "content").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MANIFEST = "digest string, path string, batch long, outcome string"


def import_once(spark: SparkSession, root: str, files: DataFrame, batch: int, judge: Callable[[DataFrame], DataFrame], step: Callable[[Domain, DataFrame], Domain]) -> None:
    """Brings files (path, length, content) into the domain below `root`, each content once, and publishes one version.

    judge(files) gives path and error, null for files that can be read; step(domain, files) is the domain with these. The
    manifest beside each version has a row for each content that was seen, with its batch and outcome: imported, or the error
    that keeps a file out. Contents of the manifest are left out, so a batch that is handed over again, and a
    copy of a file under another name, change nothing. Of equal contents in one batch the first path counts.
    """
    arrived = files.withColumn("digest", F.sha2("content", 256))
    first = arrived.groupBy("digest").agg(F.min("path").alias("path"))
    arrived = settled(arrived.join(first, ["digest", "path"]).dropDuplicates(["digest"]))

    def made(now: Domain, number: int) -> tuple[Domain, dict[str, DataFrame]] | None:
        known = V.beside(spark, root, "manifest", number)
        known = spark.createDataFrame([], MANIFEST) if known is None else known
        new = arrived.join(known.select("digest"), "digest", "left_anti")
        judged = settled(new.join(judge(new.select("path", "length", "content")).select("path", "error"), "path", "left"))
        if judged.isEmpty():
            return None
        rows = judged.select("digest", "path", F.lit(batch).cast("long").alias("batch"), F.coalesce("error", F.lit("imported")).alias("outcome"))
        return step(now, judged.where("error IS NULL").select("path", "length", "content")), {"manifest": known.unionByName(rows)}

    V.commit(spark, root, made)


def import_arriving_once(spark: SparkSession, folder: str, root: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], step: Callable[[Domain, DataFrame], Domain], files_per_batch: int = 100) -> StreamingQuery:
    """`import_once` for the files that arrive in a folder, until all that was there is handled. The domain below `root` and its manifest change
    together, so a failure between a batch and its checkpoint brings nothing in twice."""
    return import_arrivals(spark, folder, checkpoint, lambda files, batch: import_once(spark, root, files, batch, judge, step), files_per_batch)
