"""Mixing sources to target weights by hash-threshold histograms: no sort, no shuffle of documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from keylattice.llm.common import WORD, materialise, release, table

#: Buckets of one histogram level: 2 ** LEVEL_BITS.
LEVEL_BITS = 10
LEVELS = 3


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """`sizes` with `place`, the number of sources before it by code point, null last: sorted by ranges, so no task sees all."""
    spark = sizes.sparkSession
    at = F.col("source").asc_nulls_last()
    kinds = StructType([*sizes.schema.fields, StructField("part", IntegerType()), StructField("own", LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64())], names=kinds.names)
            first += n

    ordered = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), at).sortWithinPartitions(at)
    out = materialise(ordered.mapInArrow(numbered, kinds), "mix-sources")
    before, firsts = 0, []
    for r in out.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per range
        firsts.append((r.part, before))
        before += r.n
    return out.join(F.broadcast(spark.createDataFrame(firsts, "part int, first long")), "part").select(*sizes.columns, (F.col("first") + F.col("own")).alias("place"))


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`sources` (place, n) with `target`: share of all sizes dealt by weight (by place, weights repeating), none above
    `most` times its source's size; what is above is dealt again by weight among the others.

    A source is at its limit when limit / weight is at most the level at which all below it are full; each round raises the
    level by two sums over the sources, until no further source is at its limit. Empty sources get 0. If every source is at its
    limit, the rest of the budget stays undealt.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("limit", F.col("n") * F.lit(float(most)))
    level, full = float("-inf"), -1
    while True:
        at_limit = F.col("limit") <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum("n").alias("all"), F.sum(F.when(at_limit, F.col("limit"))).alias("dealt"), F.sum(F.when(~at_limit, F.col("weight"))).alias("open"), F.count_if(at_limit).alias("full")).first()
        if r["full"] == full or not r["open"]:
            break
        full, level = r["full"], max(level, (share * (r["all"] or 0) - (r["dealt"] or 0.0)) / r["open"])
    return sources.withColumn("target", F.when(F.lit(not r["open"]) | at_limit, F.col("limit")).otherwise(F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and key of each row of `docs` (doc_id, text, source).

    Size is the number of words, 0 for null, empty and blank texts. With a target of t times its source's size, every
    document is taken floor(t) times, and those below a threshold of a 64-bit hash of (doc_id, text) once more.
    The threshold comes from nested histograms: words by source and leading hash bits, then by the next bits in
    the one boundary bucket only, LEVELS times; of the last boundary bucket, one in 2 ** (LEVEL_BITS * LEVELS), all or
    nothing is taken, whichever comes nearer to the target. Ids and sources may be null, and ids repeat: equal rows share a hash
    and are taken alike; other ties don't exist. A very long text counts whole; an empty table gives an empty result; other columns
    are not read. Reruns agree. Only a compact table without texts is written and read again; sources, however many, stay in tables.
    """
    compact = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("key")
    )
    compact = materialise(compact, "mix-sizes")
    sizes = compact.groupBy("source").agg(F.sum("size").alias("n"))
    dealt = with_targets(ranked_sources(sizes), weights, share, most)
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0)
    # Below edge everything is taken once more; rest is what the boundary bucket that starts at edge must still give.
    state = dealt.select("source", "n", "target", whole.alias("whole"), (F.col("target") - F.col("n") * whole).alias("rest"), F.lit(0).cast("long").alias("edge"))
    state = materialise(state, "mix-state")
    # Unsigned leading bits of the hash, as a number below 2 ** (LEVEL_BITS * LEVELS).
    bits = F.shiftrightunsigned("d.key", 64 - LEVEL_BITS * LEVELS)
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    for level in range(1, LEVELS + 1):
        shift, width = LEVEL_BITS * (LEVELS - level), 1 << LEVEL_BITS * (LEVELS - level + 1)
        inside = compact.alias("d").join(state.alias("s"), same).where(bits.between(F.col("edge"), F.col("edge") + width - 1))
        sums = inside.groupBy("s.source", "rest", F.shiftright(bits, shift).alias("bucket")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        # The first bucket that reaches the rest; its documents are dealt by the next level.
        edges = sums.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", "n", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("at"))
        left = F.col("rest") - F.coalesce(F.col("at.before"), F.lit(0))
        edge = F.coalesce(F.shiftleft("at.bucket", shift), F.col("edge"))
        if level == LEVELS:  # the documents of the last bucket are taken if that is nearer
            edge = edge + F.when(F.col("at.n") - left < left, 1).otherwise(0)
        moved = state.alias("s").join(edges.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
        done, state = state, materialise(moved.select("s.source", "s.n", "target", "whole", left.alias("rest"), edge.cast("long").alias("edge")), "mix-state")
        release(done)
    out = compact.alias("d").join(state.alias("s"), same, "left").withColumn("copies", (F.col("whole") + F.when(bits < F.col("edge"), 1).otherwise(0)).cast("long"))
    return out.select("doc_id", "d.source", "size", F.col("n").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of all `documents`; null, empty and repeated rows as in `mix_sources`."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
