"""A corpus pipeline: quality, toxicity, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.bpe import encode_documents
from keylattice.llm.common import materialise, table
from keylattice.llm.jaccard_join import drop_near_duplicates
from keylattice.llm.mixing import mix_sources
from keylattice.llm.quality import score_quality
from keylattice.llm.toxicity import score_toxicity
from keylattice.shipping import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    ship(spark)
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of at least 0.75 similarity connect."""
    ship(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a document taken twice is there twice."""
    ship(spark)
    plan = mix_sources(docs).where("copies > 0").select("source", "key", "copies").distinct()
    # Columns of documents may have any name, so they go as one.
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.col("source").alias("from"))
    taken = whole.alias("d").join(plan.alias("p"), (F.col("d.key") == F.col("p.key")) & F.col("d.from").eqNullSafe(F.col("p.source")))
    copies = taken.select("d.doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that prove the round trip."""
    ship(spark)
    return encode_documents(docs.select("doc_id", "source", "text"), tokens=True)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("mix", mix),
    ("tokens", encode),
]

#: Neither the classifiers nor BPE can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
