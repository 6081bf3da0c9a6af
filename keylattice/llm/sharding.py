"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest dimension of metadata.

The driver holds the tree alone, one cut for each shard. A level of the tree is two or three sums over a table of sizes and coordinates without
texts: bytes by node, dimension and bin, then bytes by hash within the bin where the median falls, until that is one row.
Documents then go to their shards in one exchange, and are numbered where they are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from keylattice.llm.common import materialise, release, shared_path, table, written

#: Bins of a dimension, hash bits of one refinement, and bits of the hash that orders rows of one bin.
BINS, STEP, TIE = 1024, 12, 62
#: Rows of a node's boundary that are told apart at once.
FEW = 1 << STEP
#: What a row takes beside its text, and bytes of a file of a shard.
ROW_BYTES, FILE_BYTES = 16, 64 << 20
#: Runs of a shard's rows in one partition, a few numbers each, that are broadcast when slots are read.
MOST_RUNS = 1_000_000
#: Names of own columns beside those of documents.
OWN = "_keylattice_{}"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def by_value(column: str) -> Column:
    """A label's bin by its hash: rows of one label stay together, whatever their number."""
    return F.pmod(F.xxhash64(F.lit(17), F.col(column)), F.lit(BINS)).cast("int")


def by_length(column: str) -> Column:
    """A text's bin by the logarithm of its bytes: 32 bins for each doubling."""
    return F.least(F.floor(32 * F.log2(F.coalesce(F.octet_length(column), F.lit(0)).cast("double") + 1)), F.lit(BINS - 1)).cast("int")


#: Dimensions: of a document's metadata, in the order in which they are preferred.
DIMENSIONS: dict[str, Callable[[str], Column]] = {"source": by_value, "lang": by_value, "text": by_length}


def tie(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Order of rows in one bin, from 0 below 2 ** TIE: by text first, so that copies are neighbours and a cut parts few groups."""
    half = TIE // 2
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - half), half) + F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - half)


@dataclass
class Node:
    """A part of the tree: shards `first` to `first + shards - 1`, and, once it is cut, where."""

    first: int
    shards: int
    dim: int = 0
    bin: int = 0
    tie: int = 0
    #: Of the rows exactly at the cut, which are equal, this share goes left.
    share: float = 0.0
    sides: list[Node] = field(default_factory=list)

    def find(self, leaf: Callable[[Node], int], at: Callable[[int], Column], own: Column) -> Column:
        """leaf(node) of the node that a row falls into."""
        if not self.sides:
            return F.lit(leaf(self))
        left, right = (s.find(leaf, at, own) for s in self.sides)
        here = at(self.dim)
        equal = own < self.tie
        if self.share:
            draw = F.pmod(F.xxhash64(F.lit(self.first), F.monotonically_increasing_id()), F.lit(1 << 20))
            equal = equal | ((own == self.tie) & (draw < int(self.share * (1 << 20))))
        return F.when((here < self.bin) | ((here == self.bin) & equal), left).otherwise(right)


def grow(rows: DataFrame, shards: int, dims: int) -> Node:
    """The tree over `rows` (size, tie, c0, c1, ...): a node of n shards gives n // 2 of them its first n // 2 / n of bytes.

    Rows of a node are ordered by its widest dimension, then by tie; the cut falls where bytes come nearest to the wanted share.
    What reaches the driver is at most `shards` times BINS times `dims` sums a level.
    """
    root = Node(0, shards)
    level = [root]
    at, own = (lambda d: F.col(f"c{d}")), F.col("tie")
    while level := [n for n in level if n.shards > 1]:
        inside = rows.withColumn("node", root.find(lambda n: level.index(n) if n in level else -1, at, own)).where("node >= 0")  # noqa: B023
        coords = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"c{d}").alias("bin")) for d in range(dims)))).alias("c")
        sums = inside.select("node", "size", coords).groupBy("node", "c.dim", "c.bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        found: dict[int, dict[int, list]] = {}
        for r in sums.collect():
            found.setdefault(r.node, {}).setdefault(r.dim, []).append((r.bin, r.bytes, r.rows))
        open_: dict[int, list] = {}  # node: bytes still wanted on the left, first tie and bits of the part where the median is, its rows
        for i, by in found.items():
            node = level[i]
            spread = [max(by[d])[0] - min(by[d])[0] for d in range(dims)]
            node.dim = spread.index(max(spread))
            bins = sorted(by[node.dim])
            want = sum(b for _, b, _ in bins) * (node.shards // 2) / node.shards
            node.bin, before, many = _reach([(b, n, k) for b, n, k in bins], want)
            open_[i] = [want - before, 0, TIE, many]
        while open_:
            ask = [(i, level[i].dim, level[i].bin, lo, bits, 0 if many <= FEW else max(0, bits - STEP)) for i, (_, lo, bits, many) in open_.items()]
            spec = rows.sparkSession.createDataFrame(ask, "node int, dim int, at int, lo long, bits int, shift int")
            here = F.element_at(F.array(*(F.col(f"c{d}") for d in range(dims))), F.col("dim") + 1)
            part = inside.join(F.broadcast(spec), "node").where((here == F.col("at")) & (F.expr("shiftrightunsigned(tie - lo, bits)") == 0))
            sums = part.groupBy("node", F.expr("shiftrightunsigned(tie - lo, shift)").alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            got: dict[int, list] = {}
            for r in sums.collect():
                got.setdefault(r.node, []).append((r.bucket, r.bytes, r.rows))
            for i, _, _, lo, _, shift in ask:
                bucket, before, many = _reach(sorted(got[i]), open_[i][0])
                rest, lo = open_[i][0] - before, lo + (bucket << shift)
                if shift and many > 1:
                    open_[i] = [rest, lo, shift, many]
                    continue
                node, whole = level[i], next(b for k, b, _ in got[i] if k == bucket)
                take = min(max(round(many * rest / whole), 0), many)  # of so many rows that are equal, or one
                node.tie = lo + (1 << shift) if take == many else lo
                node.share = take / many if 0 < take < many else 0.0
                half = node.shards // 2
                node.sides = [Node(node.first, half), Node(node.first + half, node.shards - half)]
                del open_[i]
        level = [s for n in level for s in n.sides]
    return root


def _reach(sums: list[tuple[int, int, int]], want: float) -> tuple[int, int, int]:
    """The first key whose running sum reaches `want`, the sum before it, and its rows."""
    before = 0
    for key, n, many in sums:
        if before + n >= want:
            return key, before, many
        before += n
    key, n, many = sums[-1]
    return key, before - n, many


def shard_documents(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Callable[[str], Column]] | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `docs` (doc_id, text and the columns of `dimensions`) to path/shard=N and return what is there, with `shard` and `slot`.

    Either the number of shards is given, or the bytes that a shard is to reach, of UTF-8 text and ROW_BYTES for each row.
    Sizes are as near to equal as whole documents allow: the two sides of a cut miss their share by half a document at most.
    Null texts have no bytes and stay null; nulls in dimensions are a value like others; null and repeated ids are rows like others, and of
    rows that are equal in id and text a share goes left by chance. Very long texts stay whole. An empty table gives an empty
    result. Other columns stay, but columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    dimensions = dimensions or DIMENSIONS
    docs = docs.drop("shard", "slot")
    coords = [bin_of(c) for c, bin_of in dimensions.items()]
    rows = materialise(docs.select(size_of().alias("size"), tie().alias("tie"), *(c.alias(f"c{i}") for i, c in enumerate(coords))), "shard-sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or total or 1)))
    tree = grow(rows, shards, len(coords)) if total else Node(0, shards)
    release(rows)
    files = max(1, -(-total // (shards * file_bytes)))
    piece = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(files))
    # Coordinates are columns first, so that a text is hashed once and not at every cut.
    placed = docs.withColumns({OWN.format("tie"): tie()} | {OWN.format(i): c for i, c in enumerate(coords)})
    shard = tree.find(lambda n: n.first, lambda d: F.col(OWN.format(d)), F.col(OWN.format("tie")))
    dealt = placed.select(*[f"`{c}`" for c in docs.columns], shard.cast("int").alias("shard")).repartition("shard", piece).sortWithinPartitions("shard")
    # Rows of a partition are numbered in their order, so a shard's rows in it have consecutive places.
    written(dealt.withColumn(OWN.format("place"), F.monotonically_increasing_id()), path, partitioned_by="shard")
    return read_shards(spark, path, dealt.schema)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the shards at `path` with `shard` and `slot`, their place in it from 0, without gaps."""
    place = OWN.format("place")
    got = spark.read.schema(StructType([*schema.fields, StructField(place, LongType())])).parquet(path)
    part = F.shiftright(place, 33)
    runs = got.groupBy("shard", part.alias("part")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    shard, run, start = (OWN.format(c) for c in ("shard", "run", "start"))
    runs = materialise(runs, "shard-runs")
    starts = runs.select(F.col("shard").alias(shard), F.col("part").alias(run), (before - F.col("first")).alias(start))
    if runs.count() <= MOST_RUNS:  # else Spark shuffles the rows
        starts = F.broadcast(starts)
    joined = got.join(starts, (F.col("shard") == F.col(shard)) & (part == F.col(run)))
    return joined.select(*[f"`{n}`" for n in schema.names], (F.col(place) + F.col(start)).alias("slot"))


def op12_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all `documents` in 40 shards of nearly equal bytes, read back from
    their files; odd rows as in `shard_documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = shard_documents(docs, shared_path(spark, "shards"), shards=40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return got.select("doc_id", size_of().alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
