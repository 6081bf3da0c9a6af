"""Exact top-k search by pivot-table elimination.

The pivot table, the distance of every vector to every pivot, is made once and stored in blocks of vectors that are near the
same pivot, with the interval of each pivot's distances over the block. A query starts with the k-th score of a bounded
sample as its threshold. Intervals give the highest score that a block can hold: only queries that may find something there go
to a block, and there candidates are evaluated in the order of their own bounds until the next one is below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.llm.common import materialise, release, table

PIVOTS, BLOCK, CHUNK = 32, 1024, 256
#: Sampled vectors that pivots are taken from and that give the first thresholds; the longest that are sampled.
SAMPLE, LONGEST = 1024, 4096
#: Blocks of vectors near one pivot that one task packs; blocks in a page of summaries; queries in a block.
SHARE, PAGE, QUERIES = 16, 256, 256


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or holds a null or non-finite component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale)))


def far_apart(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before."""
    chosen, left = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        left = np.minimum(left, ((sample - sample[chosen[-1]]).astype(np.float64) ** 2).sum(1))
        if left.max() <= 0:
            break
        chosen.append(int(left.argmax()))
    return sample[chosen]


class Guide:
    """Pivots and sampled vectors of each dimension, from a bounded sample; a dimension without any has empty ones."""

    def __init__(self, rows: list, pivots: int):
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r.v), []).append((r.id, r.v))
        self.ids = {n: np.array([i for i, _ in own], np.int64) for n, own in by.items()}
        self.sample = {n: np.array([v for _, v in own], np.int64) for n, own in by.items()}
        self.pivots = {n: far_apart(x, pivots).astype(np.float64) for n, x in self.sample.items()}

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The rows of the pivot table of these vectors."""
        p, x = self.pivots.get(x.shape[1], np.zeros((0, x.shape[1]))), x.astype(np.float64)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0))

    def thresholds(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th score of each query among the sampled vectors, as a lower bound of its k-th score among all."""
        out = np.full(len(q), -np.inf)
        if q.shape[1] in self.sample:
            own = self.ids[q.shape[1]]
            for i, s in enumerate(scores(self.sample[q.shape[1]], q)):
                best = np.unique(np.stack([own, s]), axis=1)  # a repeated id and score is one result
                best = np.sort(best[1][best[0] != ids[i]])
                if len(best) >= k:
                    out[i] = float(best[-k])
        return out


def scores(x: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """Exact integer inner products of x with each query."""
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52
    xf = x.astype(np.float64) if small else x
    for v in q:
        yield np.rint(xf @ v.astype(np.float64)).astype(np.int64) if small else x @ v


def slack(xx: np.ndarray, qq: float) -> float:
    """What rounding may take from a bound."""
    return 1e-6 * (1 + float(xx.max(initial=0)) + qq)


def top_of_block(q_ids: np.ndarray, q: np.ndarray, mine: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, table_: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its id, the k best of block x of at least its threshold, with ties to the smaller id, their scores, and
    how many were evaluated.

    table_ and mine hold the distances to the pivots. By the triangle inequality |q - x| >= max over p of
    ||q - p| - |x - p||, so <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 has an upper bound; candidates are evaluated
    exactly in the order of that bound until the next bound is below the k-th score.
    """
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52
    xf = x.astype(np.float64)
    xx, columns = (xf * xf).sum(1), np.ascontiguousarray(table_.T)
    for i in range(len(q)):
        qf = q[i].astype(np.float64)
        lower = np.abs(columns - mine[i][:, None]).max(0, initial=0)
        bound = (qf @ qf + xx - lower * lower) / 2 + slack(xx, qf @ qf)
        order = np.flatnonzero((bound >= least[i]) & (ids != q_ids[i]))
        order = order[np.argsort(-bound[order], kind="stable")]
        best_s, best_i, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while done < len(order) and not (len(best_s) == k and bound[order[done]] < best_s[-1]):
            c = order[done : done + CHUNK]
            done += len(c)
            s = np.rint(xf[c] @ qf).astype(np.int64) if small else x[c] @ q[i]
            some = s >= (best_s[-1] if len(best_s) == k else least[i])
            best_s, best_i = np.concatenate([best_s, s[some]]), np.concatenate([best_i, ids[c][some]])
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
        yield int(q_ids[i]), best_i, best_s, done


def _blocks(vectors: DataFrame, guide, rows: int, k: int | None = None) -> DataFrame:
    """Packs (dim, near, id, v) rows, which come in that order, into blocks of one dimension and nearest pivot, with the pivot
    table, its intervals, the largest squared length and, given k, the thresholds of the rows as queries."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(cut: pd.DataFrame) -> pd.DataFrame:
            m, ids = np.array(cut["v"].tolist(), dtype=np.int64), cut["id"].to_numpy(np.int64)
            far = guide.value.distances(m)
            most = float((m.astype(np.float64) ** 2).sum(1).max())
            low, high = (far.min(0), far.max(0)) if len(far) else (far, far)
            return pd.DataFrame({"dim": [m.shape[1]], "block": [0], "ids": [ids.tobytes()], "data": [m.tobytes()], "far": [far.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()], "most": [most], "least": [guide.value.thresholds(ids, m, k).tobytes() if k else b""]})

        held: pd.DataFrame | None = None
        for batch in batches:
            for _, part in batch.groupby(["dim", "near"], sort=False):
                if held is not None and (held["dim"].iloc[0], held["near"].iloc[0]) != (part["dim"].iloc[0], part["near"].iloc[0]):
                    yield block(held)
                    held = None
                part = part if held is None else pd.concat([held, part])
                while len(part) > rows:
                    yield block(part.iloc[:rows])
                    part = part.iloc[rows:]
                held = part
        if held is not None and len(held):
            yield block(held)

    # What is near one pivot goes to as many tasks as it needs, by its size: a hot pivot is split, a small one makes whole blocks.
    parts = vectors.groupBy("dim", "near").agg(F.ceil(F.count("*") / (SHARE * rows)).alias("parts"))
    placed = vectors.join(parts, ["dim", "near"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    ordered = placed.repartition("dim", "near", "part").sortWithinPartitions("dim", "near", "id")
    made = ordered.select("dim", "near", "id", "v").mapInPandas(packed, "dim int, block long, ids binary, data binary, far binary, low binary, high binary, most double, least binary")
    # A block goes by a hash of what it holds; equal blocks would give equal results, which count once.
    return made.withColumn("block", F.xxhash64("dim", "ids", "data"))


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, evaluated: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for each row where `query` holds; on
    request also `evaluated`, the number of candidates whose score was computed for the query.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
    id; only vectors of one dimension are compared; very long ones (over LONGEST) have no pivots and are all evaluated. A row
    with the query's id counts as its own. Repeated rows count once; ties go to the smaller id, an id with several vectors is a
    candidate with each and, as a query, gets the best of all. An empty table gives an empty result.

    Summaries of candidate blocks, in pages, meet query blocks in an equi-join on (dim, salt); what a block may hold for a query
    decides which queries go on. These meet the block once, joined on its name; each meeting gives at most k rows a
    query. No side is broadcast, apart from the bounded sample and its pivots.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), query.alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    ready = ready.withColumn("dim", F.size("v")).groupBy("id", "v", "dim").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    rows = ready.where(F.col("dim") <= LONGEST).orderBy(F.xxhash64("id"), "id", "v").select("id", "v").limit(SAMPLE).collect()
    guide = spark.sparkContext.broadcast(Guide(rows, pivots))

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out = np.zeros(len(v), np.int32)
            size = v.map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                far = guide.value.distances(np.array(v.iloc[at].tolist(), dtype=np.int64))
                out[at] = far.argmin(1) if far.shape[1] else 0
            yield pd.Series(out)

    placed = materialise(ready.withColumn("near", nearest("v")), "vectors")
    c = materialise(_blocks(placed, guide, block), "candidate-blocks")
    q = materialise(_blocks(placed.where("asks"), guide, QUERIES, k), "query-blocks")
    release(placed)

    def paged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for at in range(0, len(part), PAGE):
                    cut = part.iloc[at : at + PAGE]
                    yield pd.DataFrame({"dim": [dim], "blocks": [cut["block"].to_numpy(np.int64).tobytes()], "lows": [b"".join(cut["low"])], "highs": [b"".join(cut["high"])], "mosts": [cut["most"].to_numpy(np.float64).tobytes()]})

    def admitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                blocks, most = np.frombuffer(r.blocks, np.int64), np.frombuffer(r.mosts)
                q_ids, least = np.frombuffer(r.ids, np.int64), np.frombuffer(r.least)
                mine, x = np.frombuffer(r.far).reshape(len(q_ids), -1), np.frombuffer(r.data, np.int64).reshape(len(q_ids), -1)
                low, high = (np.frombuffer(v).reshape(len(blocks), -1) for v in (r.lows, r.highs))
                qq = (x.astype(np.float64) ** 2).sum(1)
                some = np.zeros((len(blocks), len(q_ids)), bool)
                for j in range(len(blocks)):
                    gap = np.maximum(np.maximum(mine - high[j], low[j] - mine), 0).max(1, initial=0)
                    some[j] = (qq + most[j] - gap * gap) / 2 + 1e-6 * (1 + most[j] + qq) >= least
                for j in np.flatnonzero(some.any(1)):
                    at = np.flatnonzero(some[j])
                    yield pd.DataFrame({"block": [blocks[j]], "q_ids": [q_ids[at].tobytes()], "q_data": [x[at].tobytes()], "q_far": [mine[at].tobytes()], "q_least": [least[at].tobytes()]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                x, qs = np.frombuffer(r.data, np.int64).reshape(len(ids), -1), np.frombuffer(r.q_data, np.int64).reshape(len(q_ids), -1)
                far, mine = np.frombuffer(r.far).reshape(len(ids), -1), np.frombuffer(r.q_far).reshape(len(q_ids), -1)
                ones, hits, found, tried = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                for one, i, score, n in top_of_block(q_ids, qs, mine, np.frombuffer(r.q_least), ids, x, far, k):
                    if n:  # a row without a candidate carries the number of evaluations
                        ones += [one] * (len(i) + 1)
                        tried += [0] * len(i) + [n]
                        hits += [i, [0]]
                        found += [score, [0]]
                none = np.array(tried, dtype=np.int64) > 0
                ints = lambda parts: pd.arrays.IntegerArray(np.concatenate(parts).astype(np.int64), none)  # noqa: B023, E731
                yield pd.DataFrame({"query_id": np.array(ones, dtype=np.int64), "vec_id": ints(hits), "score": ints(found), "tried": tried})

    salts = max(1, spark.sparkContext.defaultParallelism)
    pages = c.select("dim", "block", "low", "high", "most").mapInPandas(paged, "dim int, blocks binary, lows binary, highs binary, mosts binary").withColumn("salt", F.pmod(F.xxhash64("blocks"), F.lit(salts)).cast("int"))
    asked = q.select("dim", "ids", "data", "far", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sent = asked.join(pages, ["dim", "salt"]).mapInPandas(admitted, "block long, q_ids binary, q_data binary, q_far binary, q_least binary")
    found = sent.join(c.select("block", "ids", "data", "far").hint("merge"), "block").mapInPandas(met, "query_id long, vec_id long, score long, tried long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = found.where("vec_id IS NOT NULL").select("query_id", "vec_id", "score").dropDuplicates()
    out = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out.join(found.groupBy("query_id").agg(F.sum("tried").alias("evaluated")), "query_id") if evaluated else out


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every fiftieth of all `embeddings`; odd, null and repeated vectors as in `top_k`."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = {
    "op1_vector_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5"""
}
