"""Ranked lexical search: postings grouped by exact impact, highest first, until bounds prove the best documents.

Documents are dealt by their files, not by term, so a frequent word loads no single task. A task turns its documents into
blocks; a block's postings are ordered by term and falling impact. A question takes postings score at a time; what
has not been taken yet bounds every score from above. Once at most k documents can still be among the best k, only their
scores are completed, exactly, from the documents' own postings. The k-th best score of earlier blocks goes on as a threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylattice.llm.common import materialise, table
from keylattice.llm.textbuf import LOWER, Hashes, pieces, raw, spans, trim
from keylattice.llm.words import ragged

#: Bytes of a term: digits, ASCII letters and all bytes of other characters; fixed by the definition of a term.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[48:58] = TERM_BYTE[65:91] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True

#: Bytes of questions that are searched for at once, and postings of a block.
QUESTION_BYTES, BLOCK_POSTINGS = 4 << 20, 1 << 20
#: A round takes the impacts down to this share of the highest one left.
ROUND = 0.5
#: Bits of an impact in a key of (term, falling impact); an impact is below 44,000 * 10 ** 6.
BITS = 36
FOUND = "question int, doc_id long, score long"


def span_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all terms."""
    return spans(TERM_BYTE[data], offsets)


class Vocabulary:
    """The distinct terms of the questions, found in texts by a 64-bit hash and confirmed byte by byte."""

    def __init__(self, terms: list[bytes]):
        data, offsets = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([0, *map(len, terms)])
        hashes = Hashes(data).of(offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the questions share a hash")
        self.data, self.start, self.size = data, offsets[:-1], np.diff(offsets)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 where no question has it. data: lower-cased bytes."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1)
        hashes = Hashes(data).of(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        term = self.order[at]
        term[(self.hashes[at] != hashes) | (self.size[term] != ends - starts)] = -1
        hit = np.flatnonzero(term >= 0)
        size = self.size[term[hit]]
        same = data[ragged(starts[hit], size)] == self.data[ragged(self.start[term[hit]], size)]
        if len(hit):
            term[hit[~np.logical_and.reduceat(same, np.cumsum(size) - size)]] = -1
        return term


def term_counts(docs: DataFrame, vocabulary, kept: str) -> DataFrame:
    """doc_id, n (all terms with repeats), terms and counts (those of the vocabulary) of each document with a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                data = LOWER[data]
                starts, ends, rows = span_terms(data, offsets)
                n = np.bincount(rows, minlength=part.num_rows)
                term = words.find(data, starts, ends)
                hit = term >= 0
                key, count = np.unique(rows[hit] * max(len(words.size), 1) + term[hit], return_counts=True)
                row, term = key // max(len(words.size), 1), key % max(len(words.size), 1)
                keep = np.flatnonzero(n > 0)
                edges = pa.array(np.append(np.searchsorted(row, keep), len(row)), pa.int32())  # rows without a term have none here
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep)), pa.array(n[keep]), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return materialise(rows.mapInArrow(counted, "doc_id long, n long, terms array<int>, counts array<int>"), kept)


def corpus_counts(compact: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of every term, counted by task first. A result of at most terms + 2 rows reaches the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
            total[terms] += batch.num_rows
            total[terms + 1] += batch.column("n").to_numpy().sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(terms + 2, np.int64)
    for r in compact.select("terms", "n").mapInArrow(added, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return int(out[terms]), int(out[terms + 1]), out[:terms]


@dataclass
class Weights:
    """What scores need beside a document: w of each term, N, L and the highest score that interests nobody."""

    w: np.ndarray
    docs: int
    words: int

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Integer impact of postings: term, its count, and the length of its document."""
        m = 100 - 75 + (75 * n * self.docs) // max(self.words, 1)
        return self.w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class ImpactBlock:
    """Postings of some documents, by term and falling impact, and by document."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: Weights):
        self.ids, self.nulls = ids, nulls
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        impact = weights.impacts(term.astype(np.int64), tf.astype(np.int64), n[doc].astype(np.int64))
        self.first, self.size, self.term, self.impact = np.cumsum(sizes) - sizes, sizes, term, impact
        key = (term.astype(np.int64) << BITS) + ((1 << BITS) - 1 - impact)
        order = np.argsort(key, kind="stable")
        key, self.doc = key[order], doc[order]
        # A group is all postings of one term with one impact.
        self.start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[self.start]
        self.start = np.append(self.start, len(key))
        self.score = (1 << BITS) - 1 - (self.key & ((1 << BITS) - 1))

    def best(self, term: np.ndarray, times: np.ndarray, k: int, least: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents that can be among the k best with a score of at least `least`, and their exact scores.

        times: how often the question has each term. asked: zeros for every term, left so.
        """
        at, end = np.searchsorted(self.key, term << BITS), np.searchsorted(self.key, (term + 1) << BITS)
        live, many = term, times
        score = np.zeros(len(self.ids), np.int64)
        while True:
            some = at < end
            live, many, at, end = live[some], many[some], at[some], end[some]
            heads = many * self.score[at]
            left = int(heads.sum())  # no document gets more than this from what is left
            bar = max(least, int(np.partition(score, -k)[-k]) if len(score) >= k else 0, 1)
            near = np.flatnonzero(score + left >= bar)
            if not left:
                return near, score[near]
            if left < bar and len(near) <= k:
                break
            level = max(1, int(heads.max() * ROUND))
            upto = np.searchsorted(self.key, (live << BITS) + ((1 << BITS) - 1 - -(-level // many)), "right")
            upto = np.clip(upto, at, end)
            group, post = ragged(at, upto - at), ragged(self.start[at], self.start[upto] - self.start[at])
            gain = np.repeat(self.score[group] * np.repeat(many, upto - at), self.start[group + 1] - self.start[group])
            np.add.at(score, self.doc[post], gain)
            at = upto
        asked[term] = times
        own, sums = ragged(self.first[near], self.size[near]), np.zeros(len(near), np.int64)
        np.add.at(sums, np.repeat(np.arange(len(near)), self.size[near]), asked[self.term[own]] * self.impact[own])
        asked[term] = 0
        return near, sums


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each question, in two steps, so that no task reads what all others found."""
    at = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("part", F.spark_partition_id() % 64)
    for keys in (["question", "part"], ["question"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*at))).where(F.col("rank") <= k)
    return some.select("question", "rank", "doc_id", "score")


def _search(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """question (place in `texts`), rank, doc_id, score."""
    spark = docs.sparkSession
    data, offsets = raw(pa.array(texts, pa.string()))
    data = LOWER[data]
    whole = data.tobytes()
    asks: list[Counter] = [Counter() for _ in texts]
    for a, b, row in zip(*(x.tolist() for x in span_terms(data, offsets)), strict=True):
        asks[row][whole[a:b]] += 1
    terms = sorted({t for ask in asks for t in ask})
    number = {t: i for i, t in enumerate(terms)}
    compact = term_counts(docs, spark.sparkContext.broadcast(Vocabulary(terms)), "search-terms")
    docs_n, words_n, df = corpus_counts(compact, len(terms))
    w = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    questions = [(np.array([number[t] for t in ask], np.int64), np.array(list(ask.values()), np.int64)) for ask in asks]
    shared = spark.sparkContext.broadcast((Weights(w, docs_n, words_n), questions))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, questions = shared.value
        asked = np.zeros(len(weights.w), np.int64)
        top = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in questions]  # score, null id, id

        def run(batch: pa.RecordBatch) -> None:
            ids = batch.column("doc_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
            block = ImpactBlock(ids.fill_null(0).to_numpy(), nulls, batch.column("n").to_numpy(), sizes, batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), weights)
            for q, (term, times) in enumerate(questions):
                score, null, own = top[q]
                near, more = block.best(term, times, k, int(score[-1]) if len(score) == k else 1, asked)
                good = more > 0
                if good.any():
                    score, null, own = np.concatenate([score, more[good]]), np.concatenate([null, nulls[near[good]]]), np.concatenate([own, block.ids[near[good]]])
                    first = np.lexsort((own, null, -score))[:k]
                    top[q] = score[first], null[first], own[first]

        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_POSTINGS, "right")))
                run(batch.slice(at, end - at))
                at = end
        sizes = [len(x[0]) for x in top]
        score, null, own = (np.concatenate([t[i] for t in top]) if top else np.zeros(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(top), dtype=np.int32), sizes)), pa.array(own, mask=null.astype(bool)), pa.array(score)], names=["question", "doc_id", "score"])
        trim()

    return best_of(compact.mapInArrow(searched, FOUND), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text).

    A term is a maximal run of digits, letters and characters beyond ASCII, only A-Z lower-cased. Scores are those of the
    integer rule in `Weights.impacts`; equal ones go by doc_id, null last, and scores of 0 are left out. Null texts, and
    texts without a term, are no documents and find nothing as items; a document that is there twice is found twice; an
    item that is there twice is answered twice; an empty table finds nothing. Whole texts count, however long; other columns are
    not read. Items go in blocks of about `question_bytes` of different texts, each one pass over the documents, so
    that what is broadcast is bounded; a block's terms, and k rows of each task and question, are all that leaves a task.
    """
    spark = docs.sparkSession
    key = F.sha2("text", 256)
    asked = items.select("item_id", "text").where("text is not null")
    different = asked.select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / question_bytes))
    found = None
    for b in range(blocks):
        rows = sorted(different.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect())
        names = spark.createDataFrame([(i, r.key) for i, r in enumerate(rows)], "question int, key string")
        part = _search(docs, [r.text for r in rows], k).join(F.broadcast(names), "question").drop("question")
        found = part if found is None else found.unionByName(part)
    return asked.select("item_id", key.alias("key")).join(found, "key").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of all `benchmark` items over all `documents`; odd rows as in `search`."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

ORACLE = {
    "op13_lexical_search": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    own AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM d) GROUP BY r, term),
    lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM own GROUP BY r),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
                FROM (SELECT term, count(*) AS df FROM own GROUP BY term), corpus),
    i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
    asked AS (SELECT q, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT q, item_id, {_TERMS} AS term FROM i) GROUP BY q, term),
    scores AS (SELECT q, any_value(item_id) AS item_id, own.r, any_value(own.doc_id) AS doc_id,
                      CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
               FROM asked JOIN own USING (term) JOIN weights USING (term) JOIN lengths ON lengths.r = own.r, corpus GROUP BY q, own.r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
