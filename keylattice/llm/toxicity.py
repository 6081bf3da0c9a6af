"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Vectors are plain TF-IDF, (1 + log tf) * (log((1 + n) / (1 + df)) + 1) over all words of the examples, of unit length. Labels come in with
the votes alone: each of the NEIGHBOURS nearest examples votes with its label, weighted by its nearness, on the document as a whole and on
each word that it shares with it. The calibration, a logistic function of the whole vote and of the words that lean most, is fitted on
examples that are scored without themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import id_bucket, labelled_sample, table
from keylattice.llm.textbuf import LOWER, Hashes, pieces, spans, trim
from keylattice.llm.words import ragged

#: Training bounds: labelled examples, and characters of an example. Every document is scored whole.
MAX_EXAMPLES, MAX_CHARS = 3000, 20_000
#: Examples of each class that the calibration is fitted on, each scored without itself.
FOLD = 400
#: Voters, at most a quarter of the examples, and how many of them are shown as evidence; chosen by cross-validation in training rows.
NEIGHBOURS, EVIDENCE = 256, 8
#: Examples of a block, and documents that meet a block together.
BLOCK, TOGETHER = 64, 64
#: Weights of terms in at least one of COMMON examples are kept as a matrix beside their postings; MARGIN covers its single precision.
COMMON, MARGIN = 20, 1e-4
#: Bytes of text that are scored at once.
PIECE = 1 << 20
THRESHOLD = 0.3

# Bytes of a term: ASCII letters and all of a multi-byte character.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words."""
    starts, ends, rows = spans(_LETTER[data], offsets)
    return Hashes(LOWER[data]).of(starts, ends), rows


class BlockMaxIndex:
    """Postings of all terms of all examples over blocks of BLOCK examples, with each block's largest weight of each term."""

    def __init__(self, sample: list[tuple[int, str, int]], neighbours: int = NEIGHBOURS, prior: float | None = None):
        """prior: share of toxic rows among all labelled training rows; by default that of the sample."""
        labels = np.array([y for _, _, y in sample], dtype=np.int64)
        self.share = float(labels.mean()) if len(labels) else 0.0
        self.prior = self.share if prior is None or self.share in (0.0, 1.0) else prior
        self.k = min(neighbours, max(8, len(sample) // 4))
        self.model: np.ndarray | None = None
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for at in range(0, len(sample), 100):
            encoded = [t.encode() for _, t, _ in sample[at : at + 100]]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
            hashes, rows = terms(np.frombuffer(b"".join(encoded), np.uint8), offsets)
            order = np.lexsort((rows, hashes))
            hashes, rows = hashes[order], rows[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])])) if len(rows) else np.zeros(0, np.int64)
            found.append((hashes[first], (rows[first] + at).astype(np.int32), np.diff(np.append(first, len(rows))).astype(np.int32)))
        hashes, row, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(hashes, kind="stable")
        hashes, row, counts = hashes[order], row[order], counts[order]
        n = len(sample)
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        self.word = hashes[start]
        self.post_start = np.append(start, len(hashes))
        df = np.diff(self.post_start)
        del hashes, order
        self.idf = np.log((1 + n) / (1 + df)) + 1
        term = np.repeat(np.arange(len(self.word), dtype=np.int32), df)
        weight = (1 + np.log(counts)) * self.idf[term]
        weight /= np.sqrt(np.bincount(row, weight**2, n))[row]
        some = np.zeros(n, bool)
        some[row] = True
        # Documents without any term are all alike: their score is their share of toxic examples, as often as the labels have them.
        odds = np.array([(1 - self.prior) / (1 - self.share), self.prior / self.share]) if 0 < self.share < 1 else np.ones(2)
        alike = np.bincount(labels[~some], minlength=2) * odds
        self.base = float((alike[1] + 10 * self.prior) / (alike.sum() + 10))
        # Similar examples share a block, so that block maxima are tight: they go by their heaviest term.
        lead = np.full(n, len(self.word))
        order = np.argsort(weight, kind="stable")
        lead[row[order]] = term[order]
        order = np.lexsort((np.arange(n), lead, ~some))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids = np.array([i for i, _, _ in sample], dtype=np.int64)[order]
        self.labels = labels[order]
        self.size = int(some.sum())
        self.blocks = -(-self.size // BLOCK)
        by = np.lexsort((place[row], term))
        self.post_row, self.post_weight = place[row[by]], weight[by].astype(np.float32)

    def derive(self) -> None:
        """Of rare terms, runs of one term's postings in one block with their largest weight; of common terms, a matrix of
        weights, a row for each example, and of the largest weights, a row for each block; and maps that searches use and clear."""
        df = np.diff(self.post_start)
        common = df * COMMON >= len(self.ids)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        dense = common[term]
        self.matrix = np.zeros((self.blocks * BLOCK, int(common.sum())), np.float32)
        self.matrix[self.post_row[dense], self.column[term[dense]]] = self.post_weight[dense]
        self.matrix_max = self.matrix.reshape(self.blocks, BLOCK, self.matrix.shape[1]).max(axis=1)
        block = self.post_row // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (term[1:] != term[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(block)))
        weight = np.maximum.reduceat(self.post_weight, start) if len(start) else self.post_weight[:0]
        rare = ~dense[start]
        self.run_block, self.run_start, self.run_size, self.run_max = block[start][rare], start[rare].astype(np.int32), size[rare].astype(np.int32), weight[rare]
        self.term_run = np.searchsorted(start[rare], self.post_start)
        self.term_run[1:][common] = self.term_run[:-1][common]
        self.slot = np.full(self.blocks * BLOCK, -1, np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("column", "matrix", "matrix_max", "run_block", "run_start", "run_size", "run_max", "term_run", "slot")}

    def vectors(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and weights of unit TF-IDF vectors, over the terms that some example has."""
        number, distinct = pd.factorize(hashes)
        at = np.minimum(np.searchsorted(self.word, distinct), max(len(self.word) - 1, 0))
        at = np.where(self.word[at] == distinct, at, -1)[number] if len(self.word) else np.full(len(hashes), -1)
        hit = at >= 0
        key, count = np.unique(rows[hit] * len(self.word) + at[hit], return_counts=True)
        row, term = (key // len(self.word), key % len(self.word)) if len(key) else (key, key)
        weight = (1 + np.log(count)) * self.idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight**2, n))[row] if len(row) else weight

    def admitted(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
        """Cosines of n documents and all examples that can be among the k nearest; -1 where a block's bound ruled them out.

        A block's bound for a document is the product of its weights and the block's largest weights, over all terms. A document
        meets the blocks of highest bound, and then those whose bound reaches the k-th best cosine of these.
        """
        q = np.zeros((n, self.matrix.shape[1]), np.float32)
        column = self.column[term]
        q[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        first = self.term_run[term]
        runs = self.term_run[term + 1] - first
        run, of, at = ragged(first, runs), np.repeat(weight, runs), np.repeat(row, runs)
        bound = q @ self.matrix_max.T + np.bincount(at * self.blocks + self.run_block[run], of * self.run_max[run], n * self.blocks).reshape(n, self.blocks)
        order = np.argsort(self.run_block[run], kind="stable")
        run, of, at = run[order], of[order], at[order]
        edge = np.searchsorted(self.run_block[run], np.arange(self.blocks + 1))
        score = np.full((n, self.blocks * BLOCK), -1, np.float32)
        score[:, self.size :] = -2
        # First the blocks of highest bound, enough for k examples; then whatever reaches the k-th best of these.
        some = min(-(-k // BLOCK) + 1, self.blocks)
        early = np.zeros((n, self.blocks), bool)
        np.put_along_axis(early, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        for turn in (early, None):
            if turn is None:
                bar = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(n, -1.0)
                turn = ~early & (bound >= bar[:, None] - MARGIN)
            for b in np.flatnonzero(turn.any(axis=0)):
                meets = turn[:, b]
                here, own = slice(b * BLOCK, (b + 1) * BLOCK), np.flatnonzero(meets)
                got = q[own] @ self.matrix[here].T
                mine = slice(edge[b], edge[b + 1])
                sizes = np.where(meets[at[mine]], self.run_size[run[mine]], 0)
                post = ragged(self.run_start[run[mine]], sizes)
                to = np.repeat((np.cumsum(meets) - 1)[at[mine]], sizes) * BLOCK + self.post_row[post] - b * BLOCK
                got += np.bincount(to, np.repeat(of[mine], sizes) * self.post_weight[post], len(own) * BLOCK).reshape(-1, BLOCK)
                score[own, here] = np.where(np.arange(b * BLOCK, (b + 1) * BLOCK) < self.size, got, -2)
        return score

    def nearest(self, term: np.ndarray, weight: np.ndarray, score: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples of highest cosine, exactly: what may be among them by `score` is scored again in double precision. Also
        the features of their votes. Ties go to the example's place, so equal texts have equal neighbours."""
        at = max(len(score) - k - (without >= 0), 0)
        near = np.flatnonzero((score >= np.partition(score, at)[at] - MARGIN) & (score > 0))
        near = near[near != without]
        column = self.column[term]
        common, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        shared = self.matrix[near[:, None], column[common]].astype(np.float64)
        sizes = self.post_start[term[rare] + 1] - self.post_start[term[rare]]
        post = ragged(self.post_start[term[rare]], sizes)
        self.slot[near] = np.arange(len(near))
        of, at = self.slot[self.post_row[post]], np.repeat(rare, sizes)
        self.slot[near] = -1
        hit = of >= 0
        of, at, post = of[hit], at[hit], post[hit]
        exact = (shared * weight[common]).sum(axis=1) + np.bincount(of, weight[at] * self.post_weight[post], len(near))
        top = np.lexsort((near, -exact))[:k]
        vote = np.zeros(len(near))
        vote[top] = 1 / (1.05 - np.minimum(exact[top], 1))
        vote *= len(top) / max(vote.sum(), 1e-9)
        toxic = np.where(self.labels[near] == 1, vote, 0)
        toxic_of, all_of = (np.bincount(at, v[of], len(term)) for v in (toxic, vote))
        toxic_of[common], all_of[common] = toxic @ (shared > 0), vote @ (shared > 0)
        x = self.features(float(toxic.sum()), len(top), toxic_of, all_of)
        return exact[top], near[top], x

    def features(self, toxic: float, k: int, toxic_of: np.ndarray, all_of: np.ndarray) -> np.ndarray:
        """Log odds of the vote of k neighbours, and how far those of the two words that lean most are above them."""
        whole = (toxic + self.share) / (k + 1)
        expected = (toxic / max(k, 1) + self.share) / 2
        lean = np.sort(np.log((toxic_of + 2 * expected) / (all_of - toxic_of + 2 * (1 - expected))) - np.log(expected / (1 - expected)))[::-1]
        return np.array([np.log(whole / (1 - whole)), *lean[:2], *[0.0] * max(2 - len(lean), 0), 1.0])

    def calibrate(self, fold: int = FOLD) -> None:
        """Fits the logistic function on examples that are scored by their neighbours without themselves."""
        labels = self.labels[: self.size]
        if not self.size or labels.min() == labels.max():
            return
        self.derive()
        chosen = np.concatenate([own[:: max(1, -(-len(own) // fold))] for own in (np.flatnonzero(labels == y) for y in (0, 1))])
        rank = np.full(len(self.ids), -1)
        rank[chosen] = np.arange(len(chosen))
        mine = rank[self.post_row] >= 0
        row, term, weight = rank[self.post_row[mine]], np.repeat(np.arange(len(self.word)), np.diff(self.post_start))[mine], self.post_weight[mine].astype(np.float64)
        order = np.argsort(row, kind="stable")
        row, term, weight = row[order], term[order], weight[order]
        edge, xs = np.searchsorted(row, np.arange(len(chosen) + 1)), []
        for lo in range(0, len(chosen), TOGETHER):
            hi = min(lo + TOGETHER, len(chosen))
            group = slice(edge[lo], edge[hi])
            score = self.admitted(row[group] - lo, term[group], weight[group], hi - lo, self.k + 1)
            for i in range(lo, hi):
                own = slice(edge[i], edge[i + 1])
                xs.append(self.nearest(term[own], weight[own], score[i - lo], self.k, int(chosen[i]))[2])
        x, y = np.array(xs), labels[chosen].astype(float)
        weight = np.where(y == 1, self.prior / y.mean(), (1 - self.prior) / (1 - y.mean()))
        model, pull = np.zeros(x.shape[1]), np.array([1.0] * (x.shape[1] - 1) + [1e-3])
        for _ in range(60):  # Newton steps, drawn a little to nothing
            p = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + pull * model
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            model -= np.clip(np.linalg.solve(curve, gradient), -1, 1)
        self.model = model

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Score and evidence (the nearest examples) of every row: the calibrated votes; `base` without a neighbour."""
        n = len(offsets) - 1
        score, shown = np.full(n, self.base), np.zeros(n, np.int64)
        near_all, exact_all = [np.zeros(0, np.int64)], [np.zeros(0)]
        row, term, weight = self.vectors(*terms(data, offsets), n) if self.size else (np.zeros(0, np.int64),) * 3
        if len(row):
            if "matrix" not in self.__dict__:  # made where it is used, not on the driver
                self.derive()
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            ends = np.append(starts[1:], len(row))
            for at in range(0, len(starts), TOGETHER):
                last = min(at + TOGETHER, len(starts))
                group = slice(starts[at], ends[last - 1])
                found = self.admitted(np.searchsorted(row[starts], row[group]) - at, term[group], weight[group], last - at, self.k)
                for i in range(at, last):
                    own = slice(starts[i], ends[i])
                    exact, near, x = self.nearest(term[own], weight[own], found[i - at], self.k)
                    if len(near) and self.model is not None:
                        score[row[starts[i]]] = 1 / (1 + np.exp(-np.clip(x @ self.model, -30, 30)))
                    shown[row[starts[i]]] = min(len(near), EVIDENCE)
                    near_all.append(near[:EVIDENCE])
                    exact_all.append(exact[:EVIDENCE])
        near = np.concatenate(near_all)
        fields = [pa.array(self.ids[near]), pa.array(np.concatenate(exact_all)), pa.array(self.labels[near].astype(np.int32))]
        evidence = pa.StructArray.from_arrays(fields, ["example", "similarity", "label"])
        return score, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shown)]).astype(np.int32)), evidence)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> DataFrame:
    """`docs` (doc_id, text, ...) with score (0 to 1, higher: toxic likelier), predicted and evidence.

    Examples are a bounded sample of labelled rows outside the held-out fold (crc32(doc_id) mod 4 = 2), both classes
    with all their words. Evidence lists the nearest EVIDENCE of the voters: example id, cosine and label. The score is calibrated
    to the share of each class among all labels. All whole texts are scored, in one pass without a shuffle; a very long one is
    a piece of its own. Texts without a word of any example, null and empty ones too, get the share of toxic examples among
    examples without words, drawn to that of all labels; so do all texts if the labels have one class only, and without any
    label the score is 0. Ties among neighbours go by their place in the index. Rows may repeat and ids be null; an empty table
    gives an empty result; other columns stay, but columns named score, predicted or evidence are replaced.
    """
    spark = docs.sparkSession
    sample, prior = labelled_sample(docs, labels, "toxic", id_bucket("doc_id", 4) != 2, max_examples, max_chars, share=1 / 3)
    made = BlockMaxIndex(sample, prior=prior)
    made.calibrate()
    index = spark.sparkContext.broadcast(made)
    del made
    del sample
    trim()
    base = docs.drop("score", "predicted", "evidence")
    at = base.columns.index("text")
    nothing = F.array().cast("array<struct<example:bigint,similarity:double,label:int>>")
    out_schema = base.select(F.struct(*base.columns, F.lit(0.0).alias("score"), nothing.alias("evidence")).alias("s")).schema["s"].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at], PIECE):
                score, evidence = index.value.documents(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), evidence], names=[*part.schema.names, "score", "evidence"])

    out = base.mapInArrow(scored, out_schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all `documents`; null, empty, very long and repeated texts as in `score_toxicity`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
