"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import id_bucket, labelled_sample, table
from keylattice.llm.textbuf import LOWER, WORD_BYTE, Hashes, pieces, spans

#: Training bounds: documents, and characters of a training document. Every document is scored whole.
MAX_DOCS, MAX_CHARS = 2000, 20_000
#: A document is rejected below this score.
THRESHOLD = 0.3

# Byte classes of the line features.
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"?-()", b"!", b"|", b"*&$%#", b"<>{}[]=_/\\@~^`+"], 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
CLASSES, OWN, NEAR = 10, 13, 6


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, lengths and rows of every line that holds a word. Features are the line's own and its neighbours'."""
    starts, ends, rows = spans(data != 10, offsets)
    w_starts, w_ends, _ = spans(WORD_BYTE[data], offsets)
    line_of = np.searchsorted(starts, w_starts, "right") - 1
    words = np.bincount(line_of, minlength=len(starts)).astype(np.float64)
    hashes = Hashes(LOWER[data]).of(w_starts, w_ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of[again], minlength=len(starts))
    length = ends - starts
    at = np.repeat(np.arange(len(starts)), length)
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(at)) if len(starts) else at
    counts = np.bincount(at * CLASSES + _CLASS[data[inside]], minlength=len(starts) * CLASSES).reshape(-1, CLASSES)
    keep = words > 0
    words, repeated, length, rows, counts = words[keep], repeated[keep], length[keep], rows[keep], counts[keep]
    n, w = np.maximum(length, 1), np.maximum(words, 1)
    own = np.empty((len(words), OWN))
    own[:, 0] = counts[:, 1] / n  # capitals
    own[:, 1] = np.minimum(counts[:, 5] / w, 2)  # !
    own[:, 2] = np.minimum(counts[:, 6] / w, 2)  # |
    own[:, 3] = np.minimum(counts[:, 7] / w, 3) / 2  # marks stuck to words
    own[:, 4] = repeated / w
    own[:, 5] = np.minimum(counts[:, 8] / w, 3) / 2
    own[:, 6] = counts[:, 2] / n
    own[:, 7] = np.minimum(counts[:, 4] / w, 2) / 2
    own[:, 8] = counts[:, 9] / n
    own[:, 9] = np.minimum(n / w, 30) / 30
    own[:, 10] = np.log1p(n) / 8
    own[:, 11] = words <= 2
    own[:, 12] = 1
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    last = np.ones(len(rows), bool)
    last[:-1] = new[1:]
    before, after = np.zeros((len(rows), NEAR)), np.zeros((len(rows), NEAR))
    before[1:], after[:-1] = own[:-1, :NEAR], own[1:, :NEAR]
    before[new], after[last] = 0, 0
    return np.hstack([own, before, after]), length.astype(np.float64), rows


def marginals(emission: np.ndarray, trans: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: P(line is good), and the expected transitions (2 x 2).

    emission: score of `good` against `bad` for each line; lines of one chain have the same row and stand together.
    """
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(rows)))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    alpha, beta = np.zeros((len(rows), 2)), np.zeros((len(rows), 2))
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max(initial=0)) + 1)]  # chains longer than t
    alpha[:, 1] = emission
    for t in range(1, len(active) - 1):
        i = first[: active[t]] + t
        a = alpha[i - 1]
        alpha[i, 0] += np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[i, 1] += np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1])
    for t in range(len(active) - 3, -1, -1):
        i = first[: active[t + 1]] + t
        b = beta[i + 1].copy()
        b[:, 1] += emission[i + 1]
        beta[i, 0] = np.logaddexp(b[:, 0] + trans[0, 0], b[:, 1] + trans[0, 1])
        beta[i, 1] = np.logaddexp(b[:, 0] + trans[1, 0], b[:, 1] + trans[1, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, int)
    pair = np.zeros((2, 2))
    if len(inner):
        z = np.logaddexp(both[inner, 0], both[inner, 1])
        for s in (0, 1):
            for e in (0, 1):
                pair[s, e] = np.exp(alpha[inner, s] + trans[s, e] + (emission[inner + 1] if e else 0) + beta[inner + 1, e] - z).sum()
    return good, pair


#: Below so many chains of a length, lines go one by one instead of step by step.
FEW = 16


def good_lines(emission: np.ndarray, trans: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(line is good) of every line, as `marginals` gives it, from the odds of both directions: a step is one fraction.

    Chains go together, step by step, while there are FEW or more; the rest of the longest ones goes line by line.
    """
    if not len(rows):
        return np.zeros(0)
    e, ((t00, t01), (t10, t11)) = np.exp(np.clip(emission, -500, 500)), np.exp(trans).tolist()
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.append(first, len(rows)))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    together = int(sizes[FEW - 1]) if len(sizes) >= FEW else 1
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(together + 1)]  # chains longer than t
    long = [(int(a), int(n)) for a, n in zip(first, sizes, strict=True) if n > together]
    ahead, behind = e.copy(), np.ones(len(e))  # odds of a line given the lines before, and the factor of those after
    for t in range(1, together):
        i = first[: active[t]] + t
        ahead[i] *= (t01 + t11 * ahead[i - 1]) / (t00 + t10 * ahead[i - 1])
    for a, n in long:
        f, out = float(ahead[a + together - 1]), []
        for x in e[a + together : a + n].tolist():
            f = x * (t01 + t11 * f) / (t00 + t10 * f)
            out.append(f)
        ahead[a + together : a + n] = out
        b, out = 1.0, []
        for x in e[a + together : a + n][::-1].tolist():
            b = (t10 + t11 * x * b) / (t00 + t01 * x * b)
            out.append(b)
        behind[a + together - 1 : a + n - 1] = out[::-1]
    for t in range(together - 2, -1, -1):
        i = first[: active[t + 1]] + t
        x = e[i + 1] * behind[i + 1]
        behind[i] = (t10 + t11 * x) / (t00 + t01 * x)
    odds = ahead * behind
    return odds / (1 + odds)


@dataclass
class LineCrf:
    """Weights of a line's features, transitions between line labels, and the calibration of a document's mean."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float
    empty: float

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every row: length-weighted mean of its lines' marginals, calibrated; `empty` without a word."""
        x, length, rows = line_features(data, offsets)
        good = good_lines(x @ self.weights, self.trans, rows)
        n = len(offsets) - 1
        total = np.bincount(rows, length, n)
        mean = np.bincount(rows, length * good, n) / np.maximum(total, 1)
        return np.where(total > 0, 1 / (1 + np.exp(-(self.slope * mean + self.offset))), self.empty)


def train(sample: list[tuple[int, str, int]], rounds: int = 200, decay: float = 1e-3) -> LineCrf:
    """Fits the field by gradient ascent with every line labelled as its document, then the document's calibration.

    Without both labels in the sample nothing can be learnt: every score is then the one label's value, or 1.
    """
    labels = np.array([label for _, _, label in sample], dtype=float)
    share = float(labels.mean()) if len(labels) else 1.0
    if share in (0.0, 1.0):
        return LineCrf(np.zeros(OWN + 2 * NEAR), np.zeros((2, 2)), 0.0, 40.0 if share else -40.0, share)
    encoded = [t.encode() for _, t, _ in sample]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    x, length, rows = line_features(data, offsets)
    y = labels[rows]
    # Every document weighs the same, however many lines it has.
    share_of_line = 1 / np.bincount(rows, minlength=len(labels))[rows]
    same = rows[1:] == rows[:-1]
    weights, trans = np.zeros(x.shape[1]), np.array([[0.5, -0.5], [-0.5, 0.5]])
    m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    wanted = np.array([[np.sum(same & (y[1:] == 0)), 0], [0, np.sum(same & (y[1:] == 1))]], dtype=float)
    for step in range(1, rounds + 1):
        good, pair = marginals(x @ weights, trans, rows)
        grad = x.T @ ((y - good) * share_of_line) / len(labels) - decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights += 0.15 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        trans = np.clip(trans + 0.5 * (wanted - pair) / max(same.sum(), 1), -3, 3)
    good, _ = marginals(x @ weights, trans, rows)
    total = np.bincount(rows, length, len(labels))
    mean = np.bincount(rows, length * good, len(labels)) / np.maximum(total, 1)
    a, b = 4.0, -2.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * mean + b)))
        a, b = a + 0.5 * (((labels - p) * mean).mean() - 1e-3 * (a - 4)), b + 0.5 * ((labels - p).mean() - 1e-3 * (b + 2))
    return LineCrf(weights, trans, float(a), float(b), share)


def score_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """`docs` (doc_id, text, ...) with score (0 to 1, higher: good likelier) and predicted (1: keep).

    The model is fitted on a bounded sample of labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0)
    and is a few hundred bytes. All whole texts are scored, in one pass without a shuffle. Null and empty texts
    have no line and get the sample's share of good documents; without any label every score is 1. A very long text is a piece
    of its own, in time linear in its lines. Rows may repeat and ids be null; other columns stay, but columns
    named score or predicted are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", id_bucket("doc_id", 5) != 0, max_docs, max_chars, positive=0)[0]))
    base = docs.drop("score", "predicted")
    at = base.columns.index("text")
    schema = F.struct(*base.columns, F.lit(0.0).alias("score"))
    out_schema = base.select(schema.alias("s")).schema["s"].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at]):
                score = pa.array(model.value.documents(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, score], names=[*part.schema.names, "score"])

    out = base.mapInArrow(scored, out_schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all `documents`; null, empty, very long and repeated texts as in `score_quality`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
