"""Distinct word-shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from keylattice.llm.textbuf import LOWER, WORD_BYTE, Hashes, mix, spans

#: Odd multipliers of a shingle's words, from a rule.
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and the row boundaries among them.

    Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased. A row with fewer words than a shingle has its whole
    sequence as one; a row without a word has none.
    """
    starts, ends, rows = spans(WORD_BYTE[data], offsets)
    word = Hashes(LOWER[data]).of(starts, ends)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    whole = np.flatnonzero(np.arange(len(word)) + words <= (first + count)[rows]) if len(word) else np.zeros(0, np.int64)
    h = np.zeros(len(whole), np.uint64)
    for j in range(words):
        h += word[whole + j] * FACTORS[j]
    short = np.flatnonzero((count > 0) & (count < words))
    h_short = np.zeros(len(short), np.uint64)
    for j in range(words - 1):
        some = count[short] > j
        h_short[some] += word[first[short[some]] + j] * FACTORS[j]
    h_short += count[short].astype(np.uint64) * FACTORS[words]
    h, of = mix(np.concatenate([h, h_short])), np.concatenate([rows[whole], short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(n + 1))
