"""Byte-level BPE encoding and decoding through a global distinct-word shuffle."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import table
from keylattice.llm.words import encode_words, ragged, split_parts, texts_of

RANKS = "byte_bpe_50k.tiktoken"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file; a file of the driver, of bounded size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TokenBytes:
    """The token-byte table: bytes of every token id."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.size, self.start = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.start[ids], self.size[ids])].tobytes()


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, tokens: bool = False) -> DataFrame:
    """`docs` without its text, with n_tokens, ids_sha256 and decoded_sha256 and, on request, tokens (array<int>).

    Each match of `pattern` is a word; each distinct word is encoded once for the whole corpus. ids_sha256 is over
    the ids as little-endian unsigned 32-bit integers; decoding joins the ids to the token-byte table. Null texts
    count as empty: no token. Rows may repeat; other columns stay, apart from those named like a result.
    """
    spark = docs.sparkSession
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["tokens"] * tokens
    docs = docs.drop(*made)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path or public_tokenizers.path(RANKS)))
    table_ = spark.sparkContext.broadcast(TokenBytes(ranks.value))

    def split(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
        return split_parts(texts_of(data, offsets), regex.compile(pattern).findall)

    def encoder() -> Callable[[list[str]], list[list[int]]]:
        coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known = ranks.value

        def encode(words: list[str]) -> list[list[int]]:
            out = []
            for w in words:
                whole = known.get(w.encode())
                out.append(coding.encode_ordinary(w) if whole is None else [whole])
            return out

        return encode

    def finish(rows: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        hashes = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        decoded = [hashlib.sha256(table_.value.decode(i)).hexdigest() for i in ids]
        out = rows.append_column("n_tokens", pa.array([len(i) for i in ids], pa.int64())).append_column("ids_sha256", pa.array(hashes, pa.string())).append_column("decoded_sha256", pa.array(decoded, pa.string()))
        return out.append_column("tokens", pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))) if tokens else out

    types = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "tokens": "array<int>"}
    schema = docs.drop("text").select("*", *(F.lit(None).cast(types[c]).alias(c) for c in made)).schema
    return encode_words(docs, split, encoder, finish, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all `documents`.

    Null and empty texts have no token and the digests of nothing; null and repeated ids stay, a row each; very long texts
    are batches of their own; other columns are not read; an empty table gives an empty result.
    """
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
