"""Global distinct-word encoding: each distinct word of a corpus is encoded once, then joined back by position.

Positions never travel with the words. A batch of documents keeps its token positions as numbers of its own
word list; only its distinct words go to the word's bucket, where all batches' words meet and each is encoded
once; the codes go back to the batch, where documents are put together by position. So a frequent word costs one
row entry per batch, not one per occurrence, and no key is hotter than the number of batches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from keylattice.llm.textbuf import Hashes, pieces, trim

#: Bytes of text in one batch.
BATCH_BYTES = 16 << 20

#: A space next to other white space (of Python's kind or Unicode's).
BESIDE = re.compile(r"\s | \s")

Splitter = Callable[[np.ndarray, np.ndarray], tuple[list[str], list[np.ndarray]]]
Encoder = Callable[[], Callable[[list[str]], list[list[int]]]]


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2 ** 32 as compressed byte planes."""
    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the runs (start, length), in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1]) if len(lengths) else np.zeros(0, np.int64)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def split_parts(texts: list[str], parts_of: Callable[[str], list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct parts of the texts, and each text as numbers of them.

    Texts are cut before single inner spaces first, where parts never span, and parts_of splits each distinct piece.
    Texts with a space at an end or next to other white space, whose run can be one part, are pieces as a whole.
    """
    number: dict[str, int] = defaultdict(count().__next__)
    get = number.__getitem__
    rows = []
    for text in texts:
        units = text.split(" ")
        if "" in units or "\n" == units[-1][-1:] or BESIDE.search(text):
            units = [text] if text else []
        else:
            units = [units[0], *map(" ".__add__, units[1:])]
        rows.append(np.fromiter(map(get, units), np.int64, len(units)))
    word: dict[str, int] = defaultdict(count().__next__)
    split = [parts_of(u) for u in number]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter(map(word.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    return list(word), [flat[ragged(starts[r], sizes[r])] for r in rows]


def split_spans(data: np.ndarray, offsets: np.ndarray, units: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]], size: int = 2 << 20) -> tuple[list[str], list[np.ndarray]]:
    """The same from the byte spans (starts, ends, rows) that `units` finds in a part (its bytes, offsets and place): spans of equal 64-bit hash and length are
    one word. Hashes are made for a few rows, about `size` bytes, at a time."""
    n = len(offsets) - 1
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, rows = units(part, offsets[lo : hi + 1] - offsets[lo], int(offsets[lo]))
        found.append((Hashes(part).of(starts, ends), starts + offsets[lo], (ends - starts).astype(np.int32), (rows + lo).astype(np.int32)))
        lo = hi
    hashes, starts, length, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    number, distinct = pd.factorize(hashes)  # by a hash table, in order of appearance: frequent words get small numbers
    first = np.zeros(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    if (length != length[first][number]).any():
        raise ValueError("two words of one batch share a hash")
    whole = data.tobytes()
    words = [whole[a:b].decode() for a, b in zip(starts[first].tolist(), (starts[first] + length[first]).tolist(), strict=True)]
    return words, np.split(number.astype(np.uint32), np.searchsorted(rows, np.arange(1, n))) if n else []


def encode_words(docs: DataFrame, split: Splitter, encoder: Encoder, finish: Callable[[pa.Table, list[np.ndarray]], pa.Table], out_schema: StructType | str) -> DataFrame:
    """finish(rows, ids of each row) of all batches of `docs`, where ids are the codes of a row's words in order.

    split: texts (bytes and offsets) to distinct words and rows of word numbers; encoder: makes, in a task, the function that encodes a
    list of distinct words. Rows reach `finish` with all their columns but the text, whatever their names.

    Texts are read and split once. One exchange carries both kinds of rows by `key`: a batch's word numbers and other columns under
    the batch's name (its partition and number, from 0 up), and word lists under their bucket (from -1 down). Both
    readers, the encoder and the assembly, take the same exchange. A batch also carries a checksum of its texts: should a lost
    task be run again over rows in another order, the assembly refuses what no longer belongs together.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = docs.columns.index("text")
    rest = [i for i in range(len(docs.columns)) if i != at]
    rest_names = [docs.columns[i] for i in rest]
    # Columns go by place: other columns may have any name, also one of ours.
    held = docs.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("check"), F.array().cast("array<string>").alias("words"), F.lit(b"").alias("numbers"), *(F.col(f"`{docs.columns[i]}`").alias(f"c{i}") for i in rest))
    schema = StructType([StructField(f.name, f.dataType) for f in held.schema.fields])

    def split_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part, data, offsets in pieces(batch, batch.schema.names[at], BATCH_BYTES):
                name, check = next(place), xxhash.xxh64(data.tobytes() + offsets.tobytes()).intdigest() - 2**63
                words, rows = split(data, offsets)
                n = part.num_rows
                kept = [part.column(i) for i in rest]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array([name] * n, pa.int64()), pa.array([check] * n, pa.int64()), pa.nulls(n, pa.list_(pa.string())), pa.array([pack(r) for r in rows], pa.binary()), *kept], names=schema.names)
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
                used = np.flatnonzero(np.diff(ends, prepend=0))
                runs = [order[ends[b - 1] if b else 0 : ends[b]] for b in used]
                n = len(used)
                lists = pa.array([[words[i] for i in r] for r in runs], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(-1 - used, pa.int64()), pa.array([name] * n, pa.int64()), pa.array([check] * n, pa.int64()), lists, pa.array([pack(r) for r in runs], pa.binary()), *(pa.nulls(n, c.type) for c in kept)], names=schema.names)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, current = None, {}, None
        for batch in batches:
            batch = batch.select([0, 1, 2, 3, 4]).filter(pc.less(batch.column(0), 0))
            if not batch.num_rows:
                continue
            encode = encode or encoder()
            sizes, codes = [], []
            for b, words in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != current:  # rows come in the order of buckets
                    current, known = b, {}
                new = [w for w in words if w not in known]
                known.update(zip(new, encode(new), strict=True))
                mine = [known[w] for w in words]
                sizes.append(pack(np.fromiter(map(len, mine), np.int64, len(mine))))
                codes.append(pack(np.fromiter(chain.from_iterable(mine), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(4), pa.array(sizes, pa.binary()), pa.array(codes, pa.binary())], names=["key", "check", "places", "sizes", "codes"])
        del known
        trim()

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pc.greater_equal(left.column(0), 0))
        kept = left.select(list(range(5, left.num_columns))).rename_columns(rest_names)
        if not left.num_rows:  # the word lists of a bucket
            return finish(kept, [])
        if len({*left.column(2).to_pylist(), *right.column(1).to_pylist()}) > 1:
            raise ValueError("the documents came in another order when a task was run again; write them to a table first")
        places = [unpack(p) for p in right.column(2).to_pylist()]
        sizes = [unpack(p) for p in right.column(3).to_pylist()]
        codes = np.concatenate([np.zeros(0, np.uint32), *(unpack(p) for p in right.column(4).to_pylist())])
        n = 1 + max((int(p.max()) for p in places if len(p)), default=-1)
        size, start, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        if places:
            place, each = np.concatenate(places), np.concatenate(sizes).astype(np.int64)
            size[place], start[place], known[place] = each, np.cumsum(each) - each, True
        ids = []
        for r in left.column(4).to_pylist():
            row = unpack(r)
            if len(row) and (row.max() >= n or not known[row].all()):
                raise ValueError("words of a batch are missing")
            ids.append(codes[ragged(start[row], size[row])])
        out = finish(kept, ids)
        trim()
        return out

    dealt = docs.mapInArrow(split_once, schema).repartition("key")
    coded = dealt.sortWithinPartitions("key").mapInArrow(encoded, "key long, check long, places binary, sizes binary, codes binary")
    return dealt.groupBy("key").cogroup(coded.groupBy("key")).applyInArrow(assembled, out_schema)
