"""Content-addressed store of token ids: unique chunks, document recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from keylattice.llm.common import materialise, release, shared_path, table, written
from keylattice.llm.textbuf import LOWER, spans
from keylattice.llm.words import encode_words, split_spans

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Chunks are cut where the rolling hash of WINDOW ids has CUT_BITS zero bits, with LEAST to MOST ids.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Joined between words that are encoded together; its own token tells them apart.
SENTINEL = "\x01"
#: Words of these letters alone, none with a capital and none that could combine.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content: the same run of ids is cut at the same places."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = ids.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    sums = np.cumsum(h)
    rolling = sums.copy()
    rolling[WINDOW:] -= sums[:-WINDOW]
    marks = np.flatnonzero(((rolling * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for m in (*marks.tolist(), n):
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over the chunk addresses; of nothing, the address of nothing."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


_ZEROS: list[list[int]] = [[0xEDB88320, *(1 << i for i in range(31))]]  # crc32 after one zero bit


def crc_combine(first: int, second: int, n: int) -> int:
    """crc32 of two joined byte strings from their own crc32 and the second's length."""
    bits, i = n * 8, 0
    while bits:
        if i == len(_ZEROS):
            _ZEROS.append([_times(_ZEROS[-1], c) for c in _ZEROS[-1]])
        if bits & 1:
            first = _times(_ZEROS[i], first)
        bits >>= 1
        i += 1
    return first ^ second


def whole_letters(vocabulary: str) -> dict[int, str] | None:
    """The byte-level characters of each of LETTERS, if the vocabulary's normaliser leaves words of LETTERS as they are and its
    pre-tokeniser never splits them, so that its model alone encodes them; else null."""
    rules = json.loads(vocabulary)
    steps = lambda k: (rules.get(k) or {}).get({"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}[k]) or [rules.get(k) or {}]
    space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    runs = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    kept = all(s in ({"type": "NFC"}, {"type": "Lowercase"}, space) for s in steps("normalizer"))
    cut = [{k: v for k, v in s.items() if k != "trim_offsets"} for s in steps("pre_tokenizer")]
    if not kept or cut != [runs, level] or rules.get("post_processor") or rules.get("truncation") or rules.get("padding"):
        return None
    if any(LETTERS.fullmatch(t["content"].lower()) for t in rules["added_tokens"]):
        return None
    of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {i: of.pre_tokenize_str(chr(i))[0][0] for i in range(256) if LETTERS.fullmatch(chr(i))}


def word_encoder(spark: SparkSession, path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    with open(path, encoding="utf-8") as f:  # a vocabulary file of the driver, of bounded size
        vocabulary = spark.sparkContext.broadcast(f.read())

    def make() -> Callable[[list[str]], list[list[int]]]:
        coder = Tokenizer.from_str(vocabulary.value)
        one = lambda words: [e.ids for e in coder.encode_batch_fast(words, add_special_tokens=False)]
        mark = one([SENTINEL])[0]
        letters, model = whole_letters(vocabulary.value), coder.model

        def encode(words: list[str]) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in words]
            rest: Iterable[int] = range(len(words))
            if letters is not None:
                rest = []
                for i, w in enumerate(words):
                    if LETTERS.fullmatch(w):
                        out[i] = [t.id for t in model.tokenize(w if w.isascii() else w.translate(letters))]
                    else:
                        rest.append(i)
            plain = [i for i in rest if words[i] and SENTINEL not in words[i]]
            if len(mark) == 1:
                for at in range(0, len(plain), 256):
                    some = plain[at : at + 256]
                    ids = np.array(one([f" {SENTINEL} ".join([words[i] for i in some])])[0], dtype=np.int64)
                    ends = np.append(np.flatnonzero(ids == mark[0]), len(ids))
                    if len(ends) == len(some):
                        for i, lo, hi in zip(some, np.concatenate([[0], ends[:-1] + 1]), ends, strict=True):
                            out[i] = ids[lo:hi].tolist()
                    else:
                        for i, x in zip(some, one([words[i] for i in some]), strict=True):
                            out[i] = x
                plain = []
            alone = sorted({i for i, w in enumerate(words) if SENTINEL in w} | set(plain))
            for i, x in zip(alone, one([words[i] for i in alone]), strict=True):
                out[i] = x
            return out

        return encode

    return make


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CUTTABLE = np.zeros(256, bool)
_CUTTABLE[33:128] = True
_CUTTABLE[39] = False


_NONE = np.zeros(0, np.int64)


def units(data: np.ndarray, offsets: np.ndarray, marks: tuple[np.ndarray, np.ndarray] = (_NONE, _NONE)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans whose encodings, one after the other, are a text's: cut at spaces and line feeds, and between an
    ASCII letter and another visible ASCII character. The spans (starts, ends) of `marks` are units of their own.

    The vocabulary's pre-tokeniser always has a boundary there and its normaliser never reaches across, but for
    apostrophes, which open contractions, and characters beyond ASCII, which may combine: neither is cut off.
    """
    inside = (data != 32) & (data != 10)
    for a, b in zip(*marks, strict=True):
        inside[a:b] = True
    starts, ends, rows = spans(inside, offsets)
    letter, cuttable = _LETTER[data], _CUTTABLE[data]
    at_cut = np.zeros(len(data) + 1, bool)
    at_cut[1:-1] = (letter[1:] != letter[:-1]) & cuttable[1:] & cuttable[:-1]
    for a, b in zip(*marks, strict=True):
        at_cut[a + 1 : b] = False
        at_cut[[a, b]] = True
    at_cut[starts] = at_cut[ends] = False
    at_cut[offsets] = False
    at_end = at_cut.copy()
    at_cut[starts], at_end[ends] = True, True
    all_starts, all_ends = np.flatnonzero(at_cut), np.flatnonzero(at_end)
    return all_starts, all_ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(all_starts, offsets)))


def special_strings(coder: Tokenizer) -> list[bytes]:
    """The vocabulary's special strings, longest first; they are found in the raw text."""
    found = []
    for t in coder.get_added_tokens_decoder().values():
        text = t.content.encode()
        data = np.frombuffer(text, np.uint8)
        if t.normalized or t.lstrip or t.rstrip or t.single_word or not t.special or len(units(data, np.array([0, len(data)]))[0]) < 2:
            raise ValueError(f"added token {t.content!r} can't be found in raw text alone")
        found.append(text)
    return sorted(found, key=len, reverse=True)


def splitter(specials: list[bytes]) -> Callable[[np.ndarray, np.ndarray], tuple[list[str], list[np.ndarray]]]:
    pattern = re.compile(b"|".join(map(re.escape, specials)))

    def split(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
        whole, marks = data.tobytes(), []
        if any(s in whole for s in specials):
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                marks += [m.span() for m in pattern.finditer(whole, lo, hi)]
        del whole
        first, last = np.array(marks, np.int64).reshape(-1, 2).T

        def cut(part: np.ndarray, own: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            here = slice(*np.searchsorted(first, [at, at + len(part)]))
            return units(part, own, (first[here] - at, last[here] - at))

        # The vocabulary's own normaliser lower-cases; doing so for ASCII first makes fewer words.
        return split_spans(LOWER[data], offsets, cut)

    return split


def unit_of(size: int) -> int:
    """Bytes of an id in a vocabulary of this size."""
    return 2 if size <= 1 << 16 else 4


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END) -> None:
    """Writes the store of `docs` (doc_id, text) below `path`.

    chunks/: (address, unit, payload: ids as little-endian integers of `unit` bytes, 2 or, in vocabularies that need
    it, 4), each once. recipes/: a row per document in ascending order of doc_id (null first; equal ids by content):
    part, place, doc_id, n_tokens, addresses, root (Merkle manifest), before (ids of earlier documents of its part).
    Null and empty texts are the end id alone; repeated rows are documents of their own; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    source = vocabulary or public_tokenizers.path(VOCABULARY)
    coder = Tokenizer.from_file(source)
    unit = unit_of(max(coder.get_vocab_size(), end_id + 1))

    def finish(rows: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        seen: dict[bytes, bytes] = {}
        recipes, sizes = [], []
        for own in ids:
            own = np.append(own, np.uint32(end_id))
            leaves, last = [], 0
            for at in cuts(own):
                payload = own[last:at].astype(f"<u{unit}").tobytes()
                leaves.append(address(payload))
                seen.setdefault(leaves[-1], payload)
                last = at
            recipes.append(leaves)
            sizes.append(len(own))
        n, m = len(ids), len(seen)
        return pa.table({
            "kind": pa.array(["recipe"] * n + ["chunk"] * m, pa.string()),
            "doc_id": pa.concat_arrays([rows.column("doc_id").combine_chunks(), pa.nulls(m, pa.int64())]),
            "n_tokens": pa.array([*sizes, *[None] * m], pa.int64()),
            "addresses": pa.array([*recipes, *[None] * m], pa.list_(pa.binary())),
            "root": pa.array([*(merkle_root(r) for r in recipes), *[None] * m], pa.binary()),
            "address": pa.array([*[None] * n, *seen], pa.binary()),
            "payload": pa.array([*[None] * n, *seen.values()], pa.binary()),
        })

    staged = encode_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), splitter(special_strings(coder)), word_encoder(spark, source), finish, "kind string, doc_id long, n_tokens long, addresses array<binary>, root binary, address binary, payload binary")
    read = materialise(staged, "staged", partitioned_by="kind")
    # A chunk reaches this once per batch that holds it, however many documents share it.
    chunks = read.where("kind = 'chunk'").select("address", F.lit(unit).alias("unit"), "payload").dropDuplicates(["address"])
    written(chunks, f"{path}/chunks")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            ends = before + batch["n_tokens"].cumsum()
            batch.insert(0, "place", np.arange(place, place + len(batch)))
            batch.insert(0, "part", part)
            batch["before"] = ends - batch["n_tokens"]
            place, before = place + len(batch), int(ends.iloc[-1]) if len(batch) else before
            yield batch

    recipes = read.where("kind = 'recipe'").select("doc_id", "n_tokens", "addresses", "root")
    ordered = recipes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "root").sortWithinPartitions("doc_id", "root")
    written(ordered.mapInPandas(placed, "part int, place long, doc_id long, n_tokens long, addresses array<binary>, root binary, before long"), f"{path}/recipes")
    release(read)


def _checked(parts: list, root: bytes, n_tokens: int) -> list:
    """A recipe's chunks in order; an error unless all are there and fit the manifest and the document's length."""
    parts = sorted(parts, key=lambda p: p["at"])
    if not all(p["n"] is not None and p["n"] > 0 for p in parts) or merkle_root([bytes(p["address"]) for p in parts]) != bytes(root) or sum(p["n"] for p in parts) != n_tokens:
        raise ValueError("a recipe does not fit its manifest or misses a chunk")
    return parts


def _with_parts(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Every recipe with its chunks' columns, also those that are missing, as `parts`."""
    recipes = spark.read.parquet(f"{path}/recipes")
    single = recipes.select("part", "place", "doc_id", "n_tokens", "root", "before", F.posexplode_outer("addresses").alias("at", "address")).join(chunks, "address", "left")
    made = [c for c in chunks.columns if c != "address"]
    return single.groupBy("part", "place").agg(*(F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root", "before")), F.collect_list(F.struct("at", "address", *made)).alias("parts"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, root of every document, from the files alone.

    Every chunk is read once: its address is recomputed, and its checksum stands for it from then on. Documents
    join their chunks' checksums (a shared chunk is a skewed key that adaptive execution splits), which are
    combined in order; a damaged or missing chunk, a Merkle root or a length that doesn't fit is an error.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, n = [], []
            for a, unit, payload in zip(batch.column("address").to_pylist(), batch.column("unit").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if address(payload) != a:
                    raise ValueError(f"chunk {a.hex()} is damaged")
                ids = np.frombuffer(payload, f"<u{unit}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["address", "crc", "n"])

    @F.pandas_udf("long")
    def combined(parts: pd.Series, roots: pd.Series, n_tokens: pd.Series) -> pd.Series:
        out = []
        for ps, root, n in zip(parts, roots, n_tokens, strict=True):
            crc = 0
            for p in _checked(ps, root, n):
                crc = crc_combine(crc, int(p["crc"]), 4 * int(p["n"]))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(digests, "address binary, crc long, n long")
    totals = spark.read.parquet(f"{path}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file part
    starts, before = [], 0
    for r in totals:
        starts.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    joined = _with_parts(spark, path, chunks).join(F.broadcast(offsets), "part")
    return joined.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", combined("parts", "root", "n_tokens").alias("ids_crc32"), "root")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array<long>) of every document, put together from its chunks and checked against its manifest."""

    @F.pandas_udf("array<long>")
    def joined(parts: pd.Series, roots: pd.Series, n_tokens: pd.Series) -> pd.Series:
        out = []
        for ps, root, n in zip(parts, roots, n_tokens, strict=True):
            own = _checked([p | {"n": None if p["payload"] is None else len(p["payload"]) // int(p["unit"])} for p in ps], root, n)
            if any(address(p["payload"]) != bytes(p["address"]) for p in own):
                raise ValueError("a chunk is damaged")
            out.append(np.concatenate([np.frombuffer(p["payload"], f"<u{int(p['unit'])}").astype(np.int64) for p in own]))
        return pd.Series(out, dtype=object)

    return _with_parts(spark, path, spark.read.parquet(f"{path}/chunks")).select("doc_id", joined("parts", "root", "n_tokens").alias("ids"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all `documents`, read back from a new store in the shared folder.

    Null, empty and blank texts are the end id alone; repeated ids are documents of their own, in an order by content;
    null ids come first; very long texts are batches of their own; other columns are not stored; an empty table
    gives an empty result.
    """
    path = shared_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
