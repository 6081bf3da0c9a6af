"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Exact texts of one shingle set are one class. Shingles are counted over the whole table; frequent ones come last in a
global order. Classes meet in tiles: a tile holds the classes that have a shingle in their prefix in common (linked sets share
one), split by hash where a shingle is frequent, and split again by its true size wherever a tile turns out too large. In a
tile, sizes must be within the band that the similarity allows; bit counts of the signatures bound the overlap from
above; what is left is decided by the sorted arrays. Since components are asked for, a first round links classes to
the most central class of a few tiles, and later tiles skip what is linked already; no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import materialise, release, table
from keylattice.llm.components import connected_components
from keylattice.llm.shingles import shingle_sets
from keylattice.llm.textbuf import mix, pieces, trim

#: Shingles of MANY sets or more are kept with their counts; the most frequent, MAX_COMMON at most, go last in the order.
MANY, MAX_COMMON = 8, 400_000
#: Shingles that one task counts at a time.
COUNTED = 1 << 22
#: Tokens of the first round; rows of a tile's part; earlier frequent shingles that a row remembers.
STARS, TILE, EARLY = 4, 2048, 8
#: Rows that a tile may have without signatures; one with more is split by its true size, and gets them.
UNSIGNED = 512


class Common:
    """Frequent shingles (their leading bits) and their counts: any list, even an incomplete one, gives a valid global order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shift: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.shift = keys[order], counts[order], np.uint64(shift)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        """Count of each shingle, 0 for those that aren't frequent."""
        out = np.zeros(len(h), np.int64)
        key = h >> self.shift
        near = np.flatnonzero(self.quick[(key & np.uint64(0xFFFF)).astype(np.int64)])
        if len(near) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
            hit = self.keys[at] == key[near]
            out[near[hit]] = self.counts[at[hit]]
        return out


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of linked sets of these sizes: 100 * overlap >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def signature(h: np.ndarray) -> bytes:
    """A bitmap of 8 bits or more a shingle, a power of two of bytes from 64 to 1024."""
    size = 64
    while size < min(len(h), 1024):
        size *= 2
    bits = np.zeros(size, np.uint8)
    at = (h >> np.uint64(40)).astype(np.int64) % (size * 8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def _folded(sigs: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to `size` bytes; a fold of a bitmap is the smaller bitmap."""
    return np.array([np.bitwise_or.reduce(np.frombuffer(s, "<u8").reshape(-1, size // 8), 0) for s in sigs]).reshape(len(sigs), size // 8)


def overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap: a bit of one side only stands for a shingle of that side only."""
    only_a = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _common_counts(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """key, n: sets that hold a shingle, over the whole table, where they are MANY or more; key: its leading 32 + `bits` bits.

    Tasks send sorted arrays of distinct shingles, 4 bytes and a count each, to the bucket of their first `bits` bits, so a hot
    shingle is one entry of each task. Equal sets of a task count once.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def sent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            at = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange(1 + (1 << bits)).astype(np.uint64))
            used = np.flatnonzero(np.diff(at))
            low, n = (tokens >> np.uint64(32 - bits)).astype(np.uint32), n.astype(np.uint32)
            cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in used], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), cut(low), cut(n)], names=["bucket", "low", "n"])

        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                h, b = shingle_sets(data, offsets, words)
                for i in range(part.num_rows):
                    own = h[b[i] : b[i + 1]]
                    if (key := hashlib.blake2b(own.tobytes(), digest_size=8).digest()) not in seen:
                        seen.add(key)
                        held.append(own)
                        size += len(own) + 8
                if size > COUNTED:
                    yield sent()
                    held, seen, size = [], set(), 0
        yield sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, n, current = [], [], -1

        def done() -> pa.RecordBatch:
            distinct, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *low]), return_inverse=True)
            total = np.bincount(place, np.concatenate([np.zeros(0, np.uint32), *n]), len(distinct)).astype(np.int64)
            some = total >= MANY
            key = distinct[some].astype(np.int64) | current << 32
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

        for batch in batches:
            for bucket, x, y in zip(batch.column("bucket").to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if bucket != current:
                    if low:
                        yield done()
                    low, n, current = [], [], bucket
                low.append(np.frombuffer(x, np.uint32))
                n.append(np.frombuffer(y, np.uint32))
        if low:
            yield done()
        trim()

    lists = docs.select("text").mapInArrow(counted, "bucket int, low binary, n binary")
    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, "key long, n long")


def _most_common(docs: DataFrame, words: int) -> Common:
    """The most frequent shingles, MAX_COMMON at most: a histogram of the counts gives the least count that fits."""
    bits = min(16, max(4, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    counts = materialise(_common_counts(docs, words, bits), "shingle-counts")
    place = F.floor(F.log2("n") * 16)
    fit, least = 0, 1 << 16
    for r in counts.groupBy(place.alias("place")).count().orderBy(F.desc("place")).collect():
        fit += r["count"]
        if fit > MAX_COMMON:
            break
        least = r["place"]
    top = counts.where(place >= least).toPandas()
    release(counts)
    return Common(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), 32 - bits)


def _profiles(docs: DataFrame, common, words: int) -> DataFrame:
    """doc_id, n, digest, central (share of frequent shingles) and keys (smallest shingles) of every row."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                h, b = shingle_sets(data, offsets, words)
                n = np.diff(b)
                hot = np.concatenate([[0], np.cumsum(common.value.of(h) > 0)])
                digest = [hashlib.blake2b(h[lo:hi].tobytes(), digest_size=16).digest() for lo, hi in zip(b[:-1], b[1:], strict=True)]
                keys = [h[lo : min(hi, lo + STARS)].view(np.int64) for lo, hi in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array((hot[b[1:]] - hot[b[:-1]]) / np.maximum(n, 1)), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "digest", "central", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(profiled, "doc_id long, n long, digest binary, central double, keys array<long>")


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of every class and the most central class of each of its few key tiles.

    A batch first finds its own most central class of each key, so a frequent key reaches its tile once per batch.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            size = np.array([len(k) for k in keys.to_pylist()], np.int64)
            token = np.concatenate([np.zeros(0, np.int64), *(np.array(k, np.int64) for k in keys.to_pylist())])
            doc = np.repeat(batch.column("doc_id").to_numpy(), size)
            central = np.repeat(batch.column("central").to_numpy(), size)
            order = np.lexsort((doc, -central, token))
            token, doc, central = token[order], doc[order], central[order]
            new = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(token) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(doc[first]), pa.array(central[first]), pa.array(doc)], names=["token", "lead", "central", "doc"])

    rows = materialise(classes.select("doc_id", "central", "keys").mapInArrow(local, "token long, lead long, central double, doc long"), "stars")
    leads = rows.where("lead = doc").select("token", "lead", "central").distinct()
    most = leads.groupBy("token").agg(F.max(F.struct("central", (-F.col("lead")).alias("less"))).alias("most"))
    across = leads.join(most, "token").select((-F.col("most.less")).alias("a"), F.col("lead").alias("b"))
    pairs = rows.select(F.col("lead").alias("a"), F.col("doc").alias("b")).union(across).where("a <> b")
    out = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star-pairs")
    release(rows)
    return out


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int, small: int = 2_000_000) -> DataFrame:
    """The pairs (a, b), a table that is released, whose documents are linked: bit counts of signatures first, then sorted arrays."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if ids.count() <= small else ids  # beyond that size, texts are shuffled to their ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                h, b = shingle_sets(data, offsets, words)
                own = [h[lo:hi] for lo, hi in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(o) for o in own], pa.int64()), pa.array([signature(o) for o in own], pa.binary()), pa.array([o.tobytes() for o in own], pa.binary())],
                    names=["id", "n", "sig", "items"],
                )

    held = materialise(docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(sets, "id long, n long, sig binary, items binary"), "pair-sets", compression="none")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            size = np.minimum([len(s) for s in sa], [len(s) for s in sb]) if len(sa) else np.zeros(0)
            keep = np.zeros(len(sa), bool)
            for w in np.unique(size):
                at = np.flatnonzero(size == w)
                x, y = _folded([sa[i] for i in at], int(w)), _folded([sb[i] for i in at], int(w))
                keep[at] = overlap_bound(x, y, na[at], nb[at]) >= needed(na[at], nb[at], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(overlap(p, q) >= needed(len(p), len(q), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signs = held.select("id", "n", "sig")
    one = pairs.join(signs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")).hint("merge"), "a")
    two = one.join(signs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")).hint("merge"), "b")
    left = materialise(two.mapInArrow(bounded, "a long, b long"), "pairs-left")
    ends = materialise(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "left-ids")
    items = held.select("id", "items").join(F.broadcast(ends) if ends.count() <= small else ends, "id")
    one = left.join(items.select(F.col("id").alias("a"), F.col("items").alias("ia")).hint("merge"), "a")
    two = one.join(items.select(F.col("id").alias("b"), F.col("items").alias("ib")).hint("merge"), "b")
    links = materialise(two.select("a", "b", "ia", "ib").mapInArrow(exact, "a long, b long"), "links")
    release(pairs, ids, held, left, ends)
    return links


def deal(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (as indexes), tiles and sides: a row whose token `count` sets have goes to each tile of its part and another one."""
    tiles = np.where(count > TILE, -(-count // TILE), 1)
    mine = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tiles
    copy = np.repeat(np.arange(len(ids)), tiles)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    lo, hi = np.minimum(mine[copy], other), np.maximum(mine[copy], other)
    return copy, lo * tiles[copy] + hi, (mine[copy] == hi).astype(np.int64)  # of a tile of one part all rows have side 1


def _tile_rows(docs: DataFrame, classes: DataFrame, common, words: int, percent: int) -> DataFrame:
    """token, tile, side, comp, doc, n, pos, early, sig: a row per class, prefix shingle and tile.

    Texts don't move: a document's prefix meets its component as one packed row, and is dealt to tiles then. Only a
    frequent shingle has more than one tile, and only its rows carry the signature and the frequent shingles before
    it in the order.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                h, b = shingle_sets(data, offsets, words)
                n = np.diff(b)
                row = np.repeat(np.arange(len(n)), n)
                count = common.value.of(h)
                order = np.lexsort((h, count, row))
                pos = np.arange(len(h)) - np.repeat(b[:-1], n)
                keep = pos <= (n - -(-percent * n // 100))[row]
                token, count, row = h[order][keep], count[order][keep], row[keep]
                ends = np.searchsorted(row, np.arange(len(n) + 1))
                runs = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                counts = [count[lo:hi][count[lo:hi] > 0] for lo, hi in runs]  # frequent ones come last
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array([token[lo:hi].tobytes() for lo, hi in runs], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array([signature(h[b[i] : b[i + 1]]) if len(c) else None for i, c in enumerate(counts)], pa.binary())],
                    names=["doc_id", "n", "tokens", "counts", "sig"],
                )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
                counts = [np.frombuffer(c, np.int64) for c in batch.column("counts").to_pylist()]
                signs = batch.column("sig").to_pylist()
                size = np.array([len(t) for t in tokens], np.int64)
                row = np.repeat(np.arange(len(size)), size)
                token = np.concatenate([np.zeros(0, np.uint64), *tokens])
                count = np.concatenate([np.zeros(0, np.int64), *(x for t, c in zip(tokens, counts, strict=True) for x in (np.zeros(len(t) - len(c), np.int64), c))])
                starts = np.cumsum(size) - size
                pos = np.arange(len(token)) - np.repeat(starts, size)
                ids, n, comp = (np.asarray(batch.column(c)) for c in ("doc_id", "n", "comp"))
                copy, tile, side = deal(ids[row], count)
                early: list = [None] * len(token)
                sig: list = [None] * len(token)
                for i in np.flatnonzero(count > 0).tolist():
                    r = int(row[i])
                    sig[i] = signs[r]
                    first = int(starts[r] + size[r]) - len(counts[r])
                    early[i] = token[first : min(i, first + EARLY)].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [_longs(token[copy]), pa.array(tile, pa.int32()), pa.array(side, pa.int32()), pa.array(comp[row[copy]]), pa.array(ids[row[copy]]), pa.array(n[row[copy]], pa.int32()), pa.array(pos[copy], pa.int32()), pa.array(early, pa.binary()).take(pa.array(copy)), pa.array(sig, pa.binary()).take(pa.array(copy))],
                    names=["token", "tile", "side", "comp", "doc", "n", "pos", "early", "sig"],
                )

    packed = docs.select("doc_id", "text").mapInArrow(prefixes, "doc_id long, n int, tokens binary, counts binary, sig binary")
    chosen = packed.join(classes.select("doc_id", "comp").hint("merge"), "doc_id")
    return chosen.mapInArrow(dealt, "token long, tile int, side int, comp long, doc long, n int, pos int, early binary, sig binary")


def tile_pairs(side: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, early: list, sig: list, percent: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one tile that can be linked and are of different components.

    Filters: the size band, the overlap that is left from the shared shingle on, an earlier frequent shingle in common
    (the pair meets there too), and the signatures' bit counts.
    """
    m = len(comp)
    split = bool((side == 0).any())
    a_rows, b_rows = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(m), np.arange(m))
    mask = np.zeros(m, np.uint64)
    if m > 2 and early[0] is not None:
        each = [np.frombuffer(e, np.uint64) for e in early]
        values, counts = np.unique(np.concatenate(each), return_counts=True)
        values = np.sort(values[np.argsort(-counts, kind="stable")[:64]])
        for i, e in enumerate(each):
            at = np.searchsorted(values, e)
            at = at[(at < len(values))][values[at[at < len(values)]] == e[at < len(values)]] if len(values) else at[:0]
            mask[i] = np.bitwise_or.reduce(np.uint64(1) << at.astype(np.uint64)) if len(at) else 0
    folded = None
    if m > 2 and sig[0] is not None:
        folded = _folded(sig, min(map(len, sig)))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(a_rows), block):
        a = a_rows[lo : lo + block]
        b = b_rows if split else b_rows[lo:]
        ok = comp[a][:, None] != comp[b][None, :]
        if not split:
            ok &= a[:, None] < b[None, :]
        i, j = np.nonzero(ok)
        i, j = a[i], b[j]
        for test in (
            lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]),
            lambda i, j: np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], percent) - np.minimum(pos[i], pos[j]),
            lambda i, j: (mask[i] & mask[j]) == 0,
            lambda i, j: overlap_bound(folded[i], folded[j], n[i], n[j]) >= needed(n[i], n[j], percent) if folded is not None else np.ones(len(i), bool),
        ):
            keep = test(i, j)
            i, j = i[keep], j[keep]
        out_a.append(i)
        out_b.append(j)
    return np.concatenate(out_a), np.concatenate(out_b)


def _met(rows: DataFrame, percent: int, unsigned: int | None = UNSIGNED) -> DataFrame:
    """a, b: pairs of different components from all tiles; and, with a token, the rows (a: document) of tiles that are too large.

    Rows come in the order of tiles. A tile that grows beyond its limit while it is read is passed on, row by row, not held.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "token", "comp", "n", "pos"]

        def passed(t: pa.Table) -> pa.RecordBatch:
            # Rows of one tile share a token of their own from here on.
            key = t.column("token").to_numpy().view(np.uint64) ^ mix(t.column("tile").to_numpy().astype(np.uint64))
            cols = [t.column(c).combine_chunks() for c in ("doc", "comp", "n", "pos")]
            return pa.RecordBatch.from_arrays([cols[0], pa.nulls(len(key), pa.int64()), _longs(key), *cols[1:]], names=names)

        def limit(t: pa.Table) -> float:
            return float("inf") if unsigned is None else unsigned if t.column("sig")[0].as_py() is None else 4 * TILE

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            token, tile = t.column("token").to_numpy(), t.column("tile").to_numpy()
            comp, doc = t.column("comp").to_numpy(), t.column("doc").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])]))
            ends = np.append(starts[1:], len(token))
            low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
            side, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("side", "n", "pos"))
            early, sig = t.column("early"), t.column("sig")
            found = [np.zeros((2, 0), np.int64)]
            for s, e in zip(starts[low != high].tolist(), ends[low != high].tolist(), strict=True):
                if e - s > UNSIGNED and e - s > limit(part := t.slice(s, e - s)):
                    yield passed(part)
                    continue
                x, y = tile_pairs(side[s:e], comp[s:e], n[s:e], pos[s:e], early[s:e].to_pylist(), sig[s:e].to_pylist(), percent)
                found.append(np.sort(np.stack([doc[s + x], doc[s + y]]), 0))
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            m = pairs.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=names)

        held: list[pa.Table] = []
        size, key, passing = 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            token, tile = now.column("token").to_numpy(), now.column("tile").to_numpy()
            if passing:  # the rest of a large tile
                other = np.flatnonzero((token != key[0]) | (tile != key[1]))
                cut = int(other[0]) if len(other) else len(token)
                if cut:
                    yield passed(now.slice(0, cut))
                if cut == len(token):
                    continue
                now, token, tile, passing = now.slice(cut), token[cut:], tile[cut:], False
            last = (token[-1], tile[-1])
            before = np.flatnonzero((token != last[0]) | (tile != last[1]))
            if held and not len(before) and key == last:
                held.append(now)
                size += now.num_rows
            else:  # all but the last tile are complete
                cut = int(before[-1]) + 1 if len(before) else 0
                if held or cut:
                    yield from emit(pa.concat_tables([*held, now.slice(0, cut)]))
                held, key = [now.slice(cut)], last
                size = held[0].num_rows
            if size > UNSIGNED and size > limit(held[0]):
                for t in held:
                    yield passed(t)
                held, size, passing = [], 0, True
        if held:
            yield from emit(pa.concat_tables(held))
        del held
        trim()

    return rows.repartition("token", "tile").sortWithinPartitions("token", "tile").mapInArrow(paired, "a long, b long, token long, comp long, n int, pos int")


def _candidates(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components from all tiles.

    Tiles that turned out too large, for shingles that are not among the listed ones, are dealt again by their true sizes, with
    signatures; there is no other end to them than pairs.
    """
    met = materialise(_met(rows, percent), "met")
    pairs = met.where("token IS NULL").select("a", "b")
    large = met.where("token IS NOT NULL").select("token", F.col("a").alias("doc_id"), "comp", "n", "pos")
    if not large.isEmpty():

        def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in pieces(batch, "text"):
                    h, b = shingle_sets(data, offsets, words)
                    sigs = [signature(h[lo:hi]) for lo, hi in zip(b[:-1], b[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigs, pa.binary())], names=["doc_id", "sig"])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    batch = whole.slice(at, 200)
                    copy, tile, side = deal(batch.column("doc_id").to_numpy(), batch.column("held").to_numpy())
                    taken = batch.take(pa.array(copy))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("token"), pa.array(tile, pa.int32()), pa.array(side, pa.int32()), *(taken.column(c) for c in ("comp", "doc_id", "n", "pos")), pa.array([b""] * len(copy), pa.binary()), taken.column("sig")],
                        names=["token", "tile", "side", "comp", "doc", "n", "pos", "early", "sig"],
                    )

        signed = materialise(docs.join(large.select("doc_id").distinct(), "doc_id").select("doc_id", "text").mapInArrow(signs, "doc_id long, sig binary").dropDuplicates(["doc_id"]), "large-signs")
        sizes = large.groupBy("token").agg(F.count("*").alias("held"))
        again = large.join(sizes, "token").join(signed, "doc_id").select("token", "doc_id", "comp", "n", "pos", "held", "sig").mapInArrow(dealt, "token long, tile int, side int, comp long, doc long, n int, pos int, early binary, sig binary")
        pairs = pairs.union(_met(again, percent, None).select("a", "b"))
    out = materialise(pairs.distinct(), "pairs")
    release(met)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text).

    Two documents are linked when 100 * shared shingles >= percent * shingles of both; a component is what links
    connect, named by its smallest doc_id. Null, empty and blank texts have no shingle and are linked with nothing.
    Rows with one doc_id are one document for links; rows without an id keep a null component. A very long text is a piece of its
    own; an empty table gives an empty result; other columns are not read. No partner, tile or candidate is capped.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(_most_common(docs, words))
    profiles = materialise(_profiles(docs, common, words), "profiles")
    full = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("central").alias("central"), F.first("keys").alias("keys")), "classes")
    first = _linked(docs, _stars(classes), words, percent)
    labels = connected_components(first)
    known = materialise(classes.join(labels, F.col("doc_id") == F.col("node"), "left").select("digest", "doc_id", F.coalesce("label", "doc_id").alias("comp")), "components")
    release(classes, first, labels)
    second = _linked(docs, _candidates(docs, _tile_rows(docs, known, common, words, percent), words, percent), words, percent)
    comps = known.select(F.col("doc_id").alias("d"), "comp")
    ends = second.join(comps, F.col("a") == F.col("d")).select(F.col("comp").alias("a"), "b").join(comps, F.col("b") == F.col("d")).select("a", F.col("comp").alias("b"))
    merged = connected_components(ends)
    release(second)
    final = known.join(merged, F.col("comp") == F.col("node"), "left").select("digest", F.coalesce("label", "comp").alias("component_id"))
    out = profiles.join(final, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """`docs` with one document of each component: that of its smallest doc_id. Rows that repeat its id and text count once,
    rows that repeat its id with another text stay, like rows without an id."""
    kept = jaccard_components(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    led = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*docs.columns)
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    once = led.select(*named, F.xxhash64("text").alias("text_key")).dropDuplicates([f"c{docs.columns.index('doc_id')}", "text_key"])
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).unionByName(docs.where("doc_id IS NULL"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all `documents`; null, empty, very long and repeated texts as in `jaccard_components`."""
    return jaccard_components(table(spark, sf_dir, "documents"))
