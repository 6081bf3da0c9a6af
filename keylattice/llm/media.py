"""Media columns: progressive JPEG as a lossless container of bytes, decoded scan by scan with numpy.

A payload of 64-byte blocks becomes the quantised coefficients of a 4:2:0 picture, one block each; all quantisation
steps are 1, so what is stored is what is read. Each component has a DC scan and its refinement, an AC scan of the
low band and its refinement (successive approximation), and an AC scan of the high band (spectral selection).
The Huffman tables give the frequent symbols codes whose length and extra bits add up to 8, so that whole runs of
blocks are packed and unpacked as bytes by numpy; anything else goes bit by bit through the general coder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylattice.llm.common import shared_path, table, written

UNIT = 64
#: Last coefficient of the low band.
LOW = 5
#: MCUs in a row of the picture, at most, but for pictures of over 4000 rows.
WIDTH = 32

# The zigzag order of the JPEG standard, by rule: anti-diagonals of alternating direction.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _table(lengths: dict[int, int]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Canonical codes of a Huffman table (symbol: code, bits) and its DHT body."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    return codes, counts + bytes(order)


# First AC scans: (run 0, size s) has 8 - s bits, end of block 8, everything else 16.
_AC = {s: 8 - s for s in range(7, 0, -1)} | {0x00: 8} | {r << 4 | s: 16 for r in range(16) for s in range(11) if (r, s) == (15, 0) or s and (r or s > 7)}
# Refinements: a new coefficient 1 bit, a run of 16 zeros 2, end of block 3, longer runs 8.
_FINE = {0x01: 1, 0xF0: 2, 0x00: 3} | {r << 4 | 1: 8 for r in range(1, 15)}
# DC differences: (size s) has 8 - s bits up to 6, then longer.
_DC = {s: 8 - s for s in range(6, 0, -1)} | {0: 8, 7: 9, 8: 10, 9: 11, 10: 12, 11: 13}
AC, AC_BODY = _table(_AC)
FINE, FINE_BODY = _table(_FINE)
DC, DC_BODY = _table(_DC)


def _bytes_of(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """The 8-bit word of every coefficient value -127 to 127, at index value + 128; 255 where there is none."""
    out = np.full(257, 255, np.uint8)
    for v in range(-127, 128):
        s = abs(v).bit_length()
        if v and codes.get(s, (0, 99))[1] + s == 8:
            out[v + 128] = codes[s][0] << s | (v if v > 0 else v + (1 << s) - 1)
    return out


AC_BYTE = _bytes_of(AC)
DC_BYTE = _bytes_of(DC)
DC_BYTE[128] = DC[0][0]


def _values_of(words: np.ndarray) -> np.ndarray:
    out = np.full(256, 999, np.int16)
    used = np.flatnonzero(words != 255)
    out[words[used]] = used - 128
    return out


AC_VALUE, DC_VALUE = _values_of(AC_BYTE), _values_of(DC_BYTE)

# Payload bytes as coefficients: 2 to 127 as they are, those from 128 negative. -1, -128, 0 and 1, which need the slow way
# in some scan, stand for 0xC1, 0xC0, 0xFF and 0xFE, which UTF-8 never holds; 0 and 1 have the places of the latter two.
TO_COEFFICIENT = np.array([b if b < 128 else -1 - (b - 0xC1) % 128 for b in range(256)], np.int16)
TO_COEFFICIENT[[0x00, 0x01, 0xFF, 0xFE]] = TO_COEFFICIENT[[0xFF, 0xFE, 0x00, 0x01]]
#: Coefficients of blocks that only fill the picture up.
FILL = 2
TO_BYTE = np.zeros(257, np.uint8)
TO_BYTE[TO_COEFFICIENT + 128] = np.arange(256)


class BitWriter:
    def __init__(self) -> None:
        self.done, self.bits, self.n = bytearray(), 0, 0

    def put(self, code: int, n: int) -> None:
        self.bits, self.n = self.bits << n | code, self.n + n
        while self.n >= 8:
            self.n -= 8
            self.done.append(self.bits >> self.n & 255)
            self.bits &= (1 << self.n) - 1

    def end(self) -> bytes:
        if self.n:
            self.put((1 << 8 - self.n) - 1, 8 - self.n)
        return bytes(self.done)


def _amplitude(v: int) -> tuple[int, int]:
    s = abs(v).bit_length()
    return (v if v > 0 else v + (1 << s) - 1), s


def encode_dc(c: np.ndarray) -> bytes:
    diff = np.diff(c >> 1, prepend=0)
    words = DC_BYTE[np.clip(diff, -128, 128) + 128]
    if (words != 255).all():
        return words.tobytes()
    out = BitWriter()
    for d in diff.tolist():
        bits, s = _amplitude(d)
        out.put(*DC[s])
        out.put(bits, s)
    return out.end()


def encode_ac(blocks: np.ndarray) -> bytes:
    """A first AC scan of (blocks, band) coefficients, after the point transform."""
    words = AC_BYTE[np.clip(blocks, -128, 128) + 128]
    odd = np.flatnonzero((words == 255).any(1))
    whole = int(odd[0]) if len(odd) else len(blocks)
    out = BitWriter()
    for block in blocks[whole:].tolist():
        run = 0
        for v in block:
            if not v:
                run += 1
                continue
            while run > 15:
                out.put(*AC[0xF0])
                run -= 16
            bits, s = _amplitude(v)
            out.put(*AC[run << 4 | s])
            out.put(bits, s)
            run = 0
        if run:
            out.put(*AC[0x00])
    return words[:whole].tobytes() + out.end()


def encode_fine(blocks: np.ndarray) -> bytes:
    """The refinement of a low band of LOW coefficients by its last bit."""
    size, bit = np.abs(blocks), np.abs(blocks) & 1
    odd = np.flatnonzero((size < 2).any(1))
    whole = int(odd[0]) if len(odd) else len(blocks)
    words = (FINE[0][0] << LOW) + bit[:whole] @ (1 << np.arange(LOW - 1, -1, -1))
    out = BitWriter()
    for i in range(whole, len(blocks)):
        mags, vals = size[i].tolist(), blocks[i].tolist()
        new = [k for k, m in enumerate(mags) if m == 1]
        last = new[-1] if new else -1
        run, fix = 0, []
        for k, m in enumerate(mags[: last + 1]):
            if m > 1:
                fix.append(m & 1)
            elif m == 0:
                run += 1
            else:
                out.put(*FINE[run << 4 | 1])
                out.put(vals[k] > 0, 1)
                for b in fix:
                    out.put(b, 1)
                run, fix = 0, []
        if last + 1 < len(mags):
            out.put(*FINE[0])
            for m in mags[last + 1 :]:
                if m > 1:
                    out.put(m & 1, 1)
    return words.astype(np.uint8).tobytes() + out.end()


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def bit(self) -> int:
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("not a code of the scan's table")

    def amplitude(self, s: int) -> int:
        v = self.take(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def decode_table(body: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[n, code] = body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode_scan(data: bytes, c: np.ndarray, first: int, last: int, high: int, low: int, body: bytes) -> None:
    """Accumulates one scan into the coefficients (blocks, 64) of its component. `body`: its Huffman table."""
    n = len(c)
    if first == 0:
        if high:
            c[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(c.dtype) << low
            return
        words = np.frombuffer(data, np.uint8)
        if body == DC_BODY and len(words) == n and (DC_VALUE[words] != 999).all():
            c[:, 0] = np.cumsum(DC_VALUE[words]) << low
            return
        r, t, value = BitReader(data), decode_table(body), 0
        for i in range(n):
            value += r.amplitude(r.symbol(t))
            c[i, 0] = value << low
        return
    band, done = last - first + 1, 0
    if not high:
        if body == AC_BODY:  # as many whole blocks of 8-bit words as there are
            words = np.frombuffer(data, np.uint8)[: n * band]
            values = AC_VALUE[words]
            odd = np.flatnonzero(values == 999)
            done = (int(odd[0]) if len(odd) else len(words)) // band
            c[:done, first : last + 1] = values[: done * band].reshape(done, band) << low
        if done == n:
            return
        r, t, rest = BitReader(data), decode_table(body), 0
        r.at = 8 * done * band
        for i in range(done, n):
            k = first
            if rest:
                rest -= 1
                continue
            while k <= last:
                run, s = divmod(r.symbol(t), 16)
                if s:
                    k += run
                    c[i, k] = r.amplitude(s) << low
                elif run < 15:
                    rest = (1 << run) - 1 + r.take(run)
                    break
                else:
                    k += 15
                k += 1
        return
    known = (c[:, first : last + 1] != 0).all(1)
    if body == FINE_BODY and band == LOW:
        done = n if known.all() else int(np.argmin(known))
        words = np.frombuffer(data, np.uint8)[:done]
        bits = words[:, None] >> np.arange(LOW - 1, -1, -1) & 1
        part = c[:done, first : last + 1]
        part += (np.sign(part) * bits << low).astype(c.dtype)
    if done == n:
        return
    r, t, rest = BitReader(data), decode_table(body), 0
    r.at = 8 * done

    def fix(i: int, k: int) -> None:
        if r.bit():
            c[i, k] += (1 << low) if c[i, k] > 0 else -(1 << low)

    for i in range(done, n):
        k = first
        while k <= last and not rest:
            run, s = divmod(r.symbol(t), 16)
            if not s and run < 15:
                rest = (1 << run) + r.take(run)
                break
            value = ((1 << low) if r.bit() else -(1 << low)) if s else 0
            while k <= last:
                if c[i, k]:
                    fix(i, k)
                elif run:
                    run -= 1
                else:
                    c[i, k] = value
                    k += 1
                    break
                k += 1
        if rest:
            for k in range(k, last + 1):
                if c[i, k]:
                    fix(i, k)
            rest -= 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(1)
def _head() -> bytes:
    tables = bytes([0x00]) + DC_BODY + bytes([0x10]) + AC_BODY + bytes([0x11]) + FINE_BODY
    return b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC4, tables)


def geometry(blocks: int) -> tuple[int, int]:
    """MCUs in a row, and rows, of the picture that holds so many blocks; an MCU has four of Y, one of Cb, one of Cr."""
    units = max(1, -(-blocks // 6))
    height = -(-units // max(WIDTH, -(-units // 4000)))
    return -(-units // height), height


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % UNIT if text else UNIT)


def encode_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG with the payload's bytes as coefficients; a comment segment holds the payload's length."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    w, h = geometry(len(blocks))
    c = np.full((w * h * 6, UNIT), FILL, np.int16)
    c[: len(blocks)] = TO_COEFFICIENT[blocks]
    n = w * h
    out = [_head(), _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    for k, part in ((1, c[: 4 * n]), (2, c[4 * n : 5 * n]), (3, c[5 * n :])):
        size = np.sign(part[:, 1 : LOW + 1]) * (np.abs(part[:, 1 : LOW + 1]) >> 1)
        scans = (
            (0, 0, 0, 1, 0x00, encode_dc(part[:, 0])),
            (1, LOW, 0, 1, 0x00, encode_ac(size)),
            (LOW + 1, 63, 0, 0, 0x00, encode_ac(part[:, LOW + 1 :])),
            (0, 0, 1, 0, 0x00, np.packbits(part[:, 0] & 1).tobytes()),
            (1, LOW, 1, 0, 0x01, encode_fine(part[:, 1 : LOW + 1])),
        )
        for first, last, high, low, tables, data in scans:
            out += [_segment(0xDA, bytes([1, k, tables, first, last, high << 4 | low])), data.replace(b"\xff", b"\xff\x00")]
    return b"".join([*out, b"\xff\xd9"])


def decode_jpeg(data: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]], tuple[int, int], list[np.ndarray], bytes]:
    """Coefficients of each component (block rows x block columns x 64, zigzag), sampling factors, picture size,
    quantisation steps of each component, and the comment. Non-interleaved scans; restarts are not used."""
    at, tables, steps, comment = 2, {}, {}, b""
    parts: dict[int, np.ndarray] = {}
    kinds: dict[int, tuple[int, int, int]] = {}
    height = width = 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0] if data[at + 1] != 0xD9 else 0
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xD9:
            break
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                steps[body[i]] = np.frombuffer(body[i + 1 : i + 65], np.uint8).astype(np.int32)
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            for i in range(n):
                k, f, q = body[6 + 3 * i : 9 + 3 * i]
                kinds[k] = (f >> 4, f & 15, q)
            most_w, most_h = max(f[0] for f in kinds.values()), max(f[1] for f in kinds.values())
            for k, (fw, fh, _) in kinds.items():
                cols = -(-(-(-width * fw // most_w)) // 8)
                rows = -(-(-(-height * fh // most_h)) // 8)
                parts[k] = np.zeros((rows, cols, UNIT), np.int16)
        elif marker == 0xDA:
            _, k, ts, first, last, approx = body[:6]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            body = tables.get(ts >> 4 if not first else 0x10 | ts & 15, b"")
            decode_scan(data[at:end].replace(b"\xff\x00", b"\xff"), parts[k].reshape(-1, UNIT), first, last, approx >> 4, approx & 15, body)
            at = end
    order = sorted(parts)
    return [parts[k] for k in order], [kinds[k][:2] for k in order], (height, width), [steps[kinds[k][2]] for k in order], comment


@lru_cache(1)
def _basis() -> np.ndarray:
    """Inverse DCT of a zigzag block as one 64 x 64 matrix."""
    k = np.arange(8)
    m = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) / 2
    m[:, 0] /= np.sqrt(2)
    return np.einsum("yv,xu->vuyx", m, m).reshape(64, 64)[ZIGZAG].astype(np.float32)


def rgb_tensor(parts: list[np.ndarray], factors: list[tuple[int, int]], size: tuple[int, int], steps: list[np.ndarray]) -> np.ndarray:
    """Full-resolution RGB (height, width, 3), uint8: inverse transform, chroma upsampling, colour conversion."""
    height, width = size
    most_w, most_h = max(f[0] for f in factors), max(f[1] for f in factors)
    planes = []
    for c, (fw, fh), q in zip(parts, factors, steps, strict=True):
        rows, cols, _ = c.shape
        p = (c.reshape(-1, 64) * q).astype(np.float32) @ _basis() + 128
        p = p.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        p = np.repeat(np.repeat(p, most_h // fh, 0), most_w // fw, 1)
        planes.append(np.clip(p[:height, :width], 0, 255))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def payload_from(parts: list[np.ndarray], comment: bytes) -> bytes:
    flat = np.concatenate([p.reshape(-1, UNIT) for p in parts])
    return TO_BYTE[flat + 128].tobytes()[: struct.unpack(">Q", comment)[0]]


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths of a step, and 64 bits that compare neighbouring cells of brightness."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (h * w)
    rows = np.add.reduceat(rgb.sum(2, dtype=np.int64), np.arange(8) * h // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(9) * w // 9, axis=1)
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return f"{w}x{h};{','.join(map(str, means.tolist()))};{bits}"


def store_media(docs: DataFrame, path: str) -> None:
    """Writes doc_id, n_bytes and media (progressive JPEG) of each text. Null texts are empty ones; rows may repeat."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_jpeg(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", "text")
    written(rows.mapInArrow(stored, rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema), path)


#: Tensors that are in memory at once, as one batch.
TENSOR_ROWS = 256

MADE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_bytes of every stored picture, and what its bytes hold: payload and media digests, the feature, and
    the full-resolution RGB tensor (height, width, rgb: height x width x 3 bytes), of which the feature is made.

    The tensor is a media column of the table that is returned: whoever writes that table stores it.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TENSOR_ROWS):
                batch = whole.slice(at, TENSOR_ROWS)
                rows = []
                for media in batch.column("media").to_pylist():
                    parts, factors, size, steps, comment = decode_jpeg(media)
                    payload, rgb = payload_from(parts, comment), rgb_tensor(parts, factors, size, steps)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                cols = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    names = [c.split()[0] for c in MADE.split(", ")]
    media = spark.read.parquet(path)
    return media.mapInArrow(decoded, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, {MADE}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, features and RGB tensors of all `documents`, from progressive JPEGs in a new table of the shared folder.

    Null and empty texts are a payload of 64 zero bytes; null and repeated ids stay, a row each; equal texts have equal values;
    a very long text is one picture, with rows of more MCUs from 4,000 rows up; other columns are not read; an empty table
    gives an empty result.
    """
    path = shared_path(spark, "media")
    store_media(table(spark, sf_dir, "documents"), path)
    return read_media(spark, path)
