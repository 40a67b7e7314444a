"""Media columns: progressive JPEG, decoded scan by scan into coefficient arrays.

``decode`` reads any 8-bit progressive Huffman file of one or three components:
each scan adds a spectral band or a bit of precision to the coefficients, with
restarts, end-of-band runs and refinement. ``rgb`` transforms the blocks in
numpy, upsamples chroma and gives a full-resolution height x width x 3 tensor.

A payload is stored losslessly in the format's own unit, the coefficient: with
all quantisers 1, each byte b is a coefficient of magnitude category 8, whose
amplitude bits are b itself (b from 128 up, b - 255 below; b - 254 for the
first of a block, whose precision is cut by an arithmetic shift). Luma is twice
as wide as chroma; blocks fill luma, then both chroma planes. Files hold, for
each component, a first pass one bit short in three bands and two refinements.
Where a scan's codes are all of one length, as in these files, it is read by
whole arrays; any other scan is read code by code.

Null and empty texts are stored as 64 zero bytes. Equal texts give equal files.
What is read back of a null or broken file is null. Whole texts are stored, however
long; repeated rows give a row each, an empty table an empty result, and other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_texts

BLOCK = 64
ROW_BLOCKS = 4096
#: The zigzag order of an 8 x 8 block's coefficients.
ZIGZAG = np.array([u * 8 + d - u for d in range(15) for u in (range(max(0, d - 7), min(d, 7) + 1) if d % 2 else range(min(d, 7), max(0, d - 7) - 1, -1))])
#: What ends a scan's coded bytes: a marker that is neither stuffing nor a restart.
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
SOF2, DHT, SOI, EOI, SOS, DQT, DRI, COM = 0xC2, 0xC4, 0xD8, 0xD9, 0xDA, 0xDB, 0xDD, 0xFE


def _basis() -> np.ndarray:
    """Zigzag coefficients -> samples, as one 64 x 64 matrix."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)[ZIGZAG]


BASIS = _basis()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0
    #: rows x cols x 64 in zigzag order; padded to whole units of interleaved scans.
    coef: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: int = 0


class _Codes:
    """A Huffman table: symbols by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.by: dict[tuple[int, int], int] = {}
        code = k = 0
        for n in range(16):
            for _ in range(counts[n]):
                self.by[n + 1, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        #: The symbol of the one-bit code 0, if there is one.
        self.short = self.by.get((1, 0))


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def get(self, n: int) -> int:
        value = 0
        for _ in range(n):
            i = self.at >> 3
            value = value << 1 | (self.raw[i] >> (7 - (self.at & 7)) & 1 if i < len(self.raw) else 1)
            self.at += 1
        return value

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (s := codes.by.get((n, code))) is not None:
                return s
        raise ValueError("bad code")

    def amplitude(self, n: int) -> int:
        value = self.get(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


def _refine(block: np.ndarray, k: int, stop: int, bits: _Bits, one: int, until: int) -> int:
    """Pass ``until`` zero coefficients from ``k`` on (all, if it is negative), a correction bit for each other one; where that ends."""
    while k <= stop:
        v = int(block[k])
        if v:
            if bits.get(1) and not abs(v) & one:
                block[k] = v + one if v > 0 else v - one
        else:
            if until == 0:
                return k
            until -= 1
        k += 1
    return k


def _unit(block: np.ndarray, bits: _Bits, scan: tuple[int, int, int, int], dc: _Codes | None, ac: _Codes | None, state: dict[str, int], key: str) -> None:
    first, last, high, low = scan
    if first == 0:
        if high:
            if bits.get(1):
                block[0] |= 1 << low
        else:
            state[key] = state.get(key, 0) + bits.amplitude(bits.symbol(dc))
            block[0] = state[key] << low
        return
    one = 1 << low
    if not high:
        if state.get("run", 0):
            state["run"] -= 1
            return
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(ac), 16)
            if size:
                k += run
                block[k] = bits.amplitude(size) * one
                k += 1
            elif run == 15:
                k += 16
            else:
                state["run"] = (1 << run) - 1 + bits.get(run)
                return
        return
    k = first
    if not state.get("run", 0):
        while k <= last:
            run, size = divmod(bits.symbol(ac), 16)
            value = 0
            if size:
                value = one if bits.get(1) else -one
            elif run < 15:
                state["run"] = (1 << run) + bits.get(run)
                break
            k = _refine(block, k, last, bits, one, run)
            if value and k <= last:
                block[k] = value
            k += 1
    if state.get("run", 0):
        _refine(block, k, last, bits, one, -1)
        state["run"] -= 1


def _whole_scan(c: Component, coded: bytes, scan: tuple[int, int, int, int], dc: _Codes | None, ac: _Codes | None, every: int, size: tuple[int, int]) -> bool:
    """Read a scan of one component whose codes are all of one length; False if it isn't such a scan."""
    first, last, high, low = scan
    if size != c.coef.shape[:2]:
        return False
    blocks = c.coef.reshape(-1, 64)
    n = len(blocks)
    if first == 0 and high:
        raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8)
        if every or last or len(raw) != -(-n // 8):
            return False
        blocks[:, 0] |= np.unpackbits(raw)[:n].astype(np.int32) << low
        return True
    if first == 0:
        s = dc.short
        raw = np.frombuffer(coded, np.uint8)
        if s != 7 or every != 1 or last or len(raw) != 3 * n - 2 or (raw[::3] >> 7).any() or not (raw[1::3] == 0xFF).all():
            return False
        v = raw[::3].astype(np.int32)
        blocks[:, 0] = np.where(v >> 6, v, v - 127) << low
        return True
    band = last - first + 1
    if not high:
        raw = np.frombuffer(coded, np.uint8)
        if ac.short != 7 or every or len(raw) != n * band or (raw >> 7).any():
            return False
        v = raw.reshape(n, band).astype(np.int32)
        blocks[:, first : last + 1] = np.where(v >> 6, v, v - 127) << low
        return True
    raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8)
    old = blocks[:, first : last + 1]
    if ac.short != 0 or every or (band + 1) % 8 or len(raw) != n * (band + 1) // 8 or not old.all():
        return False
    bits = np.unpackbits(raw).reshape(n, band + 1)
    if bits[:, 0].any():
        return False
    add = bits[:, 1:].astype(np.int32) << low
    blocks[:, first : last + 1] = old + np.where(old > 0, add, -add) * ((np.abs(old) & (1 << low)) == 0)
    return True


def decoded(data: bytes | None) -> Image | None:
    """The image of a file; None for a null or broken one."""
    try:
        return decode(data) if data is not None else None
    except (ValueError, IndexError, KeyError, TypeError, AttributeError, StopIteration, struct.error):
        return None


def decode(data: bytes) -> Image:
    """All scans of a progressive file, accumulated."""
    image, tables, every, at = None, {}, 0, 2
    quants: dict[int, np.ndarray] = {}
    comments: list[bytes] = []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("broken file")
        mark = data[at + 1]
        if mark == EOI:
            break
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == DQT:
            while body:
                wide, k = divmod(body[0], 16)
                n = 64 << wide
                quants[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif mark == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _Codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == DRI:
            every = int.from_bytes(body, "big")
        elif mark == COM:
            comments.append(body)
        elif mark == SOF2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            parts = [Component(body[i], *divmod(body[i + 1], 16), body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.cols = -(-(-(-width * c.h // hm)) // 8)
                c.rows = -(-(-(-height * c.v // vm)) // 8)
                whole = (-(-height // (8 * vm)) * c.v, -(-width // (8 * hm)) * c.h) if n > 1 else (c.rows, c.cols)
                c.coef = np.zeros((*whole, 64), np.int32)
            image = Image(width, height, parts)
        elif mark == SOS:
            n = body[0]
            used = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), *divmod(body[2 + 2 * i], 16)) for i in range(n)]
            scan = (body[1 + 2 * n], body[2 + 2 * n], *divmod(body[3 + 2 * n], 16))
            stop = _END.search(data, at).start()
            _read_scan(image, used, scan, data[at:stop], tables, every)
            image.scans += 1
            at = stop
        elif mark in range(0xC0, 0xD0) and mark not in (DHT, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman file")
    if image is None:
        raise ValueError("no image")
    image.quants, image.comments = quants, comments
    return image


def _read_scan(image: Image, used: list, scan: tuple[int, int, int, int], coded: bytes, tables: dict[int, _Codes], every: int) -> None:
    if len(used) == 1:
        c, d, a = used[0]
        dc, ac = tables.get(d), tables.get(16 + a)
        if _whole_scan(c, coded, scan, dc, ac, every, (c.rows, c.cols)):
            return
        units = [[(c.coef[r, k], dc, ac, "dc")] for r in range(c.rows) for k in range(c.cols)]
    else:
        hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
        units = [
            [(c.coef[y * c.v + j, x * c.h + i], tables.get(d), tables.get(16 + a), f"dc{c.ident}") for c, d, a in used for j in range(c.v) for i in range(c.h)]
            for y in range(-(-image.height // (8 * vm)))
            for x in range(-(-image.width // (8 * hm)))
        ]
    parts = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(coded)] if every else [coded.replace(b"\xff\x00", b"\xff")]
    step = every or max(1, len(units))
    for i, start in enumerate(range(0, len(units), step)):
        bits, state = _Bits(parts[i]), {}
        for unit in units[start : start + step]:
            for block, dc, ac, key in unit:
                _unit(block, bits, scan, dc, ac, state, key)


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component, by an inverse transform of all its blocks at once."""
    out = []
    for c in image.components:
        q = image.quants.get(c.quant)
        coef = c.coef.reshape(-1, 64)
        if q is not None and (q != 1).any():
            coef = coef * q
        px = np.clip(np.rint(coef.astype(np.float64) @ BASIS) + 128, 0, 255).astype(np.uint8)
        rows, cols = c.coef.shape[:2]
        out.append(px.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    return out


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3 in full resolution; chroma samples are repeated."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, planes(image), strict=True):
        if c.h < hm:
            p = np.repeat(p, hm // c.h, 1)
        if c.v < vm:
            p = np.repeat(p, vm // c.v, 0)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = (p.astype(np.float32) for p in full)
    cb -= 128
    cr -= 128
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    """(rows, columns) of luma blocks, an even number of columns; chroma has half of them."""
    if blocks <= 2 * ROW_BLOCKS:
        return 1, 2 * -(-blocks // 4)
    return -(-blocks // (2 * ROW_BLOCKS)), ROW_BLOCKS


_TABLES = _segment(DQT, b"\0" + b"\1" * 64) + _segment(DHT, b"".join(bytes([k, 1, *[0] * 15, s]) for k, s in ((0x00, 7), (0x10, 7), (0x11, 0))))


def encode_payload(payload: bytes, note: bytes = b"") -> bytes:
    """A progressive file whose coefficients hold ``payload`` (a positive multiple of 64 bytes); ``note`` goes into its comment."""
    n = len(payload) // BLOCK
    rows, cols = _grid(n)
    half = cols // 2
    b = np.zeros((rows * (cols + 2 * half), BLOCK), np.uint8)
    b[:n] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    high, odd = b >> 1, b & 1
    fix = odd.copy()  # correction bits are those of the magnitude: turned where the coefficient is below 0
    fix[:, 1:] ^= b[:, 1:] < 128
    fix[:, 0] = 0  # the end-of-band code before each block's corrections
    cuts = (0, rows * cols, rows * (cols + half), len(b))
    out = [b"\xff\xd8", _segment(COM, note), _TABLES, _segment(SOF2, struct.pack(">BHHB", 8, 8 * rows, 8 * cols, 3) + bytes((1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0)))]

    def scan(k: int, table: int, first: int, last: int, bits: int, coded: bytes) -> None:
        out.append(_segment(SOS, bytes((1, k + 1, table, first, last, bits))))
        out.append(coded)

    part = [slice(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    out.append(_segment(DRI, b"\0\1"))
    for k, p in enumerate(part):
        m = p.stop - p.start
        one = np.empty((m, 3), np.uint8)
        one[:, 0], one[:, 1], one[:, 2] = high[p, 0], 0xFF, 0xD0 + (np.arange(m) & 7)
        scan(k, 0x00, 0, 0, 0x01, one.tobytes()[:-2])
    out.append(_segment(DRI, b"\0\0"))
    for first, last in ((1, 5), (6, 63)):
        for k, p in enumerate(part):
            scan(k, 0x00, first, last, 0x01, high[p, first : last + 1].tobytes())
    packed = np.packbits(fix, axis=1)
    for k, p in enumerate(part):
        scan(k, 0x01, 1, 63, 0x10, packed[p].tobytes().replace(b"\xff", b"\xff\0"))
    for k, p in enumerate(part):
        scan(k, 0x00, 0, 0, 0x10, np.packbits(odd[p, 0]).tobytes().replace(b"\xff", b"\xff\0"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image, size: int) -> bytes:
    """The first ``size`` bytes that an image's coefficients hold."""
    coef = np.concatenate([c.coef.reshape(-1, 64) for c in image.components])[: size // BLOCK]
    b = np.where(coef >= 0, coef, coef + 255)
    b[:, 0] -= coef[:, 0] < 0
    return b.astype(np.uint8).tobytes()


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a file of its own."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            raw = [(t or "").encode() for t in column(batch, text_col)]
            return {"doc_id": column(batch, id_col), "n_bytes": [len(r) for r in raw], "media": [encode_payload(padded(r), str(len(r)).encode()) for r in raw]}

        return step

    return map_texts(docs.select(id_col, text_col), kernel, "doc_id long, n_bytes long, media binary", text_col)


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb: full-resolution tensors of stored files."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            got = [None if i is None else rgb(i) for i in map(decoded, column(batch, "media"))]
            part = lambda f: [None if x is None else f(x) for x in got]
            return {"doc_id": column(batch, "doc_id"), "height": part(lambda x: x.shape[0]), "width": part(lambda x: x.shape[1]), "rgb": part(lambda x: x.tobytes())}

        return step

    return map_texts(stored.select("doc_id", "media"), kernel, "doc_id long, height int, width int, rgb binary", "media")


def feature(x: np.ndarray) -> str:
    """Size, mean and spread of each channel, and how much neighbours in a row differ, of an RGB tensor."""
    flat = x.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    edge = np.abs(np.diff(x[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64)
    mean = total / n
    spread = np.sqrt(np.maximum(0, square / n - mean * mean))
    return f"{x.shape[0]}x{x.shape[1]}|" + ",".join(f"{v:.3f}" for v in (*mean, *spread, edge / n))


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of what the stored files hold: the payload read back from the coefficients, the file, and the image's feature."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out: dict[str, list] = {k: [] for k in names}
            for media in column(batch, "media"):
                image = decoded(media)
                row: tuple = (None,) * len(names)
                if image is not None and image.comments and image.comments[0].isdigit():
                    payload = payload_of(image, max(BLOCK, -(-int(image.comments[0]) // BLOCK) * BLOCK))
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb(image)))
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            return {"doc_id": column(batch, "doc_id"), "n_bytes": column(batch, "n_bytes")} | out

        return step

    return map_texts(stored, kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")
