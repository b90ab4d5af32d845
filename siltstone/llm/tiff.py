"""TIFF columns: a reader that walks image directories and yields one row per page, and a writer for 8-bit samples.

Read and written: both byte orders, strips and tiles, chunky 8- or 16-bit unsigned samples, no compression, PackBits,
LZW or deflate, the horizontal predictor, one page or several.
A null file gives no page. A file that breaks the format, has a loop of directories, is cut off or would decode to more
than `most_bytes` (a parameter; memory grows with it, not with what a header claims) gives one row with the error and
null pixels, and never stops the job. Columns of the input other than the file and the key columns asked for are
dropped, so names can't clash; repeated rows give repeated pages, an empty table none."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

# Fixed values of the TIFF format: tags, compressions, field types' sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}
#: Bytes that a file may decode to.
MOST_BYTES = 1 << 30
#: Rows of the first two pages of a stored text, LZW and PackBits; the rest is deflated.
SHORT_ROWS = 4
PAGE_ROWS, TILE = 8_192, 64


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]).tolist() if len(a) else [0]
    out, plain = bytearray(), 0

    def literal(to: int) -> None:
        for i in range(plain, to, 128):
            out.append(min(128, to - i) - 1)
            out.extend(data[i : min(i + 128, to)])

    for lo, hi in zip(edge, edge[1:], strict=False):
        if hi - lo >= 3:
            literal(lo)
            for i in range(lo, hi, 128):
                n = min(128, hi - i)
                out += bytes([257 - n, data[lo]]) if n > 1 else bytes([0, data[lo]])
            plain = hi
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before, out, held, bits = list(first), 9, None, bytearray(), 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, before = list(first), 9, None
            continue
        if before is None:
            now = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code that was not defined")
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
        out += now
        before = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, new = {bytes([i]): i for i in range(256)}, 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    run = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if run + c in table:
            run += c
            continue
        put(table[run])
        table[run + c] = new
        new += 1
        if new == 4094:
            put(256)
            table, width, new = {bytes([k]): k for k in range(256)}, 9, 258
        elif new + 1 > 1 << width:
            width += 1
        run = c
    if run:
        put(table[run])
        new += 1
        if new + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, size))
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression} is not known")


def pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), LZW: pack_lzw, PACKBITS: pack_bits}[compression](data)


def write_pages(pages: list[np.ndarray], compression: int | list[int] = DEFLATE, predictor: int | list[int] = 2, rows: int = 256, tile: int | None = None, order: str = "<") -> bytes:
    """A file with a directory for each (height, width, samples) array of unsigned 8- or 16-bit samples, in strips of `rows`, or in tiles."""
    each = lambda x: x if isinstance(x, list) else [x] * len(pages)
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page, coding, predict in zip(pages, each(compression), each(predictor), strict=True):
        height, width, samples = page.shape
        a = page.astype(page.dtype.newbyteorder(order))
        high, wide = (tile, tile) if tile else (rows, width)
        at, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = a[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predict == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1).astype(a.dtype)
                coded = pack(part.tobytes(), coding)
                at.append(len(out))
                sizes.append(len(coded))
                out += coded + b"\0" * (len(coded) & 1)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * a.itemsize] * samples), (COMPRESSION, 3, [coding]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predict])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILES, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIPS, 4, at), (ROWS, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        body = []
        for tag, kind, values in sorted(fields, key=lambda f: f[0]):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(f"{order}I", where)
            body.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(body)) + b"".join(body)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes, most_bytes: int = MOST_BYTES) -> Iterator[Page]:
    """Each page of the file, in the order of its directories; at most `most_bytes` of samples in all."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("directories in a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPE_CODE:
                where = at + 10 + 12 * i
                if count * TYPE_SIZE[kind] > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where)
        page = page_of(data, order, tags, number, most_bytes)
        most_bytes -= len(page.pixels)
        yield page
        number += 1
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def page_of(data: bytes, order: str, tags: dict[int, tuple], number: int, most_bytes: int = MOST_BYTES) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if bits not in (8, 16) or one(FORMAT, 1) != 1 or one(PLANAR, 1) != 1 and samples > 1 or predictor not in (1, 2) or not width or not height or not samples:
        raise ValueError("samples of this kind are not known")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    if not w or not h:
        raise ValueError("strips or tiles without a size")
    if width * height * samples * kind.itemsize > most_bytes or w * h * samples * kind.itemsize > most_bytes:
        raise ValueError("more samples than asked for at most")
    places, sizes = tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
    across = -(-width // w)
    if len(places) != across * -(-height // h) or len(sizes) != len(places):
        raise ValueError("strips or tiles are missing")
    if any(at + size > len(data) for at, size in zip(places, sizes, strict=True)):
        raise ValueError("the file is cut off")
    full = np.empty((height, width, samples), kind)
    for i, (at, size) in enumerate(zip(places, sizes, strict=True)):
        y, x = i // across * h, i % across * w
        rows = h if tiled else min(h, height - y)
        want = rows * w * samples * kind.itemsize
        raw = unpack(data[at : at + size], compression, want)
        if len(raw) < want:
            raise ValueError("a strip or tile is too short")
        a = np.frombuffer(raw[:want], kind).reshape(rows, w, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
        full[y : y + rows, x : x + w] = a[: height - y, : width - x]
    return Page(number, width, height, samples, bits, compression, full.tobytes())


PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]


def page_rows(data: bytes | None, most_bytes: int = MOST_BYTES) -> list[tuple]:
    """One row per page of a file under PAGE_FIELDS, or one with the error."""
    if data is None:
        return []
    try:
        return [(p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels, None) for p in read_pages(data, most_bytes)]
    except (ValueError, LookupError, ArithmeticError, TypeError, struct.error, zlib.error, MemoryError) as e:
        return [(None,) * 7 + (str(e) or type(e).__name__,)]


def pages(df: DataFrame, file: str, keep: tuple[str, ...], most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page of the TIFF files in a binary column: `keep`, page, width, height, samples, bits, compression, pixels (row by row), error.

    `keep` may not name a column like one of these; rename it first."""
    kept = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(kept))):
                rows = page_rows(data.as_py(), most_bytes)
                own = [pa.array([batch.column(k)[i].as_py()] * len(rows), batch.column(k).type) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(PAGE_FIELDS)], [*keep, *(n for n, _ in PAGE_FIELDS)])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "page int, width long, height long, samples int, bits int, compression int, pixels binary, error string"])
    return df.select(*[df[f"`{c}`"] for c in keep], df[f"`{file}`"]).mapInArrow(lean(run), ddl)


def text_pages(payload: bytes, width: int = 64) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Bytes as RGB rows of 64 pixels (192 bytes) in pages, with each page's compression and predictor.

    Two short pages, LZW and PackBits, come first; the rest is deflated after the horizontal predictor."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, width, 3)
    edge = [0, SHORT_ROWS, *range(2 * SHORT_ROWS, len(a), PAGE_ROWS), len(a)]
    cut = [a[lo:hi] for lo, hi in zip(edge, edge[1:], strict=False) if lo < min(hi, len(a))]
    return cut, [LZW, PACKBITS][: len(cut)] + [DEFLATE] * (len(cut) - 2), [1, 1][: len(cut)] + [2] * (len(cut) - 2)


def text_file(payload: bytes) -> bytes:
    """A TIFF file of a text's payload; one of over TILE rows in a page is tiled."""
    cut, coding, predict = text_pages(payload)
    return write_pages(cut, coding, predict, tile=TILE if max(map(len, cut)) >= TILE else None)


def feature_of(rows: list[tuple]) -> str:
    """Pages, width, height, compressions, and mean, spread and entropy (in thousandths) of the decoded samples, from rows of page_rows()."""
    a = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt(max(0.0, (share * values * values).sum() - mean * mean)))
    bits = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    codes = "+".join(str(c) for c in dict.fromkeys(r[5] for r in rows))
    return f"pages={len(rows)};width={rows[0][1]};height={sum(r[2] for r in rows)};compression={codes};mean={mean:.3f};spread={spread:.3f};entropy={bits:.3f}"


def text_features(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Store each text as a TIFF file, read the file back as pages() does and describe what was read.

    A null text counts as empty, an empty one is a row of blanks. Columns: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and media (binary) if asked for. A payload of more
    than MOST_BYTES can't be a string of Spark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows = []
                for t in part.column(1):
                    raw = (t.as_py() or "").encode("utf-8")
                    media = text_file(raw.ljust(max(192, -(-len(raw) // 192) * 192), b" "))
                    read = page_rows(media, 2 * MOST_BYTES)
                    back = b"".join(r[6] for r in read)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(read), media if keep_media else None))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields))], [doc_id, *(n for n, _ in fields)])

    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())][: 8 if keep_media else 7]
    ddl = f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return df.select(df[f"`{doc_id}`"], df[f"`{text}`"]).mapInArrow(lean(run), ddl)
