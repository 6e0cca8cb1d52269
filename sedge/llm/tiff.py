"""Operator 7: TIFF pages as rows.

Reading walks the image directories of a file, undoes PackBits, LZW or deflate strip by strip or
tile by tile, undoes the horizontal predictor, and gives one row per page. Writing stores 8-bit
samples by the same rules, which the round trips of the tests use in all combinations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_position, from_texts, need, sha256_hex

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I"}

PAGE = "page int, width long, height long, samples long, pixels binary"


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
        else:
            j = i + 1
            while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
            i = j
    return bytes(out)


CLEAR, STOP, FIRST = 256, 257, 258


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    out, table, last = [], None, None
    acc = bits = 0
    width = 9
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == STOP:
            break
        if code == CLEAR:
            table, last, width = [bytes((i,)) for i in range(256)] + [b"", b""], None, 9
            continue
        if table is None:
            raise ValueError("LZW data must begin with a clear code")
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        size = len(table)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    size, width = FIRST, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = acc << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(CLEAR)
    word = b""
    for byte in data:
        longer = word + bytes((byte,))
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(CLEAR)
            table.clear()
            size, width = FIRST, 9
        word = bytes((byte,))
    if word:
        put(table[word] if len(word) > 1 else word[0])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(STOP)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory, in the file's order of pages."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * i
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                fields[tag] = struct.unpack_from(form, data, where)
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page_samples(data: bytes, fields: dict[int, tuple]) -> np.ndarray:
    """Height x width x samples, 8 bits, of one directory's image."""
    one = lambda tag, otherwise: fields.get(tag, (otherwise,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if set(fields.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples stored pixel by pixel are read")
    unpack = UNPACK[one(COMPRESSION, NONE)]
    if TILE_OFFSETS in fields:
        w, h, offsets, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), fields[TILE_OFFSETS], fields[TILE_BYTES]
    else:
        w, h, offsets, sizes = width, min(height, one(ROWS_PER_STRIP, height)), fields[STRIP_OFFSETS], fields[STRIP_BYTES]
    out = np.zeros((height, width, samples), np.uint8)
    across = -(-width // w)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        top, left = k // across * h, k % across * w
        part = np.frombuffer(unpack(data[offset : offset + size]), np.uint8)
        part = part[: len(part) // (w * samples) * w * samples].reshape(-1, w, samples)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        rows, columns = min(len(part), height - top), min(w, width - left)
        out[top : top + rows, left : left + columns] = part[:rows, :columns]
    return out


def read_pages(data: bytes) -> list[np.ndarray]:
    return [page_samples(data, fields) for fields in directories(data)]


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of pages (height x width x samples, 8 bits) in strips of `rows` rows, or in tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        h, w = tile or (rows, width)
        offsets, sizes = [], []
        for top in range(0, height, h):
            for left in range(0, width, w):
                part = page[top : top + h, left : left + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                packed = PACK[compression](np.ascontiguousarray(part).tobytes())
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        if tile:
            fields |= {TILE_WIDTH: [w], TILE_HEIGHT: [h], TILE_OFFSETS: offsets, TILE_BYTES: sizes}
        else:
            fields |= {ROWS_PER_STRIP: [h], STRIP_OFFSETS: offsets, STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            kind = 4 if tag in (WIDTH, HEIGHT, STRIP_OFFSETS, STRIP_BYTES, ROWS_PER_STRIP, TILE_OFFSETS, TILE_BYTES) else 3
            body = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body
                body = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(files: DataFrame, media: str = "media", key: str = "rid") -> DataFrame:
    """One row per page of the files' TIFF bytes: key, page (from 0), width, height, samples, pixels.

    Null or empty bytes have no pages, and an empty table has none. A repeated row gives its pages
    again; a null key stays null. Other columns, whatever their names, are not read. Bytes that aren't a TIFF of
    8-bit samples fail the query, with the reason. A task holds one file's pages at a time.
    """
    rows = by_position(need(files, key, media))
    schema = T.StructType([rows.schema[0], *T.DataType.fromDDL(PAGE).fields])
    types = list(to_arrow_schema(schema).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                pages = read_pages(data.as_py()) if data.is_valid and len(data.as_py()) else []
                if pages:
                    found = zip(*((k, p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for k, p in enumerate(pages)), strict=True)
                    arrays = [batch.column(0).take(pa.array([i] * len(pages))), *(pa.array(x, t) for x, t in zip(found, types[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("c0", key)


UNIT, ROW = 192, 64  # a row of 64 pixels of three samples
RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT)


def to_media(payload: bytes) -> bytes:
    return write_pages([np.frombuffer(payload, np.uint8).reshape(-1, ROW, 3)])


def feature(page: np.ndarray) -> str:
    """Size, and of each sample's plane the mean and the mean step to the pixel on the right, in thousandths."""
    planes = page.reshape(-1, page.shape[2])
    means = planes.sum(axis=0, dtype=np.int64) * 1000 // len(planes)
    steps = np.abs(np.diff(page.astype(np.int16), axis=1)).sum(axis=(0, 1), dtype=np.int64) * 1000 // max(1, page.shape[0] * (page.shape[1] - 1))
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]};mean={'/'.join(map(str, means))};step={'/'.join(map(str, steps))}"


def _through_media(texts: list[str | None]) -> list[tuple]:
    rows = []
    for text in texts:
        payload = payload_of(text or "")
        media = to_media(payload)
        (page,) = read_pages(media)
        back = page.tobytes()
        rows.append((len((text or "").encode()), len(back), sha256_hex(back), zlib.crc32(back[-16:]), len(media), sha256_hex(media), feature(page)))
    return rows


def text_media(docs: DataFrame) -> DataFrame:
    """Each row's text stored as a TIFF page of three 8-bit samples and read back: sizes, digests and a feature.

    Null and empty texts are one row of blanks; a null doc_id stays null; each repeated row has its
    own row in the result, with equal values; an empty table gives an empty result; extra columns
    are not read. A very long text is one tall page: memory goes with its length.
    """
    return from_texts(need(docs, "doc_id", "text"), lambda: _through_media, RESULT)
