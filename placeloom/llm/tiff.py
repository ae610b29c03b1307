"""TIFF columns: image directories, PackBits, LZW and deflate, strips and tiles, predictors.

Reading walks the chain of image directories of each value and gives one row a
page. Writing stores bytes losslessly as 8-bit grey samples of a fixed width,
cut into pages of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import id_and_text, table, text_bytes

# Fixed values of the format: tags, compressions, types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 16: "Q"}

#: Samples of a row, rows of a strip, rows of a page of what is written.
ROW, STRIP, PAGE = 64, 256, 4096


class TiffError(ValueError):
    """The bytes aren't a TIFF that can be read."""


# compression


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    acc = width = 0
    out = bytearray()
    table: dict[bytes, int] = {}
    held = 0

    def put(code: int) -> None:
        nonlocal acc, held
        acc = acc << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    width, nxt, w = 9, 258, b""
    put(256)
    for b in data:
        c = bytes((b,))
        if not w or w + c in table:
            w += c
            continue
        put(table[w] if len(w) > 1 else w[0])
        table[w + c] = nxt
        nxt += 1
        w = c
        if nxt == 4094:
            put(w[0])  # the held byte goes before the table starts anew
            put(256)
            table, nxt, width, w = {}, 258, 9, b""
        elif nxt + 1 > 1 << width:
            width += 1
    if w:
        put(table[w] if len(w) > 1 else w[0])
        nxt += 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, fresh = bytearray(), [bytes((i,)) for i in range(256)] + [b"", b""]
    words, width, before = fresh[:], 9, None
    acc = held = i = 0
    while len(out) < size:
        while held < width:
            if i >= len(data):
                return bytes(out)
            acc, held, i = (acc << 8 | data[i]) & 0xFFFFFF, held + 8, i + 1
        held -= width
        code = acc >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            words, width, before = fresh[:], 9, None
            continue
        if before is None:
            if code > 255:
                raise TiffError("an LZW stream that begins within")
            word = words[code]
        else:
            if code > len(words):
                raise TiffError("an LZW code that isn't known yet")
            word = words[code] if code < len(words) else before + before[:1]
            if len(words) < 4096:
                words.append(before + word[:1])
        out += word
        before = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(str(e)) from e


#: Bytes that a stored byte can stand for, at most.
MOST = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 128}
ENCODERS: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}
DECODERS: dict[int, Callable[[bytes, int], bytes]] = {NONE: lambda x, n: x[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: packbits_decode}


# predictors


def difference(rows: np.ndarray) -> np.ndarray:
    """rows x columns x samples: each sample less the one to its left."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def undo(rows: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    raise TiffError(f"predictor {predictor}")


# writing


def encode(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, row: int = ROW, strip: int = STRIP, page: int = PAGE, order: str = "<") -> bytes:
    """A TIFF of 8-bit grey samples, ``row`` to a row; the payload is a positive multiple of it long.

    tile: side of square tiles (a multiple of 16), 0: strips.
    """
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, row)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(pixels), page):
        image = pixels[top : top + page]
        if tile:
            high, wide = -len(image) % tile, -row % tile
            full = np.pad(image, ((0, high), (0, wide)))
            parts = [full[y : y + tile, x : x + tile] for y in range(0, len(full), tile) for x in range(0, full.shape[1], tile)]
        else:
            parts = [image[y : y + strip] for y in range(0, len(image), strip)]
        places, sizes = [], []
        for part in parts:
            part = difference(part[:, :, None]) if predictor == 2 else part
            data = ENCODERS[compression](np.ascontiguousarray(part).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = {WIDTH: (4, [row]), HEIGHT: (4, [len(image)]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, places), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [strip]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            data = struct.pack(order + TYPES[kind] * len(values), *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


# reading


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory, in the order of their chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    place, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while place:
        if place in seen or place + 2 > len(data):
            raise TiffError("the chain of directories is broken")
        seen.add(place)
        (count,) = struct.unpack_from(order + "H", data, place)
        if place + 6 + 12 * count > len(data):
            raise TiffError("a directory is cut off")
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, place + 2 + 12 * i)
            if (letter := TYPES.get(kind)) is None or n == 0:
                continue  # as if it weren't there
            form = order + letter * n if n < 2 else f"{order}{n * len(letter)}{letter[0]}"
            at = place + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (at,) = struct.unpack_from(order + "I", data, at)
            if at + struct.calcsize(form) > len(data):
                raise TiffError("a value lies outside")
            tags[tag] = struct.unpack_from(form, data, at)
        yield order, tags
        (place,) = struct.unpack_from(order + "I", data, place + 2 + 12 * count)


def pages(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(number, width, height, samples: rows x columns x channels) of each page, 8 or 16 bits a sample."""
    for number, (order, tags) in enumerate(directories(data)):

        def one(tag: int, default: int | None = None, tags: dict = tags) -> int | None:
            value = tags.get(tag, (default,))[0]
            if not isinstance(value, int | None):
                raise TiffError("a value that isn't a number")
            return value

        width, height, channels = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor = set(tags.get(BITS, (1,))), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if not width or not height or bits - {8} and bits - {16} or compression not in DECODERS or one(PLANAR, 1) != 1 or not channels or predictor not in (1, 2):
            raise TiffError("a kind of image that isn't supported")
        kind = np.dtype(f"{order}u{max(bits) // 8}")
        tiled = TILE_OFFSETS in tags
        high, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
        if not high or not wide:
            raise TiffError("tiles or strips of no size")
        down, across = -(-height // high), -(-width // wide)
        places, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
        if len(places) < down * across or len(sizes) < down * across:
            raise TiffError("tiles or strips are missing")
        if any(not isinstance(x, int) or x < 0 for x in (*places, *sizes)):
            raise TiffError("a value that isn't a number")
        stored_bytes = [min(n, max(0, len(data) - at)) for at, n in zip(places, sizes, strict=False)][: down * across]
        if (down * high if tiled else height) * across * wide * channels * kind.itemsize > MOST[compression] * (sum(stored_bytes) + 8 * len(stored_bytes)):
            raise TiffError("more samples than the bytes can hold")
        image = np.zeros((down * high, across * wide, channels), kind.newbyteorder("="))
        for k in range(down * across):
            y, x = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            size = rows * wide * channels * kind.itemsize
            raw = DECODERS[compression](data[places[k] : places[k] + sizes[k]], size)
            if len(raw) < size:
                raise TiffError("a tile or strip is cut off")
            part = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(rows, wide, channels)
            image[y : y + rows, x : x + wide] = undo(part, predictor)
        yield number, width, height, image[:height, :width]


PAGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])


def page_rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row a page; the value itself goes with its first page."""
    for batch in it:
        for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = media.as_py()
            own = {"doc_id": doc_id, "n_bytes": n_bytes}
            if media is None:
                continue
            try:
                for page, width, height, samples in pages(media):
                    yield own | {"media": media if page == 0 else None, "page": page, "width": width, "height": height, "samples": samples.tobytes(), "error": None}
            except Exception as e:  # whatever a value holds, it costs a row, not the job
                yield own | {"media": media, "page": None, "width": None, "height": None, "samples": None, "error": str(e) or type(e).__name__}


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, page, width, height, samples, error): one row for each page of each TIFF.

    Null values give no row. A value that can't be read, or not to its end, gives a row with error
    set and no page after the pages before it; so does one whose directories claim more samples than
    its bytes can hold. Null and repeated ids and repeated rows stay as they are. Values are read one at
    a time, whole; other columns aren't read. An empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in page_rows(it):
            yield pa.RecordBatch.from_pylist([row], PAGE_SCHEMA).select(["doc_id", "page", "width", "height", "samples", "error"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), F.col(f"`{media_col}`").alias("media"))
    return rows.mapInArrow(run, "doc_id long, page int, width int, height int, samples binary, error string")


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2, tile: int = 0, page: int = PAGE) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled up with bytes 0, as a TIFF.

    tile: side of the tiles, 0: strips. page: rows of ROW samples of a page; a longer text has several. Null texts
    are stored like empty ones. Null and repeated ids and repeated rows stay rows of their own. Other columns
    aren't read. An empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            media = [encode(t.ljust(max(1, -(-len(t) // ROW)) * ROW, b"\0"), compression, predictor, tile, page=page) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


class Digest:
    """What a query keeps of the pages of one document, page after page."""

    def __init__(self, row: dict):
        self.row, self.sha, self.size, self.tail = row, hashlib.sha256(), 0, b""
        self.pages = self.height = 0
        self.columns = np.zeros(ROW, np.int64)

    def add(self, row: dict) -> None:
        samples = row["samples"]
        self.sha.update(samples)
        self.size += len(samples)
        self.tail = (self.tail + samples)[-64:]
        self.pages, self.height = self.pages + 1, self.height + row["height"]
        self.columns += np.frombuffer(samples, np.uint8).reshape(-1, row["width"]).sum(axis=0, dtype=np.int64)

    def result(self) -> tuple:
        media = self.row["media"]
        rising = np.packbits(self.columns > np.roll(self.columns, -1)).tobytes().hex()
        feature = f"pages={self.pages};rows={self.height};mean={self.columns.sum() / max(1, self.size):.4f};dhash={rising}"
        return self.row["doc_id"], self.row["n_bytes"], self.size, self.sha.hexdigest(), zlib.crc32(self.tail), len(media), hashlib.sha256(media).hexdigest(), feature


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back; feature: pages, rows, mean and a 64-bit difference hash of the columns.

    Texts are stored in tiles, a page for each 64 KiB, with deflate and predictor 2. Null texts count like
    empty ones; rows of null or repeated ids are rows of their own. An empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        now, done = None, []
        for row in page_rows(it):
            if row["error"]:
                raise TiffError(row["error"])
            if row["page"] == 0:
                if now:
                    done.append(now.result())
                if len(done) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
                    done = []
                now = Digest(row)
            now.add(row)
        if now:
            done.append(now.result())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), *(pa.array(x) for x in list(zip(*done, strict=True))[1:])], names=names)

    media = stored(table(spark, sf_dir, "documents"), tile=64, page=1024)
    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
