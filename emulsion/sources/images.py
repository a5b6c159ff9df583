"""PNG and plain TIFF files as a data source that reads and writes: one task a file, pixels as rows.

Both formats are read and written from their published layouts with ``zlib`` and ``struct``: PNG of 8 or 16 bits, gray or RGB with
or without alpha, not interlaced; TIFF of one page, uncompressed or deflated strips, 8 or 16 bits, gray or RGB(A). Paths may be
anything that Spark's own file systems open: tasks get bytes through Spark on reading (``read_images``) and write them where
``path`` names a folder that all executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of PNG's colour types: gray, RGB, gray with alpha, RGB with alpha.
PNG_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
PNG_LEVEL = 3
#: TIFF's tags: width, height, bits, compression, kind of colour, strips' places, samples, rows a strip, strips' sizes, planes, predictor.
WIDTH, HEIGHT, BITS, COMPRESSION, COLOUR, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
ROWS = "name string, height int, width int, samples array<int>"
PIXELS = "path string, y int, x int, r double, g double, b double"


class UnreadableImage(ValueError):
    pass


def _unfiltered(data: np.ndarray, height: int, line: int, step: int) -> np.ndarray:
    """PNG's rows without their filters; ``data`` has a filter byte before each ``line`` bytes."""
    rows = data.reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    before = np.zeros(line, np.uint8)
    for y in range(height):
        kind, row = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:  # what stands to the left: running sums of each byte of a pixel
            out[y] = np.add.accumulate(np.pad(row, (0, -line % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:line]
        elif kind == 2:
            out[y] = row + before
        elif kind in (3, 4):
            now, up, given = bytearray(line), before.tolist(), row.tolist()
            for i in range(line):
                a, b = (now[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:  # the neighbour nearest to a + b - c, left before above before corner
                    c = up[i - step] if i >= step else 0
                    guess = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                now[i] = (given[i] + guess) & 255
            out[y] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise UnreadableImage("unknown PNG filter")
        before = out[y]
    return out


def decoded_png(data: bytes) -> np.ndarray:
    """(height, width, samples) of uint8 or uint16."""
    if not data.startswith(PNG_MAGIC):
        raise UnreadableImage("not a PNG")
    at, packed, head = len(PNG_MAGIC), [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size] or b"\0\0\0\0")[0]:
            raise UnreadableImage("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in PNG_SAMPLES or head[6]:
        raise UnreadableImage("a kind of PNG that isn't read here")
    width, height, bits, colour = head[:4]
    samples, wide = PNG_SAMPLES[colour], bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * samples * wide + 1):
        raise UnreadableImage("damaged PNG")
    rows = _unfiltered(raw, height, width * samples * wide, samples * wide)
    return rows.reshape(-1).view(">u2" if wide == 2 else np.uint8).astype(np.uint16 if wide == 2 else np.uint8).reshape(height, width, samples)


def encoded_png(a: np.ndarray) -> bytes:
    """``a`` (height, width, samples) of uint8 or uint16, each row as the difference from the one above."""
    height, width, samples = a.shape
    wide = a.dtype.itemsize
    rows = np.ascontiguousarray(a.astype(">u2" if wide == 2 else np.uint8)).view(np.uint8).reshape(height, -1)
    rows = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8))], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = next(k for k, n in PNG_SAMPLES.items() if n == samples)
    head = struct.pack(">IIBBBBB", width, height, 8 * wide, colour, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), PNG_LEVEL)) + chunk(b"IEND", b"")


def decoded_tiff(data: bytes) -> np.ndarray:
    """The first page as (height, width, samples) of uint8 or uint16."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise UnreadableImage("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    tags: dict[int, tuple] = {}
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in (3, 4):  # other kinds hold nothing that is needed
            continue
        form, size = ("H", 2) if kind == 3 else ("I", 4)
        place = at + 10 + 12 * k
        if count * size > 4:
            (place,) = struct.unpack(order + "I", data[place : place + 4])
        tags[tag] = struct.unpack(f"{order}{count}{form}", data[place : place + count * size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, packing = set(tags.get(BITS, (1,))), one(COMPRESSION, 1)
    if bits not in ({8}, {16}) or packing not in (1, 8, 32946) or one(COLOUR, 1) not in (1, 2) or one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2) or not width * height:
        raise UnreadableImage("a kind of TIFF that isn't read here")
    kind = np.dtype("u1" if bits == {8} else order + "u2")
    per, out = min(one(STRIP_ROWS, height), height), []
    for place, size in zip(tags[STRIPS], tags[STRIP_SIZES], strict=True):
        part = data[place : place + size]
        out.append(part if packing == 1 else zlib.decompress(part))
    whole = b"".join(out)
    if len(whole) != height * width * samples * kind.itemsize or len(out) != -(-height // per):
        raise UnreadableImage("damaged TIFF")
    a = np.frombuffer(whole, kind).reshape(height, width, samples).astype(kind.newbyteorder("="))
    return np.add.accumulate(a, axis=1, dtype=a.dtype) if one(PREDICTOR, 1) == 2 else a


def encoded_tiff(a: np.ndarray, deflate: bool = True, icc: bytes = b"") -> bytes:
    """``a`` (height, width, samples) of uint8 or uint16 as one strip, with a colour profile if there is one."""
    height, width, samples = a.shape
    body = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes()
    body = zlib.compress(body, PNG_LEVEL) if deflate else body
    bits = struct.pack(f"<{samples}H", *[8 * a.dtype.itemsize] * samples)
    strip = 8
    extra = strip + len(body) + len(body) % 2
    entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, samples, extra if samples > 2 else int.from_bytes(bits, "little")), (COMPRESSION, 3, 1, 8 if deflate else 1), (COLOUR, 3, 1, 2 if samples >= 3 else 1), (STRIPS, 4, 1, strip), (SAMPLES, 3, 1, samples), (STRIP_ROWS, 4, 1, height), (STRIP_SIZES, 4, 1, len(body)), (PLANAR, 3, 1, 1)]
    entries += [(338, 3, 1, 2)] if samples in (2, 4) else []
    entries += [(34675, 7, len(icc), extra + len(bits))] if len(icc) > 4 else []
    directory = extra + len(bits) + len(icc) + len(icc) % 2
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", directory) + body + b"\0" * (len(body) % 2) + bits + icc + b"\0" * (len(icc) % 2) + ifd


def decoded(data: bytes) -> np.ndarray:
    return decoded_png(data) if data[:1] == b"\x89" else decoded_tiff(data)


def pixel_rows(paths: pd.Series, contents: pd.Series) -> Iterator[pd.DataFrame]:
    for path, data in zip(paths, contents, strict=True):
        try:
            a = decoded(data)
        except (UnreadableImage, zlib.error, struct.error, KeyError):
            continue
        height, width, samples = a.shape
        v = a / float(np.iinfo(a.dtype).max)
        for y in range(0, height, 256):  # some rows at once
            part = v[y : y + 256].reshape(-1, samples)
            row, x = np.divmod(np.arange(len(part)), width)
            rgb = [part[:, i if samples > 2 else 0] for i in range(3)]
            yield pd.DataFrame({"path": path, "y": (row + y).astype(np.int32), "x": x.astype(np.int32), **dict(zip("rgb", rgb, strict=True))})


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """path, y, x, r, g, b (0 to 1) of the PNG and TIFF files at ``paths`` (folders or patterns); gray is all three, alpha is left out.

    A file that can't be read gives no rows. Files come through Spark, so any store that it reads will do; a task holds one
    file at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).filter(r"lower(path) rlike '\\.(png|tiff?)$'")
    return files.select("path", "content").mapInPandas(lambda batches: (out for b in batches for out in pixel_rows(b["path"], b["content"])), PIXELS)


@dataclass
class Written(WriterCommitMessage):
    """Files written under other names, and what they are to be called; files to delete."""

    made: list[tuple[str, str]]
    gone: list[str]


class _Writer(DataSourceArrowWriter):
    """Each task writes its images beside their places under hidden names; the commit renames them, an abort deletes them."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.bits, self.gray = int(options.get("bits", "8")), options.get("gray", "false").lower() == "true"
        self.job = uuid.uuid4().hex
        if self.bits not in (8, 16):
            raise ValueError("bits must be 8 or 16")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        made: list[tuple[str, str]] = []
        gone: list[str] = []
        for batch in batches:
            for name, height, width, samples in zip(*batch.columns, strict=True):
                place = os.path.join(self.folder, name.as_py())
                h, w, flat = height.as_py() or 0, width.as_py() or 0, samples.values.to_numpy()
                if not h * w or (self.gray and not flat.any()):
                    gone.append(place)
                    continue
                a = flat.astype(np.uint8 if self.bits == 8 else np.uint16).reshape(h, w, 1 if self.gray else 3)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                hidden = os.path.join(os.path.dirname(place), f".{os.path.basename(place)}.{self.job}.{uuid.uuid4().hex}")
                made.append((hidden, place))
                with open(hidden, "wb") as f:
                    f.write(encoded_png(a) if place.lower().endswith(".png") else encoded_tiff(a))
        return Written(made, gone)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, place in m.made if m else ():
                os.replace(hidden, place)
            for place in m.gone if m else ():
                if os.path.exists(place):
                    os.remove(place)
        self._swept()

    def abort(self, messages: list[Written | None]) -> None:
        self._swept()

    def _swept(self) -> None:
        """Without the job's hidden files: also those of tasks that failed or ran twice."""
        for top, _, names in os.walk(self.folder):
            for name in names:
                if f".{self.job}." in name:
                    os.remove(os.path.join(top, name))


class Images(DataSource):
    """``df.write.format("images").option("bits", 16).save(folder)`` of rows (name, height, width, samples).

    samples are the integers of all pixels by row, three a pixel, or one with ``gray``. The name's suffix chooses PNG or TIFF (any
    other is TIFF). A gray image without a set sample, or one without cells, deletes its file.
    """

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _one_row(name: object, samples: np.ndarray) -> pa.Table:
    height, width = samples.shape[:2]
    return pa.table({"name": pa.array([name], pa.string()), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "samples": pa.array([samples.reshape(-1).astype(np.int32)], pa.list_(pa.int32()))})


def image_rows(pixels: DataFrame, *channels: str) -> DataFrame:
    """name, height, width, samples of ``pixels`` (name, y, x and integer ``channels``); cells that aren't there are 0.

    An image is a group; it is made by one task. Rows without a name or a place are left out.
    """

    def filled(key: tuple, batch: pa.Table) -> pa.Table:
        y, x = (batch.column(c).to_numpy() for c in ("y", "x"))
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(channels)), np.int32)
        for k, c in enumerate(channels):
            a[y, x, k] = batch.column(c).to_numpy()
        return _one_row(key[0].as_py(), a)

    placed = pixels.filter("name is not null and y is not null and x is not null").select("name", "y", "x", *channels)
    return placed.groupBy("name").applyInArrow(filled, ROWS)


def write_images(rows: DataFrame, folder: str, bits: int = 8, gray: bool = False) -> None:
    """``rows`` (name, height, width, samples) as files below ``folder``; all of them appear together when the job has ended well."""
    rows.sparkSession.dataSource.register(Images)
    rows.write.format("images").option("bits", str(bits)).option("gray", str(gray)).mode("append").save(folder)


def write_mask_images(masks: DataFrame, names: DataFrame, folder: str) -> None:
    """Masks (mask, y, x: set cells) as gray PNG files 0 or 255, named by ``names`` (mask, height, width); one without cells deletes its file.

    Cells outside the image are left out.
    """

    def filled(key: tuple, batch: pa.Table) -> pa.Table:
        a = np.zeros((key[1].as_py(), key[2].as_py(), 1), np.int32)
        y, x = (batch.column(c).drop_null().to_numpy() for c in ("y", "x"))
        within = (y >= 0) & (y < a.shape[0]) & (x >= 0) & (x < a.shape[1])
        a[y[within], x[within]] = 255
        return _one_row(key[0].as_py() + ".png", a)

    cells = names.select("mask", "height", "width").distinct().join(masks.select("mask", "y", "x"), "mask", "left")
    write_images(cells.groupBy("mask", "height", "width").applyInArrow(filled, ROWS), folder, gray=True)


def read_mask_images(spark: SparkSession, *paths: str) -> DataFrame:
    """mask, y, x: the cells above 0 of gray PNG files; mask is the file's name without its suffix."""
    return read_images(spark, *paths).filter("r > 0").select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("mask"), "y", "x")
