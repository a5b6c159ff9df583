"""PNG and TIFF: round trips, files written by hand, all of a job or nothing of it."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from emulsion.sources import images
from pyspark.sql import functions as F


def pictures():
    rng = np.random.default_rng(6)
    for kind in (np.uint8, np.uint16):
        top = np.iinfo(kind).max
        for samples in (1, 2, 3, 4):
            for h, w in ((1, 1), (7, 5), (40, 33)):
                yield rng.integers(0, top + 1, (h, w, samples)).astype(kind)
        yield (np.add.outer(np.arange(50), np.arange(60))[:, :, None] * (top // 200) * np.ones(3, int)).astype(kind)


def test_round_trips():
    for a in pictures():
        assert (images.decoded(images.encoded_png(a)) == a).all()
        for deflate in (True, False):
            got = images.decoded(images.encoded_tiff(a, deflate, b"x" * 129))
            assert got.dtype == a.dtype and (got == a).all()


def test_all_filters_of_png():
    """Rows filtered one by one as the format has them."""
    rng = np.random.default_rng(1)
    for step, wide in ((1, np.uint8), (3, np.uint8), (6, np.uint16)):
        height, width = 30, 11
        line = width * step
        raw = rng.integers(0, 256, (height, line)).astype(int)
        out = bytearray()
        for y in range(height):
            kind = y % 5
            out.append(kind)
            for i in range(line):
                a = raw[y, i - step] if i >= step else 0
                b = raw[y - 1, i] if y else 0
                c = raw[y - 1, i - step] if y and i >= step else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append(int(raw[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        got = images._unfiltered(np.frombuffer(bytes(out), np.uint8), height, line, step)
        assert (got == raw).all()


def test_tiff_of_other_makes():
    """Big-endian, several strips, differences along the row."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 65536, (9, 6, 3)).astype(np.uint16)
    diff = np.diff(a.astype(np.int64), axis=1, prepend=0).astype(np.uint16)
    strips = [zlib.compress(diff[y : y + 4].astype(">u2").tobytes()) for y in (0, 4, 8)]
    places = [8 + sum(map(len, strips[:k])) for k in range(3)]
    tail = 8 + sum(map(len, strips))
    long = struct.pack(">3H3I3I", 16, 16, 16, *places, *map(len, strips))
    entries = [(256, 3, 1, 6 << 16), (257, 3, 1, 9 << 16), (258, 3, 3, tail), (259, 3, 1, 8 << 16), (262, 3, 1, 2 << 16), (273, 4, 3, tail + 6), (277, 3, 1, 3 << 16), (278, 3, 1, 4 << 16), (279, 4, 3, tail + 18), (305, 2, 4, 0), (317, 3, 1, 2 << 16)]
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0" * 4
    data = b"MM\0*" + struct.pack(">I", tail + len(long)) + b"".join(strips) + long + ifd
    assert (images.decoded(data) == a).all()


@pytest.mark.parametrize("data", [b"", b"GIF89a", images.PNG_MAGIC, b"II*\0\x08\0\0\0", images.encoded_png(np.zeros((2, 2, 1), np.uint8))[:-20], images.encoded_tiff(np.zeros((2, 2, 3), np.uint8))[:30]])
def test_what_cannot_be_read(spark, tmp_path, data):
    (tmp_path / "bad.png").write_bytes(data)
    (tmp_path / "good.tif").write_bytes(images.encoded_tiff(np.full((1, 2, 1), 255, np.uint8)))
    assert {os.path.basename(r["path"]) for r in images.read_images(spark, str(tmp_path)).collect()} == {"good.tif"}


@pytest.mark.parametrize("bits", [8, 16])
def test_pixels_out_and_in(spark, tmp_path, bits):
    top = 2**bits - 1
    rng = np.random.default_rng(bits)
    want = {f"roll{k % 2}/f{k}.{'png' if k < 3 else 'tif'}": rng.integers(0, top + 1, (300 if k == 0 else 5 + k, 4, 3)) for k in range(5)}
    rows = [(n, int(y), int(x), *map(int, a[y, x])) for n, a in want.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "name string, y int, x int, r int, g int, b int").repartition(3)
    images.write_images(images.image_rows(df, "r", "g", "b"), str(tmp_path), bits)
    got = images.read_images(spark, str(tmp_path))
    seen = {(os.sep.join(r["path"].split("/")[-2:]), r["y"], r["x"]): tuple(round(r[c] * top) for c in "rgb") for r in got.collect()}
    assert seen == {(n, y, x): (r, g, b) for n, y, x, r, g, b in rows}
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith(".")]


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    good = [(f"a{i}.png", 2, 2, [1] * 12) for i in range(6)]
    df = spark.createDataFrame([*good, ("bad.png", 2, 2, [1] * 5)], "name string, height int, width int, samples array<int>").repartition(4)
    (tmp_path / "a0.png").write_bytes(b"old")
    with pytest.raises(Exception):  # noqa: B017
        images.write_images(df, str(tmp_path))
    assert os.listdir(tmp_path) == ["a0.png"] and (tmp_path / "a0.png").read_bytes() == b"old"
    images.write_images(df.filter("name != 'bad.png'"), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [n for n, *_ in good]


def test_masks_as_files(spark, tmp_path):
    names = spark.createDataFrame([("x_dust_add", 4, 6), ("y_dust_add", 3, 3), ("z_dust_add", 2, 2)], "mask string, height int, width int")
    cells = spark.createDataFrame([("x_dust_add", 1, 5), ("x_dust_add", 3, 0), ("y_dust_add", 0, 0), ("y_dust_add", 9, 9)], "mask string, y int, x int")
    images.write_mask_images(cells, names, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["x_dust_add.png", "y_dust_add.png"]
    got = {tuple(r) for r in images.read_mask_images(spark, str(tmp_path)).collect()}
    assert got == {("x_dust_add", 1, 5), ("x_dust_add", 3, 0), ("y_dust_add", 0, 0)}
    raw = images.decoded((tmp_path / "x_dust_add.png").read_bytes())
    assert raw.shape == (4, 6, 1) and set(raw.ravel().tolist()) == {0, 255}
    images.write_mask_images(cells.filter("mask != 'x_dust_add'"), names, str(tmp_path))  # an empty mask deletes its file
    assert os.listdir(tmp_path) == ["y_dust_add.png"]


def test_encoded_exports(spark, tmp_path):
    """Linear pixels, encoded as exports are, read back the same."""
    from emulsion.sources.rasters import export_rows

    df = spark.range(64).select(F.lit("f.tif").alias("name"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), *((F.col("id") / 63.0 * k).alias(c) for c, k in zip("rgb", (1.0, 0.5, 1.5), strict=True)))
    out = export_rows(df, 65535).withColumns({c: F.col(c).cast("int") for c in "rgb"})
    images.write_images(images.image_rows(out, "r", "g", "b"), str(tmp_path), 16)
    want = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in out.collect()}
    assert {(r["y"], r["x"]): tuple(round(r[c] * 65535) for c in "rgb") for r in images.read_images(spark, str(tmp_path)).collect()} == want
