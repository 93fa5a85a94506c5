"""Images against loops over pixels; archives against zipfile, damaged members and failing requests included."""

import math
import random
import struct
import zipfile
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.sources import archive, images


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def plain_hash(rgb: np.ndarray) -> tuple[list[int], str]:
    """Levels and hash by loops: each field's mean weighs every pixel by the area they share."""
    h, w, _ = rgb.shape
    grey = [[(int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 0x8000) >> 16 for r, g, b in row] for row in rgb]
    levels = []
    for y in range(8):
        for x in range(9):
            top, bottom, left, right, total = Fraction(y * h, 8), Fraction((y + 1) * h, 8), Fraction(x * w, 9), Fraction((x + 1) * w, 9), 0
            for j in range(int(top), math.ceil(bottom)):
                for i in range(int(left), math.ceil(right)):
                    total += grey[j][i] * (min(bottom, j + 1) - max(top, j)) * (min(right, i + 1) - max(left, i))
            levels.append(math.floor(total / ((bottom - top) * (right - left)) + Fraction(1, 2)))
    bits = 0
    for y in range(8):
        for x in range(8):
            bits = bits << 1 | (levels[y * 9 + x] > levels[y * 9 + x + 1])
    return levels, f"{bits:016x}"


def test_images(spark, tmp_path):
    draw = np.random.default_rng(3)
    pictures = {f"p{k}.png": draw.integers(0, 256, (h, w, 3), dtype=np.uint8) for k, (h, w) in enumerate([(8, 9), (24, 40), (5, 4), (61, 33)])}
    for name, x in pictures.items():
        (tmp_path / name).write_bytes(png(x))
    (tmp_path / "broken.png").write_bytes(png(pictures["p1.png"])[:60])
    (tmp_path / "empty.png").write_bytes(b"")
    found = {r.file.rsplit("/", 1)[1]: r for r in images.images(spark, str(tmp_path)).collect()}
    assert set(found) == {*pictures, "broken.png"}  # an empty file gives no row
    for name, x in pictures.items():
        levels, h = plain_hash(x)
        r = found[name]
        assert (r.ok, r.width, r.height, r.dhash, r.levels) == (True, x.shape[1], x.shape[0], h, levels)
    assert not found["broken.png"].ok and found["broken.png"].dhash is None
    stated = spark.createDataFrame([("p0.png", 9, 8), ("p1.png", 24, 40), ("p2.png", 1, 1), ("broken.png", 1, 1), ("gone.png", 1, 1), ("empty.png", 1, 1)], "file string, width int, height int")
    named = images.images(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert sorted(map(tuple, images.size_problems(named, stated).collect())) == [("broken.png", "undecodable"), ("empty.png", "missing"), ("gone.png", "missing"), ("p1.png", "swapped"), ("p2.png", "other")]


def test_archive_members(spark, tmp_path):
    draw, path = random.Random(8), tmp_path / "a.zip"
    contents = {f"pics/{k}.jpg": draw.randbytes(draw.randrange(3_000)) * (1 + k % 3) for k in range(40)} | {"pics/empty.jpg": b"", "notes.txt": b"n" * 5_000}
    with zipfile.ZipFile(path, "w") as z:
        for k, (name, x) in enumerate(contents.items()):
            z.writestr(name, x, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.mkdir("pics/folder")
    d = archive.zip_members(spark, f"file://{path}", range_bytes=8_000)
    assert d.rdd.getNumPartitions() > 5
    assert {r.name: (r.size, r.problem, bytes(r.content)) for r in d.collect()} == {n: (len(x), None, x) for n, x in contents.items()}
    some = archive.zip_members(spark, f"file://{path}", prefix="pics/", suffix="7.jpg")
    assert sorted(r.name for r in some.select("name").collect()) == sorted(n for n in contents if n.endswith("7.jpg"))
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
    raw = bytearray(path.read_bytes())
    raw[infos[2].header_offset + 30 + len(infos[2].filename) + 5] ^= 1  # stored: wrong checksum
    raw[infos[5].header_offset] ^= 1  # no header
    packed = infos[7].header_offset + 30 + len(infos[7].filename)
    raw[packed : packed + 4] = b"\xff\xff\xff\xff"  # deflated
    path.write_bytes(raw)
    found = {r.name: r for r in archive.zip_members(spark, f"file://{path}", range_bytes=8_000).collect()}
    bad = {infos[2].filename: "wrong checksum", infos[5].filename: "no local header", infos[7].filename: "cannot be inflated"}
    assert {n: r.problem for n, r in found.items() if r.problem} == bad
    assert all(bytes(found[n].content) == x for n, x in contents.items() if n not in bad)


def test_requests_are_repeated():
    waits, left = [], [3]

    def read(start, stop):
        left[0] -= 1
        if left[0] >= 1:
            raise OSError("lost")
        return b"x" * (stop - start - (left[0] == 0))

    assert archive.fetched("p", 5, 9, read, waits.append) == b"xxxx" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(RuntimeError, match="after 5 attempts"):
        archive.fetched("p", 0, 4, lambda a, b: b"", waits.append)
