import struct
import zlib

import numpy as np

from quire.operators import align
from quire.sources import images


def png(path, pixels):
    """Write an array (height, width, 3) or (height, width)."""
    h, w = pixels.shape[:2]
    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def slow(pixels, width, height):
    """The mean of what each cell covers, by repeating every pixel until the sides divide."""
    h, w = pixels.shape[:2]
    big = np.repeat(np.repeat(pixels.astype(float), height, 0), width, 1)
    return np.floor(big.reshape(height, h, width, w, -1).mean((1, 3)) + 0.5).astype(int)


def thumb(spark, path, width, height):
    out = np.full((height, width, 3), -1)
    for r in images.thumbnails(spark, path, width, height).collect():
        out[r.y, r.x] = r.r, r.g, r.b
    return out


def test_scaling_equals_the_mean_of_areas(spark, tmp_path):
    rng = np.random.default_rng(1)
    for w, h in ((7, 11), (40, 30), (3, 2)):
        a = rng.integers(0, 256, (h, w, 3))
        png(tmp_path / "a.png", a)
        assert (thumb(spark, f"{tmp_path}/a.png", 5, 8) == slow(a, 5, 8)).all()
    grey = rng.integers(0, 256, (9, 9))
    png(tmp_path / "g.png", grey)
    assert (thumb(spark, f"{tmp_path}/g.png", 4, 4) == slow(grey, 4, 4)).all()
    (tmp_path / "no.png").write_bytes(b"no picture")
    assert images.thumbnails(spark, f"{tmp_path}/no.png").count() == 0


def test_generated_covers_are_told_from_scans(spark, tmp_path):
    rng = np.random.default_rng(2)
    flat = np.full((300, 200, 3), (30, 60, 90))
    flat[:70] = 255
    off_white = flat.copy()
    off_white[:70] = 235  # paper is not white
    scan = rng.integers(0, 230, (300, 200, 3))
    band = scan.copy()
    band[:70] = 255  # a white band over a photograph; scaling levels its noise, so it has colours of many levels
    band[70:] = (np.arange(230)[:, None, None] * np.array([1, 0, 0]) + np.arange(200)[None, :, None] * np.array([0, 1, 1])).astype(int)
    for gid, a in ((1, flat), (2, off_white), (3, scan), (4, band)):
        png(tmp_path / f"pg{gid}.cover.medium.png", a)
    png(tmp_path / "other.png", flat)
    jvm = spark._jvm
    read, file = jvm.javax.imageio.ImageIO.read, jvm.java.io.File
    assert jvm.javax.imageio.ImageIO.write(read(file(f"{tmp_path}/pg1.cover.medium.png")), "jpg", file(f"{tmp_path}/pg5.cover.medium.jpg"))
    pixels = images.covers(spark, f"{tmp_path}/*")
    assert "Python" not in pixels._jdf.queryExecution().executedPlan().toString()
    got = {r.gid: (r.generated, r.buckets) for r in align.generated_cover(pixels).collect()}
    assert {g: x for g, (x, _) in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True} and got[1][1] == 2
