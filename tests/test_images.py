"""Pictures through Spark's own decoder."""

import struct
import zlib

import numpy as np

from selenite.sources import images, raster

R = np.random.default_rng(7)


def rgba_png(a):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + r.tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_containers(spark, tmp_path):
    gray, rgb, rgba = (R.integers(0, 256, (5, 7, n), np.uint8) for n in (1, 3, 4))
    rgba[2, 3, 3] = rgba[0, 0, 3] = 0
    blocks = R.integers(0, 256, (3, 4), np.uint8)
    blocks[0, :2] = 0, 255  # the largest difference
    for name, b in (("g.png", raster.png_bytes(gray[..., 0])), ("c.bmp", images.bmp_bytes(rgb)), ("a.png", rgba_png(rgba)), ("j.jpg", images.jpeg_blocks(blocks)), ("w.webp", b"RIFF0000WEBP"), ("h.png", raster.png_bytes(gray[..., 0])[:40])):
        (tmp_path / name).write_bytes(b)
    name = lambda r: r.path.rpartition("/")[2]
    head = {name(r): (r.width, r.height, r.bands, r.violations) for r in images.headers(spark, f"file://{tmp_path}").collect()}
    assert head == {"g.png": (7, 5, 1, []), "c.bmp": (7, 5, 3, []), "a.png": (7, 5, 4, []), "j.jpg": (32, 24, 1, []), **{n: (None, None, None, ["unreadable"]) for n in ("w.webp", "h.png")}}
    got = {}
    for r in images.samples(spark, f"file://{tmp_path}").collect():
        got.setdefault(name(r), {})[r.y, r.x] = (r.dn, r.valid)
    assert set(got) == {"g.png", "c.bmp", "a.png", "j.jpg"}
    for n, a, ok in (("g.png", gray[..., 0], None), ("c.bmp", rgb.mean(2), None), ("a.png", rgba[..., :3].mean(2), rgba[..., 3] > 0), ("j.jpg", np.kron(blocks, np.ones((8, 8))), None)):
        assert len(got[n]) == a.size
        for (y, x), (v, valid) in got[n].items():
            assert abs(v - a[y, x]) < 1e-9 and valid == (ok is None or ok[y, x])
