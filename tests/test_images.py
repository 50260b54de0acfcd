import struct
import zlib

import pytest

from kongrid.sources.images import read_images, split_ingest, to_grid, validate_ingest
from kongrid.streaming import streams

KINDS = {1: 0, 3: 2, 4: 6}


def png(rows, channels):
    """A minimal PNG; `rows` are lists of pixel tuples in r, g, b[, a] order."""

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, KINDS[channels], 0, 0, 0)
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("img")
    (d / "rgb.png").write_bytes(png([[(10, 20, 30), (40, 50, 60)], [(0, 0, 0), (255, 255, 255)]], 3))
    (d / "gray.png").write_bytes(png([[(7,), (9,), (200,)]], 1))
    (d / "alpha.png").write_bytes(png([[(100, 150, 200, 128), (1, 2, 3, 0)]], 4))
    (d / "broken.png").write_bytes(b"not an image")
    return str(d)


def test_read_validate_unpack(spark, folder):
    img = validate_ingest(read_images(spark, folder), max_cells=3)
    status = {r["grid_id"].split("/")[-1]: r["status"] for r in img.collect()}
    assert status == {"rgb.png": 413, "gray.png": 200, "alpha.png": 200, "broken.png": 400}
    good, bad = split_ingest(validate_ingest(read_images(spark, folder)))
    assert bad.count() == 1
    cells = {(r["grid_id"].split("/")[-1], r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in to_grid(good).collect()}
    assert len(cells) == 4 + 3 + 2
    assert cells["rgb.png", 0, 1] == (60, 50, 40) and cells["rgb.png", 1, 1] == (255, 255, 255)
    assert cells["gray.png", 0, 2] == (200, 200, 200)
    assert cells["alpha.png", 0, 1] == (24, 24, 24)
    a = 128 / 255
    assert cells["alpha.png", 0, 0] == tuple(int(c * a + 24 * (1 - a)) for c in (200, 150, 100))


def test_oversize_bytes_win(spark, folder):
    r = validate_ingest(read_images(spark, folder), max_bytes=5).select("status").distinct().collect()
    assert [x[0] for x in r] == [413]


def test_image_stream_equals_batch(spark, folder, tmp_path):
    q = streams.ingest_stream(streams.image_arrivals(spark, folder), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"), 10_000, 3)
    q.awaitTermination()
    got = {r["path"].split("/")[-1]: (r["height"], r["width"]) for r in spark.read.parquet(str(tmp_path / "ok")).collect()}
    assert got == {"gray.png": (1, 3), "alpha.png": (1, 2)}
    assert {r["status"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {413, 400}


def test_sizes_from_headers():
    from kongrid.sources.images import image_size

    gif = b"GIF89a" + struct.pack("<HH", 7, 5) + b"\0" * 9
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -4) + b"\0" * 8
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 6
    assert [image_size(x) for x in (gif, bmp, jpeg, png([[(1, 2, 3)] * 3] * 2, 3))] == [(5, 7), (4, 9), (30, 40), (2, 3)]
    assert {image_size(x) for x in (None, b"", b"text", jpeg[:25], b"\xff\xd8", b"BM", gif[:7])} == {(-1, -1)}


def test_files_over_the_size_limit_are_listed_but_not_decoded(spark, folder):
    every = {r["grid_id"]: r for r in read_images(spark, str(folder)).collect()}
    small = sorted(r["length"] for r in every.values())[0]
    got = read_images(spark, str(folder), max_bytes=small).collect()
    assert {r["grid_id"] for r in got} == set(every)
    assert all((r["data"] is None) == (r["length"] > small) for r in got)
