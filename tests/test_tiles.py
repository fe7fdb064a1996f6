import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.functions.vectors import cosine, keep_prefix, keep_tiles
from tilewise.operators.tiles import sample_grid, sample_rows, tile_grid, tile_sample
from tilewise.sources.images import mask_prefix, raster_bytes, read_images


def raster(spark, n):
    return spark.createDataFrame([([1.0] * n,)], "v array<float>")


def test_remainder_pixels_are_never_kept(spark):
    df = raster(spark, 13 * 11)
    px = np.array(df.select(keep_prefix("v", F.lit(25), 13, 11)).first()[0]).reshape(11, 13)
    assert px[:10, :10].all() and not px[10:].any() and not px[:, 10:].any()


def test_no_tiles_is_black_and_cosine_0(spark):
    row = raster(spark, 64).select(cosine(keep_prefix("v", F.lit(0)), "v").alias("c"), keep_prefix("v", F.lit(0)).alias("m")).first()
    assert row.c == 0.0 and not any(row.m)


def test_all_tiles_of_a_divisible_grid_are_the_image(spark):
    assert raster(spark, 100).select(cosine(keep_prefix("v", F.lit(25), 10, 10), "v")).first()[0] == pytest.approx(1.0)


def test_more_tiles_than_there_are_raise(spark):
    with pytest.raises(Exception, match="at most 25"):
        raster(spark, 64).select(keep_prefix("v", F.lit(26))).collect()


def test_order_of_a_tile_set_does_not_matter(spark):
    one, two = (F.array(*[F.lit(x) for x in t]) for t in ((7, 0, 24), (24, 7, 0, 7)))
    row = raster(spark, 100).select(keep_tiles("v", one, 10, 10).alias("a"), keep_tiles("v", two, 10, 10).alias("b")).first()
    assert row.a == row.b and sum(row.a) == 12


def test_sample_is_distinct_and_repeatable(spark):
    a, b = (tile_sample(spark, (5, 25), 3).orderBy("k", "trial", "idx").collect() for _ in range(2))
    assert a == b
    five = [r.idx for r in a if r.k == 5 and r.trial == 1]
    assert len(set(five)) == 5 and set(five) <= set(range(25))
    assert sorted(r.idx for r in a if r.k == 25 and r.trial == 0) == list(range(25))


def test_boxes(spark):
    rows = tile_grid(spark.createDataFrame([(1, 13, 11)], "image_id int, width int, height int")).orderBy("idx").collect()
    assert len(rows) == 25 and tuple(rows[7])[1:] == (7, 1, 2, 4, 2, 6, 4)


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("k", [0, 1, 7, 25])
def test_image_file_masked_on_bytes(spark, tmp_path, k):
    px = np.random.default_rng(0).integers(1, 255, (11, 13, 3), dtype=np.uint8)
    png(tmp_path / "a.png", px)
    got = read_images(spark, str(tmp_path)).select(mask_prefix("image.data", "image.width", "image.height", F.lit(k))).first()[0]
    want = np.zeros_like(px)
    for i in range(k):
        r, c = divmod(i, 5)
        want[r * 2 : r * 2 + 2, c * 2 : c * 2 + 2] = px[r * 2 : r * 2 + 2, c * 2 : c * 2 + 2]
    assert bytes(got) == want[:, :, ::-1].tobytes()


def test_raster_bytes(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 1.0, 9.0],)], "v array<float>")
    assert bytes(df.select(raster_bytes("v")).first()[0]) == bytes([0] * 3 + [127] * 3 + [255] * 6)


def test_tiles_are_sampled_within_rows(spark):
    """As by ranks over all tiles, for images that are there several times too, but no task sorts rows."""
    images = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,), (4,), (None,), (None,)] + [(5,)] * 7, "image_id long")
    every = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("idx"))
    for k in (1, 5, 25, 60):
        want = sample_rows(every, ["image_id"], k, F.concat_ws("-", "image_id", "idx"))
        assert sorted(map(str, sample_grid(images, k).collect())) == sorted(map(str, want.collect())), k
    plan = sample_grid(images, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan
