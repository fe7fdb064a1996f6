"""Images as rows: files, rasters from vectors, and tile masks on their bytes.

The image struct is the one of Spark's image source: origin, height, width, nChannels, mode, data; data is row-major,
three bytes a pixel in the order blue, green, red.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.sources import files


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """(image) of the files below a path, decoded by Spark's image source."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path)


def png(data: bytes, width: int, height: int) -> bytes:
    """Blue-green-red bytes, row by row, as a PNG file of 8 bits a colour."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, 3)[:, :, ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_images(df: DataFrame, folder: str, id_col: str = "image_id", data: str = "data", width: str = "width", height: str = "height") -> DataFrame:
    """(name, bytes) of a PNG file ``<id>.png`` for each row, written below a shared folder. Rows without id or data have none.

    Files appear whole; a task that runs again writes the same ones. The result is a plan: files are there once it has run.
    """
    files.make(folder)

    def run(batches):
        for b in batches:
            names, sizes = [], []
            for image, raw, w, h in zip(*(c.to_pylist() for c in b.columns)):
                blob = png(raw, w, h)
                files.put(folder, f"{image}.png", blob)
                names.append(f"{image}.png")
                sizes.append(len(blob))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(data).isNotNull())
    return rows.select(F.col(id_col).cast("string"), data, F.col(width).cast("int"), F.col(height).cast("int")).mapInArrow(run, "name string, bytes bigint")


def grey(data: Column | str) -> Column:
    """The first byte of each pixel as numbers from 0 to 255."""
    c = F.col(data) if isinstance(data, str) else data
    pixels = F.sequence(F.lit(0), (F.octet_length(c) / 3).cast("int") - 1)
    return F.transform(pixels, lambda i: F.conv(F.hex(F.substring(c, i * 3 + 1, F.lit(1))), 16, 10).cast("double"))


def raster_bytes(vec: str) -> Column:
    """Blue-green-red bytes of a vector of numbers from -1 to 1, a grey pixel an element."""
    level = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    pixel = lambda x: F.repeat(F.lpad(F.hex(level(x)), 2, "0"), 3)
    return F.unhex(F.array_join(F.transform(vec, pixel), ""))


def mask_prefix(data: Column | str, width: Column | str, height: Column | str, k: Column | str, rows: int = 5, cols: int = 5) -> Column:
    """data with only the first k tiles of the rows x cols grid; the rest, and what integer tile sizes leave over, black.

    A line of a tile is a run of bytes, so lines are cut with substring and joined; no pixel is touched by itself.
    """
    data, width, height, k = (F.col(x) if isinstance(x, str) else x for x in (data, width, height, k))
    n = rows * cols
    k = F.when((k <= n) & (k >= 0), k).otherwise(F.raise_error(F.lit(f"k must be from 0 to {n}")).cast("int"))
    tw, th = F.floor(width / cols).cast("int"), F.floor(height / rows).cast("int")
    black = lambda pixels: F.unhex(F.repeat(F.lit("000000"), pixels.cast("int")))

    def line(y):
        r = F.when((th > 0) & (y < th * rows), F.floor(y / th).cast("int")).otherwise(F.lit(rows))
        kept = F.greatest(F.lit(0), F.least(F.lit(cols), k - r * cols)) * tw  # pixels from the left
        kept = F.when(r < rows, kept).otherwise(F.lit(0)).cast("int")
        return F.concat(F.substring(data, y * width * 3 + 1, kept * 3), black(width - kept))

    lines = F.transform(F.sequence(F.lit(0), height - 1), line)
    return F.aggregate(lines, F.lit(b""), lambda a, x: F.concat(a, x))
