"""Vector expressions: masks, norms, cosine. All are built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The product of norms is raised to this, so a zero vector has cosine 0.
EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision. Arrays of unequal length give null."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in one pass over both arrays; 0 if either is all zeros."""
    start = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    step = lambda s, p: F.struct((s.ab + p.x * p.y).alias("ab"), (s.aa + p.x * p.x).alias("aa"), (s.bb + p.y * p.y).alias("bb"))
    return F.aggregate(pairs, start, step, lambda s: s.ab / F.greatest(F.sqrt(s.aa) * F.sqrt(s.bb), F.lit(EPS)))



def keep_prefix(vec: Column | str, k: Column | str, width: int = 8, height: int = 8, rows: int = 5, cols: int = 5) -> Column:
    """The raster with only its first k tiles; all else 0. A k above rows * cols raises."""
    k, n = _c(k), rows * cols
    k = F.when(k <= n, k).otherwise(F.raise_error(F.lit(f"k must be at most {n}")).cast("int"))
    tile = _tiles(width, height, rows, cols)
    return F.zip_with(_c(vec), tile, lambda x, t: F.when((t >= 0) & (t < k), x).otherwise(F.lit(0).cast("float")))


def tile_mask(tiles: Column | str, width: int = 8, height: int = 8, rows: int = 5, cols: int = 5) -> Column:
    """Whether each pixel is in one of a list of tiles, whose order and repeats don't matter."""
    return F.transform(_tiles(width, height, rows, cols), lambda t: F.array_contains(_c(tiles), t))


def keep(vec: Column | str, mask: Column | str) -> Column:
    """The raster with only the pixels of a mask."""
    return F.zip_with(_c(vec), _c(mask), lambda x, m: F.when(m, x).otherwise(F.lit(0).cast("float")))


def keep_tiles(vec: Column | str, tiles: Column | str, width: int = 8, height: int = 8, rows: int = 5, cols: int = 5) -> Column:
    """The raster with only the tiles in a list. Where lists repeat from row to row, make their ``tile_mask`` once and ``keep`` it."""
    return keep(vec, tile_mask(tiles, width, height, rows, cols))


def tile_sums(vec: Column | str, f, width: int = 8, height: int = 8, rows: int = 5, cols: int = 5) -> Column:
    """The sum of f over the pixels of each tile, as an array by tile."""
    tw, th = width // cols, height // rows
    pixels = [[(r * th + y) * width + c * tw + x for y in range(th) for x in range(tw)] for r in range(rows) for c in range(cols)]
    each = lambda i: f(F.get(_c(vec), F.lit(i)).cast("double"))
    return F.array(*[sum((each(i) for i in some[1:]), each(some[0])) if some else F.lit(0.0) for some in pixels])


def _tiles(width: int, height: int, rows: int, cols: int) -> Column:
    """Each pixel's tile, as a constant."""
    tw, th = width // cols, height // rows
    at = [(i // width // th) * cols + (i % width) // tw if i % width < tw * cols and i // width < th * rows else -1 for i in range(width * height)]
    return F.array(*[F.lit(t) for t in at])


def every_other(vec: Column | str, odd: bool) -> Column:
    """Elements at even (or odd) places, counted from 0."""
    return F.filter(_c(vec), lambda x, i: i % 2 == int(odd))
