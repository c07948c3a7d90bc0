"""Derivatives of a surface: slopes, curvatures, gradients, hillshade."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from talusgrid.grid import Grid
from talusgrid.operators.neighbours import EIGHT, shifted

_CROSS = tuple(o for o in EIGHT if o[0] in ("e", "s", "w", "n"))


def _safe(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def slopes(grid: Grid) -> Grid:
    """sx and sy: central differences over 2 dx, the grid's edge repeated outside."""
    z, dx = F.col("value"), 2.0 * grid.geo.dx
    cells = shifted(grid, _CROSS)
    at = {k: F.coalesce(F.col(k), z) for k in "eswn"}
    return Grid(cells.select("row", "col", ((at["e"] - at["w"]) / dx).alias("sx"), ((at["s"] - at["n"]) / dx).alias("sy")), grid.geo)


def max_slope(grid: Grid) -> Grid:
    """Magnitude of the slope."""
    return slopes(grid).map(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))


def hillshade(grid: Grid, azimuth: float, inclination: float) -> Grid:
    """255 (cos Z cos S + sin Z sin S cos(A - aspect)), for light from an azimuth and above the horizon in degrees."""
    az, zenith = math.radians(360.0 - azimuth + 90.0), math.radians(90.0 - inclination)
    slope = F.atan(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))
    aspect = F.atan2("sy", "sx")
    shade = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    return slopes(grid).map(shade * 255.0)


def laplacian(grid: Grid) -> Grid:
    """The five-point Laplacian, the grid's edge repeated outside."""
    z = F.col("value")
    total = sum((F.coalesce(F.col(k), z) for k in "eswn"), F.lit(0.0))
    return Grid(shifted(grid, _CROSS).select("row", "col", ((total - z * 4.0) / F.lit(grid.geo.dx**2)).alias("value")), grid.geo)


#: Finite curvature is the same five-point sum.
finite_curvature = laplacian


def contour_curvature(grid: Grid) -> Grid:
    """Curvature of contour lines; no data on the border, where data is missing and on flat cells."""
    d, z = grid.geo.dx, F.col("value")
    c = {k: F.col(k) for k, _, _ in EIGHT}
    fx, fy = (c["e"] - c["w"]) / (2 * d), (c["s"] - c["n"]) / (2 * d)
    fxx, fyy = (c["e"] - z * 2.0 + c["w"]) / (d * d), (c["s"] - z * 2.0 + c["n"]) / (d * d)
    fxy = (c["se"] - c["ne"] - c["sw"] + c["nw"]) / (4 * d * d)
    p = fx * fx + fy * fy
    return Grid(shifted(grid, EIGHT).select("row", "col", _safe(fxx * fy * fy - fxy * fx * fy * 2.0 + fyy * fx * fx, p * F.sqrt(p + 1.0)).alias("value")), grid.geo)


def _difference(before: Column, here: Column, after: Column, step: float) -> Column:
    """Central where both sides are there, one-sided at an edge."""
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step)).when(after.isNotNull(), (after - here) / step).otherwise((here - before) / step)


def gradient(grid: Grid, band: str = "value", names: tuple[str, str] = ("gx", "gy")) -> Grid:
    """gx along columns and gy along rows, one-sided at the edges."""
    cells = shifted(grid, _CROSS, band, keep=grid.bands)
    z = F.col(band)
    gx, gy = _difference(F.col("w"), z, F.col("e"), grid.geo.dx), _difference(F.col("n"), z, F.col("s"), grid.geo.dx)
    return Grid(cells.select("row", "col", *[b for b in grid.bands if b not in names], gx.alias(names[0]), gy.alias(names[1])), grid.geo)


def gradient_magnitude_direction(gradients: Grid) -> Grid:
    """Magnitude, and direction in degrees from east, of bands gx and gy."""
    return gradients.select(F.hypot("gx", "gy").alias("magnitude"), F.degrees(F.atan2("gy", "gx")).alias("direction"))


def fold_direction(direction: Column, azimuth: float = 0.0, reflect: bool = False) -> Column:
    """Degrees from an azimuth in (-180, 180], or with opposite directions as one in (-90, 90]."""
    turn = 180.0 if reflect else 360.0
    d = F.pmod(direction - azimuth, F.lit(turn))
    return F.when(d > turn / 2, d - turn).otherwise(d)


def principal_curvatures(grid: Grid) -> Grid:
    """k1 >= k2 from mean and Gaussian curvature of the surface, with nested one-step differences."""
    one = gradient(grid, "value", ("zx", "zy"))
    two = gradient(one, "zx", ("zxx", "zxy"))
    two = gradient(two, "zy", ("zyx", "zyy"))
    zx, zy, zxx, zxy, zyy = (F.col(c) for c in ("zx", "zy", "zxx", "zxy", "zyy"))
    p = zx * zx + zy * zy + 1.0
    mean = -((zx * zx + 1.0) * zyy - zx * zy * zxy * 2.0 + (zy * zy + 1.0) * zxx) / (F.pow(p, F.lit(1.5)) * 2.0)
    gauss = (zxx * zyy - zxy * zxy) / (p * p)
    root = F.sqrt(F.greatest(mean * mean - gauss, F.lit(0.0)))
    return two.select((mean + root).alias("k1"), (mean - root).alias("k2"))


def _steps(grid: Grid, length: float) -> int:
    return max(1, math.ceil(length / grid.geo.dx))


def gradient_over(grid: Grid, length: float) -> Grid:
    """gx and gy over N = ceil(length / dx) cells either way: differences over (2 N + 1) dx."""
    n = _steps(grid, length)
    cells = shifted(grid, (("e", 0, n), ("w", 0, -n), ("s", n, 0), ("n", -n, 0)))
    inner = (F.col("row") >= n) & (F.col("row") < grid.geo.ny - n) & (F.col("col") >= n) & (F.col("col") < grid.geo.nx - n)
    width = (2 * n + 1) * grid.geo.dx
    return Grid(cells.select("row", "col", F.when(inner, (F.col("e") - F.col("w")) / width).alias("gx"), F.when(inner, (F.col("s") - F.col("n")) / width).alias("gy")), grid.geo)


def laplacian_over(grid: Grid, length: float) -> Grid:
    """Second differences over N = ceil(length / dx) cells either way, by (2 dx N) squared."""
    n = _steps(grid, length)
    cells = shifted(grid, (("e", 0, n), ("w", 0, -n), ("s", n, 0), ("n", -n, 0)))
    inner = (F.col("row") >= n) & (F.col("row") < grid.geo.ny - n) & (F.col("col") >= n) & (F.col("col") < grid.geo.nx - n)
    total = F.col("e") + F.col("w") + F.col("s") + F.col("n") - F.col("value") * 4.0
    return Grid(cells.select("row", "col", F.when(inner, total / (2.0 * grid.geo.dx * n) ** 2).alias("value")), grid.geo)


def edge_of_data(grid: Grid) -> Grid:
    """1 for cells with data on the grid's border or beside a cell without, else 0 (NULL without data)."""
    geo = grid.geo
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == geo.ny - 1) | (F.col("col") == geo.nx - 1)
    beside = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k, _, _ in EIGHT], F.lit(False))
    return Grid(shifted(grid.dense(), EIGHT).select("row", "col", F.when(F.col("value").isNotNull(), (border | beside).cast("double")).alias("value")), geo)


def plane_fit(grid: Grid) -> "DataFrame":  # noqa: F821
    """Least-squares a and b of z = a x + b y + c over all cells with data, with x, y in map units.

    Two regressions at once by their normal equations, so that gaps in the grid don't bias it.
    """
    rows = grid.cells.where("value is not null").select((F.col("col") * F.lit(grid.geo.dx)).alias("x"), (F.col("row") * F.lit(grid.geo.dx)).alias("y"), F.col("value").alias("z"))
    sums = rows.agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return sums.select(_safe(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det).alias("a"), _safe(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det).alias("b"))


def valid_data(grid: Grid) -> Grid:
    return grid.map(F.when(F.col("value") > 0, 1.0))


def log_area(grid: Grid) -> Grid:
    return grid.map(F.log10(F.when(F.col("value") > 0, F.col("value"))))
