import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import array, disc

from talusgrid.errors import InputError
from talusgrid.grid import Georef, Grid, cells_of, points_of
from talusgrid.operators import morphology, neighbours, search, stencil, tiling, windows

RNG = np.random.default_rng(5)
Z = RNG.integers(0, 100, (9, 12)).astype(float)


@pytest.fixture(scope="module")
def grid(spark):
    return Grid.of_array(spark, Z, dx=2.0, xll=10.0, yll=20.0)


def test_points_go_to_cells_and_back(spark, grid):
    pts = [grid.geo.point(r, c) for r in range(9) for c in range(12)]
    rows = grid.rowcols(points_of(spark, pts)).orderBy("point").collect()
    assert [(r.row, r.col) for r in rows] == [(r, c) for r in range(9) for c in range(12)]
    outside = grid.rowcols(points_of(spark, [(-50.0, 0.0), (10.0 + 12 * 2.0, 20.0)])).collect()
    assert all(r.row is None and r.col is None for r in outside)
    assert grid.geo.cell(13.0, 20.0) == (8, 2) and grid.geo.cell(11.0, 20.0) == (8, 0)  # halves to even


def test_georeference_of_a_transform():
    g = Georef.from_geotransform(4, 3, (100.0, 10.0, 0, 500.0, 0, -10.0))
    assert (g.xll, g.yll) == (105.0, 475.0) and g.geotransform == (100.0, 10.0, 0.0, 500.0, 0.0, -10.0)
    assert Georef(10, 10, 0.1, 11.0, 47.0).utm_zone() == 32 and Georef(10, 10, 0.1, 11.0, -47.0).utm_zone() == -32


def test_geographic_area_of_a_pixel(spark):
    g = Georef(3, 3, 1.0, 0.0, 44.0, geographic=True)
    got = [r.a for r in spark.range(3).select(g.area("id").alias("a")).collect()]
    want = [6371000.0**2 * math.radians(1) * (math.sin(math.radians(46.5 - k)) - math.sin(math.radians(45.5 - k))) for k in range(3)]
    assert np.allclose(got, want)


def test_put_and_at(spark, grid):
    out = grid.put(cells_of(spark, [(0, 0), (3, 4), (99, 99)]), constant=-1.0)
    a = array(out)
    assert a[0, 0] == a[3, 4] == -1 and (a != Z).sum() == 2
    assert grid.at(-1, 0).count() == 0 and grid.at(2, 3).first().value == Z[2, 3]


@pytest.mark.parametrize("wrap", [False, True])
def test_kernel_statistics_by_tile_are_those_of_the_single_values(spark, wrap):
    z = np.random.default_rng(3).integers(-50, 50, (5, 270)).astype(float)
    z[np.random.default_rng(4).random(z.shape) < 0.4] = np.nan  # gaps, and more than one tile
    g = Grid.of_array(spark, z)
    kernel = [(i, j, 1.0) for i in (-2, 0, 1) for j in range(-7, 4 + i)] + [(0, 9, 2.5), (0, 10, 2.5), (0, 0, 1.0), (3, -6, -1.0)]
    got = neighbours.kernel_stats(g, kernel, ["sum", "min", "max"], wrap)
    want = neighbours.under_kernel(g, kernel, [F.count("*").alias("n"), F.sum(F.col("v") * F.col("k")).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")], wrap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert neighbours.kernel_stats(Grid(g.cells.where("false"), g.geo), kernel, ["sum"], wrap).count() == 0


def padded(z):
    return np.pad(z, 1, mode="edge")


def test_slopes_laplacian_and_hillshade(grid):
    p = padded(Z)
    sx, sy = (p[1:-1, 2:] - p[1:-1, :-2]) / 4, (p[2:, 1:-1] - p[:-2, 1:-1]) / 4
    assert np.allclose(array(stencil.max_slope(grid)), np.hypot(sx, sy))
    lap = (p[1:-1, 2:] + p[1:-1, :-2] + p[2:, 1:-1] + p[:-2, 1:-1] - 4 * Z) / 4
    assert np.allclose(array(stencil.laplacian(grid)), lap)
    s, aspect, az, zen = np.arctan(np.hypot(sx, sy)), np.arctan2(sy, sx), math.radians(135), math.radians(60)
    want = 255 * (math.cos(zen) * np.cos(s) + math.sin(zen) * np.sin(s) * np.cos(az - aspect))
    assert np.allclose(array(stencil.hillshade(grid, 315.0, 30.0)), want)


def test_gradients_and_curvatures(grid):
    gy, gx = np.gradient(Z, 2.0)
    got = stencil.gradient(grid)
    assert np.allclose(array(got, "gx"), gx) and np.allclose(array(got, "gy"), gy)
    zxy, zxx = np.gradient(gx, 2.0)
    zyy, _ = np.gradient(gy, 2.0)
    p = 1 + gx**2 + gy**2
    h = -((gx**2 + 1) * zyy - 2 * gx * gy * zxy + (gy**2 + 1) * zxx) / (2 * p**1.5)
    k = (zxx * zyy - zxy**2) / p**2
    root = np.sqrt(np.maximum(h * h - k, 0))
    got = stencil.principal_curvatures(grid)
    assert np.allclose(array(got, "k1"), h + root) and np.allclose(array(got, "k2"), h - root)
    cont = array(stencil.contour_curvature(grid))
    assert np.isnan(cont[0]).all() and np.isnan(cont[:, -1]).all() and np.isfinite(cont[1:-1, 1:-1]).sum() > 50


def test_gaps_are_seen_by_stencils(spark):
    z = Z.copy()
    z[4, 5] = np.nan
    dense = Grid.of_array(spark, z)
    sparse = Grid(dense.cells.where("value is not null"), dense.geo)
    for f in (stencil.laplacian, stencil.contour_curvature, stencil.gradient):
        a, b = f(dense), f(sparse)
        for band in a.bands:
            x, y = array(a, band), array(b, band)
            x[4, 5] = y[4, 5] = 0
            assert np.allclose(x, y, equal_nan=True), f
    edge = array(stencil.edge_of_data(dense))
    assert np.isnan(edge[4, 5]) and edge[3, 4] == edge[5, 6] == 1 and edge[2, 2] == 0 and edge[0].all()


def test_scaled_differences(grid):
    got = array(stencil.gradient_over(grid, 3.0), "gx")
    assert np.allclose(got[2:-2, 2:-2], (Z[2:-2, 4:] - Z[2:-2, :-4]) / 10) and np.isnan(got[:2]).all()
    lap = array(stencil.laplacian_over(grid, 3.0))
    want = (Z[2:-2, 4:] + Z[2:-2, :-4] + Z[4:, 2:-2] + Z[:-4, 2:-2] - 4 * Z[2:-2, 2:-2]) / 64
    assert np.allclose(lap[2:-2, 2:-2], want)


def test_plane_fit_of_a_plane(spark):
    g = Grid.of_array(spark, [[3 * j + 7 * i + 1 for j in range(6)] for i in range(5)], dx=2.0)
    r = stencil.plane_fit(g).first()
    assert math.isclose(r.a, 1.5) and math.isclose(r.b, 3.5)


def test_windows(grid):
    ny, nx = Z.shape
    got = array(windows.moving_window(grid, windows.disc(4.0, 2.0), "max"))
    want = np.array([[max(Z[i + a, j + b] for a, b in disc(2.0) if 0 <= i + a < ny and 0 <= j + b < nx) for j in range(nx)] for i in range(ny)])
    assert np.array_equal(got, want)
    mean = array(windows.rectangular_mean(grid, 2.0))
    assert np.allclose(mean, [[Z[max(i - 1, 0) : i + 2, max(j - 1, 0) : j + 2].mean() for j in range(nx)] for i in range(ny)])
    median = array(windows.moving_window(grid, windows.rectangle(2.0, 2.0), lambda v: v.median()))
    assert np.allclose(median, [[np.median(Z[max(i - 1, 0) : i + 2, max(j - 1, 0) : j + 2]) for j in range(nx)] for i in range(ny)])


def test_disc_mean_is_a_circular_convolution(spark):
    for shape in ((8, 10), (7, 9)):
        z = RNG.random(shape)
        ny, nx = shape
        y, x = np.mgrid[0:ny, 0:nx]
        t = (np.hypot(x - nx / 2, y - ny / 2) <= 2.0).astype(float)
        t /= t.sum()
        want = np.real(np.fft.ifftshift(np.fft.ifft2(np.fft.fft2(z) * np.fft.fft2(t))))
        assert np.allclose(array(windows.disc_mean(Grid.of_array(spark, z), 2.0)), want), shape


def test_local_relief_mirrors_the_edge(grid):
    r = 2
    p = np.pad(Z, r, mode="symmetric")
    offs = [(i, j) for i in range(-r, r) for j in range(-r, r) if i * i + j * j <= r * r]
    want = [[max(p[i + r + a, j + r + b] for a, b in offs) - min(p[i + r + a, j + r + b] for a, b in offs) for j in range(12)] for i in range(9)]
    assert np.array_equal(array(windows.local_relief(grid, r)), want)


def test_quadrats_and_histogram(spark, grid):
    got = {(r.qrow, r.qcol): r.m for r in windows.map_quadrats(grid, 5, 4, m=F.sum("value")).collect()}
    assert got == {(i, j): Z[i : i + 4, j : j + 5].sum() for i in (0, 4) for j in (0, 5)}
    py = {(r.qrow, r.qcol): r.value for r in windows.map_quadrats_python(grid, lambda c: c["value"].sum(), 5, 4).collect()}
    assert py == got
    xs, ys = [0.0, 1.0, 2.0, 3.0, 3.0], [0.0, 0.5, 1.0, 2.0, 2.1]
    pairs = spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")
    h = windows.histogram_2d(pairs, [0, 1, 3], [0, 1, 2])
    want = np.histogram2d(xs, ys, bins=[[0, 1, 3], [0, 1, 2]])[0]
    assert {(r.bx, r.by): r.n for r in h.collect()} == {(i, j): int(want[i, j]) for i in range(2) for j in range(2)}


def test_morphology(spark):
    m = (RNG.random((9, 11)) > 0.6).astype(float)
    g = Grid.of_array(spark, m)
    p = np.pad(m, 1)
    near = [p[1:-1, 2:], p[1:-1, :-2], p[2:, 1:-1], p[:-2, 1:-1]]
    assert np.array_equal(array(morphology.dilate(g)), np.maximum.reduce([m, *near]))
    assert np.array_equal(array(morphology.erode(g)), np.minimum.reduce([m, *near]))
    opened, closed = array(morphology.opened(g)), array(morphology.closed(g))
    assert (opened <= m).all() and (closed[1:-1, 1:-1] >= m[1:-1, 1:-1]).all()


def test_tiles_strip_and_mosaic(spark, grid):
    parts = tiling.tiles(grid, 5, 4, 2, 3)
    one = array(tiling.one_tile(parts, grid.geo, 1, 1, 5, 4, 2, 3))
    p = np.pad(Z, ((3, 3), (2, 2)), mode="symmetric")
    assert np.array_equal(one, p[4 : 4 + 10, 5 : 5 + 9])
    assert np.array_equal(array(tiling.merge_tiles(parts, grid.geo, 5, 4, 2, 3)), Z)
    stripped = [tiling.remove_padding(tiling.one_tile(parts, grid.geo, i, j, 5, 4, 2, 3), 2, 3) for i in range(3) for j in range(3)]
    assert np.array_equal(array(tiling.mosaic(stripped)), Z)
    part = tiling.window(grid, 2, 3, 3, 3).map(F.lit(None).cast("double"))
    holes = array(tiling.mosaic([grid, part]))
    assert np.isnan(holes[2:5, 3:6]).all() and np.isnan(holes).sum() == 9


def test_clip_and_errors(grid):
    got = tiling.clip_to_extent(grid, (12.0, 28.0, 22.0, 32.0))
    assert array(got).shape == (3, 6) and np.array_equal(array(got), Z[4:7, 2:8])
    assert got.geo.point(0, 0) == grid.geo.point(4, 2)
    with pytest.raises(InputError):
        tiling.clip_to_extent(grid, (-100.0, 28.0, 22.0, 32.0))


def test_resampling_keeps_polynomials(spark):
    f = lambda x, y: 2 + 0.3 * x - 0.5 * y + 0.01 * x**3 + 0.02 * y**2 * x
    geo = Georef(12, 10, 2.0)
    z = [[f(*geo.point(i, j)) for j in range(12)] for i in range(10)]
    g = Grid.of_array(spark, z, dx=2.0)
    for how in ("cubic", "quintic"):
        got = tiling.resample(g, 1.6, how)
        a = array(got)
        want = np.array([[f(*got.geo.point(i, j)) for j in range(got.geo.nx)] for i in range(got.geo.ny)])
        inside = np.array([[got.geo.point(i, j)[0] <= 22 and got.geo.point(i, j)[1] <= 18 for j in range(got.geo.nx)] for i in range(got.geo.ny)])
        assert np.allclose(a[inside], want[inside]), how
    same = array(tiling.bilinear(g, g.geo))
    assert np.allclose(same, z)


@pytest.mark.parametrize("degree", [3, 5])
def test_splines_pass_through_their_values_and_keep_polynomials(degree):
    at, rng = np.arange(50.0), np.random.default_rng(8)
    places = np.concatenate([rng.random(40) * 49, [0.0, 49.0]])
    values = np.stack([rng.normal(size=50), (at / 50) ** degree, np.where(at == 7, np.nan, at)], axis=1)
    assert np.allclose(tiling._along_spline(values, at, degree)[:, :2], values[:, :2])
    out = tiling._along_spline(values, places, degree)
    assert np.allclose(out[:, 1], (places / 50) ** degree) and np.isnan(out[:, 2]).all()
    for n in (1, 2, 3, 4):  # too few values for the degree
        assert np.allclose(tiling._along_spline(at[:n, None], at[:n], degree)[:, 0], at[:n])


def test_order_and_search(spark, grid):
    rows = search.sorted_cells(grid).orderBy("rank").collect()
    want = sorted(np.ndindex(Z.shape), key=lambda c: (-Z[c], c[0] * 12 + c[1]))
    assert [(r.row, r.col) for r in rows] == want and [r.rank for r in rows] == list(range(108))
    pts = cells_of(spark, [(4, 4), (0, 0)])
    for p, (i, j) in enumerate([(4, 4), (0, 0)]):
        around = [(i + a, j + b) for a in range(-2, 2) for b in range(-2, 2) if math.hypot(a, b) <= 2 and 0 <= i + a < 9 and 0 <= j + b < 12]
        top = search.greatest_value(grid, pts, 2).where(f"point = {p}").first()
        assert (top.row, top.col) == min(around, key=lambda c: (-Z[c], c))
        near = search.nearest_value(grid, pts, 50.0, 2).where(f"point = {p}").first()
        assert (near.row, near.col) == min(around, key=lambda c: (abs(Z[c] - 50), c))
        over = search.nearest_at_least(grid, pts, 50.0, 2).where(f"point = {p}").first()
        assert (over.row, over.col) == min(around, key=lambda c: (Z[c] < 50, abs(Z[c] - 50), c))


def test_geographic_area_takes_edges_as_decimals(spark):
    """Beside exact edges (odd multiples of 0.005 degrees) the difference of sines has no more than its own rounding."""
    geo = Georef(1, 2000, 0.01, geographic=True)
    got = np.array([r.a for r in spark.range(2000).select("id", geo.area("id").alias("a")).orderBy("id").collect()])
    k = 2000 - 1 - np.arange(2000)
    rad = np.pi / 180
    want = 6371000.0**2 * (0.01 * rad) * np.abs(np.sin((2 * k + 1) / 200 * rad) - np.sin((2 * k - 1) / 200 * rad))
    assert (got == want).mean() > 0.9 and np.abs(got - want).max() < 1.6e-6
