import math

import numpy as np
import pytest
from support import array

from talusgrid.api import build
from talusgrid.errors import InputError
from talusgrid.functions import numeric, projection
from talusgrid.grid import Georef, Grid
from talusgrid.operators import spectral
from talusgrid.plans import pipelines
from talusgrid.sources import outlets, rasters, synthetic, vector

RNG = np.random.default_rng(8)
Z = np.round(RNG.normal(0, 50, (11, 9)), 2)


def test_parquet_round_trip(spark, tmp_path):
    z = Z.copy()
    z[2, 3] = np.nan
    g = Grid.of_array(spark, z, 5.0, 100.0, 200.0)
    rasters.save(g, str(tmp_path / "g"), tile=4)
    back = rasters.load(spark, str(tmp_path / "g"))
    assert back.geo == g.geo and np.array_equal(array(back), z, equal_nan=True)
    rows = rasters.window_of(spark, str(tmp_path / "g"), 3, 6, tile=4)
    assert rows.count() == 4 * 9


def test_ascii_round_trip(spark, tmp_path):
    z = Z.copy()
    z[0, 0] = np.nan
    g = Grid.of_array(spark, z, 5.0, 100.0, 200.0)
    path = str(tmp_path / "g.asc")
    rasters.write_ascii(g, path)
    back = rasters.read_ascii(spark, path, 32632)
    assert np.allclose(array(back), z, equal_nan=True) and (back.geo.xll, back.geo.dx) == (100.0, 5.0) and "zone 32N" in back.geo.projection
    with pytest.raises(InputError):
        rasters.ascii_header(["ncols 3", "nrows 4", "xllcorner 1"])
    geo, nodata, n = rasters.ascii_header(["NCOLS 3", "nrows 4", "xllcorner 1", "yllcorner 2", "cellsize 2", "NODATA_value -9"])
    assert (geo.xll, geo.yll, nodata, n) == (2.0, 3.0, -9.0, 6)


def test_tiff_round_trip(spark, tmp_path):
    z = Z.copy()
    z[4, 4] = np.nan
    g = Grid.of_array(spark, z, 5.0, 100.0, 200.0)
    path = str(tmp_path / "g.tif")
    rasters.write_tiff(g, path)
    back = rasters.read_tiff(spark, path)
    assert np.array_equal(array(back), z, equal_nan=True) and back.geo.xll == 100.0 and back.geo.yll == 200.0
    two = g.select(g.cells["value"].alias("a"), (g.cells["value"] * 2).alias("b"))
    rasters.write_tiff(two, path, "float32")
    back = rasters.read_tiff(spark, path, ["a", "b"])
    assert np.allclose(array(back, "b"), 2 * z, equal_nan=True, rtol=1e-6)


def test_e00_has_all_values(spark, tmp_path):
    path = tmp_path / "g.e00"
    rasters.write_e00(Grid.of_array(spark, Z), str(path))
    text = path.read_text()
    assert text.startswith("EXP  0") and text.rstrip().endswith("EOS") and f"{Z[3, 3]:21.14E}" in text


def test_polygons(spark):
    geo = Georef(12, 10, 1.0, 0.5, 0.5)
    rows = spark.createDataFrame([(1, "POLYGON ((1 1, 9 1, 9 8, 1 8, 1 1), (3 3, 5 3, 5 6, 3 6, 3 3))")], "shape long, wkt string")
    a = array(vector.rasterize(vector.from_wkt(rows), geo))
    want = np.array([[float(1 < x < 9 and 1 < y < 8 and not (3 < x < 5 and 3 < y < 6)) for x in np.arange(12) + 0.5] for y in np.arange(10)[::-1] + 0.5])
    assert np.array_equal(a, want)
    table, lines = vector.outlines(Grid.of_array(spark, want, 1.0, 0.5, 0.5))
    cells = {r.region: (r.value, r.cells) for r in table.collect()}
    assert sorted(cells.values()) == [(0.0, 6), (0.0, 120 - 56), (1.0, 50)]
    ring = next(r for r, v in cells.items() if v[0] == 1.0)
    sides = [(s.x0, s.y0, s.x1, s.y1) for s in lines.where(f"region = {ring}").collect()]
    assert len(sides) == 30 + 10
    text = vector.ring_wkt(sides)
    area = sum(x0 * y1 - x1 * y0 for x0, y0, x1, y1 in sides) / 2
    assert text.startswith("POLYGON ((") and area == 50.0


def test_outlets(spark, tmp_path):
    a = outlets.of_dict(spark, {"p": {"x": (1, 2), "y": (3, 4)}})
    b = outlets.of_dict(spark, {"p": {"y": (5, 6)}, "q": {"z": (7, 8)}})
    merged = outlets.upsert(a, b)
    assert outlets.to_dict(merged) == {"p": {"x": (1.0, 2.0), "y": (5.0, 6.0)}, "q": {"z": (7.0, 8.0)}}
    outlets.save(merged, str(tmp_path / "o"))
    assert outlets.to_dict(outlets.load(spark, str(tmp_path / "o"))) == outlets.to_dict(merged)


def test_synthetic_grids(spark):
    t = np.linspace(0, 1, 40)
    s = 3 * np.sin(2 * np.pi * 4 * t)
    assert np.allclose(array(synthetic.sinusoid_grid(spark, 3, 40, 10, 3.0))[1], s - s.min())
    tri = array(synthetic.triangle_grid(spark, 4, 40, 10, 2.0, slope_y=0.5))
    assert tri[0].max() == 0 and tri[3].max() > 7 and tri.min() >= 0


def test_spectral_fits(spark):
    dx = 2.0
    z = RNG.normal(size=(12, 14))
    g = Grid.of_array(spark, z, dx)
    for fixed in (False, True):
        c = spectral.quadratic_coefficients(g, 4.0, fixed, tile=5)
        got = {n: array(c, n)[5, 6] for n in "abcde"}
        u = np.arange(-2, 3) * dx
        x, y = np.meshgrid(u, -u)
        patch = z[3:8, 4:9] - z[5, 6]
        terms = [x**2, y**2, x * y, x, y] + ([] if fixed else [np.ones_like(x)])
        want = np.linalg.lstsq(np.stack([t.ravel() for t in terms], 1), patch.ravel(), rcond=None)[0]
        assert np.allclose([got[n] for n in "abcde"], want[:5])
        cmin = array(spectral.minimum_curvature(g, 4.0, fixed))
        a, b, k = (array(c, n) for n in "abc")
        assert np.allclose(cmin, -a - b - np.sqrt((a - b) ** 2 + k**2))
    area = Grid.of_array(spark, np.full(z.shape, 10.0), dx)
    got = spectral.valley_width(g, area, 5.0, 9.0, 2.0, tile=6)
    best, width = np.zeros(z.shape), np.full(z.shape, np.nan)
    for s in np.arange(2.0, 9.0, dx):
        c = array(spectral.minimum_curvature(g, s))
        better = c < best
        best[better], width[better] = c[better], s
    assert np.array_equal(array(got), width, equal_nan=True) and np.allclose(array(got, "min_c"), best)


def test_deflection_matches_a_whole_transform(spark):
    z = RNG.normal(size=(8, 6))
    dx, D, rm, rc, g = 2.0, 50.0, 3.3, 2.7, 9.8
    wx, wy = (np.concatenate([np.arange(n // 2), np.arange(n // 2)[::-1]]) / (dx * (n // 2)) for n in (6, 8))
    X, Y = np.meshgrid(wx, wy)
    want = np.real(np.fft.ifft2(np.fft.fft2(-z * rc * g) / ((rm - rc) * g + (2 * 3.141) ** 4 * D * (X**2 + Y**2) ** 2)))
    assert np.allclose(array(spectral.deflection(Grid.of_array(spark, z, dx), D, rm, rc, g)), want)


def test_numeric_routines():
    x, _, ok = numeric.nelder_mead(lambda t: (t - 1.7) ** 2, 0.5, 1e-8)
    assert ok and abs(x - 1.7) < 1e-4
    assert math.isclose(numeric.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(numeric.t_two_sided(1.0, 1), 0.5, rel_tol=1e-9)


def test_utm(spark):
    east, north = projection.to_utm(9.0, 48.0, 32)
    assert math.isclose(east, 500000.0, abs_tol=1e-6) and math.isclose(north, 5316300.0, abs_tol=2000)
    lon = Grid(Georef(20, 20, 0.01, 10.0, 47.0, geographic=True).frame(spark), Georef(20, 20, 0.01, 10.0, 47.0, geographic=True))
    field = lon.map(lon.geo.x() * 100 + lon.geo.y() * 10)
    out = projection.convert_to_utm(field, 500.0)
    row, col = 15, 15
    got = out.cells.where(f"row = {row} and col = {col}").first().value
    best = min(((abs(projection.to_utm(x, y, 32)[0] - out.geo.point(row, col)[0]) + abs(projection.to_utm(x, y, 32)[1] - out.geo.point(row, col)[1]), x, y) for x in np.arange(10, 10.2, 0.0005) for y in np.arange(47, 47.2, 0.0005)))
    assert abs(got - (best[1] * 100 + best[2] * 10)) < 0.2


def test_build_picks_the_first_constructor_that_fits(spark):
    z = build("Elevation", spark, dx=2.0, grid=Z.tolist())
    assert np.array_equal(array(z), Z)
    assert build("BaseSpatialGrid", spark, nx=3, ny=2, projection="", geo_transform=(0, 1, 0, 2, 0, -1)).cells.count() == 6
    filled = build("FilledElevation", elevation=z)
    fd = build("FlowDirectionD8", flooded_dem=filled)
    area = build("Area", flow_direction=fd, order=filled)
    assert array(area).max() > 4.0
    assert np.isfinite(array(build("MaxSlope", elevation=z))).all()
    geo = build("GeographicMaxSlope", elevation=z)
    assert geo.geo.geographic
    with pytest.raises(InputError):
        build("Hillshade", elevation=z)
    with pytest.raises(InputError):
        build("NoSuchGrid", elevation=z)


def test_pipeline_saves_every_stage(spark, tmp_path):
    got = pipelines.process_all(Grid.of_array(spark, Z - Z.min(), 10.0), str(tmp_path / "p"), 100.0, 0.4)
    assert set(got) == {"elevation", "filled", "flow_direction", "area", "flow_length", "ksi", "scaled_relief"}
    again = pipelines.process_for_theta(spark, str(tmp_path / "p"), 100.0, 0.4)
    assert np.allclose(array(again["ksi"]), array(got["ksi"]))


def test_text_rasters_come_to_the_driver_deflated(spark, tmp_path, monkeypatch):
    sent = []
    inflate = rasters.zlib.decompress
    monkeypatch.setattr(rasters.zlib, "decompress", lambda data: sent.append(len(data)) or inflate(data))
    z = Grid.of_array(spark, [[None if (i, j) == (2, 3) else float(i * j % 7) for j in range(40)] for i in range(30)])
    for write, read in ((rasters.write_e00, rasters.read_e00), (rasters.write_ascii, rasters.read_ascii)):
        sent.clear()
        path = str(tmp_path / write.__name__)
        write(z, path)
        assert 0 < sum(sent) < 0.5 * (tmp_path / write.__name__).stat().st_size
        assert {tuple(r) for r in read(spark, path).cells.collect()} == {tuple(r) for r in z.cells.collect()}
