"""One entry for every grid: ``build(kind, **inputs)`` picks the first constructor whose inputs are all given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession

from talusgrid.errors import InputError
from talusgrid.functions.projection import convert_to_utm
from talusgrid.grid import Georef, Grid, points_of
from talusgrid.operators import accumulate, fill, flow, profile, spectral, stencil, windows
from talusgrid.sources import rasters

Maker = tuple[tuple[str, ...], Callable[..., object]]


def _create(spark, nx, ny, projection, geo_transform, **_):
    return Grid.zeros(spark, Georef.from_geotransform(nx, ny, geo_transform, projection))


def _read_ascii(spark, ai_ascii_filename, EPSGprojectionCode, **_):
    return rasters.read_ascii(spark, ai_ascii_filename, EPSGprojectionCode)


def _read_raster(spark, gdal_filename, **_):
    return rasters.read_tiff(spark, gdal_filename) if gdal_filename.lower().endswith((".tif", ".tiff")) else rasters.load(spark, gdal_filename)


COMMON: list[Maker] = [(("nx", "ny", "projection", "geo_transform"), _create), (("ai_ascii_filename", "EPSGprojectionCode"), _read_ascii), (("gdal_filename",), _read_raster)]


def _points(spark, outlets):
    return points_of(spark, outlets) if isinstance(outlets, (list, tuple)) else outlets


def _order(kw):
    """The grid whose values, from high to low, are the order in which cells are processed."""
    for name in ("order", "flooded_dem", "elevation"):
        if kw.get(name) is not None:
            return kw[name]
    raise InputError("order", "an order, flooded_dem or elevation grid is needed")


def _k(**names):
    return lambda kw: {n: kw[k] for n, k in names.items() if k in kw}


_interval = _k(vertical_interval="vertical_interval", horizontal_interval="horizontal_interval")


MAKERS: dict[str, list[Maker]] = {
    "BaseSpatialGrid": [(("nx", "ny", "dx"), lambda spark, nx, ny, dx, seed=0, mask=None, **_: Grid.random(spark, Georef(nx, ny, dx), seed, mask)), (("dx", "grid"), lambda spark, dx, grid, **_: Grid.of_array(spark, grid, dx))],
    "ValueGrid": [(("dx", "grid"), lambda spark, dx, grid, **_: Grid.of_array(spark, grid, dx))],
    "Elevation": [(("nx", "ny", "dx"), lambda spark, nx, ny, dx, seed=0, mask=None, **_: Grid.random(spark, Georef(nx, ny, dx), seed, mask)), (("dx", "grid"), lambda spark, dx, grid, **_: Grid.of_array(spark, grid, dx))],
    "FlowDirectionD8": [(("flooded_dem",), lambda flooded_dem, compat=True, **_: flow.flow_direction(flooded_dem, compat))],
    "Gradient": [(("elevation",), lambda elevation, **_: stencil.gradient(elevation))],
    "ScarpWavelet": [(("wavelet_filename",), lambda spark, wavelet_filename, elevation_filename=None, **_: rasters.read_scarp_wavelet(spark, wavelet_filename, elevation_filename))],
    "LocalRelief": [(("elevation", "pixel_radius"), lambda elevation, pixel_radius, **_: windows.local_relief(elevation, pixel_radius))],
    "Mask": [(("flow_direction", "outlets"), lambda spark, flow_direction, outlets, **_: flow.upstream_mask(flow_direction, _points(spark, outlets)))],
    "LogArea": [(("area",), lambda area, **_: stencil.log_area(area))],
    "Hillshade": [(("elevation", "azimuth", "inclination"), lambda elevation, azimuth, inclination, **_: stencil.hillshade(elevation, azimuth, inclination))],
    "MaxSlope": [(("elevation",), lambda elevation, **_: stencil.max_slope(elevation))],
    "Laplacian": [(("elevation",), lambda elevation, **_: stencil.laplacian(elevation))],
    "PriorityFillGrid": [(("outlets", "mask"), lambda spark, outlets, mask, **_: flow.flood_mask(mask, _points(spark, outlets)))],
    "FilledElevation": [
        (("elevation", "maximum_pit_depth"), lambda spark, elevation, maximum_pit_depth, outlets=None, randomize=None, **_: fill.fill_in_order(elevation, None if outlets is None else _points(spark, outlets), maximum_pit_depth, randomize=randomize)),
        (("elevation",), lambda spark, elevation, outlets=None, mask=None, epsilon=fill.EPSILON, clip_to_fill=False, **_: fill.fill(elevation, None if outlets is None else _points(spark, outlets), mask, epsilon, clip_to_fill)),
    ],
    "Area": [(("flow_direction",), lambda flow_direction, evaluate_at=None, **kw: accumulate.area(flow_direction, _order(kw), evaluate_at)), (("dx", "grid"), lambda spark, dx, grid, **_: Grid.of_array(spark, grid, dx))],
    "ValleyArea": [(("flow_direction", "area", "laplace", "valley_laplace_value", "min_area_value"), lambda flow_direction, area, laplace, valley_laplace_value, min_area_value, iterations=None, **kw: accumulate.valley_area(flow_direction, _order(kw), area, laplace, valley_laplace_value, min_area_value, iterations))],
    "MainstemValleyArea": [(("area", "laplace", "valley_laplace_value", "min_area_value", "flow_direction"), lambda flow_direction, area, laplace, valley_laplace_value, min_area_value, iterations=None, flow_length=None, **kw: accumulate.mainstem_valley_area(flow_direction, _order(kw), area, laplace, valley_laplace_value, min_area_value, flow_length or accumulate.flow_length(flow_direction, _order(kw)), iterations))],
    "KsFromChiWithSmoothing": [(("elevation", "area", "flow_direction", "theta", i), lambda elevation, area, flow_direction, theta, area_threshold=0.0, **kw: profile.ks_with_smoothing(elevation, area, flow_direction, theta, area_threshold=area_threshold, **_interval(kw))) for i in ("vertical_interval", "horizontal_interval")],
    "ThetaFromChiWithSmoothing": [(("elevation", "area", "flow_direction", i, "min_area"), lambda elevation, area, flow_direction, min_area, **kw: profile.theta_with_smoothing(elevation, area, flow_direction, min_area, **_interval(kw))) for i in ("vertical_interval", "horizontal_interval")],
    "MultiscaleCurvatureValleyWidth": [(("elevation", "area", "area_cutoff", "max_width", "min_width"), lambda elevation, area, area_cutoff, max_width, min_width, fix_center=False, normalize=False, **_: spectral.valley_width(elevation, area, area_cutoff, max_width, min_width, fix_center, normalize))],
    "DiscreteFlowAccumulation": [(("elevation", "outlets"), lambda spark, elevation, outlets, terminations_only=False, **_: fill.discrete_flow(elevation, _points(spark, outlets), terminations_only)), (("elevation",), lambda elevation, terminations_only=False, **_: fill.discrete_flow(elevation, None, terminations_only))],
    "FlowLength": [(("flow_direction",), lambda flow_direction, **kw: accumulate.flow_length(flow_direction, _order(kw)))],
    "Relief": [(("flow_direction", "elevation", "flow_length"), lambda flow_direction, elevation, flow_length, area=None, Ao=None, **kw: accumulate.relief(flow_direction, elevation, flow_length, _order(kw | {"elevation": elevation}), area, Ao))],
    "ScaledRelief": [(("flow_direction", "elevation", "flow_length", "Ao", "theta"), lambda flow_direction, elevation, flow_length, Ao, theta, area=None, **kw: accumulate.scaled_relief(flow_direction, elevation, flow_length, _order(kw | {"elevation": elevation}), Ao, theta, area))],
    "Ksi": [(("area", "flow_direction", "theta", "Ao", "flow_length"), lambda area, flow_direction, theta, Ao, flow_length, **kw: accumulate.ksi(area, flow_direction, theta, Ao, flow_length, _order(kw)))],
    "RestoredElevation": [(("flow_direction", "elevation", "area", "theta", "ks", "outlets", "iterations"), lambda spark, flow_direction, elevation, area, theta, ks, outlets, iterations, fix_external_outlets=True, **_: profile.restored_elevation(flow_direction, elevation, area, theta, ks, _points(spark, outlets), iterations, fix_external_outlets)[0])],
    "ChiScaledRelief": [
        (("elevation", "flow_direction", "theta", "Ao", "outlets"), lambda spark, elevation, flow_direction, theta, Ao, outlets, **_: accumulate.chi_scaled_relief(elevation, flow_direction, theta, Ao, _points(spark, outlets))),
        (("elevation", "flow_direction", "flow_length", "theta", "Ao", "basin_length"), lambda elevation, flow_direction, flow_length, theta, Ao, basin_length, **_: accumulate.chi_scaled_relief(elevation, flow_direction, theta, Ao, accumulate.outlets_at_length(flow_length, flow_direction, basin_length))),
    ],
    "Chi": [
        (("area", "flow_direction", "theta", "Ao", "outlets"), lambda spark, area, flow_direction, theta, Ao, outlets, mask=None, maximum_length=None, **_: accumulate.chi(area, flow_direction, theta, Ao, _points(spark, outlets), mask, maximum_length)),
        (("area", "flow_direction", "flow_length", "theta", "Ao", "basin_length"), lambda area, flow_direction, flow_length, theta, Ao, basin_length, mask=None, **_: accumulate.chi(area, flow_direction, theta, Ao, accumulate.outlets_at_length(flow_length, flow_direction, basin_length), mask)),
    ],
    "CrossDivideDChi": [(("chi", "flow_direction"), lambda chi, flow_direction, **_: accumulate.cross_divide_dchi(chi, flow_direction))],
    "NormalizedCrossDivideDChi": [(("chi", "flow_direction"), lambda chi, flow_direction, **_: accumulate.cross_divide_dchi(chi, flow_direction, True))],
    "Deflection": [(("elevation", "D", "rho_m", "rho_c", "g"), lambda elevation, D, rho_m, rho_c, g, restored_elevation=None, **_: spectral.deflection(elevation, D, rho_m, rho_c, g, restored_elevation))],
    "ChannelSlope": [(("flow_direction", "elevation"), lambda flow_direction, elevation, **_: flow.channel_slope(flow_direction, elevation))],
    "UtmElevation": [(("elevation", "dx"), lambda elevation, dx, zone=None, **_: convert_to_utm(elevation, dx, zone))],
}
for _name, _side in (("ChannelSlopeWithSmoothing", "both"), ("ChannelDownSlopeWithSmoothing", "down"), ("ChannelUpSlopeWithSmoothing", "up")):
    MAKERS[_name] = [(("elevation", "area", "flow_direction", i), lambda elevation, area, flow_direction, min_area=1e6, side=_side, **kw: profile.slope_with_smoothing(elevation, area, flow_direction, min_area=min_area, side=side, **_interval(kw))) for i in ("vertical_interval", "horizontal_interval")]
#: The same operators on grids in degrees: a pixel's area and side depend on its latitude.
GEOGRAPHIC = ("Elevation", "Hillshade", "MaxSlope", "Laplacian", "Area", "ValleyArea", "MainstemValleyArea", "KsFromChiWithSmoothing", "ThetaFromChiWithSmoothing", "DiscreteFlowAccumulation", "FlowLength", "Ksi", "RestoredElevation", "Chi", "Deflection")


def _geographic(value: object) -> object:
    return Grid(value.cells, replace(value.geo, geographic=True)) if isinstance(value, Grid) else value


def build(kind: str, spark: SparkSession | None = None, **inputs) -> Grid:
    """A grid of a kind from keyword inputs, by the first constructor, in order, that has all it needs.

    Without inputs there is nothing to build from and InputError says so. Kinds that begin with
    Geographic treat all their grids as being in degrees.
    """
    name = kind.removeprefix("Geographic")
    geographic = name != kind
    if name not in MAKERS or geographic and name not in GEOGRAPHIC:
        raise InputError(kind, "there is no such kind of grid")
    spark = spark or SparkSession.getActiveSession()
    inputs = {k: _geographic(v) for k, v in inputs.items()} if geographic else inputs
    for needs, make in [*COMMON, *MAKERS[name]]:
        if set(needs) <= set(inputs):
            out = make(spark=spark, **inputs)
            return _geographic(out) if geographic else out
    raise InputError(kind, "inputs " + ", ".join(sorted(inputs)) + " fit none of its constructors")
