"""Rasters as DataFrames of cells with a georeference.

A grid has one row for each cell: ``row`` and ``col`` (long; row 0 is the northernmost) and one
or more bands of values (double). No data is NULL or a missing row. Every operator takes and
returns such lazy grids; nothing is computed before an action.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres, for pixel areas of geographic grids.
EARTH_RADIUS = 6371000.0
#: Metres of a degree, for the rough pixel size of a geographic grid.
METRES_PER_DEGREE = 110000


@dataclass(frozen=True)
class Georef:
    """Position of a grid of square pixels; xll and yll are the centre of the lower left pixel."""

    nx: int
    ny: int
    dx: float = 1.0
    xll: float = 0.0
    yll: float = 0.0
    projection: str = ""
    geographic: bool = False

    @staticmethod
    def from_geotransform(nx: int, ny: int, transform: Sequence[float], projection: str = "", geographic: bool = False) -> Georef:
        """From (x of the upper left corner, dx, 0, y of the upper left corner, 0, -dx)."""
        dx = transform[1]
        return Georef(nx, ny, dx, transform[0] + dx / 2, transform[3] - dx * (ny - 0.5), projection, geographic)

    @property
    def geotransform(self) -> tuple[float, float, float, float, float, float]:
        return (self.xll - self.dx / 2, self.dx, 0.0, self.yll + self.dx * (self.ny - 0.5), 0.0, -self.dx)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax of pixel centres."""
        return self.xll, self.xll + (self.nx - 1) * self.dx, self.yll, self.yll + (self.ny - 1) * self.dx

    def cell(self, x: float, y: float) -> tuple[int, int] | None:
        """Row and column of a point, halves to even; None outside the grid."""
        col, row = round((x - self.xll) / self.dx), self.ny - 1 - round((y - self.yll) / self.dx)
        return (row, col) if 0 <= col < self.nx and 0 <= row < self.ny else None

    def point(self, row: int, col: int) -> tuple[float, float]:
        return col * self.dx + self.xll, (self.ny - 1 - row) * self.dx + self.yll

    def x(self, col: Column | str = "col") -> Column:
        return (F.col(col) if isinstance(col, str) else col) * F.lit(float(self.dx)) + F.lit(float(self.xll))

    def y(self, row: Column | str = "row") -> Column:
        return (F.lit(self.ny - 1) - (F.col(row) if isinstance(row, str) else row)) * F.lit(float(self.dx)) + F.lit(float(self.yll))

    def col_of(self, x: Column) -> Column:
        return F.bround((x - F.lit(float(self.xll))) / F.lit(float(self.dx))).cast("long")

    def row_of(self, y: Column) -> Column:
        return F.lit(self.ny - 1).cast("long") - F.bround((y - F.lit(float(self.yll))) / F.lit(float(self.dx))).cast("long")

    def inside(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        row, col = (F.col(c) if isinstance(c, str) else c for c in (row, col))
        return (row >= 0) & (row < self.ny) & (col >= 0) & (col < self.nx)

    def area(self, row: Column | str = "row") -> Column:
        """Area of a pixel: dx squared, or that of its spherical quadrangle."""
        if not self.geographic:
            return F.lit(float(self.dx) ** 2)
        # edges as decimal numbers, where dx and yll are such: doubles summed up would be off by a last place, which the difference of sines shows
        half = Decimal(repr(float(self.dx))) / 2
        low, step = Decimal(repr(float(self.yll))) - half, half * 2
        row = F.col(row) if isinstance(row, str) else row
        up = F.lit(self.ny - 1) - row

        def edge(k: int) -> Column:
            # a whole number of units of the last place over a power of ten is rounded once
            digits = max(-low.as_tuple().exponent, -step.as_tuple().exponent, 0)
            units = (up + k) * F.lit(int(step.scaleb(digits))) + F.lit(int(low.scaleb(digits)))
            return units.cast("double") / F.lit(10.0**digits)

        if max(-low.as_tuple().exponent, -step.as_tuple().exponent) > 12:
            south, north = self.y(row) - self.dx / 2, self.y(row) + self.dx / 2
        else:
            south, north = edge(0), edge(1)
        return F.lit(EARTH_RADIUS**2) * F.abs(F.radians(F.lit(float(self.dx)))) * F.abs(F.sin(F.radians(north)) - F.sin(F.radians(south)))

    def dimension(self, row: Column | str = "row") -> Column:
        """Side of a pixel: dx, or the root of its area."""
        return F.sqrt(self.area(row)) if self.geographic else F.lit(float(self.dx))

    def cell_id(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        row, col = (F.col(c) if isinstance(c, str) else c for c in (row, col))
        return (row * F.lit(self.nx) + col).cast("long")

    def row_at(self, cell: Column) -> Column:
        return F.floor(cell / F.lit(self.nx)).cast("long")

    def col_at(self, cell: Column) -> Column:
        return F.pmod(cell, F.lit(self.nx).cast("long"))

    def utm_zone(self) -> int:
        """Zone of the grid's middle by bands of six degrees; negative in the south."""
        lon, lat = self.xll + (self.nx - 1) * self.dx / 2, self.yll + (self.ny - 1) * self.dx / 2
        zone = int((lon + 180) // 6) % 60 + 1
        return zone if lat >= 0 else -zone

    def approximate_dx(self) -> int:
        """Whole metres of a pixel side of a geographic grid."""
        return int(self.dx * METRES_PER_DEGREE)

    def window(self, row0: int, col0: int, ny: int, nx: int) -> Georef:
        """The georeference of a block of this grid."""
        return replace(self, nx=nx, ny=ny, xll=self.xll + col0 * self.dx, yll=self.yll + (self.ny - row0 - ny) * self.dx)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All (row, col) of the grid."""
        n = F.lit(self.nx).cast("long")
        return spark.range(self.nx * self.ny).select(F.floor(F.col("id") / n).cast("long").alias("row"), (F.col("id") % n).alias("col"))

    def to_row(self, spark: SparkSession) -> DataFrame:
        """The georeference as a table of one row."""
        schema = "geo_transform array<double>, projection string, dx double, xllcenter double, yllcenter double, nx int, ny int, geographic boolean"
        return spark.createDataFrame([(list(map(float, self.geotransform)), self.projection, float(self.dx), float(self.xll), float(self.yll), self.nx, self.ny, self.geographic)], schema)

    def axes(self, spark: SparkSession) -> DataFrame:
        """(axis, index, coordinate) of pixel centres: x by column, y by row from the north."""
        xs = spark.range(self.nx).select(F.lit("x").alias("axis"), F.col("id").alias("index"), self.x("id").alias("coordinate"))
        return xs.unionByName(spark.range(self.ny).select(F.lit("y").alias("axis"), F.col("id").alias("index"), self.y("id").alias("coordinate")))


@dataclass(frozen=True)
class Grid:
    cells: DataFrame
    geo: Georef

    @property
    def bands(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("row", "col")]

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def select(self, *bands: Column | str) -> Grid:
        return Grid(self.cells.select("row", "col", *bands), self.geo)

    def map(self, value: Column, name: str = "value") -> Grid:
        """A grid with one band, an expression over this grid's columns."""
        return self.select(value.alias(name))

    def renamed(self, name: str, band: str = "value") -> DataFrame:
        return self.cells.select("row", "col", F.col(band).alias(name))

    def join(self, other: Grid, name: str, how: str = "left", band: str = "value") -> Grid:
        """This grid with a band of another grid of the same shape as column ``name``."""
        return Grid(self.cells.join(other.renamed(name, band), ["row", "col"], how), self.geo)

    # -- construction ---------------------------------------------------------------------

    @staticmethod
    def zeros(spark: SparkSession, geo: Georef) -> Grid:
        return Grid(geo.frame(spark).withColumn("value", F.lit(0.0)), geo)

    @staticmethod
    def of_array(spark: SparkSession, values: Iterable[Iterable[float | None]], dx: float = 1.0, xll: float = 0.0, yll: float = 0.0) -> Grid:
        """From a small nested list; NaN is no data."""
        rows = [list(map(float_or_none, r)) for r in values]
        flat = [(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)]
        return Grid(spark.createDataFrame(flat, "row long, col long, value double"), Georef(len(rows[0]) if rows else 0, len(rows), dx, xll, yll))

    @staticmethod
    def random(spark: SparkSession, geo: Georef, seed: int, mask: Grid | None = None) -> Grid:
        """Uniform values in [0, 1), everywhere or only where the mask is 1 (else zero)."""
        cells = geo.frame(spark).withColumn("value", F.rand(seed))
        if mask is not None:
            cells = cells.join(mask.renamed("m"), ["row", "col"], "left").select("row", "col", F.when(F.col("m") == 1, F.col("value")).otherwise(0.0).alias("value"))
        return Grid(cells, geo)

    def zero_like(self) -> Grid:
        return self.map(F.lit(0.0))

    # -- points ---------------------------------------------------------------------------

    def at(self, row: int, col: int) -> DataFrame:
        """The cell's value: no row outside the grid, negative indices included."""
        return self.cells.where((F.col("row") == row) & (F.col("col") == col))

    def put(self, points: DataFrame, value: str | None = None, constant: float | None = None) -> Grid:
        """Values at (row, col) of ``points`` replaced by its column ``value`` or by a constant; points outside do nothing."""
        new = points.select("row", "col", (F.lit(constant) if value is None else F.col(value)).cast("double").alias("new"), F.lit(True).alias("hit")).groupBy("row", "col").agg(F.max("new").alias("new"), F.max("hit").alias("hit"))
        joined = self.cells.join(new, ["row", "col"], "left")
        return Grid(joined.select("row", "col", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value")), self.geo)

    def located(self) -> DataFrame:
        """The cells with their x and y."""
        return self.cells.withColumns({"x": self.geo.x(), "y": self.geo.y()})

    def rowcols(self, points: DataFrame) -> DataFrame:
        """Points (x, y, ...) with row and col; both NULL outside the grid."""
        row, col = self.geo.row_of(F.col("y")), self.geo.col_of(F.col("x"))
        ok = self.geo.inside(row, col)
        return points.withColumns({"row": F.when(ok, row), "col": F.when(ok, col)})

    def locations_in(self, points: DataFrame) -> DataFrame:
        """Points (x, y, ...) in the grid whose value is neither no data nor zero."""
        good = self.cells.where("value is not null and not isnan(value) and value <> 0").select("row", "col")
        return self.rowcols(points).join(good, ["row", "col"], "left_semi").drop("row", "col")

    def dense(self) -> Grid:
        """With a row for every cell of the frame."""
        return Grid(self.geo.frame(self.spark).join(self.cells, ["row", "col"], "left"), self.geo)


def float_or_none(v: float | None) -> float | None:
    return None if v is None or v != v else float(v)


def points_of(spark: SparkSession, points: Iterable[tuple[float, float]]) -> DataFrame:
    """Numbered points (point, x, y)."""
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "point long, x double, y double")


def cells_of(spark: SparkSession, cells: Iterable[tuple[int, int]]) -> DataFrame:
    """Numbered cells (point, row, col)."""
    return spark.createDataFrame([(i, int(r), int(c)) for i, (r, c) in enumerate(cells)], "point long, row long, col long")
