"""Cells of the sky of about equal area, for joins of places that lie within a radius of each other.

The sphere is cut into bands of declination about as high as the radius, and each band into cells about
as wide as it is high, so a circle reaches some dozen cells wherever it lies. Right ascension wraps;
a circle that holds a pole reaches all cells of the bands that it touches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Degrees by which circles are widened, so that rounding loses no cell.
SLACK = 1e-9
#: Most bands: cells below 30 arc seconds would only make numbers longer.
MOST_BANDS = 21600


def bands(radius: float) -> int:
    return max(1, min(MOST_BANDS, math.floor(180 / radius))) if radius > 0 else MOST_BANDS


#: Cells in which the first of several circles is sought are so many times narrower than the radius: a circle then covers about a fifth of the cells that it reaches.
FINE = 2


def _cells_of(band: Column, n: int) -> Column:
    """How many cells a band has."""
    return F.greatest(F.lit(1), F.round(2 * n * F.cos(F.radians((band + 0.5) * (180 / n) - 90)))).cast("long")


def _band(dec: Column, n: int) -> Column:
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((dec + 90) * (n / 180)))).cast("long")


def _number(band: Column, cell: Column, n: int) -> Column:
    return band * (4 * n) + cell


def sky_cell(ra: str, dec: str, radius: float, fine: int = 1) -> Column:
    """The number of the cell that holds a place (degrees); cells are `fine` times narrower than the radius."""
    n = bands(radius / fine)
    band = _band(F.col(dec), n)
    count = _cells_of(band, n)
    return _number(band, F.least(count - 1, F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360 * count).cast("long")), n)


def covers(ra: str, dec: str, band: Column, i: Column, count: Column, n: int, radius: float) -> Column:
    """Whether the circle around a place surely holds the whole of a band's cell i (of `count`).

    Every point of the cell lies within `own` of its middle: half its height and half its width at most,
    where meridians stand farthest apart."""
    low, high = band * (180 / n) - 90, (band + 1) * (180 / n) - 90
    middle = (low + high) / 2
    widest = F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(low)), F.cos(F.radians(high))))
    own = _apart(F.pow(F.sin(F.radians(F.lit(90 / n)) / 2), 2) + F.cos(F.radians(middle)) * widest * F.pow(F.sin(F.radians(180.0 / count) / 2), 2))
    far = _apart(F.pow(F.sin(F.radians(F.col(dec) - middle) / 2), 2) + F.cos(F.radians(dec)) * F.cos(F.radians(middle)) * F.pow(F.sin(F.radians(F.col(ra) - (i + 0.5) * 360.0 / count) / 2), 2))
    return own + far <= radius - 1e-6


def _apart(haversine: Column) -> Column:
    """Degrees between places, of the haversine of their distance."""
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), haversine))))


def with_cells(places: DataFrame, ra: str, dec: str, radius: float, name: str, fine: int = 1, whole: str | None = None) -> DataFrame:
    """A row per place and cell that has a point within `radius` degrees of it, with the cell's number; none without a place.

    The column `whole`, if named, tells whether the circle holds all of the cell (`covers`)."""
    n, r = bands(radius / fine), radius + SLACK
    place, high = F.pmod(F.col(ra), F.lit(360.0)), F.col(dec)
    # half the width of the circle in right ascension; where the circle holds a pole, half a turn
    sine = F.lit(math.sin(math.radians(min(r, 90.0)))) / F.greatest(F.cos(F.radians(high)), F.lit(1e-12))
    half = F.when((F.abs(high) + r >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine)))) + SLACK
    rows = places.where(F.col(ra).isNotNull() & high.isNotNull() & ~F.isnan(ra) & ~F.isnan(dec))
    rows = rows.withColumns({"__half": half, "__band": F.explode(F.sequence(_band(high - r, n), _band(high + r, n)))}).withColumn("__n", _cells_of(F.col("__band"), n))
    low = F.floor((place - F.col("__half")) / 360 * F.col("__n")).cast("long")
    last = F.least(F.floor((place + F.col("__half")) / 360 * F.col("__n")).cast("long"), low + F.col("__n") - 1)
    rows = rows.withColumn("__i", F.explode(F.sequence(low, last)))
    if whole:
        rows = rows.withColumn(whole, covers(ra, dec, F.col("__band"), F.pmod("__i", "__n"), F.col("__n"), n, radius))
    return rows.withColumn(name, _number(F.col("__band"), F.pmod("__i", "__n"), n)).drop("__half", "__band", "__n", "__i")
