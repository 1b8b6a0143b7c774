"""The place nearest to each position: a join on cells of space.

Positions lie on a sphere of radius one, in cells of a cubic grid. A place in the 27 cells around a position is the
nearest of all if it is no further than a cell is wide; positions without one are looked up again in wider cells, the last
of which hold the whole sphere. There are no poles and no date line to care for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut

#: Widths of cells: about 64, 640 and 3,200 km; then all.
WIDTHS = (0.01, 0.1, 0.5, 4.0)
EARTH_KM = 6371.0


def _xyz(lat: Column, lon: Column) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def _real(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def nearest_places(positions: DataFrame, places: DataFrame, widths: tuple[float, ...] = WIDTHS) -> DataFrame:
    """(lat, lon, place_id, km): for each distinct position (lat, lon) the nearest of the places (place_id, lat, lon).

    Distances are along the great circle; of equally near places the smaller id. NULL, NaN and impossible positions and
    places take part in nothing; no places give no rows. The places, which a gazetteer bounds, are copied to the 27 cells
    around each; positions, which grow, are not.
    """
    real = _real(F.col("lat"), F.col("lon"))
    known = places.where(F.col("place_id").isNotNull() & real).select("place_id", *[c.alias(f"p{n}") for n, c in _xyz(F.col("lat"), F.col("lon")).items()])
    known = cut(known.distinct())
    left = cut(positions.where(real).select("lat", "lon").distinct().select("lat", "lon", *[c.alias(n) for n, c in _xyz(F.col("lat"), F.col("lon")).items()]))
    found: list[DataFrame] = []
    for level, width in enumerate(widths):
        last = level == len(widths) - 1
        cell = lambda c: F.floor(c / F.lit(width)).cast("int")
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        spread = known.withColumns({"cx": cell(F.col("px")), "cy": cell(F.col("py")), "cz": cell(F.col("pz"))})
        for c in ("cx", "cy", "cz"):
            spread = spread.withColumn("step", F.explode(around)).withColumn(c, F.col(c) + F.col("step"))
        own = left.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y")), "cz": cell(F.col("z"))})
        square = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in (("x", "px"), ("y", "py"), ("z", "pz"))), F.lit(0.0))
        best = own.join(spread, ["cx", "cy", "cz"]).groupBy("lat", "lon").agg(F.min(F.struct(square.alias("d"), "place_id")).alias("best"))
        best = best if last else best.where(F.sqrt("best.d") <= width)
        best = cut(best.select("lat", "lon", "best.place_id", (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("best.d") / 2))).alias("km")))
        found.append(best)
        left = cut(left.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        if last or left.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found)
