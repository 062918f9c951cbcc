"""Zone polygons from shapefiles, in plain degrees.

A shapefile is a pair of small files, so one task parses each pair: ``.shp`` holds the rings, ``.dbf`` the attributes, both in
the order of records. Coordinates in a Lambert conformal conic projection become longitude and latitude by column expressions.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORDS = "attributes map<string,string>, rings array<struct<xs:array<double>,ys:array<double>>>"
#: Polygon, and polygon with z or m values, whose x and y come first in the same places (fixed values of the format).
POLYGONS, NONE = (5, 15, 25), 0


def rings_of(content: bytes) -> Iterator[list[tuple[list[float], list[float]]]]:
    """The rings of each record, without a ring's closing vertex; a null shape has none."""
    if len(content) < 100 or struct.unpack_from(">i", content)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at < len(content):
        if at + 12 > len(content):
            raise ValueError(f"a record at byte {at} is cut off")
        size, kind = 2 * struct.unpack_from(">i", content, at + 4)[0], struct.unpack_from("<i", content, at + 8)[0]
        body, end = at + 8, at + 8 + size
        if size < 4 or end > len(content) or kind not in (NONE, *POLYGONS):
            raise ValueError(f"a record at byte {at} is cut off or no polygon")
        rings = []
        if kind != NONE:
            if size < 44:
                raise ValueError(f"a record at byte {at} is cut off")
            parts, points = struct.unpack_from("<2i", content, body + 36)
            if min(parts, points) < 0 or 44 + 4 * parts + 16 * points > size:
                raise ValueError(f"a record at byte {at} is cut off")
            starts = [*struct.unpack_from(f"<{parts}i", content, body + 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", content, body + 44 + 4 * parts)
            for a, b in zip(starts, starts[1:]):
                if not 0 <= a <= b <= points:
                    raise ValueError(f"a record at byte {at} has rings out of order")
                xs, ys = list(xy[2 * a : 2 * b : 2]), list(xy[2 * a + 1 : 2 * b : 2])
                if len(xs) > 1 and (xs[0], ys[0]) == (xs[-1], ys[-1]):
                    del xs[-1], ys[-1]
                rings.append((xs, ys))
        yield rings
        at = end


def attributes_of(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """The fields of each record as trimmed texts; blank ones are null, deleted records keep their place."""
    if len(content) < 32:
        raise ValueError("not a dBase table")
    count, head, width = struct.unpack_from("<IHH", content, 4)
    if head + count * width > len(content):
        raise ValueError("a dBase table is cut off")
    fields, at = [], 32
    while at + 32 <= head and content[at : at + 1] != b"\r":
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    if 1 + sum(n for _, n in fields) > width:
        raise ValueError("a dBase table's records are narrower than its fields")
    for k in range(count):
        place, row = head + k * width + 1, {}
        for name, n in fields:
            row[name] = content[place : place + n].decode(encoding).strip(" \0") or None
            place += n
        yield row


def shapefile(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """attributes and rings of every record of the shapefiles in a folder; a pair of unequal length or a lone file fails the run."""
    read = lambda ending: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(folder).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.col("content").alias(ending))

    def parsed(batches):
        import pandas as pd

        for pairs in batches:
            for stem, shp, dbf in zip(pairs["stem"], pairs["shp"], pairs["dbf"]):
                if shp is None or dbf is None:
                    raise ValueError(f"{stem} lacks its .shp or .dbf")
                rows = [(a, [{"xs": xs, "ys": ys} for xs, ys in r]) for a, r in zip(attributes_of(dbf, encoding), rings_of(shp), strict=True)]
                yield pd.DataFrame(rows, columns=["attributes", "rings"])

    return read("shp").join(read("dbf"), "stem", "full").mapInPandas(parsed, _RECORDS)


def zone_polygons(records: DataFrame, zone_id: str = "LocationID") -> DataFrame:
    """zone_id and rings, as ``readers.polygons`` gives them; the parts of a zone in several records come together."""
    rows = records.select(F.element_at("attributes", zone_id).cast("double").cast("int").alias("zone_id"), "rings")
    return rows.groupBy("zone_id").agg(F.flatten(F.collect_list("rings")).alias("rings"))


@dataclass(frozen=True)
class Lambert:
    """A Lambert conformal conic projection with two standard parallels (degrees; offsets and axis in units of ``unit`` metres)."""

    south: float
    north: float
    origin: float
    meridian: float
    east: float
    unit: float
    axis: float = 6378137.0
    flattening: float = 1 / 298.257222101

    @property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _t(self, degrees: float) -> float:
        s = math.sin(math.radians(degrees))
        return math.tan(math.pi / 4 - math.radians(degrees) / 2) / ((1 - self.e * s) / (1 + self.e * s)) ** (self.e / 2)

    def _m(self, degrees: float) -> float:
        s = math.sin(math.radians(degrees))
        return math.cos(math.radians(degrees)) / math.sqrt(1 - (self.e * s) ** 2)

    @property
    def n(self) -> float:
        return math.log(self._m(self.south) / self._m(self.north)) / math.log(self._t(self.south) / self._t(self.north))

    @property
    def scale(self) -> float:
        """Radius of a parallel in metres, over t to the power n."""
        return self.axis * self._m(self.south) / (self.n * self._t(self.south) ** self.n)

    def forward(self, longitude: float, latitude: float) -> tuple[float, float]:
        r, r0 = (self.scale * self._t(d) ** self.n for d in (latitude, self.origin))
        turn = self.n * math.radians(longitude - self.meridian)
        return self.east + r * math.sin(turn) / self.unit, (r0 - r * math.cos(turn)) / self.unit

    def degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude; the series for the latitude is exact to well under a millimetre."""
        r0 = self.scale * self._t(self.origin) ** self.n
        dx, dy = (x - self.east) * self.unit, F.lit(r0) - y * self.unit
        t = F.pow(F.sqrt(dx * dx + dy * dy) / self.scale, F.lit(1 / self.n))
        conformal = F.lit(math.pi / 2) - 2 * F.atan(t)
        e2 = self.e**2
        terms = (
            e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
            7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
            7 * e2**3 / 120 + 81 * e2**4 / 1120,
            4279 * e2**4 / 161280,
        )
        latitude = conformal
        for k, c in enumerate(terms, 1):
            latitude = latitude + c * F.sin(2 * k * conformal)
        return F.degrees(F.atan2(dx, dy) / self.n) + self.meridian, F.degrees(latitude)


#: EPSG:2263, New York Long Island in US survey feet (fixed values).
EPSG_2263 = Lambert(south=40 + 40 / 60, north=41 + 2 / 60, origin=40 + 10 / 60, meridian=-74.0, east=984250.0, unit=1200 / 3937)


def in_degrees(polygons: DataFrame, projection: Lambert = EPSG_2263) -> DataFrame:
    """``polygons`` with rings in longitude and latitude."""

    def turned(r: Column) -> Column:
        points = F.zip_with(r["xs"], r["ys"], lambda x, y: F.struct(*[c.alias(n) for c, n in zip(projection.degrees(x, y), "xy")]))
        return F.struct(F.transform(points, lambda p: p["x"]).alias("xs"), F.transform(points, lambda p: p["y"]).alias("ys"))

    return polygons.withColumn("rings", F.transform("rings", turned))
