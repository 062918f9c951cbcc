import struct

import pytest
from pyspark.sql import functions as F

from cityflux.functions import geo
from cityflux.sources import readers, shapes

SQUARE = [(-73.99, 40.70), (-73.99, 40.72), (-73.97, 40.72), (-73.97, 40.70), (-73.99, 40.70)]
HOLE = [(-73.985, 40.705), (-73.975, 40.705), (-73.975, 40.715), (-73.985, 40.715), (-73.985, 40.705)]


def shp(records):
    out = b""
    for k, rings in enumerate(records, 1):
        points = [p for r in rings for p in r]
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        body = struct.pack("<i", 0) if not rings else struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        out += struct.pack(">2i", k, len(body) // 2) + body
    return struct.pack(">i", 9994) + bytes(96) + out


def dbf(rows):
    fields = b"".join(name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([n, 0]) + bytes(14) for name, kind, n in (("LocationID", b"N", 6), ("zone", b"C", 12)))
    head = 32 + len(fields) + 1
    return struct.pack("<4BIHH", 3, 125, 1, 1, len(rows), head, 19) + bytes(20) + fields + b"\r" + b"".join(b" " + str(i).rjust(6).encode() + z.ljust(12).encode() for i, z in rows)


def test_projected_zones(spark, tmp_path):
    project = lambda ring: [shapes.EPSG_2263.forward(*p) for p in ring]
    (tmp_path / "z.shp").write_bytes(shp([[project(SQUARE), project(HOLE)], []]))
    (tmp_path / "z.dbf").write_bytes(dbf([(7, "Seven"), (8, "N/A")]))
    records = shapes.shapefile(spark, str(tmp_path))
    assert {r["attributes"]["zone"]: len(r["rings"]) for r in records.collect()} == {"Seven": 2, "N/A": 0}
    zones = shapes.in_degrees(shapes.zone_polygons(records.where(F.size("rings") > 0)))
    first = readers.checked_polygons(zones, 1).first()
    for ring, want in zip(first["rings"], (SQUARE, HOLE), strict=True):
        for x, y, (lon, lat) in zip(ring["xs"], ring["ys"], want[:-1], strict=True):
            assert (x, y) == pytest.approx((lon, lat), abs=1e-9)
    points = spark.createDataFrame([(1, -73.988, 40.702), (2, -73.98, 40.71), (3, -73.9, 40.71)], "id int, x double, y double")
    got = {r["id"]: (r["zone_id"], r["status"]) for r in geo.assign_zones(points, zones, "x", "y").collect()}
    assert got == {1: (7, geo.MAPPED), 2: (None, geo.OUTSIDE), 3: (None, geo.OUTSIDE)}


def test_the_projections_origin():
    assert shapes.EPSG_2263.forward(-74.0, 40 + 10 / 60) == pytest.approx((984250.0, 0.0), abs=1e-6)
    x, y = shapes.EPSG_2263.forward(-73.0, 40 + 10 / 60)
    assert 1_260_000 < x < 1_270_000  # a degree of longitude is some 85 km there
    assert y > 0


def test_damaged_files():
    whole, table = shp([[SQUARE]]), dbf([(7, "Seven")])
    for n in (0, 50, 105, 110, 130, len(whole) - 1):
        with pytest.raises(ValueError, match="shapefile|cut off"):
            list(shapes.rings_of(whole[:n]))
    for n in (0, 40, len(table) - 1):
        with pytest.raises(ValueError, match="dBase"):
            list(shapes.attributes_of(table[:n]))
    assert list(shapes.rings_of(shp([]))) == []
