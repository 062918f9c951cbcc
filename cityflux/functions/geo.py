"""Points and polygons as column expressions.

A polygon is an array of rings (outer ring and holes alike), each two arrays of vertices; a point is inside by the even-odd
rule over all rings, and a point on an edge is outside, as for ``within``. Zones are matched by the leaves of their trees of
cells (``cells.py``): a point names one cell of each level, and the joins are equalities on cells. The leaves are broadcast up
to a number of bytes that is counted on the very table that is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..session import pinned
from . import cells
from .cells import Grid

MAPPED, OUTSIDE = "MAPPED", "OUTSIDE_TAXI_ZONE_POLYGONS"


def _fold(xs: Column, ys: Column, test) -> Column:
    """Folds ``test(x1, y1, x2, y2)`` over a ring's edges; the ring closes by itself."""
    n = F.size(xs)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: test(F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)))


def crossings(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """How often a ray to the right of the point crosses a ring."""
    hits = _fold(xs, ys, lambda x1, y1, x2, y2: ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.when(y1 == y2, 1.0).otherwise(y2 - y1) + x1))
    return F.size(F.filter(hits, lambda h: h))


def on_edge(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    def test(x1, y1, x2, y2):
        flat = (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)
        return flat & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))

    return F.exists(_fold(xs, ys, test), lambda h: h)


def inside(px: Column, py: Column, rings: Column) -> Column:
    """``rings``: array of structs (xs, ys)."""
    total = F.aggregate(F.transform(rings, lambda r: crossings(px, py, r["xs"], r["ys"])), F.lit(0), lambda a, x: a + x)
    return (total % 2 == 1) & ~F.exists(rings, lambda r: on_edge(px, py, r["xs"], r["ys"]))


_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
LEAVES = f"zone %s, level int, cx long, cy long, flag boolean, right double, edges {_EDGES}"
#: A table of leaves of up to this many bytes goes to every executor; a larger one meets the points in shuffles.
MOST_BYTES = 128 << 20
OVERLAP = "OVERLAPS_ZONE"


def grid_of(zones: DataFrame) -> Grid:
    """The grid over the rings of all zones."""
    ends = lambda f, axis: f(F.flatten(F.transform("rings", lambda r: r[axis])))
    row = zones.agg(F.min(ends(F.array_min, "xs")), F.max(ends(F.array_max, "xs")), F.min(ends(F.array_min, "ys")), F.max(ends(F.array_max, "ys"))).first()
    return Grid.over(*[0.0 if v is None else v for v in row])


def _rings(value) -> list[tuple]:
    return [(r["xs"], r["ys"]) for r in value if r is not None] if value is not None else []


def leaf_table(zones: DataFrame, grid: Grid, zone_id: str = "zone_id") -> DataFrame:
    """The leaves of all zones' trees, one task per part of the zones."""
    schema = T.StructType.fromDDL(LEAVES % zones.schema[zone_id].dataType.simpleString())
    shape = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for zone, rings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                edges, _ = cells.edges_of(_rings(rings))
                rows += [{"zone": zone, "level": x.level, "cx": x.cx, "cy": x.cy, "flag": x.flag, "right": x.right, "edges": [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in x.edges.tolist()]} for x in cells.leaves(edges, grid)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return zones.select(zone_id, "rings").mapInArrow(run, schema)


def _crossed(px: Column, py: Column, e: Column, right: Column) -> Column:
    """Whether an edge of a leaf changes the parity of a point: its crossing and its ends to the right, taken together."""
    up1, up2 = e["y1"] > py, e["y2"] > py
    hit = (up1 != up2) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y1"] == e["y2"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"])
    return (hit != ((e["x1"] > right) & up1)) != ((e["x2"] > right) & up2)


def _on(px: Column, py: Column, e: Column) -> Column:
    flat = (e["x2"] - e["x1"]) * (py - e["y1"]) == (e["y2"] - e["y1"]) * (px - e["x1"])
    return flat & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def _close(px: Column, py: Column, e: Column, distance: float) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / (dx * dx + dy * dy)))
    return F.hypot(px - e["x1"] - t * dx, py - e["y1"] - t * dy) <= distance


def _in_leaf(px: Column, py: Column, z: Column, distance: float) -> Column:
    odd = (F.size(F.filter(z["edges"], lambda e: _crossed(px, py, e, z["right"]))) % 2 == 1) != z["flag"]
    return odd & ~F.exists(z["edges"], lambda e: _close(px, py, e, distance) if distance else _on(px, py, e))


def located(points: DataFrame, leaves: DataFrame, grid: Grid, x: str, y: str, distance: float = 0.0) -> DataFrame:
    """``points`` with ``_hits``, the zones that they lie in, further than ``distance`` from the edges.

    A point has one cell in each level that has leaves, and meets the leaves of that cell as one list, so points are neither
    multiplied nor grouped again. The leaves are read once for each level, so they should be stored.
    """
    per_level = {r[0]: r[1] for r in leaves.groupBy("level").agg(F.sum(64 + 32 * F.size("edges"))).collect()}  # DEEPEST + 1 rows at most
    px, py, hits = F.col(x).cast("double"), F.col(y).cast("double"), []
    for level in sorted(per_level):
        keys, near = [f"_cx{level}", f"_cy{level}"], f"_near{level}"
        listed = leaves.where(F.col("level") == level).groupBy(F.col("cx").alias(keys[0]), F.col("cy").alias(keys[1])).agg(F.collect_list(F.struct("zone", "flag", "right", "edges")).alias(near))
        at = lambda p, low: F.floor((p - low) / grid.side(level))  # noqa: B023, E731
        points = points.withColumns({keys[0]: at(px, grid.x), keys[1]: at(py, grid.y)}).join(F.broadcast(listed) if sum(per_level.values()) <= MOST_BYTES else listed, keys, "left")
        inside_ones = F.filter(F.coalesce(near, F.array()), lambda z: F.coalesce(_in_leaf(px, py, z, distance), F.lit(False)))
        points = points.withColumn(f"_hits{level}", F.transform(inside_ones, lambda z: z["zone"])).drop(*keys, near)
        hits.append(f"_hits{level}")
    return points.withColumn("_hits", F.concat(*hits) if hits else F.array().cast(f"array<{leaves.schema['zone'].dataType.simpleString()}>")).drop(*hits)


def assign_zones(points: DataFrame, zones: DataFrame, x: str, y: str, zone_id: str = "zone_id") -> DataFrame:
    """``points`` with the id of the zone they lie in and a status; a point in several zones fails the run. ``zones`` has ``zone_id`` and ``rings``."""
    grid = grid_of(zones)
    found = located(points, pinned(leaf_table(zones, grid, zone_id)), grid, x, y)
    several = F.raise_error(F.concat(F.lit("a point lies in several zones: "), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string")))
    zone = F.when(F.size("_hits") > 1, several.cast(zones.schema[zone_id].dataType)).otherwise(F.get("_hits", 0))
    rest = [c for c in points.columns if c not in (zone_id, "status")]
    return found.select(*rest, zone.alias(zone_id), F.when(F.size("_hits") > 0, MAPPED).otherwise(OUTSIDE).alias("status"))


def zone_faults(zones: DataFrame, zone_id: str = "zone_id") -> DataFrame:
    """zone, fault, other, x, y: what is wrong with rings, and which zones overlap.

    Rings are searched zone by zone, among the edges that share a leaf. Zones overlap where edges of two of them cross in a
    cell that both have, or where a vertex, an edge's middle or an inner point of one lies inside the other; borders that
    differ by less than the cells' margin count as shared.
    """
    grid, kind = grid_of(zones), zones.schema[zone_id].dataType.simpleString()
    faults = f"zone {kind}, fault string, other {kind}, x double, y double"
    tests, shape = T.StructType.fromDDL(f"zone {kind}, x double, y double"), to_arrow_schema(T.StructType.fromDDL(faults))

    def run(batches):
        for batch in batches:
            rows = [{"zone": z, "fault": f, "other": None, "x": x, "y": y} for z, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f, x, y in cells.ring_faults(_rings(r), grid)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    def probes(batches):
        for batch in batches:
            for z, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e, _ = cells.edges_of(_rings(r))
                inner = cells.inner_point(e)
                p = np.concatenate((e[:, :2], (e[:, :2] + e[:, 2:]) / 2, np.array([inner] if inner else []).reshape(-1, 2)))
                yield pa.RecordBatch.from_arrays([pa.array([z] * len(p), to_arrow_type(tests["zone"].dataType)), pa.array(p[:, 0]), pa.array(p[:, 1])], names=tests.names)

    own = zones.select(zone_id, "rings")
    leaves = pinned(leaf_table(zones, grid, zone_id))
    hit = located(own.mapInArrow(probes, tests), leaves, grid, "x", "y", grid.margin / 2)
    inner = hit.select("zone", F.explode(F.array_remove("_hits", F.col("zone"))).alias("other"), "x", "y")

    levels = [r[0] for r in leaves.select("level").distinct().collect()]  # DEEPEST + 1 at most
    a = leaves.select("level", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("zone", "edges")])
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(cells.FAN)), F.col("_l") - F.col("level")))
    b = leaves.withColumnRenamed("level", "_l").withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v <= F.col("_l")))).select("level", up("cx").alias("cx"), up("cy").alias("cy"), F.col("_l"), F.col("zone").alias("b_zone"), F.col("edges").alias("b_edges"))
    pairs = a.join(b, ["level", "cx", "cy"]).where((F.col("a_zone") != F.col("b_zone")) & ((F.col("_l") > F.col("level")) | (F.col("a_zone") < F.col("b_zone"))))

    def side(p, q1, q2):
        """Distance of a point from a line, with its side."""
        dx, dy = q2[0] - q1[0], q2[1] - q1[1]
        return (dx * (p[1] - q1[1]) - dy * (p[0] - q1[0])) / F.hypot(dx, dy)

    def cross(e, f):
        p, q = ((e["x1"], e["y1"]), (e["x2"], e["y2"])), ((f["x1"], f["y1"]), (f["x2"], f["y2"]))
        far = F.lit(grid.margin / 2)
        apart = lambda u, v: (F.least(u, v) < -far) & (F.greatest(u, v) > far)
        return apart(side(p[0], *q), side(p[1], *q)) & apart(side(q[0], *p), side(q[1], *p))

    crossing = F.filter("a_edges", lambda e: F.exists("b_edges", lambda f: cross(e, f)))
    crossed = pairs.withColumn("_e", F.get(crossing, 0)).where("_e is not null").select(F.col("a_zone").alias("zone"), F.col("b_zone").alias("other"), F.col("_e.x1").alias("x"), F.col("_e.y1").alias("y"))
    both = inner.unionByName(crossed).select(F.least("zone", "other").alias("zone"), F.greatest("zone", "other").alias("other"), "x", "y")
    overlaps = both.groupBy("zone", "other").agg(F.min_by("x", F.struct("x", "y")).alias("x"), F.min_by("y", F.struct("x", "y")).alias("y"))
    return own.mapInArrow(run, faults).unionByName(overlaps.select("zone", F.lit(OVERLAP).alias("fault"), "other", "x", "y"))
