"""Geometry as Column expressions over (ring, point, [lon, lat]) arrays.

Points in rings are decided by half-open ray casting over all rings of a polygon, so a hole is outside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the geohash code
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"

POINT, RINGS, MULTI = "array<double>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def grid(precision: int) -> tuple[int, int]:
    """Numbers of cells of a geohash length along longitude and latitude."""
    bits = 5 * precision
    return 1 << (bits + 1) // 2, 1 << bits // 2


def cell_x(lon: Column, precision: int) -> Column:
    n = grid(precision)[0]
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((lon + 180) / 360 * n))).cast("long")


def cell_y(lat: Column, precision: int) -> Column:
    n = grid(precision)[1]
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((lat + 90) / 180 * n))).cast("long")


def cell_hash(x: Column, y: Column, precision: int) -> Column:
    """The geohash of a cell: bits of x and y in turn, x first, five to a character."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    bit = lambda v, k: F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long"))
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for i in range(5 * c, 5 * c + 5):
            value = value * 2 + (bit(y, ny - 1 - i // 2) if i % 2 else bit(x, nx - 1 - i // 2))
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    return cell_hash(cell_x(lon, precision), cell_y(lat, precision), precision)


def _box(west: Column, east: Column, south: Column, north: Column, precision: int) -> Column:
    """Geohashes of a rectangle of cells."""
    return F.flatten(F.transform(F.sequence(west, east), lambda i: F.transform(F.sequence(south, north), lambda j: cell_hash(i, j, precision))))


#: Cells of a cover at most, but for the coarsest.
COVER = 1024


def cover(rings: Column, precision: int = 5, most: int = COVER) -> Column:
    """Geohashes of the cells of the bounding box: a superset of those that the polygon touches.

    The longest hashes, up to the precision, of which there are at most ``most``; so a large polygon has
    short ones, and two covers meet where a hash of one begins with one of the other.
    """
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    out = None
    for p in range(1, precision + 1):
        ends = [f(g(v), p) for f, v in ((cell_x, xs), (cell_y, ys)) for g in (F.array_min, F.array_max)]
        cells = _box(*ends, p)
        few = (ends[1] - ends[0] + 1) * (ends[3] - ends[2] + 1) <= most
        out = cells if out is None else F.when(few, cells).otherwise(out)
    return out


def beginnings(cell: Column, precision: int) -> Column:
    """The hash and all its beginnings."""
    return F.array_distinct(F.array(*(F.substring(cell, 1, k) for k in range(1, precision + 1))))


def edges(ring: Column) -> Column:
    """(a, b) of consecutive points, the last to the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains_point(rings: Column, lon: Column, lat: Column) -> Column:
    def crosses(e):
        (ax, ay), (bx, by) = (e["a"][0], e["a"][1]), (e["b"][0], e["b"][1])
        straddles = (ay > lat) != (by > lat)
        return straddles & (lon < (bx - ax) * (lat - ay) / F.when(straddles, by - ay).otherwise(F.lit(1.0)) + ax)

    all_edges = F.flatten(F.transform(rings, edges))
    return F.size(F.filter(all_edges, crosses)) % 2 == 1


def multi_contains_point(polygons: Column, lon: Column, lat: Column) -> Column:
    return F.exists(polygons, lambda p: contains_point(p, lon, lat))


def _side(a, b, c) -> Column:
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def edges_meet(p: Column, q: Column) -> Column:
    """Do any two edges of two polygons have a point in common? Touching and lying on each other count."""
    ep, eq = F.flatten(F.transform(p, edges)), F.flatten(F.transform(q, edges))

    def near(e, f, k):
        low, high = lambda s: F.least(s["a"][k], s["b"][k]), lambda s: F.greatest(s["a"][k], s["b"][k])
        return (low(e) <= high(f)) & (low(f) <= high(e))

    def meet(e, f):
        across = lambda s, t: _side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) <= 0
        return near(e, f, 0) & near(e, f, 1) & across(e, f) & across(f, e)

    return F.exists(ep, lambda e: F.exists(eq, lambda f: meet(e, f)))


def overlaps(p: Column, q: Column) -> Column:
    """Edges meet, or one polygon holds a point of the other; where a ring starts does not matter."""
    held = contains_point(p, q[0][0][0], q[0][0][1]) | contains_point(q, p[0][0][0], p[0][0][1])
    return edges_meet(p, q) | held


def outer_holds(p: Column, q: Column) -> Column:
    """All points of q's outer ring lie in p's outer ring."""
    return F.forall(q[0], lambda v: contains_point(F.slice(p, 1, 1), v[0], v[1]))


def parse(geojson: Column) -> Column:
    """struct(type, point, rings, polygons) of a GeoJSON text; malformed text raises, other types have neither."""
    kind = F.from_json(geojson, "type string, coordinates string", {"mode": "FAILFAST"})["type"]
    as_type = lambda t: F.from_json(geojson, f"type string, coordinates {t}", {"mode": "PERMISSIVE"})["coordinates"]
    return F.struct(kind.alias("type"), F.when(kind == "Point", as_type(POINT)).alias("point"), F.when(kind == "Polygon", as_type(RINGS)).alias("rings"), F.when(kind == "MultiPolygon", as_type(MULTI)).alias("polygons"))
