"""Distances and plane geometry as column expressions; all stay in the JVM.

Three distances are in use and aren't to be mixed: the great circle, a local
plane with the mean latitude of both points, and a plane of one fixed latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Earth's radius, metres of a degree, walking.
RADIUS = 6371000.0
PER_LAT, PER_LON = 110574.0, 111320.0
FIXED_LAT = 51.5
WALK_METRES, WALK_FACTOR, WALK_MOST = 80.0, 1.3, 20
#: (walk to the nearest below, furthest walk, or minutes more than the nearest); the last holds for the rest.
REACH_BANDS = ((5, None, 5), (10, 15, None), (None, None, 6))
REACH_FLOOR = 9
CITY_LAT, CITY_LON = 51.5074, -0.1278
CELL = 250.0
REGION = 0.02


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(h))


def local_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = (lon1 - lon2) * PER_LON * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, (lat1 - lat2) * PER_LAT)


def plane_x(lon: Column) -> Column:
    return lon * (PER_LON * math.cos(math.radians(FIXED_LAT)))


def plane_y(lat: Column) -> Column:
    return lat * PER_LAT


def segment_distance_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of a point from a segment in a plane; a segment of no length is its point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    cx, cy = ax + t * dx - px, ay + t * dy - py
    return cx * cx + cy * cy


def cells_between(low: Column, high: Column, cell: float = CELL) -> Column:
    """Numbers of the cells from low to high."""
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def cells_along(ax: Column, ay: Column, bx: Column, by: Column, cell: float = CELL) -> Column:
    """The cells that a segment goes through, as an array of struct(row, col): in each row those between where it enters and leaves.

    Their number grows with the segment's length, not with the area of its box. Millimetres to both sides count as touched.
    """
    low, high, edge = F.least(ay, by), F.greatest(ay, by), 1e-3

    def of_row(row: Column) -> Column:
        enter, leave = F.greatest(low, row * cell), F.least(high, (row + 1) * cell)
        at = lambda y: F.when(ay == by, ax).otherwise(ax + (y - ay) * (bx - ax) / (by - ay))
        first, last = (F.when(ay == by, v).otherwise(at(y)) for v, y in ((ax, enter), (bx, leave)))
        left, right = F.greatest(F.least(first, last), F.least(ax, bx)), F.least(F.greatest(first, last), F.greatest(ax, bx))
        return F.transform(cells_between(left - edge, right + edge, cell), lambda col: F.struct(row.alias("row"), col.alias("col")))

    return F.flatten(F.transform(cells_between(low, high, cell), of_row))


def has_coordinates(lat: Column, lon: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return F.coalesce(ok(lat) & ok(lon), F.lit(False))


def walk_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(metres * WALK_FACTOR / WALK_METRES + 0.5)).cast("int")


def walk_radius(minutes: float = WALK_MOST) -> float:
    return minutes * WALK_METRES / WALK_FACTOR


def reach_minutes(nearest: Column, bands=REACH_BANDS, floor: int = REACH_FLOOR) -> Column:
    """The longest walk worth listing, by the walk to the nearest station."""
    case = None
    for under, ceiling, delta in bands:
        value = F.lit(ceiling) if ceiling is not None else nearest + delta
        if under is None:
            return F.greatest(F.lit(floor), value if case is None else case.otherwise(value))
        case = F.when(nearest < under, value) if case is None else case.when(nearest < under, value)
    return F.greatest(F.lit(floor), case.otherwise(F.lit(bands[-1][1]) if bands[-1][1] is not None else nearest + bands[-1][2]))


def ring_offset(index: Column, count: Column) -> Column:
    """struct(x, y): places of equal coordinates on rings of eight; 0 if alone."""
    ring = F.floor(index / 8) + 1
    angle = (index % 8) / 8 * (2 * math.pi)
    radius = F.least(F.lit(24.0), 6.0 + ring * 5)
    alone = count <= 1
    return F.struct(F.when(alone, F.lit(0.0)).otherwise(F.cos(angle) * radius).alias("x"), F.when(alone, F.lit(0.0)).otherwise(F.sin(angle) * radius).alias("y"))


def fan_slots(n: Column, gap: float = 30.0, least: float = 28.0) -> Column:
    """array of struct(x, y): n places around a ring whose neighbours are ``gap`` apart, the first at the top."""
    angle = lambda i: -math.pi / 2 + i * (2 * math.pi) / n
    radius = F.when(n > 1, F.greatest(F.lit(least), gap / (2 * F.sin(math.pi / n)))).otherwise(F.lit(least))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.cos(angle(i)) * radius).alias("x"), (F.sin(angle(i)) * radius).alias("y")))


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return 156543.03392 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def mercator(lat: Column, lon: Column, zoom: float, tile: int = 512) -> Column:
    """struct(x, y) in pixels of the whole world at a zoom."""
    world = tile * 2.0**zoom
    s = F.sin(F.radians(lat))
    return F.struct(((lon + 180) / 360 * world).alias("x"), ((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * world).alias("y"))


def region_cell(lat: Column, lon: Column, size: float = REGION) -> Column:
    return F.struct(F.floor(lat / size + 0.5).cast("long").alias("row"), F.floor(lon / size + 0.5).cast("long").alias("col"))


def cell_ring(row: Column, col: Column, size: float = REGION) -> Column:
    """The closed ring of the square around a cell's middle, one cell to each side."""
    y, x = row * size, col * size
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(*(F.array(x + size * i, y + size * j) for i, j in corners))


def ring_area(path: Column) -> Column:
    """Signed area of a closed path of [x, y] points: positive if it runs counter-clockwise."""
    steps = F.transform(F.sequence(F.lit(2), F.size(path)), lambda i: F.element_at(F.element_at(path, i - 1), 1) * F.element_at(F.element_at(path, i), 2) - F.element_at(F.element_at(path, i), 1) * F.element_at(F.element_at(path, i - 1), 2))
    return F.when(F.size(path) > 1, F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)).otherwise(F.lit(0.0)) / 2


def oriented(path: Column) -> Column:
    """The path, or its reverse, so that its longer extent rises; a ring runs counter-clockwise."""
    head, tail = F.element_at(path, 1), F.element_at(path, -1)
    dx, dy = F.element_at(tail, 1) - F.element_at(head, 1), F.element_at(tail, 2) - F.element_at(head, 2)
    back = F.when((dx == 0) & (dy == 0), ring_area(path) < 0).when(F.abs(dx) >= F.abs(dy), dx < 0).otherwise(dy < 0)
    return F.when(back, F.reverse(path)).otherwise(path)


def clipped(path: Column, west: float, south: float, east: float, north: float) -> Column:
    """The pieces of a path of [x, y] points that lie in a box, two points at least."""
    inside = lambda p: F.element_at(p, 1).between(west, east) & F.element_at(p, 2).between(south, north)
    none = F.slice(F.array(path), F.lit(1), F.lit(0))
    runs = F.aggregate(
        path,
        F.struct(none.alias("done"), F.slice(path, F.lit(1), F.lit(0)).alias("now")),
        lambda s, p: F.when(inside(p), F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(p)).alias("now"))).otherwise(
            F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.slice(path, F.lit(1), F.lit(0)).alias("now"))
        ),
        lambda s: F.concat(s["done"], F.array(s["now"])),
    )
    return F.filter(runs, lambda r: F.size(r) >= 2)


def band_width(stack: Column) -> Column:
    return F.floor(1e4 / stack + 0.5) / 1e4


def band_index(slot: Column, stack: Column) -> Column:
    return slot - (stack - 1) / 2
