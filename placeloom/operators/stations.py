"""Stations: within a walk, nearest to a stop, beside a line, merged by name."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.text import in_locale, station_key
from placeloom.operators.components import components
from placeloom.storage import stored

LIST_MOST = 6
STOP_METRES, LINE_METRES, MERGE_METRES = 300.0, 150.0, 900.0
#: Degrees of latitude up to which the cells of a walk hold; farther north or south, pass a higher one.
MOST_LAT = 66.0
#: Nodes of a connected run of one name that one task folds; a larger one goes in rounds over tiles of TILE x TILE cells.
RUN_ROWS = 50_000
TILE = 16


def _cells(lat, lon, metres: float, most_lat: float):
    row, col = metres / geo.PER_LAT, metres / (geo.PER_LON * math.cos(math.radians(most_lat)))
    return F.floor(lat / row), F.floor(lon / col)


def stations_within(roots: DataFrame, stations: DataFrame, max_minutes: int = geo.WALK_MOST, limit: int = LIST_MOST, bands=geo.REACH_BANDS, floor: int = geo.REACH_FLOOR, most_lat: float = MOST_LAT) -> DataFrame:
    """(root_id, name, lat, lon, metres, minutes, lines, place): what each station within a walk of a root adds.

    roots: root_id, lat, lon. stations: name, lat, lon, lines (array of structs with a name). A line
    counts at the nearest station that has it; a station that adds none isn't listed. The list ends at
    a walk that depends on the nearest station's, and after ``limit`` stations (0: no limit). Roots
    without coordinates and stations without lines take no part. The radius join is an equi join on
    cells as wide as the radius, with the roots' eight neighbours. It joins places: roots at one place have one list, and of the
    stations at one place each line has one, so neither grows by how many are there.
    """
    radius = geo.walk_radius(max_minutes)
    placed = roots.where(geo.has_coordinates(F.col("lat"), F.col("lon"))).select("root_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    site = ["r_lat", "r_lon"]
    row, col = _cells(F.col("r_lat"), F.col("r_lon"), radius, most_lat)
    r = placed.select(*site).distinct().withColumns({"row": F.explode(F.sequence(row - 1, row + 1))}).withColumn("col", F.explode(F.sequence(col - 1, col + 1)))
    row, col = _cells(F.col("lat"), F.col("lon"), radius, most_lat)
    # of the stations at one place, the first that has a line is the nearest for all roots
    s = stations.select("name", "lat", "lon", F.posexplode("lines").alias("at", "line")).groupBy("lat", "lon", F.col("line.name").alias("of"))
    s = s.agg(F.min_by(F.struct("name", "at", "line"), F.struct(in_locale(F.col("name")).alias("k"), "name", "at")).alias("s")).select("lat", "lon", "s.*").withColumns({"row": row, "col": col})
    lines = r.join(s, ["row", "col"]).withColumn("metres", geo.local_metres(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon"))).where(F.col("metres") <= radius).drop("row", "col")
    lines = lines.withColumn("minutes", geo.walk_minutes(F.col("metres")))
    lines = lines.withColumn("__first", F.min("minutes").over(Window.partitionBy(*site))).where(F.col("minutes") <= geo.reach_minutes(F.col("__first"), bands, floor))
    nearest = Window.partitionBy(*site, "line.name").orderBy("metres", in_locale(F.col("name")), "name", "lat", "lon", "at")
    adds = lines.withColumn("__n", F.row_number().over(nearest)).where("__n = 1")
    rows = adds.groupBy(*site, "name", "lat", "lon", "metres", "minutes").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*site).orderBy("metres", in_locale(F.col("name")), "name", "lat", "lon")))
    rows = rows.where(F.col("place") <= limit) if limit > 0 else rows
    return placed.join(rows, site).drop(*site)


def nearest_station(stops: DataFrame, stations: DataFrame, most: float = STOP_METRES) -> DataFrame:
    """stops with station_ordinal and metres of the nearest station below ``most`` metres, null if there is none.

    Plane of the fixed latitude; of equally near stations the first by ordinal. stops: stop_id, lat, lon.
    Places are joined, each of them once, however many stops or stations it has.
    """
    x, y = geo.plane_x(F.col("lon")), geo.plane_y(F.col("lat"))
    p = stops.where(geo.has_coordinates(F.col("lat"), F.col("lon"))).select(x.alias("px"), y.alias("py")).distinct()
    p = p.withColumn("col", F.explode(F.sequence(F.floor(F.col("px") / most) - 1, F.floor(F.col("px") / most) + 1))).withColumn("row", F.explode(F.sequence(F.floor(F.col("py") / most) - 1, F.floor(F.col("py") / most) + 1)))
    s = stations.groupBy(x.alias("sx"), y.alias("sy")).agg(F.min("ordinal").alias("ordinal")).withColumns({"col": F.floor(F.col("sx") / most), "row": F.floor(F.col("sy") / most)})
    d = F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy"))
    best = p.join(s, ["col", "row"]).withColumn("d", d).where(F.col("d") < most).groupBy("px", "py").agg(F.min(F.struct("d", "ordinal")).alias("b"))
    return stops.withColumns({"__x": x, "__y": y}).join(best, (F.col("__x") == F.col("px")) & (F.col("__y") == F.col("py")), "left").select(*stops.columns, F.col("b.ordinal").alias("station_ordinal"), F.col("b.d").alias("metres"))


def segments(lines: DataFrame) -> DataFrame:
    """(line, ax, ay, bx, by) of each segment of lines(line, path: array of [lon, lat])."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    rows = lines.where(F.size("path") > 1).select("line", F.explode(steps).alias("s"))
    at = lambda p, k: F.element_at(F.col(f"s.{p}"), k)
    return rows.select("line", geo.plane_x(at("a", 1)).alias("ax"), geo.plane_y(at("a", 2)).alias("ay"), geo.plane_x(at("b", 1)).alias("bx"), geo.plane_y(at("b", 2)).alias("by"))


def lines_beside(stations: DataFrame, lines: DataFrame, most: float = LINE_METRES, cell: float = geo.CELL) -> DataFrame:
    """(ordinal, line): the lines with a segment within ``most`` metres of a station; a cell must be as wide at least.

    A segment is in the cells that it goes through, a station looks in its own and the eight around it.
    """
    assert cell >= most
    s = segments(lines).select("*", F.inline(geo.cells_along(*(F.col(c) for c in ("ax", "ay", "bx", "by")), cell)))
    p = stations.select("ordinal", geo.plane_x(F.col("lon")).alias("px"), geo.plane_y(F.col("lat")).alias("py"))
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / cell) - 1, F.floor(F.col(c) / cell) + 1))
    p = p.withColumn("col", near("px")).withColumn("row", near("py"))
    d = geo.segment_distance_squared(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    return p.join(s, ["col", "row"]).where(d <= most * most).select("ordinal", "line").distinct()


def _folded(most: float):
    """Function of batches of clusters (kind 0) and nodes (kind 1) sorted by (run, tile_x, tile_y, kind, ordinal): what nodes settle.

    A node joins the first cluster, by founder, whose mean lies within ``most`` metres, or founds one. Nodes after their ``until`` wait,
    and so do those behind a waiting one of the cells around. Rows out: settled nodes (kind 1) and the clusters that changed
    (kind 0). One tile's clusters are held at a time, never its nodes.
    """
    per_lon, side = geo.PER_LON * math.cos(math.radians(geo.FIXED_LAT)), 2 * most
    names = ["run", "tile_x", "tile_y", "kind", "ordinal", "lon", "lat", "members", "until", "cell_x", "cell_y"]

    def cell(c: list) -> tuple[int, int]:
        return math.floor(c[1] * per_lon / side), math.floor(c[2] * geo.PER_LAT / side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, grid, changed, waiting = None, {}, {}, set()

        def out(rows: list) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["run", "kind", "ordinal", "founder", "lon", "lat", "members"])

        def done() -> list:
            return [(tile[0], 0, f, f, c[1], c[2], c[3]) for f, c in changed.items()]

        for batch in batches:
            rows = []
            for r in zip(*(batch.column(n).to_pylist() for n in names)):
                if r[:3] != tile:
                    rows += done()
                    tile, grid, changed, waiting = r[:3], {}, {}, set()
                _, _, _, kind, ordinal, lon, lat, members, until, x, y = r
                if kind == 0:
                    c = [ordinal, lon, lat, members]
                    grid.setdefault(cell(c), {})[ordinal] = c
                    continue
                around = [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                if until is not None and ordinal > until or not waiting.isdisjoint(around):
                    waiting.add((x, y))
                    continue
                near = [c for k in around for c in grid.get(k, {}).values() if math.hypot((lon - c[1]) * per_lon, (lat - c[2]) * geo.PER_LAT) <= most]
                if near:
                    c = min(near)
                    before, n = cell(c), c[3]
                    c[1:] = (c[1] * n + lon) / (n + 1), (c[2] * n + lat) / (n + 1), n + 1
                    if cell(c) != before:
                        grid[before].pop(c[0])
                        grid.setdefault(cell(c), {})[c[0]] = c
                else:
                    c = [ordinal, lon, lat, 1]
                    grid.setdefault(cell(c), {})[ordinal] = c
                changed[c[0]] = c
                rows.append((tile[0], 1, ordinal, c[0], None, None, None))
            yield out(rows)
        if changed:
            yield out(done())

    return run


_FOLDED = "run long, kind int, ordinal long, founder long, lon double, lat double, members int"


def _fold(rows: DataFrame, most: float) -> DataFrame:
    tile = ["run", "tile_x", "tile_y"]
    return rows.repartition(*tile).sortWithinPartitions(*tile, "kind", "ordinal").mapInArrow(_folded(most), _FOLDED)


def _fold_by_rounds(nodes: DataFrame, most: float) -> DataFrame:
    """What ``_fold`` gives for runs of any size, many tasks a run.

    Two nodes more than 2 * ``most`` apart change nothing for each other: what one joins is out of the other's reach, before and after.
    So a tile's nodes are settled in order up to those that come after a waiting node of a cell around that is another tile's;
    the tiles of the next round lie across the borders of the last one's. The first waiting node of a run always settles.
    """
    per_lon, side = geo.PER_LON * math.cos(math.radians(geo.FIXED_LAT)), 2 * most
    waiting, clusters, settled, n = nodes, None, None, 0
    while not waiting.isEmpty():
        shift_x, shift_y = ((0, 0), (TILE // 2, TILE // 2), (TILE // 2, 0), (0, TILE // 2))[n % 4]
        n += 1
        tile_x, tile_y = (lambda c, s: F.floor((c + s) / TILE))(F.col("cell_x"), shift_x), (lambda c, s: F.floor((c + s) / TILE))(F.col("cell_y"), shift_y)
        around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
        first = waiting.groupBy("run", "cell_x", "cell_y").agg(F.min("ordinal").alias("first")).select("*", tile_x.alias("of_x"), tile_y.alias("of_y"))
        first = first.withColumn("cell_x", around("cell_x")).withColumn("cell_y", around("cell_y")).where((F.col("of_x") != tile_x) | (F.col("of_y") != tile_y))
        until = first.groupBy("run", "cell_x", "cell_y").agg(F.min("first").alias("until"))
        rows = waiting.join(until, ["run", "cell_x", "cell_y"], "left").select("run", tile_x.alias("tile_x"), tile_y.alias("tile_y"), F.lit(1).alias("kind"), "ordinal", "lon", "lat", F.lit(1).alias("members"), "until", "cell_x", "cell_y")
        if clusters is not None:
            near = clusters.select("*", F.floor(F.col("lon") * per_lon / side).alias("cell_x"), F.floor(F.col("lat") * geo.PER_LAT / side).alias("cell_y"))
            near = near.withColumn("cell_x", around("cell_x")).withColumn("cell_y", around("cell_y"))
            near = near.select("run", tile_x.alias("tile_x"), tile_y.alias("tile_y"), F.lit(0).alias("kind"), F.col("founder").alias("ordinal"), "lon", "lat", "members", F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("cell_x"), F.lit(0).cast("long").alias("cell_y")).distinct()
            rows = rows.unionByName(near.join(rows.select("run", "tile_x", "tile_y").distinct(), ["run", "tile_x", "tile_y"], "left_semi"))
        new = stored(_fold(rows, most), "folded")
        own = new.where("kind = 1")
        moved = new.where("kind = 0").select("run", "founder", "lon", "lat", "members")
        if clusters is not None:  # a round's tiles never change the same cluster
            moved = moved.unionByName(clusters.join(moved.select("founder"), "founder", "left_anti"))
        clusters = stored(moved, "clusters")
        settled = own if settled is None else settled.union(own)
        waiting = stored(waiting.join(own.select("ordinal"), "ordinal", "left_anti").select(*nodes.columns), "waiting")
    if clusters is None:
        return nodes.sparkSession.createDataFrame([], _FOLDED)
    return settled.unionByName(clusters.select("run", F.lit(0).alias("kind"), F.col("founder").alias("ordinal"), "founder", "lon", "lat", "members"))


def merge_stations(nodes: DataFrame, most: float = MERGE_METRES, run_rows: int = RUN_ROWS) -> DataFrame:
    """(ordinal, name, lon, lat, members, lines): nodes of one name close to each other as one station.

    In the order of ``ordinal``, which is unique, a node joins the first cluster of its key whose running mean lies within ``most``
    metres. The name is the shortest, then the first; lines by name, the first spelling of each. Nodes without
    coordinates are stations of their own; a null name is like an empty one; no nodes give no rows.
    nodes: ordinal, name, lon, lat, lines (array of struct name, color, tfl). What moves a mean is within 2 * ``most`` metres
    of what it decides, so a name is dealt out by connected runs of cells of that width; a run of more than ``run_rows``
    goes in rounds over tiles, with the same result.
    """
    per_lon, side = geo.PER_LON * math.cos(math.radians(geo.FIXED_LAT)), 2 * most
    lines = F.coalesce("lines", F.array().cast(nodes.schema["lines"].dataType))
    rows = nodes.select(F.col("ordinal").cast("long").alias("ordinal"), "name", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), lines.alias("lines"))
    placed = rows.select("ordinal", "lon", "lat", F.coalesce(station_key(F.col("name")), F.lit("")).alias("key")).where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
    placed = placed.withColumns({"cell_x": F.floor(F.col("lon") * per_lon / side), "cell_y": F.floor(F.col("lat") * geo.PER_LAT / side)})
    cells = stored(placed.groupBy("key", "cell_x", "cell_y").agg(F.min("ordinal").alias("node"), F.count("*").alias("n")), "cells")
    other = cells.select("key", F.explode(F.sequence(F.col("cell_x"), F.col("cell_x") + 1)).alias("cell_x"), "cell_y", F.col("node").alias("to"))
    other = other.withColumn("cell_y", F.explode(F.sequence(F.col("cell_y") - 1, F.col("cell_y") + 1)))
    runs = components(cells.join(other, ["key", "cell_x", "cell_y"]).where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    run = stored(cells.join(runs.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "cell_x", "cell_y", "n", F.coalesce("component", "node").alias("run")), "runs")
    large = run.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > run_rows).select("run")
    placed = placed.join(run.drop("n"), ["key", "cell_x", "cell_y"]).select("run", "ordinal", "lon", "lat", "cell_x", "cell_y")
    here = lambda df: df.select("run", F.lit(0).alias("tile_x"), F.lit(0).alias("tile_y"), F.lit(1).alias("kind"), "ordinal", "lon", "lat", F.lit(1).alias("members"), F.lit(None).cast("long").alias("until"), "cell_x", "cell_y")
    if large.isEmpty():
        folded = stored(_fold(here(placed), most), "folded")
    else:
        placed = stored(placed, "placed")
        folded = stored(_fold(here(placed.join(large, "run", "left_anti")), most), "folded").union(_fold_by_rounds(placed.join(large, "run", "left_semi"), most))
    of = rows.join(folded.where("kind = 1").select("ordinal", "founder"), "ordinal", "left").withColumn("founder", F.coalesce("founder", "ordinal"))
    named = of.groupBy("founder").agg(F.min_by("name", F.struct(F.col("name").isNull(), F.length("name"), in_locale(F.col("name")), "name")).alias("name"))
    listed = of.select("founder", "ordinal", F.posexplode("lines").alias("at", "line")).groupBy("founder", F.col("line.name").alias("line_name")).agg(F.min(F.struct("ordinal", "at", "line")).alias("x"))
    listed = listed.groupBy("founder").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("own"))
    means = folded.where("kind = 0").select("founder", F.col("lon").alias("mean_lon"), F.col("lat").alias("mean_lat"), "members")
    first = rows.join(named.withColumnRenamed("name", "best"), rows.ordinal == F.col("founder")).join(means, "founder", "left").join(listed, "founder", "left")
    none = F.array().cast(nodes.schema["lines"].dataType)
    return first.select("ordinal", F.col("best").alias("name"), F.coalesce("mean_lon", "lon").alias("lon"), F.coalesce("mean_lat", "lat").alias("lat"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("own", none).alias("lines"))


def ordered_lines(lines):
    """Transport for London first, then by name."""
    return F.transform(F.array_sort(F.transform(lines, lambda x: F.struct((~x["tfl"]).alias("o"), in_locale(x["name"]).alias("k"), x.alias("x")))), lambda s: s["x"])


def assign_lines(nodes: DataFrame, stops: DataFrame, drawn: DataFrame) -> DataFrame:
    """(name, lon, lat, lines) of stations, with the lines that stop there or, if none does, that pass close by.

    nodes: ordinal, name, lon, lat. stops: stop_id, lat, lon, line (struct name, color, tfl). drawn: line
    (struct), path. Stations without lines are left out; coordinates have five decimals.
    """
    named = nodes.where((F.trim("name") != "") & geo.has_coordinates(F.col("lat"), F.col("lon"))).withColumn("name", F.trim("name"))
    at = nearest_station(stops, named).where("station_ordinal IS NOT NULL")
    first = at.groupBy("station_ordinal", "line.name").agg(F.min_by("line", "stop_id").alias("line"), F.min("stop_id").alias("o"))
    served = first.groupBy("station_ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("lines"))
    none = F.array().cast("array<struct<name: string, color: string, tfl: boolean>>")
    merged = merge_stations(named.join(served, named.ordinal == served.station_ordinal, "left").select("ordinal", "name", "lon", "lat", F.coalesce("lines", none).alias("lines")))
    beside = lines_beside(merged.where(F.size("lines") == 0), drawn).groupBy("ordinal").agg(F.collect_list("line").alias("inferred"))
    rows = merged.join(beside, "ordinal", "left").withColumn("lines", F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.coalesce("inferred", none)))
    five = lambda c: F.floor(F.col(c) * 1e5 + 0.5) / 1e5
    return rows.where(F.size("lines") > 0).select("name", five("lon").alias("lon"), five("lat").alias("lat"), ordered_lines(F.col("lines")).alias("lines"))


