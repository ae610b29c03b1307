"""Entity resolution: many appearances of a place become one record.

Names block; within a name, coordinates cluster; clusters that share a postcode
merge; clusters whose names are subsets of each other and that lie next to each
other merge. All but the order-dependent clustering of one name is relational.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.text import address_score, description_key, full_postcode, in_locale, is_all_caps, is_clean_name, name_key, split_name, text, word_count
from placeloom.functions.url import dedupe_key
from placeloom.operators.components import components
from placeloom.storage import stored

MERGE_METRES, SUBSET_METRES = 200.0, 60.0
#: Entries of a connected run that one task clusters by itself.
RUN_ROWS = 50_000
#: Cells of the grid of a radius that one of the cells of runs holds, about; the narrowest tiles of large runs, in cells of the grid.
CELLS, LEAST_TILE = 8, 8
DISHES, DISHES_LENGTH = 4, 42
#: Cells of the plane are this much wider than the radius, as cells are cut by degrees and distances are great circles.
MARGIN = 1.02
#: Degrees of latitude up to which cells are wide enough: every inhabited place.
MOST_LAT = 80.0


def keyed(entries: DataFrame) -> DataFrame:
    """Entries with name_key (a key of its own for a name of which nothing is left) and numeric coordinates. The key of a name is made once."""
    names = entries.select(text(F.col("name")).alias("__name")).distinct().withColumn("__key", name_key(F.col("__name")))
    rows = entries.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "__name": text(F.col("name"))}).join(names, "__name")
    return rows.withColumn("name_key", F.when(F.col("__key") == "", F.concat(F.lit("__"), F.col("id").cast("string"))).otherwise(F.col("__key"))).drop("__name", "__key")


def _cell(lat: Column, lon: Column, metres: float) -> tuple[Column, Column]:
    """Cells at least as wide as the radius up to MOST_LAT degrees of latitude."""
    degrees = metres * MARGIN / (math.pi * geo.RADIUS / 180)
    return F.floor(lat / degrees), F.floor(lon / (degrees / math.cos(math.radians(MOST_LAT))))


def _width(band, side: float, of=math):
    """Width of the cells of a band in radians, by the edge closer to the equator: any two points of a cell are within 1.5 x side."""
    low = np.minimum(np.abs(band), np.abs(band + 1)) if of is np else min(abs(band), abs(band + 1))
    cos = of.cos(low * side)
    return side / (np.maximum(1e-9, cos) if of is np else max(1e-9, cos))


def _greedy(metres: float):
    """Function of batches (__run, tile_y, tile_x, ordinal, lat, lon, home, label) sorted by run, tile and ordinal: (ordinal, before, label) of home rows.

    A row takes the smallest of the labels of earlier rows of its tile within metres and of its own, which is its ordinal or
    what it is known to reach. Any two points of a cell are within metres, so a cell's label only gets smaller from row to row:
    a row looks at points of cells around only as long as one of them has a smaller label. A cell holds each point
    of a label once, with the box around them. Rows stream past; a tile is never held.
    """
    reach, side = metres * MARGIN / geo.RADIUS, metres / geo.RADIUS / 1.5
    none = 1 << 63

    def around(band: int, col: int) -> list[range]:
        """Keys of the cells that may hold a point within metres of one of this cell."""
        w, edge = _width(band, side), max(abs(band), abs(band + 1)) * side
        far = 2 * math.asin(min(1.0, math.sin(reach / 2) / max(1e-9, math.cos(min(edge + reach, math.pi / 2)))))
        out = []
        for b in range(band - 2, band + 3):
            v = _width(b, side)
            out.append(range((b << 32) + math.floor((col * w - far) / v), (b << 32) + math.floor(((col + 1) * w + far) / v) + 1))
        return out

    def place(cells: dict, key: int, band: int, col: int, y: float, x: float, label: int) -> int:
        cell = cells.get(key)
        if cell is None:  # its label, the smallest label around, the keys around, (label, box, points) from the largest label on
            keys = around(band, col)
            cell = cells[key] = [none, min((cells[k][0] for r in keys for k in r if k in cells), default=none), keys, []]
        label = min(label, cell[0])
        if cell[1] < label:
            cos = math.cos(y)
            far = 2 * math.asin(min(1.0, math.sin(reach / 2) / max(1e-9, math.cos(min(abs(y) + reach, math.pi / 2)))))
            met = []
            for r in cell[2]:
                for k in r:
                    n = cells.get(k)
                    if n is not None and n[0] < label:
                        for found, box, points in n[3]:
                            if found < label and box[0] - reach <= y <= box[1] + reach and box[2] - far <= x <= box[3] + far:
                                met.append((found, k, points))
            met.sort(key=lambda m: m[:2])
            for found, _, points in met:
                if any(2 * geo.RADIUS * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + cos * k * math.sin((u - x) / 2) ** 2))) <= metres for (v, u), k in points.items()):
                    label = found
                    break
        if label < cell[0]:
            cell[0] = label
            cell[3].append((label, [y, y, x, x], {(y, x): math.cos(y)}))
            for r in cell[2]:
                for k in r:
                    n = cells.get(k)
                    if n is not None and label < n[1]:
                        n[1] = label
        else:
            _, box, points = cell[3][-1]
            if (y, x) not in points:
                points[y, x] = math.cos(y)
                box[:] = min(box[0], y), max(box[1], y), min(box[2], x), max(box[3], x)
        return label

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cells = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("__run", "tile_y", "tile_x")])
            y, x = np.radians(batch.column("lat").to_numpy()), np.radians(batch.column("lon").to_numpy())
            band = np.floor(y / side).astype(np.int64)
            col = np.floor(x / _width(band, side, np)).astype(np.int64)
            before = batch.column("label").to_numpy()
            rows = list(zip(((band << 32) + col).tolist(), band.tolist(), col.tolist(), y.tolist(), x.tolist(), before.tolist()))
            label = np.empty(len(rows), np.int64)
            edge = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
            for a, b in zip(edge, edge[1:]):
                if (now := tuple(group[:, a].tolist())) != last:
                    last, cells = now, {}
                label[a:b] = [place(cells, *r) for r in rows[a:b]]
            home = batch.column("home").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("ordinal").to_numpy()[home]), pa.array(before[home]), pa.array(label[home])], names=["ordinal", "before", "label"])

    return cluster


def _grid(y: Column, x: Column, metres: float) -> tuple[Column, Column]:
    """(band, col): the cell of a point in radians, narrow enough that any two points of a cell are within metres."""
    side = metres / geo.RADIUS / 1.5
    band = F.floor(y / side)
    return band, F.floor(x / _band_width(band, side))


def _band_width(band: Column, side: float) -> Column:
    return side / F.greatest(F.lit(1e-9), F.cos(F.least(F.abs(band), F.abs(band + 1)) * side))  # by the edge closer to the equator


def _around(band: Column, col: Column, metres: float) -> Column:
    """The cells that may hold a point within metres of one of this cell, itself included, as an array of struct(band, col)."""
    reach, side = metres * MARGIN / geo.RADIUS, metres / geo.RADIUS / 1.5
    w, edge = _band_width(band, side), F.greatest(F.abs(band), F.abs(band + 1)) * side
    far = 2 * F.asin(F.least(F.lit(1.0), math.sin(reach / 2) / F.greatest(F.lit(1e-9), F.cos(F.least(edge + reach, F.lit(math.pi / 2))))))
    cols = lambda b: F.sequence(F.floor((col * w - far) / _band_width(b, side)), F.floor(((col + 1) * w + far) / _band_width(b, side)))
    return F.flatten(F.transform(F.sequence(band - 2, band + 2), lambda b: F.transform(cols(b), lambda c: F.struct(b.alias("band"), c.alias("col")))))


_TILED = "ordinal long, before long, label long"


def _in_tiles(rows: DataFrame, metres: float) -> DataFrame:
    """(ordinal, before, label) of home rows."""
    sorted_ = rows.select("__run", "tile_y", "tile_x", "ordinal", "lat", "lon", "home", "label").repartition("__run", "tile_y", "tile_x").sortWithinPartitions("__run", "tile_y", "tile_x", "ordinal")
    return sorted_.mapInArrow(_greedy(metres), _TILED)


def _clusters_by_rounds(placed: DataFrame, metres: float) -> DataFrame:
    """(ordinal, geo_id) of runs (__run, __side, ordinal, lat, lon) of any size, many tasks a run.

    A row joins the first cluster of which an earlier row is within metres, so its cluster is the smallest of those of all such
    rows: the smallest ordinal that it reaches by going to earlier rows within metres. Tiles of __side x __side cells, each with the
    rows of the cells around it, are clustered one by one; then again from the labels that rows have in the tiles that they
    belong to, where rows around have got smaller ones, until none changes.
    """
    band, col = _grid(F.radians("lat"), F.radians("lon"), metres)
    tile = lambda b, c: F.struct(F.floor(b / F.col("__side")).alias("tile_y"), F.floor(c / F.col("__side")).alias("tile_x"))
    points = placed.withColumns({"band": band, "col": col})
    points = points.withColumn("near", F.explode(F.array_distinct(F.transform(_around(F.col("band"), F.col("col"), metres), lambda c: tile(c["band"], c["col"])))))
    points = stored(points.select("__run", "near.tile_y", "near.tile_x", "ordinal", "lat", "lon", (F.col("near") == tile(F.col("band"), F.col("col"))).alias("home")), "tiles")
    key = ["__run", "tile_y", "tile_x"]
    now = stored(_in_tiles(points.withColumn("label", F.col("ordinal")), metres), "labels")
    while True:
        labels, changed = now.select("ordinal", "label"), now.where("label < before").select("ordinal")
        around = stored(points.where("NOT home").join(changed, "ordinal", "left_semi").select(key).distinct(), "changed")
        if around.isEmpty():
            return labels.select("ordinal", F.col("label").alias("geo_id"))
        again = stored(_in_tiles(points.join(around, key, "left_semi").join(labels, "ordinal"), metres), "again")
        new = again.select("ordinal", F.col("before").alias("__before"), F.col("label").alias("__label"))
        now = stored(labels.join(new, "ordinal", "left").select("ordinal", F.col("label").alias("before"), F.coalesce("__label", "label").alias("label")), "labels")


def geo_clusters(entries: DataFrame, metres: float = MERGE_METRES) -> DataFrame:
    """Adds geo_id, the ordinal of the first entry of a cluster of one name.

    Greedy and in input order: an entry that lies between two clusters joins the first and doesn't merge
    them. Places without coordinates are clusters of their own. Entries of a name are dealt out by
    connected runs of occupied cells first, as clusters never reach over an empty one, so a chain's
    branches all over the country aren't one group. A run of at most RUN_ROWS entries is one task; a larger one
    is clustered in rounds over tiles of about so many, with the same result.
    """
    rows = stored(entries.select("name_key", F.col("ordinal").cast("long").alias("ordinal"), "lat", "lon", *(c.alias(n) for n, c in zip(("__row", "__col"), _cell(F.col("lat"), F.col("lon"), metres)))).where("__row IS NOT NULL AND __col IS NOT NULL"), "rows")
    cells = stored(rows.groupBy("name_key", "__row", "__col").agg(F.min("ordinal").alias("__node"), F.count("*").alias("__n")), "cells")
    other = cells.select("name_key", F.explode(F.sequence(F.col("__row"), F.col("__row") + 1)).alias("__row"), F.col("__col"), F.col("__node").alias("__to"))
    other = other.withColumn("__col", F.explode(F.sequence(F.col("__col") - 1, F.col("__col") + 1)))
    edges = cells.join(other, ["name_key", "__row", "__col"]).where(F.col("__node") != F.col("__to")).select(F.col("__node").alias("a"), F.col("__to").alias("b"))
    runs = components(edges)
    run = stored(cells.join(runs, cells["__node"] == runs.node, "left").select("name_key", "__row", "__col", "__n", F.coalesce("component", "__node").alias("__run")), "runs")
    dense = F.sum("__n") / F.count("*") / CELLS  # entries of a cell of the grid
    large = run.groupBy("__run").agg(F.sum("__n").alias("__n"), F.greatest(F.lit(LEAST_TILE), F.ceil(F.sqrt(RUN_ROWS / dense))).alias("__side")).where(F.col("__n") > RUN_ROWS).select("__run", "__side")
    placed = rows.join(run.drop("__n"), ["name_key", "__row", "__col"]).select("__run", "ordinal", "lat", "lon")
    if large.isEmpty():
        small, more = placed, None
    else:
        placed = stored(placed, "placed")
        small, more = placed.join(large, "__run", "left_anti"), _clusters_by_rounds(placed.join(large, "__run"), metres)
    whole = small.withColumns({"tile_y": F.lit(0).cast("long"), "tile_x": F.lit(0).cast("long"), "home": F.lit(True), "label": F.col("ordinal")})
    found = stored(_in_tiles(whole, metres).select("ordinal", F.col("label").alias("geo_id")), "clusters")
    found = found if more is None else found.union(more)
    return entries.join(found, "ordinal", "left").withColumn("geo_id", F.coalesce("geo_id", F.col("ordinal").cast("long")))


def postcode_clusters(entries: DataFrame) -> DataFrame:
    """Adds place_id: clusters of one name that share a full postcode, directly or over others, are one."""
    codes = entries.select("name_key", "geo_id", full_postcode(F.col("address")).alias("code")).where("code <> ''").distinct()
    first = codes.groupBy("name_key", "code").agg(F.min("geo_id").alias("first"))
    edges = codes.join(first, ["name_key", "code"]).select(F.col("geo_id").alias("a"), F.col("first").alias("b"))
    groups = components(edges)
    return entries.join(groups, entries.geo_id == groups.node, "left").withColumn("place_id", F.coalesce("component", "geo_id")).drop("node", "component")


def primary_order() -> list[Column]:
    """Priced first, then a standalone name, then the longest description, then the id."""
    return [(text(F.col("priceRange")) == ""), ~is_clean_name(F.col("name")), -F.length(text(F.col("description"))), in_locale(F.col("id").cast("string")), F.col("id").cast("string")]


def subset_clusters(entries: DataFrame, metres: float = SUBSET_METRES) -> DataFrame:
    """Adds final_id: places whose primary names hold one another's words, start alike and lie within metres, are one.

    A set of words meets those that hold it under its rarest word. Only points around which several places come under that word are
    looked at. In a cell of which any two points are within metres the places of a set are one, so cells meet once for
    each two sets, not their points; of two cells one pair of points within metres is enough.
    """
    best = entries.groupBy("place_id").agg(F.min_by("name", F.struct(*primary_order())).alias("__primary"))
    words = F.filter(F.split(name_key(F.col("__primary")), " "), lambda w: w != "")
    tokens = stored(best.select("place_id", F.array_distinct(words).alias("tokens"), F.try_element_at(words, F.lit(1)).alias("first")).where("first IS NOT NULL"), "tokens")
    each = tokens.select("first", "tokens").distinct().withColumn("word", F.explode("tokens"))
    rare = each.join(each.groupBy("first", "word").agg(F.count("*").alias("n")), ["first", "word"]).groupBy("first", "tokens").agg(F.min(F.struct("n", "word"))["word"].alias("rare"))
    met = each.join(rare.select("first", F.col("rare").alias("word")).distinct(), ["first", "word"]).groupBy("first", "tokens").agg(F.collect_set("word").alias("words"))
    places = stored(tokens.join(rare, ["first", "tokens"]).join(met, ["first", "tokens"]), "words")
    row, col = _cell(F.col("lat"), F.col("lon"), metres)
    band, cell = _grid(F.radians("lat"), F.radians("lon"), metres)
    points = entries.where("lat IS NOT NULL AND lon IS NOT NULL").select("place_id", "lat", "lon").distinct().join(places, "place_id")
    points = stored(points.withColumns({"row": row, "col": col, "band": band, "cell": cell}), "points")
    block = ["first", "word", "row", "col"]
    lowest = (F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    around = points.select("first", F.explode("words").alias("word"), "row", "col", F.col("place_id").alias("lo"), F.col("place_id").alias("hi")).groupBy(*block).agg(*lowest)
    around = around.withColumn("row", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1))).withColumn("col", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)))
    live = stored(around.groupBy(*block).agg(*lowest).where("lo < hi").select(*block), "blocks")

    def groups(word: Column) -> DataFrame:
        box = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
        return points.withColumn("word", word).join(live, block, "left_semi").groupBy("first", "word", "tokens", "band", "cell").agg(F.collect_set("place_id").alias("places"), F.collect_set(F.struct("lat", "lon")).alias("points"), *box)

    small, large = stored(groups(F.col("rare")), "held"), groups(F.explode("words"))
    large = large.select("first", "word", *(F.col(c).alias(f"__{c}") for c in large.columns if c not in ("first", "word")), F.struct("band", F.col("cell").alias("col")).alias("near"))
    pairs = small.withColumn("near", F.explode(_around(F.col("band"), F.col("cell"), metres))).join(large, ["first", "word", "near"])
    home, alike = (F.col("band") == F.col("__band")) & (F.col("cell") == F.col("__cell")), F.col("tokens") == F.col("__tokens")
    once = ~alike | (F.struct("band", "cell") < F.struct("__band", "__cell"))
    nested = F.size(F.array_except("tokens", "__tokens")) == 0
    d = metres * MARGIN / (math.pi * geo.RADIUS / 180)
    wide = d / F.cos(F.radians(F.least(F.greatest(F.abs("min_lat"), F.abs("max_lat")) + d, F.lit(89.9))))
    close = lambda p: p["lat"].between(F.col("__min_lat") - d, F.col("__max_lat") + d) & p["lon"].between(F.col("__min_lon") - wide, F.col("__max_lon") + wide)
    near = F.exists("points", lambda p: close(p) & F.exists("__points", lambda q: geo.haversine(p["lat"], p["lon"], q["lat"], q["lon"]) <= metres))
    pairs = pairs.withColumns({"a": F.array_min("places"), "b": F.array_min("__places")}).where((F.col("a") != F.col("b")) & once & nested).where(home | near)
    edges = small.select(F.explode("places").alias("a"), F.array_min("places").alias("b")).union(pairs.select("a", "b")).where("a <> b")
    ids = components(edges)
    return entries.join(ids, entries.place_id == ids.node, "left").withColumn("final_id", F.coalesce("component", "place_id")).drop("node", "component")


def clustered(entries: DataFrame) -> DataFrame:
    """Entries (ordinal, id, name, lat, lon, address, priceRange, description) with name_key, geo_id, place_id and final_id."""
    return subset_clusters(stored(postcode_clusters(stored(geo_clusters(keyed(entries)), "geo")), "placed"))


def _first_text(a: Column) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))


def merged(entries: DataFrame) -> DataFrame:
    """One record for each final_id of clustered entries, in the order of ids.

    Further columns taken if there: phone, websiteUrl, googleMapsUrl, entryUrl, pageTitle. Descriptions go
    priced first, then longest; near-identical ones, sources of one entryUrl, and URLs and phones of one
    spelling come once. The name is put together of the dishes it was listed under, the simplest name and what
    the fullest adds. A record holds what differs of the appearances of its place, which is what it is for: of each
    key the first is found by groups of place and key, before any are gathered.
    """
    optional = ["phone", "websiteUrl", "googleMapsUrl", "entryUrl", "pageTitle"]
    rows = entries.withColumns({c: F.lit(None).cast("string") for c in optional if c not in entries.columns})
    first = rows.groupBy("name_key").agg(F.min("ordinal").alias("__name_first"))
    base = F.col("__split.base")
    rows = rows.join(first, "name_key").withColumn("__split", split_name(F.col("name")))
    address = F.trim(text(F.col("address")))
    order = F.struct("__name_first", "place_id", "geo_id", "ordinal", F.col("id").cast("string").alias("id"))  # the order in which clusters came about
    rows = rows.select(
        "final_id", "id", "name", "lat", "lon", "priceRange", "description", *optional, order.alias("at"), F.struct(*primary_order()).alias("rank"), (text(F.col("priceRange")) == "").alias("unpriced"), (-F.length(text(F.col("description")))).alias("length"),
        description_key(F.col("description")).alias("description_key"), F.when(F.trim(text(F.col("websiteUrl"))) != "", dedupe_key(F.col("websiteUrl"))).alias("url_key"), address.alias("address"), (-address_score(address)).alias("address_rank"),
        base.alias("base"), F.struct(word_count(base), is_all_caps(base), F.length(base), in_locale(base), base.alias("b")).alias("simple"), F.col("__split.dish").alias("dish"), F.lower("__split.dish").alias("dish_key"),
    )
    rows = stored(rows, "appearances")
    nothing, filled = F.lit(None).cast("string"), lambda name: F.when(F.col(name).isNotNull() & (F.trim(name) != ""), F.col(name))
    lists = {  # key, what is kept of the first of its key
        "said": (F.col("description_key"), ("description", "pageTitle", "entryUrl")), "listed": (F.col("entryUrl"), ("name", "pageTitle", "entryUrl")), "sites": (F.col("url_key"), ("websiteUrl",)),
        "dishes": (F.col("dish_key"), ("dish",)), "bases": (F.col("base"), ("base",)), "phones": (filled("phone"), ("phone",)),
    }
    kept = lambda k, cs: F.struct(*(F.when(F.lit(k == "said"), F.col(c)).alias(c) for c in ("unpriced", "length")), "at", *((F.col(cs[i]) if i < len(cs) else nothing).alias(n) for i, n in enumerate("abc")))
    items = F.array(*(F.struct(F.lit(k).alias("kind"), key.alias("key"), kept(k, cs).alias("item")) for k, (key, cs) in lists.items()))
    items = rows.select("final_id", F.explode(items).alias("x")).where("x.key <> ''").groupBy("final_id", F.col("x.kind").alias("kind"), F.col("x.key").alias("key")).agg(F.min("x.item").alias("item"))
    lists = items.groupBy("final_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in lists))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("at")))
    ones = rows.groupBy("final_id").agg(
        F.min_by("id", "rank").alias("id"), F.min(F.when(F.col("base") != "", F.col("simple")))["b"].alias("core"), F.min(F.when(F.col("address") != "", F.struct("address_rank", "at", "address")))["address"].alias("address"),
        first(filled("priceRange")).alias("priceRange"), first(filled("googleMapsUrl")).alias("maps"),
    )
    ones = stored(ones, "records")
    p = rows.join(ones.select("final_id", "id"), ["final_id", "id"]).groupBy("final_id").agg(F.min_by(F.struct("name", "lat", "lon", "googleMapsUrl", "entryUrl", "pageTitle", "description"), "at").alias("p"))
    m = ones.join(p, "final_id", "left").join(lists, "final_id", "left")
    m = m.withColumns({k: F.coalesce(k, F.filter(F.array(F.lit(None).cast(lists.schema[k].dataType.elementType)), lambda x: F.lit(False))) for k in lists.columns if k != "final_id"})
    pick = lambda items, **fields: F.transform(items, lambda x: F.struct(*(x[f].alias(n) for n, f in fields.items())))
    m = m.withColumns({"bases": F.col("bases.a"), "phones": F.col("phones.a"), "said": pick("said", text="a", pageTitle="b", entryUrl="c"), "listed": pick("listed", name="a", pageTitle="b", entryUrl="c"), "dishes": pick("dishes", dish="a"), "websiteUrls": F.col("sites.a")})
    m = m.withColumns({"core": F.coalesce("core", split_name(F.col("p.name"))["base"]), "joined": F.array_join("dishes.dish", "/")})
    fullest = F.aggregate("bases", F.col("core"), lambda best, b: F.when(F.startswith(F.lower(b), F.lower("core")) & (F.length(b) > F.length(best)), b).otherwise(best))
    m = m.withColumns({"namePre": F.when((F.size("dishes") > 0) & (F.size("dishes") <= DISHES) & (F.length("joined") <= DISHES_LENGTH), F.concat("joined", F.lit(" at "))).otherwise(F.lit("")), "namePost": F.substr(fullest, F.length("core") + 1)})
    return m.select(
        "id", F.concat("namePre", "core", "namePost").alias("name"), "namePre", F.col("core").alias("nameCore"), "namePost",
        F.coalesce("address", F.lit("")).alias("address"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), "priceRange",
        _first_text(F.col("phones")).alias("phone"), "phones", _first_text(F.col("websiteUrls")).alias("websiteUrl"), "websiteUrls",
        F.when(text(F.col("p.googleMapsUrl")) != "", F.col("p.googleMapsUrl")).otherwise(F.coalesce("maps", F.lit(""))).alias("googleMapsUrl"), F.col("p.entryUrl").alias("entryUrl"), F.col("p.pageTitle").alias("pageTitle"),
        F.coalesce(F.try_element_at(F.col("said.text"), F.lit(1)), F.col("p.description"), F.lit("")).alias("description"), F.col("said").alias("descriptions"), F.col("listed").alias("sources"),
    )


def resolved(entries: DataFrame) -> DataFrame:
    return merged(clustered(entries)).orderBy(in_locale(F.col("id").cast("string")), F.col("id").cast("string"))


def report(entries: DataFrame, places: DataFrame, largest: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts: entries, places, removed, multi_source) and the largest merges (name, sources, descriptions, priceRange)."""
    counts = entries.agg(F.count("*").alias("entries")).join(places.agg(F.count("*").alias("places"), F.count_if(F.size("sources") > 1).alias("multi_source")))
    counts = counts.select("entries", "places", (F.col("entries") - F.col("places")).alias("removed"), "multi_source")
    top = places.select("id", "name", F.size("sources").alias("sources"), F.size("descriptions").alias("descriptions"), "priceRange").orderBy(F.desc("sources"), "id").limit(largest)
    return counts, top
