"""Place search: annotation, filter, ranking, in-view list, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.functions.text import in_locale, joined_lower
from placeloom.operators.positions import numbered

#: Price tiers in the order of the in-view list, then places without one.
TIER_ORDER = ("$$", "$", "$$$", "$$$$")
SEARCH_LIMIT, LIST_LIMIT = 80, 120
# Marker colours and sizes in pixels.
COLOURS = {"$": "#2aa36b", "$$": "#2b7de9", "$$$": "#8c5bd4", "$$$$": "#2c2c2e"}
NO_TIER = "#ef5a43"
VIEW_PADDING, OVERLAP, FAN_MOST, FAN_ZOOM = 48, 26, 12, 14


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def annotate(df: DataFrame) -> DataFrame:
    """Adds numeric lat and lon, the ring offset of places at one coordinate, and the texts to search.

    df: ordinal, name, lat, lon and, if there, address, priceRange, openFor, bestFor, description,
    pageTitle, descriptions, sources. Coordinates that aren't numbers become null; equal ones are
    equal to six decimals. search_text: name, address, tier, notes, descriptions and guide titles,
    lower-cased; name_text and guide_text: its parts for ranking.
    """
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    texts, titles = F.array(_optional(df, "description")), F.array(_optional(df, "pageTitle"))
    if "descriptions" in df.columns:
        texts = F.when(F.size("descriptions") > 0, F.col("descriptions.text")).otherwise(texts)
    if "sources" in df.columns:
        titles = F.when(F.size("sources") > 0, F.col("sources.pageTitle")).otherwise(titles)
    full = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    rows = df.withColumns({"lat": lat, "lon": lon}).withColumn("__at", F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon")))
    rows = numbered(rows, "__at", "ordinal", "__index", "__count")
    offset = geo.ring_offset(F.col("__index"), F.col("__count"))
    return rows.withColumns(
        {
            "offset_x": offset["x"],
            "offset_y": offset["y"],
            "search_text": joined_lower(F.col("name"), _optional(df, "address"), _optional(df, "priceRange"), _optional(df, "openFor"), _optional(df, "bestFor"), F.array_join(full(texts), " "), F.array_join(full(titles), " ")),
            "name_text": F.lower(F.coalesce("name", F.lit(""))),
            "guide_text": F.lower(F.array_join(full(titles), " ")),
        }
    ).drop("__at", "__index", "__count")


def query_text(text: str) -> str:
    return text.strip().lower()


def matching(df: DataFrame, text: str = "", price: str = "all") -> DataFrame:
    """Annotated places of a tier ('all': any) whose text contains the query ('' matches all)."""
    rows = df if price == "all" else df.where(F.col("priceRange") == price)
    return rows if text == "" else rows.where(F.contains("search_text", F.lit(text)))


def ranked(df: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first matches: name hits, then hits of a guide's title, then others, each in input order. Adds hit_tier."""
    tier = F.when(F.contains("name_text", F.lit(text)), 0).when(F.contains("guide_text", F.lit(text)), 1).otherwise(2)
    return df.withColumn("hit_tier", tier).orderBy("hit_tier", "ordinal").limit(limit)


def search(df: DataFrame, text: str, price: str = "all", limit: int = SEARCH_LIMIT) -> DataFrame:
    text = query_text(text)
    return ranked(matching(df, text, price), text, limit)


def tier_rank(price: Column) -> Column:
    case = F.when(price == TIER_ORDER[0], 0)
    for k, tier in enumerate(TIER_ORDER[1:], 1):
        case = case.when(price == tier, k)
    return case.otherwise(len(TIER_ORDER))


def in_view(df: DataFrame, box: tuple[float, float, float, float] | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Places in a box (west, south, east, north; None: all) by tier, distance to the city's centre and name. Adds metres."""
    rows = df.where(geo.has_coordinates(F.col("lat"), F.col("lon")))
    if box:
        rows = rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    rows = rows.withColumn("metres", geo.haversine(F.lit(geo.CITY_LAT), F.lit(geo.CITY_LON), F.col("lat"), F.col("lon")))
    return rows.orderBy(tier_rank(F.col("priceRange")), "metres", in_locale(F.col("name")), "name", "ordinal").limit(limit)


def overflow(df: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(visible, more): places there are and how many the list leaves out."""
    return df.agg(F.count("*").alias("visible")).select("visible", F.greatest(F.lit(0).cast("long"), F.col("visible") - limit).alias("more"))


def by_id(df: DataFrame, place_id: str) -> DataFrame:
    return df.where(F.col("id") == place_id)


def marker_colour(price: Column) -> Column:
    case = None
    for tier, colour in COLOURS.items():
        case = F.when(price == tier, colour) if case is None else case.when(price == tier, colour)
    return case.otherwise(NO_TIER)


def marker_detail(zoom: Column) -> Column:
    return F.when(zoom >= 14, "full").when(zoom >= 12, "mid").otherwise("small")


def on_screen(df: DataFrame, centre_lat: float, centre_lon: float, zoom: float, width: int, height: int, padding: int = VIEW_PADDING, ringed: bool = True) -> DataFrame:
    """Places drawn on a screen of this size, padded; adds x and y in pixels: with the ring offset as drawn, without it where the place is."""
    p = geo.mercator(F.col("lat"), F.col("lon"), zoom)
    c = geo.mercator(F.lit(centre_lat), F.lit(centre_lon), zoom)
    x, y = p["x"] - c["x"] + width / 2, p["y"] - c["y"] + height / 2
    rows = df.where(geo.has_coordinates(F.col("lat"), F.col("lon"))).withColumns({"x": x + F.col("offset_x"), "y": y + F.col("offset_y")} if ringed else {"x": x, "y": y})
    return rows.where(F.col("x").between(-padding, width + padding) & F.col("y").between(-padding, height + padding))


def drawing_order(df: DataFrame, selected: str | None = None, fanned: tuple[str, ...] = ()) -> DataFrame:
    """Markers on screen in the order in which they are drawn: adds layer, 0 without a tier, 1 with one, 2 the selected.

    Within a layer the northern ones come first, so that each overlaps the one behind it; members of a fan aren't drawn here.
    """
    rows = df.where(~F.col("id").isin(*fanned)) if fanned else df
    layer = F.when(F.col("id") == F.lit(selected), 2).when(F.coalesce("priceRange", F.lit("")) != "", 1).otherwise(0)
    return rows.withColumn("layer", layer).orderBy("layer", "y", "ordinal")


def tap_candidates(df: DataFrame, x: float, y: float, reach: float, tolerance: float = 4.0) -> DataFrame:
    """Places on screen within reach of a tap: by steps of ``tolerance`` pixels, in a step priced first, then by distance.

    A comparison that calls distances equal within a tolerance isn't an order; steps are one.
    """
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    rows = df.withColumn("pixels", d).where(F.col("pixels") <= reach)
    return rows.orderBy(F.floor(F.col("pixels") / tolerance), F.col("priceRange").isNull(), "pixels", "ordinal")


def overlapping(df: DataFrame, seed_x: float, seed_y: float, overlap: float = OVERLAP, most: int = FAN_MOST) -> DataFrame:
    """The places whose markers overlap the seed's, the closest first; not chained over others."""
    return tap_candidates(df, seed_x, seed_y, overlap, 0.5).limit(most)


def fan(df: DataFrame) -> DataFrame:
    """Members of a fan with their slots on the ring: adds slot, slot_x, slot_y."""
    every = Window.orderBy("pixels", "ordinal")  # FAN_MOST members at most
    rows = df.withColumns({"slot": F.row_number().over(every) - 1, "__n": F.count("*").over(Window.partitionBy())})
    place = F.element_at(geo.fan_slots(F.col("__n")), F.col("slot").cast("int") + 1)
    return rows.withColumns({"slot_x": place["x"], "slot_y": place["y"]}).drop("__n")


def pruned_fan(df: DataFrame, anchor: str, selected: str | None, overlap: float = OVERLAP) -> DataFrame:
    """What stays of a fan: the anchor, the selected and members that overlap the anchor; none if but one is left."""
    a = df.where(F.col("id") == anchor).select(F.col("x").alias("__x"), F.col("y").alias("__y"))
    near = F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) <= overlap
    kept = df.join(F.broadcast(a), how="left").where((F.col("id") == anchor) | (F.col("id") == F.lit(selected)) | near).drop("__x", "__y")
    return kept.withColumn("__n", F.count("*").over(Window.partitionBy())).where("__n > 1").drop("__n")
