"""From scraped tables to the public dataset, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.text import empty_to_null, half_even
from placeloom.sources.readers import json_list
from placeloom.storage import stored

TEXTS = {
    "id": "e.entry_id", "name": "e.restaurant_name", "entryUrl": "coalesce(e.entry_anchor_url, p.page_url)", "pageTitle": "p.page_title", "description": "e.description_text",
    "address": "coalesce(e.address, e.venue_address)", "googleMapsUrl": "coalesce(e.google_maps_search_url, e.source_google_maps_url)", "websiteUrl": "e.website_url", "phone": "e.phone_number",
    "priceRange": "e.price_range", "openFor": "e.open_for", "bestFor": "e.best_for", "mustTryDish": "e.must_try_dish", "knowBeforeYouGo": "e.know_before_you_go", "outdoorSeating": "e.outdoor_seating",
    "additionalLocationNotes": "e.additional_location_notes", "bookingUrl": "e.booking_url", "bookingProvider": "e.booking_provider",
}
#: The order of the public dataset, which later steps depend on.
ORDER = ("restaurant_name", "page_title", "entry_position")


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def public_places(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with coordinates and a name, with their page: 20 columns, texts trimmed and '' null, coordinates to six decimals by their exact value, ties to even.

    The pages' keys are unique, so the join keeps the entries' number.
    """
    rows = entries.alias("e").join(pages.alias("p"), F.expr("e.page_id = p.page_id")).where("e.latitude IS NOT NULL AND e.longitude IS NOT NULL AND e.restaurant_name IS NOT NULL")
    cols = [empty_to_null(F.expr(x)).alias(n) for n, x in TEXTS.items()]
    return rows.select(*(F.col(f"{'p' if o == 'page_title' else 'e'}.{o}").alias(f"__{o}") for o in ORDER), *cols, *(half_even(F.col(f"e.{a}itude"), 6).alias(b) for a, b in (("lat", "lat"), ("long", "lon"))))


def in_order(places: DataFrame) -> DataFrame:
    """Public places in their order, with it as ordinal."""
    key = [F.asc_nulls_first(f"__{o}") for o in ORDER]
    rows = places.orderBy(*key, "id")
    # a number that grows in the order, without bringing all rows to one task
    return rows.withColumn("ordinal", F.monotonically_increasing_id()).drop(*(f"__{o}" for o in ORDER))


def ranked(places: DataFrame) -> DataFrame:
    """Public places with their place in the order, from 1, by counts of the sorted partitions."""
    rows = stored(in_order(places), "order")  # sorted once: the partitions stay as they are counted
    part = F.shiftright("ordinal", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    lower = counts.select(F.col("part").alias("other"), "n")
    before = counts.select("part").join(F.broadcast(lower), F.col("other") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    own = rows.withColumn("part", part).join(F.broadcast(before), "part")  # a row for each partition
    return own.withColumn("place", F.col("before") + F.col("ordinal").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "ordinal")


def as_table(places: DataFrame) -> DataFrame:
    return places.select(*(F.col(c).alias(snake(c)) for c in places.columns if not c.startswith("__") and c != "ordinal"))


#: Columns of the wide export and of the table they are from, e: entries, p: pages.
WIDE = {
    "id": "e.entry_id", "name": "e.restaurant_name", "position": "e.entry_position", "entryUrl": "e.entry_anchor_url", "pageId": "p.page_id", "pageTitle": "p.page_title", "pageUrl": "p.page_url",
    "pageDescription": "p.page_description", "publishedAt": "p.published_at", "modifiedAt": "p.modified_at_meta", "address": "e.address", "venueAddress": "e.venue_address", "googleMapsUrl": "e.google_maps_search_url",
    "googleMapsSource": "e.google_maps_link_source", "sourceGoogleMapsUrl": "e.source_google_maps_url", "websiteUrl": "e.website_url", "phone": "e.phone_number", "priceRange": "e.price_range", "openFor": "e.open_for",
    "bestFor": "e.best_for", "mustTryDish": "e.must_try_dish", "knowBeforeYouGo": "e.know_before_you_go", "outdoorSeating": "e.outdoor_seating", "additionalLocationNotes": "e.additional_location_notes",
    "bookingUrl": "e.booking_url", "bookingProvider": "e.booking_provider", "venueUrl": "e.guide_venue_url", "venueSlug": "e.venue_slug", "venueTitle": "e.venue_title",
}
WIDE_LISTS = {"categories": "p.category_titles_json", "relatedPostUrls": "e.venue_related_post_urls_json", "relatedPostTitles": "e.venue_related_post_titles_json"}


def wide_places(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """The older export, 35 columns of the tables of ``plans.pages``: only coordinates are needed, addresses as they are, missing
    descriptions '', lists from JSON. A column that a table lacks is an error.
    """
    rows = entries.alias("e").join(pages.alias("p"), F.expr("e.page_id = p.page_id")).where("e.latitude IS NOT NULL AND e.longitude IS NOT NULL")
    numbers = [F.col(f"e.{a}itude").cast("double").alias(b) for a, b in (("lat", "lat"), ("long", "lon"))]
    lists = [json_list(F.col(c)).alias(n) for n, c in WIDE_LISTS.items()]
    return rows.select(*(F.col(c).alias(n) for n, c in WIDE.items()), F.coalesce("e.description_text", F.lit("")).alias("description"), *numbers, *lists)


def price_counts(df: DataFrame, price: Column) -> DataFrame:
    """(price, places); places without a tier are none."""
    return df.groupBy(F.coalesce(price, F.lit("none")).alias("price")).agg(F.count("*").alias("places"))


def bounds(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row of extremes; of no rows all are null."""
    return df.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def statistics(places: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: page_count, entry_count, bounds and price_counts (a map)."""
    counts = price_counts(places, F.col("priceRange")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("price", "places")))).alias("price_counts"))
    one = places.agg(F.count("*").alias("entry_count"), F.struct(F.min("lat").alias("minLat"), F.max("lat").alias("maxLat"), F.min("lon").alias("minLon"), F.max("lon").alias("maxLon")).alias("bounds"))
    return one.join(pages.agg(F.count("*").alias("page_count"))).join(counts)


def region_cells(points: DataFrame) -> DataFrame:
    from placeloom.functions.geo import region_cell

    return points.select(region_cell(F.col("lat"), F.col("lon")).alias("c")).select("c.*").distinct()
