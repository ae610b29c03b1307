"""Sources: CSV, sitemaps, saved pages with sidecars, JSON payloads, GeoJSON and OSM elements."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.geo import has_coordinates
from placeloom.functions.url import normalize_url
from placeloom.sources.split import csv_records, json_items, parsed_csv
from placeloom.storage import stored

MOST_SITEMAPS = 20_000


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with an ordinal from 0 on without gaps: by file path, then by place in the file; a byte order mark is dropped.

    A quote in a quoted value is written twice. A file is read by many tasks, though values may hold line breaks.
    """
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    rows = csv_records(spark, path).select(parsed_csv(F.col("text"), columns).alias("r"), "ordinal")
    return rows.select(*(F.col("r")[c].alias(c.lstrip("\ufeff")) for c in columns), "ordinal")


def _inflated(content: bytes | None) -> bytes:
    if content and content[:2] == b"\x1f\x8b":
        try:
            return zlib.decompress(content, 31)
        except zlib.error:
            return b""
    return content or b""


def inflated_text(content: Column) -> Column:
    """Binary as UTF-8 text, unpacked first if it is gzip; what isn't UTF-8 becomes U+FFFD."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([_inflated(v).decode("utf-8", "replace") for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(content)


def saved_pages(spark: SparkSession, folder: str, glob: str = "*.html.gz") -> DataFrame:
    """(path, html, meta) of saved pages below a folder; meta: text of path.meta.json, '{}' if there is none.

    A folder without saved pages is a FileNotFoundError.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if read.option("pathGlobFilter", glob).load(folder).select("path").isEmpty():  # contents aren't read for it
        raise FileNotFoundError(f"no files {glob} below {folder}")
    pages = read.option("pathGlobFilter", glob).load(folder).select("path", inflated_text(F.col("content")).alias("html"))
    meta = read.option("pathGlobFilter", "*.meta.json").load(folder).select(F.regexp_replace("path", "\\.meta\\.json$", "").alias("path"), F.col("content").cast("string").alias("meta"))
    return pages.join(meta, "path", "left").withColumn("meta", F.coalesce("meta", F.lit("{}")))


def sitemap_locations(xml: Column) -> Column:
    """struct(kind, locs) of a sitemap: the root's local name, and its locations without white space around."""
    body = F.regexp_replace(xml, "^\\s*(<\\?[^>]*\\?>\\s*|<!--.*?-->\\s*)*", "")
    kind = F.regexp_extract(body, "^<(?:[\\w.-]+:)?([\\w.-]+)", 1)
    locs = F.xpath(F.when(kind != "", body), F.lit("//*[local-name()='loc']/text()"))
    return F.struct(kind.alias("kind"), F.filter(F.transform(locs, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "").alias("locs"))


def crawled(documents: DataFrame, roots: DataFrame, most: int = MOST_SITEMAPS) -> DataFrame:
    """(url, is_sitemap): what the roots list, over all sitemaps that indexes name.

    documents: url, xml - the fetched sitemaps; roots: url. A sitemap is visited once, so circles end; one that
    isn't there counts as visited; more than ``most`` is an error. The frontier stays a table.
    """
    docs = stored(documents.select(normalize_url(F.col("url"), False).alias("url"), sitemap_locations(F.col("xml")).alias("s")).dropDuplicates(["url"]), "sitemaps")
    new = stored(roots.select(normalize_url(F.col("url"), False).alias("url")).distinct(), "frontier")
    seen = new
    while not new.isEmpty():
        if seen.count() > most:
            raise RuntimeError(f"more than {most} sitemaps")
        listed = docs.join(new, "url", "left_semi").where("s.kind = 'sitemapindex'").select(F.explode("s.locs").alias("loc"))
        found = listed.select(normalize_url(F.col("loc"), False).alias("url")).distinct()
        new = stored(found.join(seen, "url", "left_anti"), "frontier")
        seen = stored(seen.union(new), "seen")
    content = docs.join(seen, "url", "left_semi").where("s.kind = 'urlset'").select(F.explode("s.locs").alias("loc")).select(normalize_url(F.col("loc"), False).alias("url")).distinct()
    return content.select("url", F.lit(False).alias("is_sitemap")).union(seen.select("url", F.lit(True).alias("is_sitemap")))


PLACE = (
    "id string, name string, entryUrl string, pageTitle string, description string, address string, lat string, lon string, googleMapsUrl string, websiteUrl string, phone string, priceRange string, "
    "openFor string, bestFor string, mustTryDish string, knowBeforeYouGo string, outdoorSeating string, additionalLocationNotes string, bookingUrl string, bookingProvider string, "
    "descriptions array<struct<text: string, pageTitle: string, entryUrl: string>>, sources array<struct<name: string, pageTitle: string, entryUrl: string>>"
)


def _items(spark: SparkSession, path: str, key: str, kind: str, parts: bool = False) -> DataFrame:
    """(ordinal, r): the items of a list of the root object, read by many tasks; parts as for json_items()."""
    return json_items(spark, path, key, parts).select("ordinal", F.from_json("text", kind).alias("r"))


def places_payload(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Places of a payload {stats, bounds, restaurants}, with an ordinal in its order; lat and lon as doubles."""
    rows = _items(spark, path, "restaurants", f"struct<{PLACE}>", parts).select("ordinal", "r.*")
    return rows.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})


def geojson_features(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(ordinal, properties, type, point, line, lines) of a feature collection; of the last three the one of its type is set."""
    kind = "struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
    rows = _items(spark, path, "features", kind, parts).select("ordinal", F.col("r.properties").alias("properties"), F.col("r.geometry.type").alias("type"), F.col("r.geometry.coordinates").alias("c"))
    as_ = lambda t, k: F.when(F.col("type") == t, F.from_json("c", k)).alias({"Point": "point", "LineString": "line", "MultiLineString": "lines"}[t])
    return rows.select("ordinal", "properties", "type", as_("Point", "array<double>"), as_("LineString", "array<array<double>>"), as_("MultiLineString", "array<array<array<double>>>"))


def station_features(features: DataFrame) -> DataFrame:
    """(ordinal, name, lon, lat) of station points with a name and coordinates."""
    rows = features.where(F.col("properties").getItem("station") == "true").select("ordinal", F.trim(F.col("properties").getItem("name")).alias("name"), F.try_element_at("point", F.lit(1)).alias("lon"), F.try_element_at("point", F.lit(2)).alias("lat"))
    return rows.where((F.col("name") != "") & has_coordinates(F.col("lat"), F.col("lon")))


OSM = "type string, id long, lat double, lon double, tags map<string,string>, geometry array<struct<lat: double, lon: double>>, members array<struct<type: string, ref: long, role: string, lat: double, lon: double, geometry: array<struct<lat: double, lon: double>>>>"


def osm_elements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Elements of a saved map query, with an ordinal in its order."""
    return _items(spark, path, "elements", f"struct<{OSM}>", parts).select("ordinal", "r.*")


def path_of(geometry: Column) -> Column:
    return F.transform(F.filter(geometry, lambda p: p.isNotNull()), lambda p: F.array(p["lon"], p["lat"]))


def json_list(text: Column) -> Column:
    """A JSON list of texts; anything else is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
