"""Saved pages to tables: one Python pass over each page's HTML, the rest relational.

The page's own nested document stays JSON text; its fields are taken out by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import html
from placeloom.functions.text import first_existing
from placeloom.functions.url import domain, entry_anchor, entry_id, maps_search, page_id, part, query_value, slug, urls_in_text, venue_url
from placeloom.sources.readers import json_list

#: Columns of the pages table that are a field of the page's document: name -> path.
PAGE_FIELDS = {
    "page_global_id": "globalId", "page_wp_id": "wpId", "page_chorus_id": "chorusId", "page_chorus_uuid": "chorusUuid", "page_title": "title", "primary_category_title": "primaryCategory.title", "primary_category_id": "primaryCategory.id",
    "original_published_at": "originalPublishedAt", "published_at": "publishedAt", "created_at": "createdAt", "updated_at": "updatedAt", "word_count": "wordCount", "status": "status", "resource_type": "resourceType",
}
#: Columns of the entries table that are a field of the map point.
ENTRY_FIELDS = {
    "restaurant_name": "name", "address": "address", "venue_address": "venue.address", "sevenrooms_reservation_url": "venue.sevenrooms.reservationWidgetUrl", "sevenrooms_url_key": "venue.sevenrooms.urlKey",
    "sevenrooms_venue_string_id": "venue.sevenrooms.venueStringId", "opentable_reservation_url": "venue.opentable.naturalReservationUrl", "safegraph_booking_url": "venue.safegraph.bookingLink",
    "venue_id": "venue.id", "venue_global_id": "venue.globalId", "venue_slug": "venue.slug", "venue_title": "venue.title",
}

def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def _thumbnail(json: Column, media: str, shape: str) -> Column:
    return F.coalesce(_at(json, f"{media}.image.thumbnails.{shape}.url"), _at(json, f"{media}.thumbnails.{shape}.url"))


def _texts(json: Column, path: str, field: str) -> Column:
    """Non-empty values of a field of a list of objects, as a JSON list."""
    rows = F.from_json(_at(json, path), "array<string>")
    values = F.filter(F.transform(rows, lambda r: F.get_json_object(r, f"$.{field}")), lambda v: v.isNotNull() & (v != ""))
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def parsed(pages: DataFrame, own_domain: str = "") -> DataFrame:
    """pages (path, html, meta) with p: the parts of each page, and its cards. The only Python step but for descriptions."""
    rows = pages.withColumn("p", html.parts(F.col("html")))
    return rows.withColumn("p", F.col("p").withField("cards", html.told_apart(F.col("p.found"), own_domain)))


def page_table(rows: DataFrame) -> DataFrame:
    """The pages table; a page that can't be read keeps what its sidecar tells and has parse_error set."""
    d, meta, head = F.col("p.resource"), (lambda n: _at(F.col("meta"), n)), (lambda n: F.try_element_at("p.properties", F.lit(n)))
    url = F.coalesce(F.nullif(_at(d, "permalink"), F.lit("")), F.nullif(meta("final_url"), F.lit("")), meta("url"))
    fields = [_at(d, x).alias(n) for n, x in PAGE_FIELDS.items()]
    points = F.coalesce(F.json_array_length(_at(d, "mapPoints")), F.lit(0))
    return rows.select(
        page_id(_at(d, "globalId"), _at(d, "id"), F.coalesce(url, "path")).alias("page_id"), *fields,
        first_existing(_at(d, "seo.headline"), _at(d, "promo.headline"), head("og:title"), F.col("p.title")).alias("page_headline"),
        first_existing(_at(d, "social.headline"), head("og:title")).alias("page_social_headline"), url.alias("page_url"),
        first_existing(F.col("p.canonical"), meta("canonical_url"), _at(d, "canonicalUrlOverride")).alias("page_canonical_url"),
        F.coalesce(meta("input_data.url"), meta("url")).alias("page_input_url"), meta("final_url").alias("page_final_url"), slug(url).alias("page_slug"),
        first_existing(_at(d, "seo.description"), _at(d, "social.description"), F.try_element_at("p.names", F.lit("description"))).alias("page_description"),
        F.col("p.dek_text").alias("page_dek_text"), F.col("p.overview_text").alias("page_overview_text"), F.col("p.overview_html").alias("page_overview_html"),
        _texts(d, "authors", "name").alias("author_names_json"), _texts(d, "authors", "permalink").alias("author_urls_json"), _texts(d, "categories", "title").alias("category_titles_json"), _texts(d, "categories", "slug").alias("category_slugs_json"), _texts(d, "superCats", "title").alias("super_category_titles_json"),
        head("article:modified_time").alias("modified_at_meta"), meta("fetched_at").alias("fetched_at"),
        *(_thumbnail(d, m, s).alias(f"{n}_image_{s}_url") for n, m in (("lede", "ledeMedia"), ("promo", "promo.image")) for s in ("horizontal", "square")), head("og:image").alias("og_image_url"),
        points.alias("map_point_count"), F.coalesce(F.size("p.cards"), F.lit(0)).alias("rendered_map_card_count"), F.coalesce("p.n_items", F.lit(0)).alias("jsonld_item_count"), F.size(F.coalesce("p.candidates", F.array().cast("array<string>"))).alias("candidate_count"),
        F.col("path").alias("source_html_path"), F.when(F.col("meta") != "{}", F.concat("path", F.lit(".meta.json"))).otherwise("").alias("source_meta_path"), meta("status_code").cast("int").alias("status_code"), meta("content_type").alias("content_type"), meta("content_length").cast("long").alias("content_length"), meta("sha256").alias("sha256"),
        d.alias("raw_page_json"), F.col("meta").alias("raw_meta_json"), F.col("p.listed_json").alias("raw_jsonld_json"), F.col("p.error").alias("parse_error"),
    )


def _card(cards: Column, fragment: Column, venue_slug: Column, position: Column) -> Column:
    """The card of an entry: by the last id that is the slug, else the first data-slug; fragment, venue, then place in order."""
    by_id = lambda k: F.try_element_at(F.filter(cards, lambda c: c["slug"] == k), F.lit(-1))
    by_data = lambda k: F.try_element_at(F.filter(cards, lambda c: c["data_slug"] == k), F.lit(1))
    known = lambda k: F.when(k != "", F.coalesce(by_id(k), by_data(k)))
    return F.coalesce(known(fragment), known(venue_slug), F.try_element_at(cards, position))


def entry_table(rows: DataFrame) -> DataFrame:
    """The entries table, one row for each map point that is an object; positions count all points."""
    d, meta = F.col("p.resource"), (lambda n: _at(F.col("meta"), n))
    url = F.coalesce(F.nullif(_at(d, "permalink"), F.lit("")), F.nullif(meta("final_url"), F.lit("")), meta("url"))
    points = rows.select(
        page_id(_at(d, "globalId"), _at(d, "id"), F.coalesce(url, "path")).alias("page_id"), url.alias("page_url"), F.col("path").alias("source_html_path"), F.col("p.cards").alias("cards"), F.col("p.items").alias("items"),
        F.posexplode(F.from_json(_at(d, "mapPoints"), "array<string>")).alias("at", "raw_point_json"),
    ).where(F.startswith(F.col("raw_point_json"), F.lit("{")))
    x = F.col("raw_point_json")
    e = points.select("page_id", "page_url", "source_html_path", "cards", (F.col("at") + 1).alias("entry_position"), x, F.try_element_at(F.filter("items", lambda i: i["position"] == F.col("at") + 1), F.lit(-1)).alias("item"), *(_at(x, f).alias(n) for n, f in ENTRY_FIELDS.items()))
    e = e.withColumns({"entry_anchor_url": entry_anchor(F.col("page_url"), F.col("venue_slug"), F.col("item.url")), "d": html.description(x), "latitude": _at(x, "location.latitude"), "longitude": _at(x, "location.longitude")})
    e = e.withColumn("entry_fragment", F.coalesce(F.nullif(part(F.col("entry_anchor_url"), "fragment"), F.lit("")), "venue_slug"))
    e = e.withColumn("card", _card(F.col("cards"), F.coalesce("entry_fragment", F.lit("")), F.coalesce("venue_slug", F.lit("")), F.col("entry_position")))
    own, made = F.nullif("card.google_maps_url", F.lit("")), maps_search(F.col("latitude"), F.col("longitude"), F.col("address"))
    campaign = F.coalesce(_at(x, "campaignCustomLink.url"), _at(x, "campaignCustomLink.href"), F.when(~F.startswith(_at(x, "campaignCustomLink"), F.lit("{")), _at(x, "campaignCustomLink")))
    offers = [("sevenrooms", F.col("sevenrooms_reservation_url")), ("opentable", F.col("opentable_reservation_url")), ("safegraph", F.col("safegraph_booking_url")), ("campaign_custom_link", campaign), ("rendered_map_card", F.col("card.booking_url"))]
    provider = None
    for name, link in offers:
        there = F.coalesce(link, F.lit("")) != ""
        provider = F.when(there, name) if provider is None else provider.when(there, name)
    labels = [F.col(f"d.{c}").alias(c) for c in ("price_range", "open_for", "best_for", "must_try_dish", "know_before_you_go", "outdoor_seating", "additional_location_notes")]
    posts = [_texts(x, "venue.posts.nodes", f) for f in ("permalink", "title")]
    return e.select(
        entry_id(F.col("page_id"), F.col("entry_position")).alias("entry_id"), "page_id", "page_url", "entry_position", "entry_anchor_url", "entry_fragment", "restaurant_name", F.lit(None).cast("string").alias("entry_subtitle"),
        F.col("d.text").alias("description_text"), F.col("d.html").alias("description_html"), "address", "venue_address", F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.coalesce(own, made["url"]).alias("google_maps_search_url"), F.coalesce(query_value(own, "query"), made["query"]).alias("google_maps_query"),
        F.when(own.isNotNull(), "source_html").when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "generated_coordinates").otherwise("generated_address").alias("google_maps_link_source"), F.col("card.google_maps_url").alias("source_google_maps_url"),
        first_existing(_at(x, "url"), F.col("card.website_url")).alias("website_url"), first_existing(_at(x, "phone"), F.col("card.phone_number")).alias("phone_number"), *labels, F.col("d.notes").alias("structured_notes_json"),
        first_existing(*(link for _, link in offers)).alias("booking_url"), provider.alias("booking_provider"), *(c for c in ENTRY_FIELDS if c.startswith(("sevenrooms", "opentable", "safegraph"))), campaign.alias("campaign_custom_link_url"),
        "venue_id", "venue_global_id", "venue_slug", "venue_title", venue_url(F.col("page_url"), F.col("venue_slug")).alias("guide_venue_url"),
        *(_thumbnail(x, m, s).alias(f"{n}_image_{s}_url") for n, m in (("point", "ledeMedia"), ("venue", "venue.ledeMedia")) for s in ("horizontal", "square")),
        F.size(json_list(posts[0])).alias("venue_related_posts_count"), posts[0].alias("venue_related_post_urls_json"), posts[1].alias("venue_related_post_titles_json"),
        F.col("card.raw").alias("rendered_card_json"), "raw_point_json", _at(x, "venue").alias("raw_venue_json"), F.lit("pending").alias("validation_status"), "source_html_path", F.col("item.name").alias("jsonld_name"), F.col("d.links").alias("description_links"),
    )


PAGE_LINKS = {"page_url": "page_url", "page_canonical_url": "page_url", "lede_image_horizontal_url": "page_asset", "lede_image_square_url": "page_asset", "promo_image_horizontal_url": "page_asset", "promo_image_square_url": "page_asset", "og_image_url": "page_asset"}
ENTRY_LINKS = {"entry_anchor_url": "entry_anchor", "website_url": "restaurant_website", "google_maps_search_url": "", "booking_url": "booking", "guide_venue_url": "generated_venue", "point_image_horizontal_url": "entry_image", "point_image_square_url": "entry_image", "venue_image_horizontal_url": "venue_image", "venue_image_square_url": "venue_image"}


def _link(field: str, kind: Column, url: Column, words: Column | None = None) -> Column:
    return F.struct(F.lit(field).alias("source_field"), kind.alias("link_kind"), url.alias("url"), F.coalesce(F.lit("") if words is None else words, F.lit("")).alias("link_text"))


def _all(field: str, kind: str, urls: Column) -> Column:
    return F.transform(urls, lambda u: _link(field, F.lit(kind), u))


def link_table(rows: DataFrame, pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(scope, page_id, entry_id, source_field, link_kind, url, link_text, domain, is_external) of all links that have a URL."""
    body = rows.select(F.col("path").alias("source_html_path"), F.coalesce("p.overview_links", F.array().cast("array<struct<url: string, text: string, target: string>>")).alias("b"))
    own = F.array(*(_link(f, F.lit(k), F.col(f)) for f, k in PAGE_LINKS.items()))
    lists = F.concat(F.transform("b", lambda x: _link("page_overview_html", F.lit("body_link"), x["url"], x["text"])), own, _all("author_urls_json", "author", json_list(F.col("author_urls_json"))))
    of_page = pages.where("parse_error IS NULL").join(body, "source_html_path").select(F.lit("page").alias("scope"), "page_id", F.lit(None).cast("string").alias("entry_id"), "page_url", F.explode(lists).alias("l"))
    maps = F.when(F.col("google_maps_link_source") == "source_html", "source_google_maps").otherwise("generated_google_maps_search")
    own = F.array(*(_link(f, F.lit(k) if k else maps, F.col(f)) for f, k in ENTRY_LINKS.items()))
    inline = F.concat(*(_all(f, "inline_url", urls_in_text(F.col(f))) for f in ("description_text", "address", "venue_address")))
    lists = F.concat(F.transform("description_links", lambda x: _link("description_html", F.lit("body_link"), x["url"], x["text"])), own, _all("venue_related_post_urls_json", "venue_related_post", json_list(F.col("venue_related_post_urls_json"))), inline)
    of_entry = entries.select(F.lit("entry").alias("scope"), "page_id", "entry_id", "page_url", F.explode(lists).alias("l"))
    every = of_page.unionByName(of_entry).select("scope", "page_id", "entry_id", "page_url", "l.*").where(F.coalesce("url", F.lit("")) != "")
    home = domain(F.col("page_url"))
    return every.select("scope", "page_id", "entry_id", "source_field", "link_kind", "url", "link_text", domain(F.col("url")).alias("domain"), F.when((home != "") & (domain(F.col("url")) == home), 0).otherwise(1).alias("is_external"))


def parse_failures(pages: DataFrame) -> DataFrame:
    """An error issue for each page that couldn't be read."""
    return pages.where("parse_error IS NOT NULL").select("page_id", F.lit(None).cast("string").alias("entry_id"), F.lit(-1).alias("rule"), F.lit("error").alias("severity"), F.lit("page_parse_failed").alias("issue_code"), F.lit("source_html_path").alias("field_name"), F.col("parse_error").alias("message"), F.col("source_html_path").alias("source_value"))


def run_summary(pages: DataFrame, entries: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: pages, entries, entries needing review, issues by severity (a map)."""
    bad = issues.where(F.col("severity").isin("error", "warning") & F.col("entry_id").isNotNull()).agg(F.count_distinct("entry_id").alias("entries_needing_review"))
    by = issues.groupBy("severity").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("issues"))
    return pages.agg(F.count("*").alias("pages")).join(entries.agg(F.count("*").alias("entries"))).join(bad).join(by)
