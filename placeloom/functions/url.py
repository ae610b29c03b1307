"""URL functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions.text import safe_slug, text, trimmed

# Other services' addresses and names.
MAPS_SEARCH = "https://www.google.com/maps/search/?api=1&query="
TRANSIT_PACKAGE = "com.citymapper.app.release"
TRANSIT_WEB = "https://citymapper.com/directions?"
TRANSIT_STORE = "https://play.google.com/store/apps/details?id=" + TRANSIT_PACKAGE
GEOCODER = "https://nominatim.openstreetmap.org/search?"
VIEWBOX = "-0.62,51.75,0.35,51.25"

#: scheme, authority, path, query, fragment of RFC 3986.
_PARTS = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


def part(url: Column, which: str) -> Column:
    """scheme, authority, path, query or fragment as written; '' if there is none."""
    return F.regexp_extract(text(url), _PARTS, {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[which])


def _path(url: Column) -> Column:
    path = part(url, "path")
    return F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def normalize_url(url: Column, keep_query: bool = True) -> Column:
    """Scheme and host lower-cased, no fragment, no slashes at the path's end but the root's.

    With keep_query the query stays and a missing scheme is https; without it the query goes and
    a missing scheme stays missing.
    """
    u = trimmed(url)
    scheme = F.lower(part(u, "scheme"))
    if keep_query:
        scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    head = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    host = F.lower(part(u, "authority"))
    slashes = F.when((host != "") | scheme.isin("http", "https"), F.concat(F.lit("//"), host)).otherwise(F.lit(""))
    query = part(u, "query")
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")) if keep_query else F.lit("")
    return F.concat(head, slashes, _path(u), tail)


def domain(url: Column) -> Column:
    return F.lower(part(url, "authority"))


def is_http(url: Column) -> Column:
    return part(url, "scheme").isin("http", "https") & (part(url, "authority") != "")


def same_url(a: Column, b: Column) -> Column:
    """Scheme and host compared without case, paths without slashes at their ends; queries don't count."""
    key = lambda u: F.when(text(u) == "", F.lit("")).otherwise(F.concat(F.lower(part(u, "scheme")), F.lit("://"), domain(u), F.regexp_replace(part(u, "path"), "/+$", "")))
    return key(a) == key(b)


def dedupe_key(url: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(F.lower(text(url)), "^https?://", ""), "^www\\.", "")
    return F.regexp_replace(u, "/+$", "")


def slug(url: Column) -> Column:
    """The last part of the path."""
    return F.element_at(F.split(F.regexp_replace(part(url, "path"), "/+$", ""), "/"), -1)


def query_value(url: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, decoded; null if there is none."""
    values = F.transform(F.filter(F.split(part(url, "query"), "&"), lambda p: F.startswith(p, F.lit(name + "="))), lambda p: F.try_url_decode(F.substring(p, len(name) + 2, 1 << 30)))
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def urls_in_text(c: Column) -> Column:
    """http and https URLs in a text, without closing punctuation."""
    return F.transform(F.regexp_extract_all(text(c), F.lit("https?://[^\\s<>()]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[).,;\"']+$", ""))


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    e = F.regexp_replace(F.url_encode(text(c)), "\\+", "%20")
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(plain))
    return e


def encode_form(c: Column) -> Column:
    """Percent-encoding of forms: spaces become +, and ~ is encoded."""
    return F.url_encode(text(c))


def maps_search(lat: Column, lon: Column, address: Column) -> Column:
    """struct(url, query): by coordinates with seven decimals, else by address; both null without either."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    query = F.when(y.isNotNull() & x.isNotNull(), F.format_string("%.7f,%.7f", y, x)).otherwise(F.nullif(text(address), F.lit("")))
    encoded = F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A"))
    return F.struct(F.concat(F.lit(MAPS_SEARCH), encoded).alias("url"), query.alias("query"))


def venue_url(page_url: Column, venue_slug: Column) -> Column:
    known = (part(page_url, "scheme") != "") & (part(page_url, "authority") != "") & (text(venue_slug) != "")
    return F.when(known, F.concat(part(page_url, "scheme"), F.lit("://"), part(page_url, "authority"), F.lit("/venue/"), venue_slug))


def entry_anchor(page_url: Column, entry_slug: Column, listed_url: Column) -> Column:
    """The listed URL, else the page's with the slug as fragment, else the page's."""
    return F.coalesce(F.nullif(listed_url, F.lit("")), F.when((text(page_url) != "") & (text(entry_slug) != ""), F.concat(page_url, F.lit("#"), entry_slug)), page_url)


def _number(c: Column) -> Column:
    """A double as the shortest decimal, whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def map_link(stored: Column, name: Column, address: Column, lat: Column, lon: Column) -> Column:
    """The stored link, else a search for name and address, else for the coordinates; '' without coordinates."""
    place = F.concat_ws(", ", F.nullif(name, F.lit("")), F.nullif(address, F.lit("")))
    query = F.coalesce(F.nullif(place, F.lit("")), F.concat(_number(lat), F.lit(","), _number(lon)))
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(text(stored) != "", stored).when(known, F.concat(F.lit(MAPS_SEARCH), encode_component(query))).otherwise(F.lit(""))


def transit_link(name: Column, address: Column, lat: Column, lon: Column, from_lat: Column | None = None, from_lon: Column | None = None, app: bool = False) -> Column:
    """Directions to a place, from a location if one is given; for the app: an intent that falls back to its store."""
    end = F.concat(F.lit("endcoord="), encode_form(F.concat(_number(lat), F.lit(","), _number(lon))), F.lit("&endname="), encode_form(F.coalesce(F.nullif(name, F.lit("")), F.nullif(address, F.lit("")), F.lit("Restaurant"))))
    query = end
    if from_lat is not None and from_lon is not None:
        start = F.concat(F.lit("&startcoord="), encode_form(F.concat(_number(from_lat), F.lit(","), _number(from_lon))), F.lit("&startname=Current+Location"))
        query = F.concat(end, F.coalesce(start, F.lit("")))
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    link = F.concat(F.lit(TRANSIT_WEB), query)
    if app:
        link = F.concat(F.lit("intent://directions?"), query, F.lit(f"#Intent;scheme=citymapper;package={TRANSIT_PACKAGE};S.browser_fallback_url="), encode_component(F.lit(TRANSIT_STORE)), F.lit(";end"))
    return F.when(known, link).otherwise(F.lit(""))


def share_link(origin: Column, place_id: Column) -> Column:
    return F.when(text(place_id) != "", F.concat(origin, F.lit("/?r="), encode_component(place_id))).otherwise(text(origin))


def geocode_url(q: Column) -> Column:
    fixed = "format=jsonv2&limit=1&countrycodes=gb&accept-language=en&viewbox=" + VIEWBOX.replace(",", "%2C")
    return F.concat(F.lit(GEOCODER + fixed + "&q="), encode_form(q))


def view_state(url: Column) -> Column:
    """struct(place_id, zoom, lat, lon) of ?r= and #zoom/lat/lon; parts that aren't there are null."""
    number = "(-?\\d+(?:\\.\\d+)?)"
    pattern = f"^(\\d+(?:\\.\\d+)?)/{number}/{number}$"
    at = lambda k: F.nullif(F.regexp_extract(part(url, "fragment"), pattern, k), F.lit("")).cast("double")
    return F.struct(query_value(url, "r").alias("place_id"), at(1).alias("zoom"), at(2).alias("lat"), at(3).alias("lon"))


def view_hash(zoom: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("#%.2f/%.5f/%.5f", zoom.cast("double"), lat.cast("double"), lon.cast("double"))


def app_url(path: Column, place_id: Column, view: Column) -> Column:
    return F.concat(F.coalesce(path, F.lit("/")), F.when(text(place_id) != "", F.concat(F.lit("?r="), encode_component(place_id))).otherwise(F.lit("")), text(view))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: digits, or an HTTP date less now, not below 0; null if neither."""
    v = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.when(F.rlike(v, F.lit("^\\d+$")), v.cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_micros(date) - F.unix_micros(now)) / 1e6))


def content_extension(content_type: Column) -> Column:
    ct = F.lower(F.trim(F.split_part(text(content_type), F.lit(";"), F.lit(1))))
    return F.when(F.contains(ct, F.lit("json")), F.lit(".json.gz")).when(F.contains(ct, F.lit("xml")), F.lit(".xml.gz")).when(F.startswith(ct, F.lit("text/plain")), F.lit(".txt.gz")).otherwise(F.lit(".html.gz"))


def storage_path(folder: Column, url: Column, content_type: Column) -> Column:
    """folder/raw/host/first two hex digits/sha256_hint.extension of a body."""
    sha = F.sha2(text(url), 256)
    parts = F.filter(F.split(part(url, "path"), "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    hint = F.when(F.size(parts) > 0, safe_slug(F.array_join(last, "-"))).otherwise(F.lit("root"))
    return F.concat_ws("/", folder, F.lit("raw"), safe_slug(part(url, "authority")), F.substring(sha, 1, 2), F.concat(sha, F.lit("_"), hint, content_extension(content_type)))


def page_id(global_id: Column, own_id: Column, url: Column) -> Column:
    """The first id there is, else the SHA-1 of the URL."""
    return F.coalesce(F.nullif(global_id.cast("string"), F.lit("")), F.nullif(own_id.cast("string"), F.lit("")), F.sha1(text(url)))


def entry_id(page: Column, position: Column) -> Column:
    return F.format_string("%s:%03d", page, position)


