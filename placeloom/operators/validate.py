"""Validation rules of pages and entries: each gives a row of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions.text import casefold, normalize_space, text
from placeloom.functions.url import is_http, same_url

SHORT = 40


def _empty(c: str) -> Column:
    return text(F.col(c)) == ""


def _as_text(c: Column) -> Column:
    """A missing value is told as null."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def page_rules() -> list[tuple[str, str, Column, str, str, Column]]:
    """(severity, code, condition, field, message, value) for pages."""
    n, points = F.col, F.col("map_point_count")
    both = lambda a, b: (text(n(a)) != "") & (text(n(b)) != "") & ~same_url(n(a), n(b))
    return [
        ("warning", "multiple_map_resource_candidates", n("candidate_count") != 1, "raw_page_json", "Not exactly one map resource was found", n("candidate_count")),
        ("warning", "final_url_mismatch", both("page_final_url", "page_url"), "page_final_url", "The URL fetched last isn't the page's", n("page_final_url")),
        ("warning", "canonical_url_mismatch", both("page_canonical_url", "page_url"), "page_canonical_url", "The canonical URL isn't the page's", n("page_canonical_url")),
        ("warning", "jsonld_map_point_count_mismatch", (n("jsonld_item_count") != 0) & (n("jsonld_item_count") != points), "jsonld_item_count", "Listed items and map points differ in number", n("jsonld_item_count")),
        ("warning", "rendered_card_count_mismatch", (n("rendered_map_card_count") != 0) & (n("rendered_map_card_count") != points), "rendered_map_card_count", "Cards and map points differ in number", n("rendered_map_card_count")),
        ("info", "missing_page_overview_text", _empty("page_overview_text"), "page_overview_text", "The page has no overview", n("page_overview_text")),
        ("info", "missing_modified_time_meta", _empty("modified_at_meta"), "modified_at_meta", "The page doesn't tell when it was changed", n("modified_at_meta")),
    ]


#: Texts that rules compare, folded once an entry: for a column c these rules read __c.
FOLDED = ("restaurant_name", "venue_title", "jsonld_name")


def entry_rules() -> list[tuple[str, str, Column, str, str, Column]]:
    """(severity, code, condition, field, message, value) for entries with FOLDED texts."""
    n = F.col
    lat, lon = n("latitude").try_cast("double"), n("longitude").try_cast("double")
    missing = n("latitude").isNull() | n("longitude").isNull()
    outside = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon) | ~lat.between(-90, 90) | ~lon.between(-180, 180)
    a, b, listed = (n(f"__{c}") for c in FOLDED)
    apart = (a != "") & (b != "") & (a != b) & ~F.contains(n("restaurant_name"), F.lit("@")) & ~F.contains(a, b) & ~F.contains(b, a)
    return [
        ("error", "missing_restaurant_name", _empty("restaurant_name"), "restaurant_name", "The entry has no name", n("restaurant_name")),
        ("error", "missing_address", _empty("address"), "address", "The entry has no address", n("address")),
        ("error", "missing_coordinates", missing, "latitude/longitude", "The entry has no coordinates", F.concat_ws(",", n("latitude").cast("string"), n("longitude").cast("string"))),
        ("error", "invalid_coordinates", ~missing & outside, "latitude/longitude", "The coordinates are no place on Earth", F.concat_ws(",", n("latitude").cast("string"), n("longitude").cast("string"))),
        ("info", "missing_description", _empty("description_text"), "description_text", "The entry has no description", n("description_text")),
        ("info", "very_short_description", ~_empty("description_text") & (F.length("description_text") < SHORT), "description_text", "The description is very short", n("description_text")),
        ("info", "missing_website_url", _empty("website_url"), "website_url", "The entry has no website", n("website_url")),
        ("error", "invalid_website_url", ~_empty("website_url") & ~is_http(n("website_url")), "website_url", "The website isn't an http address", n("website_url")),
        ("info", "missing_phone_number", _empty("phone_number"), "phone_number", "The entry has no phone number", n("phone_number")),
        ("error", "invalid_booking_url", ~_empty("booking_url") & ~is_http(n("booking_url")), "booking_url", "The booking link isn't an http address", n("booking_url")),
        ("info", "restaurant_name_venue_title_mismatch", apart, "restaurant_name", "Name and venue title differ", n("restaurant_name")),
        ("warning", "jsonld_name_mismatch", (listed != "") & (listed != a), "restaurant_name", "Name and listed name differ", n("jsonld_name")),
        ("info", "duplicate_venue_on_page", n("venue_repeats") > 1, "venue_id", "The venue is on the page more than once", n("venue_id")),
        ("warning", "duplicate_name_address_on_page", n("name_repeats") > 1, "restaurant_name,address", "Name and address are on the page more than once", n("restaurant_name")),
    ]


def _issue(k: int, rule) -> Column:
    severity, code, _, field, message, value = rule
    return F.struct(F.lit(k).alias("rule"), F.lit(severity).alias("severity"), F.lit(code).alias("issue_code"), F.lit(field).alias("field_name"), F.lit(message).alias("message"), _as_text(value).alias("source_value"))


def _exploded(df: DataFrame, rules, keys: list[Column]) -> DataFrame:
    """Issues of (number, rule) pairs."""
    issues = F.array(*(F.when(F.coalesce(rule[2], F.lit(False)), _issue(k, rule)) for k, rule in rules))
    return df.select(*keys, F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i")).select("page_id", "entry_id", "i.*")


def page_issues(pages: DataFrame) -> DataFrame:
    """(page_id, entry_id null, rule, severity, issue_code, field_name, message, source_value)."""
    return _exploded(pages, enumerate(page_rules()), [F.col("page_id"), F.lit(None).cast("string").alias("entry_id")])


#: Rules on what is on a page more than once, by the column that counts it.
REPEATS = {"duplicate_venue_on_page": "venue_repeats", "duplicate_name_address_on_page": "name_repeats"}


def _repeat_keys() -> dict[str, Column]:
    """What is counted on a page, null if blank: a venue, and a name with its address."""
    key = casefold(F.concat_ws("|", normalize_space(F.col("restaurant_name")), normalize_space(F.col("address"))))
    return {"venue_repeats": F.nullif(F.col("venue_id").cast("string"), F.lit("")), "name_repeats": F.when(F.regexp_replace(key, "[| ]", "") != "", key)}


def _repeated(rows: DataFrame, column: str, count: str) -> DataFrame:
    """(page_id, column, count) of what is on a page more than once; counted by partial aggregates."""
    return rows.where(F.col(column).isNotNull()).groupBy("page_id", column).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def with_repeats(entries: DataFrame) -> DataFrame:
    """Adds how often a venue, and a name with its address, are on the page; blank ones don't count."""
    keys = _repeat_keys()
    rows = entries.withColumns({"__venue": keys["venue_repeats"], "__name": keys["name_repeats"]})
    for column, count in (("__venue", "venue_repeats"), ("__name", "name_repeats")):
        rows = rows.join(_repeated(rows, column, count), ["page_id", column], "left")  # what comes once isn't joined
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("venue_repeats", "name_repeats")}).drop("__name", "__venue")


def entry_issues(entries: DataFrame) -> DataFrame:
    """The same rows for entries; their repeats on the page are counted here.

    Rules on one entry need no shuffle. Those on repeats shuffle an entry's ids, what is counted and the value told, no other column.
    """
    rules = list(enumerate(entry_rules()))
    folded = entries.withColumns({f"__{c}": casefold(normalize_space(F.col(c))) for c in FOLDED})
    issues = _exploded(folded, [(k, r) for k, r in rules if r[1] not in REPEATS], [F.col("page_id"), F.col("entry_id")])
    for k, rule in rules:
        if rule[1] in REPEATS:
            count = REPEATS[rule[1]]
            rows = entries.select("page_id", "entry_id", _as_text(rule[5]).alias("value"), _repeat_keys()[count].alias("__key")).where("__key IS NOT NULL")
            found = rows.join(_repeated(rows, "__key", count), ["page_id", "__key"])
            issues = issues.union(found.select("page_id", "entry_id", _issue(k, (*rule[:5], F.col("value"))).alias("i")).select("page_id", "entry_id", "i.*"))
    return issues


def with_status(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds validation_flags (codes in the order of the rules), validation_issue_count and validation_status."""
    flags = issues.where("entry_id IS NOT NULL").groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "issue_code"))), lambda x: x["issue_code"]).alias("validation_flags"), F.bool_or(F.col("severity").isin("error", "warning")).alias("__bad"))
    rows = entries.join(flags, "entry_id", "left")
    return rows.withColumns({"validation_flags": F.coalesce("validation_flags", F.array().cast("array<string>")), "validation_issue_count": F.coalesce(F.size("validation_flags"), F.lit(0)), "validation_status": F.when(F.coalesce("__bad", F.lit(False)), "needs_review").otherwise("validated")}).withColumn("validation_issue_count", F.size("validation_flags")).drop("__bad")


def entries_needing_review(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """Entries with errors or warnings: their columns, issue_codes joined by '; ' and messages by ' | ', in the order of the rules."""
    bad = issues.where(F.col("severity").isin("error", "warning")).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("rule", "issue_code", "message"))).alias("i"))
    return entries.join(bad, "entry_id").withColumns({"issue_codes": F.array_join(F.col("i.issue_code"), "; "), "issue_messages": F.array_join(F.col("i.message"), " | ")}).drop("i")


def page_summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of each page, its own and its entries', by severity; 0 for pages without any."""
    rows = pages.select("page_id", "page_title").join(issues.select("page_id", "severity"), "page_id", "left")
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}_count")
    return rows.groupBy("page_id", "page_title").agg(count("error"), count("warning"), count("info")).orderBy(F.desc("error_count"), F.desc("warning_count"), "page_title", "page_id")


def review_template(pages: DataFrame, entries: DataFrame, issues: DataFrame) -> DataFrame:
    """Every issue with the page and, if it has one, the entry it belongs to, by severity, page, entry and rule."""
    rows = issues.join(pages.select("page_id", "page_title", "page_url"), "page_id", "left").join(entries.select("entry_id", "restaurant_name", "entry_position"), "entry_id", "left")
    return rows.orderBy(F.asc_nulls_first("severity"), F.asc_nulls_first("page_title"), F.asc_nulls_first("entry_position"), "rule")


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"))
