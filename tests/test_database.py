import json

import pytest
from pyspark.sql import functions as F

from placeloom.functions.text import half_even
from placeloom.operators import validate
from placeloom.plans import public
from placeloom.sources import database
from placeloom.sources.database import Rules


def _shown(spark, name):
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_rules_are_counted(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (None, "z"), (None, "z"), (2, "z")], "id int, name string")
    b = spark.createDataFrame([(10, 1), (11, 9), (12, 9), (13, None)], "id int, of int")
    rules = {"a": Rules(("id",), ("name",)), "b": Rules(("id",), (), {"of": ("a", "id")})}
    got = {tuple(r)[:3]: r["rows"] for r in database.broken({"a": a, "b": b}, rules).collect()}
    assert got == {("a", "not null", "id"): 2, ("a", "not null", "name"): 1, ("a", "unique", "id"): 3, ("b", "not null", "id"): 0, ("b", "unique", "id"): 0, ("b", "references", "of -> a.id"): 2}
    assert database.broken({"a": a.limit(0), "b": b.limit(0)}, rules).where("rows <> 0").isEmpty()


def test_a_violation_leaves_what_was_there(spark, tmp_path):
    rules, views = {"a": Rules(("id",), (), {}, (("name",),))}, {"names": "SELECT DISTINCT name FROM {a}"}
    good = spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id int, name string")
    database.publish(spark, "own", {"a": good}, rules, views, str(tmp_path), 2)
    assert _shown(spark, "own.a_by_name") == [("x", 1), ("x", 3)] and spark.table("own.names").count() == 2
    with pytest.raises(database.IntegrityError) as e:
        database.publish(spark, "own", {"a": good.union(good)}, rules, views, str(tmp_path), 2)
    assert e.value.broken == [("a", "unique", "id", 3)]
    assert spark.table("own.a").count() == 3 and spark.sql("SHOW TABLES IN own").where("tableName LIKE '%\\_\\_%'").count() == 2
    database.publish(spark, "own", {"a": good.where("id = 1")}, rules, views, str(tmp_path), 2)
    assert _shown(spark, "own.a") == [(1, "x")] and spark.sql("SHOW TABLES IN own").where("tableName LIKE '%\\_\\_%'").count() == 2
    joined = spark.table("own.a").hint("merge").join(spark.table("own.a").withColumnRenamed("name", "other"), "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()  # both sides lie in buckets of the key
    database.publish(spark, "own", {"a": good.limit(0)}, rules, views, str(tmp_path), 2)
    assert spark.table("own.a").isEmpty() and spark.table("own.names").isEmpty()


def test_guide_views_are_the_reports(spark, tmp_path):
    pages = spark.createDataFrame([("p1", "One", "u1", 2), ("p2", "Two", "u2", 0)], "page_id string, page_title string, page_url string, map_point_count int")
    entries = spark.createDataFrame([("e1", "p1", 1, "v", "A"), ("e2", "p1", 2, None, "B")], "entry_id string, page_id string, entry_position int, venue_id string, restaurant_name string")
    found = [("p1", "e1", 3, "warning", "b", "f", "second", "x"), ("p1", "e1", 1, "error", "a", "f", "first", "x"), ("p1", "e2", 0, "info", "c", "f", "third", "x"), ("p2", None, 0, "warning", "d", "f", "fourth", "x")]
    issues = spark.createDataFrame(found, "page_id string, entry_id string, rule int, severity string, issue_code string, field_name string, message string, source_value string")
    links = spark.createDataFrame([(1, "page", "p1", None, "body", "u")], "link_id long, scope string, page_id string, entry_id string, source_field string, url string")
    tables = {"pages": pages, "restaurant_entries": entries, "validation_issues": database.with_issue_ids(issues), "entry_links": links}
    database.publish_guides(spark, "guides_t", tables, str(tmp_path), 2)
    (r,) = spark.table("guides_t.entries_needing_review").collect()
    want = validate.entries_needing_review(entries, issues).select("entry_id", "issue_codes", "issue_messages").first()
    assert (r.entry_id, r.review_issue_codes, r.review_messages) == tuple(want) == ("e1", "a; b", "first | second")
    counts = ["page_id", "page_title", "error_count", "warning_count", "info_count"]
    assert {tuple(x) for x in spark.table("guides_t.page_validation_summary").select(*counts).collect()} == {tuple(x) for x in validate.page_summary(pages, issues).select(*counts).collect()}
    assert _shown(spark, "guides_t.restaurant_entries_by_page_id") == [("p1", "e1"), ("p1", "e2")]
    with pytest.raises(database.IntegrityError, match="entry_id -> restaurant_entries.entry_id"):
        database.publish_guides(spark, "guides_t", tables | {"entry_links": links.withColumn("entry_id", F.lit("none"))}, str(tmp_path), 2)


def test_public_database(spark, tmp_path):
    places = spark.createDataFrame([("a", "A", 51.5, -0.1, "$"), ("b", "B", 51.6, -0.2, None)], "id string, name string, lat double, lon double, priceRange string")
    pages = spark.createDataFrame([("p",)], "page_id string")
    database.publish_public(spark, "public_t", places.withColumn("lat", half_even(F.col("lat"), 6)), public.statistics(places, pages), "2026-01-01T00:00:00", str(tmp_path), 2)
    values = dict(_shown(spark, "public_t.metadata"))
    assert values["entry_count"] == "2" and json.loads(values["bounds_json"])["maxLat"] == 51.6 and json.loads(values["price_counts_json"]) == {"$": 1, "none": 1}
    assert _shown(spark, "public_t.restaurants_by_price_range") == [("$", "a")] and spark.table("public_t.restaurants").columns[-1] == "price_range"
    with pytest.raises(database.IntegrityError, match="not null lat"):
        database.publish_public(spark, "public_t", places.withColumn("lat", F.lit(None).cast("double")), public.statistics(places, pages), "x", str(tmp_path), 2)
