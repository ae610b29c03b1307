"""Inputs of the queries, derived from the plain tables by exact arithmetic, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


PLACES = """
  SELECT p_partkey AS ordinal, CAST(p_partkey AS STRING) AS id, p_name AS name,
    51.30 + (p_partkey * 7919 % 4000) / 10000.0D AS lat, -0.50 + (p_partkey * 104729 % 8000) / 10000.0D AS lon,
    concat(p_brand, ', ', p_size, ' High Street, London E', 1 + p_size % 18, ' ', p_partkey % 9, 'AB, UK') AS address,
    CASE p_size % 5 WHEN 1 THEN '$' WHEN 2 THEN '$$' WHEN 3 THEN '$$$' WHEN 4 THEN '$$$$' END AS priceRange,
    concat(p_type, ' and ', p_name) AS description, concat('Guide to ', p_type) AS pageTitle
  FROM part
"""

STATIONS = """
  SELECT s_suppkey AS ordinal, s_name AS name,
    51.30 + (s_suppkey * 7919 % 400) / 1000.0D AS lat, -0.50 + (s_suppkey * 104729 % 800) / 1000.0D AS lon,
    s_nationkey AS line_a, s_suppkey % 7 AS line_b
  FROM supplier
"""

#: Entries and pages of the guides, from orders and customers.
ENTRIES = """
  SELECT CAST(o_custkey AS STRING) AS page_id, concat(o_custkey, ':', o_orderkey) AS entry_id, CAST(o_orderkey % 100 AS INT) AS entry_position,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(' Place ', o_orderkey % 50, ' ') END AS restaurant_name,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(o_orderkey % 30, ' Maltby Street') END AS address, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '9 Back Lane' END AS venue_address,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 51.2 + (o_orderkey % 997) / 1000.0D END AS latitude,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 200.5D ELSE -0.4 + (o_orderkey % 991) / 1000.0D END AS longitude,
    CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN 'Short.' ELSE concat('A long enough description of order ', o_orderkey, ' for all.') END AS description_text,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('https://www.place', o_orderkey, '.example.com/') WHEN 2 THEN 'ftp://old.example.com' ELSE concat('http://place', o_orderkey, '.example.org') END AS website_url,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('020 ', o_orderkey) END AS phone_number,
    CASE WHEN o_orderkey % 29 = 0 THEN 'book here' WHEN o_orderkey % 2 = 0 THEN 'https://book.example.com/x' END AS booking_url,
    CASE o_orderkey % 5 WHEN 1 THEN '$' WHEN 2 THEN '$$' WHEN 3 THEN '$$$' END AS price_range,
    CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_orderkey % 40 AS STRING) END AS venue_id, concat('Place ', o_orderkey % 49) AS venue_title,
    CASE WHEN o_orderkey % 9 = 0 THEN concat('place  ', o_orderkey % 50) END AS jsonld_name, CAST(NULL AS STRING) AS entry_anchor_url,
    CAST(NULL AS STRING) AS google_maps_search_url, CASE WHEN o_orderkey % 4 = 1 THEN 'https://maps.example.com/1' END AS source_google_maps_url,
    CAST(NULL AS STRING) AS open_for, CAST(NULL AS STRING) AS best_for, CAST(NULL AS STRING) AS must_try_dish, CAST(NULL AS STRING) AS know_before_you_go, CAST(NULL AS STRING) AS outdoor_seating,
    CAST(NULL AS STRING) AS additional_location_notes, CAST(NULL AS STRING) AS booking_provider
  FROM orders
"""

PAGES = """
  SELECT CAST(c_custkey AS STRING) AS page_id, concat('Guide ', c_mktsegment, ' ', c_custkey % 20) AS page_title, concat('https://guide.example.com/maps/', c_custkey) AS page_url,
    concat('https://guide.example.com/maps/', c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, '/') AS page_final_url,
    concat('HTTPS://Guide.example.com/maps/', c_custkey + CASE WHEN c_custkey % 14 = 0 THEN 1 ELSE 0 END) AS page_canonical_url,
    CAST(c_custkey % 3 AS INT) AS candidate_count, CAST(c_custkey % 12 AS INT) AS map_point_count, CAST(c_custkey % 6 AS INT) AS jsonld_item_count, CAST(c_custkey % 4 AS INT) AS rendered_map_card_count,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Overview' END AS page_overview_text, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01' END AS modified_at_meta
  FROM customer
"""


def in_duckdb(sql: str) -> str:
    """The same input in the other dialect."""
    return sql.replace("0000.0D", "0000.0::DOUBLE").replace("000.0D", "000.0::DOUBLE").replace("200.5D", "200.5::DOUBLE").replace("AS STRING", "AS VARCHAR")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the inputs above over the tables of a folder."""
    name = sql[sql.rindex("FROM ") + 5 :].strip()
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))
