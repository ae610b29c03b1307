"""Sinks: tables, payloads, reports and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.text import in_locale
from placeloom.functions.url import storage_path
from placeloom.storage import shared_dir


def table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A Parquet table; columns that df lacks are null."""
    if columns is not None:
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    df.write.mode("overwrite").parquet(path)


def csv_report(df: DataFrame, path: str, order: list | None = None, keep_empty: bool = True) -> int:
    """One CSV file with a header and a byte order mark, in order; the number of rows. A report is for people to read.

    Without keep_empty nothing is written for an empty table.
    """
    n = df.count()
    if n == 0 and not keep_empty:
        return 0
    rows = df.orderBy(*order) if order else df
    mark = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    mark.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return n


def batch_plan(records: DataFrame, path: str) -> None:
    """A folder of CSV files for each batch."""
    rows = records.select("batch_folder", "url", "input_row_number", "batch_key")
    rows.repartition("batch_folder").sortWithinPartitions("batch_folder", "input_row_number").write.mode("overwrite").partitionBy("batch_folder").option("header", True).csv(path)


def manifest_reports(manifest: DataFrame, path: str) -> None:
    """The manifest, its summary and a part for each batch."""
    from placeloom.operators.manifest import summary

    csv_report(manifest, f"{path}/manifest", ["batch_order", "input_row_number", "url"])
    csv_report(summary(manifest), f"{path}/summary")
    manifest.repartition("batch_folder").write.mode("overwrite").partitionBy("batch_folder").option("header", True).csv(f"{path}/by_batch")


def stored_bodies(pages: DataFrame, path: str) -> DataFrame:
    """(url, body_path, sha256, length) of bodies (url, batch_folder, content_type, content) written under the batch and the hash's first digits.

    The body's path is a column of the table; Spark names its own files.
    """
    rows = pages.select("url", storage_path(F.col("batch_folder"), F.col("url"), F.coalesce("content_type", F.lit(""))).alias("body_path"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("length"), "content", "batch_folder", F.substring(F.sha2("url", 256), 1, 2).alias("prefix"))
    rows.repartition("batch_folder", "prefix").write.mode("overwrite").partitionBy("batch_folder", "prefix").parquet(path)
    return rows.select("url", "body_path", "sha256", "length")


def place_json(df: DataFrame) -> Column:
    """A place as JSON; null fields are left out."""
    return F.to_json(F.struct(*(F.col(c) for c in df.columns if c != "ordinal")))


def places_payload(places: DataFrame, stats: DataFrame, path: str, order: list) -> None:
    """Places as JSON lines in order and the statistics beside them: one object a line, which scales, where one document wouldn't."""
    places.orderBy(*order).select(place_json(places).alias("value")).write.mode("overwrite").text(f"{path}/places")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def places_document(places: DataFrame, stats: DataFrame, path: str, order: list) -> None:
    """One document {stats, bounds, restaurants} as text files that are it when they are read one after the other, by name.

    stats: one row with a column bounds. Places are in order, one a line; null fields are kept. No task holds the
    document: the places are sorted once, and written between its beginning and its end. Without places the list is empty.
    """
    shared_dir(places.sparkSession)
    kept = {"ignoreNullFields": "false"}
    columns = [F.col(c) for c in places.columns if c != "ordinal" and not c.startswith("__")]
    rows = places.orderBy(*order).select(F.to_json(F.struct(*columns), kept).alias("value"), F.monotonically_increasing_id().alias("at")).checkpoint()
    first = rows.agg(F.min("at").alias("first"))
    body = rows.join(F.broadcast(first), how="cross").select(F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), F.col("value")).alias("value"))  # first: one row
    head = stats.select(F.concat(F.lit('{"stats":'), F.to_json(F.struct(*stats.columns), kept), F.lit(',"bounds":'), F.to_json("bounds", kept), F.lit(',"restaurants":[')).alias("value"))
    end = places.sparkSession.range(0, 1, 1, 1).select(F.lit("]}").alias("value"))
    head.union(body).union(end).write.mode("overwrite").text(path)


def resolution(entries: DataFrame, places: DataFrame, stats: DataFrame, path: str, write: bool = False) -> DataFrame:
    """Counts of a resolution (entries, places, removed, multi_source); only with write are the places written to path.

    stats: the one row of statistics of the payload the entries came from; its entryCount and restaurantCount are set anew.
    """
    from placeloom.operators.dedupe import report

    counts, _ = report(entries, places)
    if write:
        n = counts.select("entries", "places").first()
        places_document(places, stats.withColumns({"entryCount": F.lit(n.entries), "restaurantCount": F.lit(n.places)}), path, [in_locale(F.col("id").cast("string")), F.col("id").cast("string")])
    return counts


def metadata(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "key string, value string")


def geojson(features: DataFrame, path: str) -> None:
    """Features (properties struct, geometry struct) as one GeoJSON text a line."""
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", "geometry")).alias("value")).write.mode("overwrite").text(path)
