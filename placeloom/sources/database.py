"""A database of tables with keys, references, lookups and views: checked as a whole, then shown as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.plans.public import as_table


@dataclass(frozen=True)
class Rules:
    """What holds for a table: its key (of one or more columns, none null), columns that aren't null, columns that name a key of
    another table (or are null), and the columns or tuples of columns that it is looked up by."""

    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    lookups: tuple[tuple[str, ...], ...] = ()


class IntegrityError(ValueError):
    """Rows that break rules; ``broken`` has (table, rule, columns, rows) of each rule."""

    def __init__(self, broken: list[tuple[str, str, str, int]]):
        super().__init__("; ".join(f"{t}: {n} rows, {rule} {c}" for t, rule, c, n in broken))
        self.broken = broken


GUIDES = {
    "pages": Rules(("page_id",)),
    "restaurant_entries": Rules(("entry_id",), ("page_id", "entry_position"), {"page_id": ("pages", "page_id")}, (("page_id",), ("venue_id",), ("restaurant_name",))),
    "entry_links": Rules(("link_id",), ("scope", "source_field", "url"), {"page_id": ("pages", "page_id"), "entry_id": ("restaurant_entries", "entry_id")}, (("entry_id",),)),
    "validation_issues": Rules(("issue_id",), ("severity", "issue_code", "message"), {}, (("entry_id",), ("page_id",))),
}
GUIDE_VIEWS = {
    "entries_needing_review": """
        SELECT e.*, r.review_issue_codes, r.review_messages FROM {restaurant_entries} e JOIN (
          SELECT entry_id, listagg(issue_code, '; ') WITHIN GROUP (ORDER BY rule) AS review_issue_codes, listagg(message, ' | ') WITHIN GROUP (ORDER BY rule) AS review_messages
          FROM {validation_issues} WHERE severity IN ('error', 'warning') GROUP BY entry_id) r ON r.entry_id = e.entry_id""",
    "page_validation_summary": """
        SELECT p.page_id, p.page_title, p.page_url, p.map_point_count, coalesce(v.error_count, 0) AS error_count, coalesce(v.warning_count, 0) AS warning_count, coalesce(v.info_count, 0) AS info_count
        FROM {pages} p LEFT JOIN (SELECT page_id, count_if(severity = 'error') AS error_count, count_if(severity = 'warning') AS warning_count, count_if(severity = 'info') AS info_count
          FROM {validation_issues} GROUP BY page_id) v ON v.page_id = p.page_id""",
}
PUBLIC = {"metadata": Rules(("key",), ("value",)), "restaurants": Rules(("id",), ("name", "lat", "lon"), {}, (("lat", "lon"), ("price_range",)))}


def with_issue_ids(issues: DataFrame) -> DataFrame:
    """Issues with issue_id: page, entry and rule, of which an issue has one each."""
    return issues.withColumn("issue_id", F.concat_ws("#", "page_id", F.coalesce("entry_id", F.lit("")), F.col("rule").cast("string")))


def broken(tables: Mapping[str, DataFrame], rules: Mapping[str, Rules]) -> DataFrame:
    """(table, rule, columns, rows): how many rows break a rule, one row a rule, 0 where it holds.

    "not null": a row with a null there. "unique": a row beyond the first of its key (null is a value here). "references": a row
    whose value is no key of the other table; null refers to none. Counted by partial aggregates; a reference is an anti join
    of distinct values, so a hot value is one row of it. An empty table breaks nothing.
    """
    parts = []
    for name, df in tables.items():
        r = rules[name]
        filled = list(dict.fromkeys((*r.key, *r.required)))
        nulls = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in filled))
        parts.append(nulls.select(F.explode(F.array(*(F.struct(F.lit(c).alias("columns"), F.col(f"`{c}`").alias("rows")) for c in filled))).alias("x")).select(F.lit(name).alias("table"), F.lit("not null").alias("rule"), "x.columns", "x.rows"))
        own = df.groupBy(*(f"`{c}`" for c in r.key)).agg(F.count("*").alias("__n"))
        rows = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
        parts.append(own.agg(rows.alias("rows")).select(F.lit(name), F.lit("unique"), F.lit(", ".join(r.key)), "rows"))
        for column, (other, key) in r.references.items():
            used = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("__v")).agg(F.count("*").alias("__n"))
            keys = tables[other].select(F.col(f"`{key}`").alias("__v"))
            orphans = used.join(keys, "__v", "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"))
            parts.append(orphans.select(F.lit(name), F.lit("references"), F.lit(f"{column} -> {other}.{key}"), "rows"))
    return reduce(DataFrame.union, parts)


def publish(spark: SparkSession, database: str, tables: Mapping[str, DataFrame], rules: Mapping[str, Rules], views: Mapping[str, str] | None = None, path: str | None = None, buckets: int | None = None) -> None:
    """Writes tables, their lookups and views as ``database``, or raises IntegrityError and leaves what was there.

    Each table is written once, bucketed and sorted by its key, under a name of its generation; the rules are checked on what was
    written, and only then views by the plain names change over, so readers see one generation or the next. A lookup
    ``<table>_by_<columns>`` holds the columns and the key, bucketed and sorted by the columns; rows where all of them are null are left out.
    views: SQL in which {name} is a table. path: a shared folder, else the warehouse. The tables of the generation before are dropped.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    generation = uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    full = lambda name: f"`{database}`.`{name}`"
    made: list[str] = []

    def write(df: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
        own = f"{name}__{generation}"
        made.append(own)
        writer = df.repartition(n, *(F.col(f"`{c}`") for c in columns)).write.format("parquet").bucketBy(n, *columns).sortBy(*columns)
        (writer.option("path", f"{path}/{own}") if path else writer).saveAsTable(full(own))
        return spark.table(full(own))

    try:
        written = {name: write(df, name, rules[name].key) for name, df in tables.items()}
        wrong = [tuple(r) for r in broken(written, rules).where("rows > 0").collect()]  # one row a rule
        if wrong:
            raise IntegrityError(wrong)
        shown = dict.fromkeys(tables)
        for name, df in written.items():
            for columns in rules[name].lookups:
                held = df.where(reduce(or_, (F.col(f"`{c}`").isNotNull() for c in columns)))
                lookup = f"{name}_by_{'_'.join(columns)}"
                write(held.select(*(f"`{c}`" for c in dict.fromkeys((*columns, *rules[name].key)))), lookup, columns)
                shown[lookup] = None
    except Exception:
        for own in made:
            spark.sql(f"DROP TABLE IF EXISTS {full(own)}")
        raise
    before = [r.tableName for r in spark.sql(f"SHOW TABLES IN `{database}`").collect() if "__" in r.tableName and not r.tableName.endswith(generation)]
    for name in shown:
        spark.sql(f"CREATE OR REPLACE VIEW {full(name)} AS SELECT * FROM {full(f'{name}__{generation}')}")
    for name, sql in (views or {}).items():
        spark.sql(f"CREATE OR REPLACE VIEW {full(name)} AS {sql.format(**{t: full(f'{t}__{generation}') for t in tables})}")
    for own in before:
        spark.sql(f"DROP TABLE IF EXISTS {full(own)}")


def publish_guides(spark: SparkSession, database: str, tables: Mapping[str, DataFrame], path: str | None = None, buckets: int | None = None) -> None:
    """The tables of scraped guides (those of GUIDES) with their two views of what needs review."""
    publish(spark, database, tables, GUIDES, GUIDE_VIEWS, path, buckets)


def publish_public(spark: SparkSession, database: str, places: DataFrame, stats: DataFrame, generated_at: str, path: str | None = None, buckets: int | None = None) -> None:
    """The public dataset: restaurants, and metadata of the one row of statistics (entry_count, page_count, bounds, price_counts)."""
    s = stats.select("entry_count", "page_count", F.to_json("bounds", {"ignoreNullFields": "false"}).alias("bounds"), F.to_json("price_counts").alias("prices")).first()
    values = {"generated_at": generated_at, "entry_count": str(s.entry_count), "page_count": str(s.page_count), "bounds_json": s.bounds, "price_counts_json": json.dumps(json.loads(s.prices), separators=(",", ":"))}
    publish(spark, database, {"metadata": spark.createDataFrame(sorted(values.items()), "key string, value string"), "restaurants": as_table(places)}, PUBLIC, None, path, buckets)
