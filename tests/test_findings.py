"""Queries beside their SQL on tables that the smallest ones don't hold: repeated places, pages and keys."""

import math
import os

import duckdb
import pytest

from placeloom import registry
from placeloom.operators import dedupe, manifest, stations, validate
from placeloom.plans import catalog
from placeloom.plans.inputs import ENTRIES, derived
from placeloom.sources import split

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    value = lambda v: (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, folder, name, **made):
    """Whether a query gives what its SQL gives over the smallest tables, but for those made by SQL here."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if t in made:
            con.sql(f"COPY ({made[t].format(t=f"'{SF}/{t}.parquet'")}) TO '{path}'")
        elif not os.path.exists(path):
            os.symlink(f"{SF}/{t}.parquet", path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    relation = con.sql(registry.ORACLE_SQL[name])
    order = [relation.columns.index(c) for c in columns]
    wanted = [tuple(r[i] for i in order) for r in relation.fetchall()]
    assert wanted and canonical(got) == canonical(wanted)


#: The places of 8,000 keys repeat their coordinates.
TWICE = "SELECT * FROM {t} UNION ALL SELECT * REPLACE (p_partkey + 8000 AS p_partkey) FROM {t}"


@pytest.mark.parametrize("name", ["drawing_order", "markers_on_screen", "tap_candidates"])
def test_markers_of_places_at_one_coordinate(name, spark, tmp_path):
    same(spark, tmp_path, name, part=TWICE)


def test_title_with_references_of_other_names_or_without_semicolon(spark, tmp_path):
    same(spark, tmp_path, "page_heads", pages="SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<title>A &amp; B &amp</title><a href=\"x&amp=1\">x</a>' ELSE '<title>&lt &amp;amp AT&T &quot;x</title>' END AS html FROM {t}")


def test_rules_meet_each_row_of_a_url(spark, tmp_path):
    same(spark, tmp_path, "rule_audit", pages="SELECT page_id * 3 + i AS page_id, url, html FROM {t}, range(3) r(i) WHERE i = 0 OR page_id % 4 < i")


def most_rows(df):
    """The most rows that a step of the plan gives."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(p.plan())
        n = p.metrics().get("numOutputRows")
        found = max(found, n.get().value() if n.isDefined() else 0)
        left += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_nearest_station_of_many_stops_at_one_place(spark):
    stops = spark.range(400).selectExpr("id AS stop_id", "51.5D AS lat", "-0.1D AS lon")
    near = spark.range(400).selectExpr("id + 7 AS ordinal", "51.5001D AS lat", "-0.1D AS lon")
    df = stations.nearest_station(stops, near)
    assert {(r.stop_id, r.station_ordinal) for r in df.collect()} == {(k, 7) for k in range(400)}
    assert most_rows(df) < 4_000


def test_stations_within_a_walk_of_many_roots_at_one_place(spark):
    roots = spark.range(400).selectExpr("id AS root_id", "51.5D AS lat", "-0.1D AS lon")
    near = spark.range(400).selectExpr("concat('S', lpad(id, 3, '0')) AS name", "51.5001D AS lat", "-0.1D AS lon", "array(named_struct('name', concat('L', id % 3)), named_struct('name', 'A')) AS lines")
    df = stations.stations_within(roots, near)
    assert {(r.name, tuple(x.name for x in r.lines), r.place) for r in df.collect()} == {("S000", ("L0", "A"), 1), ("S001", ("L1",), 2), ("S002", ("L2",), 3)}
    assert df.count() == 1200 and most_rows(df) < 4_000


def shuffled_columns(df):
    """How many columns the widest shuffle of a plan has."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
        found = max(found, p.output().size() if kind == "ShuffleExchangeExec" else 0)
        left += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_issues_shuffle_what_repeats_and_no_whole_entry(spark):
    entries = derived(spark, SF, ENTRIES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert 0 < shuffled_columns(validate.entry_issues(entries)) <= 4 < len(entries.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_manifest_carries_no_column_that_nobody_reads(spark):
    rows = spark.range(50).selectExpr("concat('u', id % 7) AS url", "id AS version", "'done' AS status", "id % 2 AS batch_order", "'b' AS batch_key", "repeat('x', 5000) AS error")
    m = manifest.upserted(rows, rows.limit(0))
    assert "error" not in manifest.summary(m)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.url, r.version, len(r.error)) for r in m.collect()} == {(f"u{k % 7}", k, 4000) for k in range(43, 50)}


def test_document_in_parts(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS n", "to_json(named_struct('a', concat('}]{', id))) AS value").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        path = catalog._document(rows, "n", '{"count": {"x": [1]}, "items": [null', '], "more": {}}', "parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r.f for r in spark.read.text(path).selectExpr("_metadata.file_path AS f").distinct().collect()]
    assert len(files) > 1
    got = {(r.ordinal, r.text) for r in split.json_items(spark, path, "items", parts=True).collect()}
    assert got == {(0, "null"), *((k + 1, f'{{"a":"}}]{{{k}"}}') for k in range(1000))}


def test_places_that_crowd_meet_by_cells(spark, monkeypatch):
    """Places of one name close together, and two rows of them just within reach: no join gives a row for each two of them."""
    found, components = [], dedupe.components
    monkeypatch.setattr(dedupe, "components", lambda edges: (found.append(most_rows(edges)), components(edges))[1])
    rows = spark.range(400).selectExpr("id AS place_id", "cast(id AS string) AS id", "CASE WHEN id % 4 = 3 THEN 'Ombra Bar' WHEN id % 4 = 2 THEN 'Foo Wine' ELSE 'Ombra' END AS name", "51.5D + (id % 4) * 0.0005D AS lat", "-0.1D + id * 0.0000001D AS lon", "cast(null AS string) AS priceRange", "'' AS description")
    got = {r.place_id: r.final_id for r in dedupe.subset_clusters(rows).collect()}
    assert got == {k: (0, 0, 2, 3)[k % 4] for k in range(400)}
    assert max(found) < 8_000


def test_a_record_gathers_what_differs_and_not_all_appearances(spark):
    rows = spark.range(300).selectExpr("id AS ordinal", "cast(id AS string) AS id", "'Soup at Foo' AS name", "51.5D AS lat", "-0.1D AS lon", "'1 St' AS address", "'$' AS priceRange", "concat('Text ', id % 3) AS description", "0L AS final_id", "0L AS place_id", "0L AS geo_id", "'foo' AS name_key", "concat('http://e/', id % 5) AS entryUrl")
    df = dedupe.merged(rows)
    (r,) = df.collect()
    assert [d.text for d in r.descriptions] == ["Text 0", "Text 1", "Text 2"] and [x.entryUrl for x in r.sources] == [f"http://e/{k}" for k in range(5)]
    gathered, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        p = left.pop()
        if p.nodeName() == "Aggregate" and "collect_list" in p.simpleString(1000):
            child = p.child()
            gathered.append((child.child() if child.nodeName() == "Project" else child).nodeName())
        left += [p.children().apply(k) for k in range(p.children().size())]
    assert gathered and set(gathered) == {"Aggregate"}
