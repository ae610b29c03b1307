import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.functions import html
from placeloom.operators import components, manifest, rail, validate
from placeloom.plans import pages as plan
from placeloom.plans import public
from placeloom.sources import readers, writers
from placeloom.streaming import streams

FEATURE = "ordinal long, line string, color string, tfl boolean, parts array<array<array<double>>>"
A, B = [[0.0, 0.0], [1.0, 0.0]], [[1.0, 0.0], [2.0, 0.0]]


def bands(spark, rows):
    return sorted((r.line, r.wf, r.oi, r.parts) for r in rail.bands(spark.createDataFrame(rows, FEATURE)).collect())


def test_bands(spark):
    assert bands(spark, [(0, "L", "#1", True, [A])]) == [("L", 1.0, 0.0, [A])]
    two = bands(spark, [(0, "M", "#1", True, [A, B]), (1, "L", "#2", True, [A])])
    assert two == [("L", 0.5, -0.5, [A]), ("M", 0.5, 0.5, [A]), ("M", 1.0, 0.0, [B])]
    four = bands(spark, [(k, n, f"#{k}", True, [A, B]) for k, n in enumerate("dcba")])
    assert [(x[0], x[1], x[2]) for x in four] == [("a", 0.25, -1.5), ("b", 0.25, -0.5), ("c", 0.25, 0.5), ("d", 0.25, 1.5)]
    assert four[0][3] == [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]]  # chained end to end
    assert bands(spark, []) == []


def one_by_one(paths):
    """Chains by the plain rule, and whether any point has more than two ends: the sign of area and extents by hand."""
    left, out = dict(enumerate([tuple(map(tuple, p)) for p in paths])), []
    while left:
        line = list(left.pop(min(left)))
        for _ in range(2):
            while fits := [k for k, p in left.items() if line[-1] in (p[0], p[-1])]:
                p = left.pop(min(fits))
                line += (p if p[0] == line[-1] else p[::-1])[1:]
            line.reverse()
        dx, dy = line[-1][0] - line[0][0], line[-1][1] - line[0][1]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(line, line[1:]))
        along = (dx if abs(dx) >= abs(dy) else dy) if dx or dy else area
        out.append(line if along >= 0 else line[::-1])
    return [[list(p) for p in line] for line in out]


def chains(spark, *corridors):
    rows = [(f"{c},x", c * 1000 + k, [[float(x) for x in p] for p in path]) for c, paths in enumerate(corridors) for k, path in enumerate(paths)]
    got = rail.chained(spark.createDataFrame(rows, "corridor string, pid long, part array<array<double>>")).orderBy("seed").collect()
    return [[r.path for r in got if r.corridor == f"{c},x"] for c in range(len(corridors))]


def test_chaining(spark):
    got = chains(spark, [[[1, 0], [2, 0]], [[1, 0], [0, 0]]], [[[0, 0], [1, 0]], [[5, 5], [5, 9]]], [[[3, 0], [0, 1]]], [[[0, 0], [0, 1], [1, 1]], [[1, 1], [1, 0], [0, 0]]], [[[0, 0], [2, 0], [2, 2], [0, 0]]])
    assert got[0] == [[[0, 0], [1, 0], [2, 0]]]  # turned around
    assert got[1] == [[[0, 0], [1, 0]], [[5, 5], [5, 9]]] and got[2] == [[[0, 1], [3, 0]]]
    ring = got[3][0]
    assert len(got[3]) == 1 and ring[0] == ring[-1] == [0, 0] and sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:])) > 0
    assert got[4] == [[[0, 0], [2, 0], [2, 2], [0, 0]]]  # a ring of one path


def test_chains_as_one_by_one(spark):
    """Long lines, rings and tangles in any order and direction, in several corridors at once."""
    rng = random.Random(8)
    corridors = []
    for k in range(6):
        line = [[[x, (x * x * 7 + k) % 5], [x + 0.5, k], [x + 1, ((x + 1) * (x + 1) * 7 + k) % 5]] for x in range(rng.randint(1, 40))]
        circle = [(50 + round(9 * np.cos(t), 3), round(9 * np.sin(t), 3)) for t in np.linspace(0, 6, rng.randint(3, 12))]
        line += [[list(a), list(b)] for a, b in zip(circle, circle[1:] + circle[:1])]
        line += [[[rng.randint(100, 103), 0], [rng.randint(100, 103), 1 if k % 2 else 0]] for _ in range(12)]
        line = [p for j, p in enumerate(line) if p not in line[:j] and p[::-1] not in line[:j]]
        corridors.append([p if rng.random() < 0.5 else p[::-1] for p in rng.sample(line, len(line))])
    assert chains(spark, *corridors) == [one_by_one(c) for c in corridors]


def test_routes_to_features(spark):
    kind = "ordinal long, tags map<string,string>, route string, members array<struct<ref: long, path: array<array<double>>>>"
    rows = [(0, {"name": "Circle line: x"}, "subway", [(1, [[0.1, 0.1], [0.2, 0.2]]), (2, [[9.0, 9.0], [0.3, 0.3]])]), (1, {"name": "Circle line: back"}, "subway", [(1, [[0.2, 0.2], [0.1, 0.1]])]), (2, {"operator": "Nobody"}, "train", [(3, [[0.0, 0.0], [1.0, 1.0]])])]
    got = rail.line_features(spark.createDataFrame(rows, kind), (0.0, 0.0, 1.0, 1.0)).collect()
    assert [(r.color, r.tfl, r.line, r.parts) for r in got] == [("#FFD300", True, "Circle line", [[[0.1, 0.1], [0.2, 0.2]]])]


PAGE = """<html><head><title> The  Guide</title><meta name="description" content="D"><meta name="description" content="E"><meta property="og:image" content="I">
<link rel="alternate" href="x"><link rel="nofollow canonical" href="https://g.example.com/maps/a"></head><body>
<div data-slug="one" id="one"><h2>One &amp; only</h2><a href="https://www.google.com/maps/x">Map</a><a href="tel:020">020 1</a><a href="https://own.example.com">Visit website</a></div>
<div data-slug="two" id="two"><h2>Two</h2><a href="https://resy.example.com/x">Book</a></div>
<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"position":1,"item":{"name":"One","url":"https://g.example.com/maps/a#one"}}]}</script>
<script id="__NEXT_DATA__" type="x">%s</script></body></html>"""
POINTS = [
    {"name": "One & only", "slug": "one", "address": "1 St", "location": {"latitude": 51.5, "longitude": "-0.1"}, "description": [{"plaintext": "Fine food and a long enough text, really."}, {"html": "<p>Open for: Lunch</p>"}, {"plaintext": "Price: about $$"}, {"plaintext": "Vibe check: loud"}], "venue": {"id": 7, "slug": "v1", "title": "One", "opentable": {"naturalReservationUrl": "https://o.example.com"}, "posts": {"nodes": [{"permalink": "https://p.example.com", "title": "P"}, {"title": "Q"}]}}},
    "not a point",
    {"name": "Three", "slug": "two"},
]
DATA = {"props": {"pageProps": {"hydration": {"responses": [{}, {"data": {"node": {"id": "77", "title": "T", "permalink": "https://g.example.com/maps/a", "wordCount": 5, "authors": [{"name": "N", "permalink": "https://g.example.com/n"}], "ledeMedia": {"image": {"thumbnails": {"square": {"url": "https://i.example.com/s"}}}}, "mapPoints": POINTS, "blocks": [{"__typename": "CoreParagraphBlockType", "paragraphContents": [{"html": "Hi <a href='https://l.example.com'>there</a>"}]}]}}}]}}}}


def test_page_functions(spark):
    df = spark.createDataFrame([(PAGE % json.dumps(DATA),), (None,), ("<p>x<a href='u'>1<a href='v'>2</a>3</a>",)], "h string")
    a, b, c = df.select(html.head(F.col("h")).alias("h"), html.text_and_links(F.col("h")).alias("t"), html.cards()(F.col("h")).alias("c"), html.items(F.col("h")).alias("i")).collect()
    assert a.h.title == "The Guide" and a.h.canonical == "https://g.example.com/maps/a" and a.h.names == {"description": "E"} and a.h.properties == {"og:image": "I"}
    assert [x.heading for x in a.c] == ["One & only", "Two"] and a.c[0].phone_number == "020 1" and a.c[0].website_url == "https://own.example.com" and a.c[1].booking_url == "https://resy.example.com/x"
    assert [(x.position, x.name) for x in a.i] == [(1, "One")]
    assert b.t.text == "" and b.t.links == [] and b.c == []
    assert [(x.url, x.text) for x in c.t.links] == [("v", "2"), ("u", "1 3")] or [(x.url, x.text) for x in c.t.links] == [("v", "2"), ("u", "13")]


def test_saved_pages_to_tables(spark, tmp_path):
    for name, body in (("a", PAGE % json.dumps(DATA)), ("b", "<html>nothing</html>")):
        (tmp_path / f"{name}.html.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "a.html.gz.meta.json").write_text(json.dumps({"url": "https://g.example.com/maps/a", "final_url": "https://g.example.com/maps/A", "status_code": 200}))
    rows = plan.parsed(readers.saved_pages(spark, str(tmp_path))).cache()
    pages, entries = plan.page_table(rows), plan.entry_table(rows)
    p = {r.source_html_path[-9]: r for r in pages.collect()}
    assert p["a"].page_id == "77" and p["a"].map_point_count == 3 and p["a"].status_code == 200 and p["a"].page_overview_text == "Hi there" and p["a"].author_names_json == '["N"]' and p["a"].lede_image_square_url == "https://i.example.com/s" and p["a"].word_count == "5" and p["b"].parse_error
    e = entries.orderBy("entry_position").collect()
    assert [(x.entry_id, x.restaurant_name) for x in e] == [("77:001", "One & only"), ("77:003", "Three")]
    assert e[0].entry_anchor_url == "https://g.example.com/maps/a#one" and e[0].google_maps_link_source == "source_html" and e[0].latitude == 51.5 and e[0].longitude == -0.1 and e[0].booking_provider == "opentable" and e[1].booking_provider is None and e[0].venue_id == "7" and e[0].open_for == "Lunch" and e[0].price_range == "$$" and e[0].venue_related_post_titles_json == '["P","Q"]' and e[0].venue_related_posts_count == 1
    assert json.loads(e[0].structured_notes_json) == {"Open for": "Lunch", "Price": "$$", "Vibe check": "loud"}
    links = plan.link_table(rows, pages, entries).collect()
    assert {(x.scope, x.link_kind) for x in links} >= {("page", "body_link"), ("page", "author"), ("entry", "venue_related_post"), ("entry", "source_google_maps")} and all(x.is_external == 1 for x in links if x.domain == "l.example.com")
    issues = validate.page_issues(pages.where("parse_error IS NULL")).union(validate.entry_issues(entries)).union(plan.parse_failures(pages))
    codes = {(x.entry_id, x.issue_code) for x in issues.collect()}
    assert {(None, "page_parse_failed"), (None, "final_url_mismatch"), (None, "jsonld_map_point_count_mismatch"), ("77:003", "missing_address"), ("77:003", "missing_coordinates")} <= codes
    assert (None, "canonical_url_mismatch") not in codes
    assert [r.id for r in public.in_order(public.public_places(entries, pages)).collect()] == ["77:001"]
    assert tuple(plan.run_summary(pages, entries, issues).first())[:3] == (2, 2, 2)
    (wide,) = public.wide_places(entries, pages).collect()  # from the library's own tables, no column added by hand
    assert len(wide) == 35 and wide.id == "77:001" and wide.venueUrl == e[0].guide_venue_url == "https://g.example.com/venue/v1" and wide.pageUrl == "https://g.example.com/maps/a" and wide.relatedPostTitles == ["P", "Q"]
    with pytest.raises(Exception, match="guide_venue_url"):
        public.wide_places(entries.drop("guide_venue_url"), pages)
    rows.unpersist()


def test_card_links(spark):
    """Every rule of a link's kind and their order; the first that isn't empty fills the field; raw is the card as JSON."""
    page = """<div id="" data-slug="s"><h2>A</h2><a href="https://maps.google.co.uk/x">Phone</a><a href="tel:"> </a><a href="tel:020  7">Phone</a><a href="tel:9">99 9</a>
    <a href="https://x.example.com"><title>Booking</title></a><a href="https://www.OpenTable.com/r">Visit website</a><a href="/local">Visit website</a><a href="https://own.example.com/y"><title>Link</title></a>
    <a href="https://guide.example.com/z"><title>Link</title></a><a href="ftp://x"><title>Link</title></a><a>no address</a></div><div data-slug="no id"></div>"""
    (c,) = spark.createDataFrame([(page,)], "h string").select(html.cards("guide.example.com")(F.col("h")).alias("c")).first().c
    assert [x.kind.removeprefix("source_") for x in c.links] == ["google_maps", "phone", "phone", "phone", "booking", "booking", "website", "website", "rendered_card_link", "rendered_card_link"]
    assert (c.slug, c.heading, c.google_maps_url, c.phone_number, c.booking_url, c.website_url) == ("s", "A", "https://maps.google.co.uk/x", "020 7", "https://x.example.com", "/local")
    raw = json.loads(c.raw)
    assert list(raw) == sorted(raw) and raw["links"][0] == {"kind": "source_google_maps", "text": "", "titles": [], "url": "https://maps.google.co.uk/x"}
    (none,) = spark.createDataFrame([("<div id='a' data-slug='b'></div>",)], "h string").select(html.cards()(F.col("h")).alias("c")).first().c
    assert none.phone_number is None and none.website_url is None and none.links == [] and json.loads(none.raw)["booking_url"] is None


def test_map_choice():
    assert html.chosen_map({"a": [{"mapPoints": [1]}, {"b": {"mapPoints": [1, 2]}}]})[1] == ["root.a[1].b", "root.a[0]"]
    assert html.chosen_map({"mapPoints": []}) == (None, [])
    assert html.chosen_map(DATA)[1] == ["hydration.responses[1].data.node"]


def test_sources_and_sinks(spark, tmp_path):
    csv = tmp_path / "urls.csv"
    csv.write_bytes("﻿url,note\nhttps://X.example.com/a/,1\n,2\nhttps://x.example.com/a#z,3\nhttps://x.example.com/b?q=1,4\n".encode())
    got = manifest.intake(readers.csv_rows(spark, str(csv))).orderBy("input_row_number").collect()
    assert [(r.url, r.input_row_number) for r in got] == [("https://x.example.com/a", 2), ("https://x.example.com/b?q=1", 5)] and got[0].input_data["note"] == "1"
    with pytest.raises(ValueError):
        manifest.url_column(["a", "b"])
    assert manifest.url_column(["x"]) == "x"
    payload = tmp_path / "p.json"
    payload.write_text(json.dumps({"stats": {}, "restaurants": [{"id": "a", "name": "A", "lat": "51.5", "lon": -0.1, "descriptions": [{"text": "t"}]}]}))
    places = readers.places_payload(spark, str(payload))
    assert places.first().lat == 51.5 and places.first().descriptions[0].text == "t"
    writers.places_payload(places, spark.range(1), str(tmp_path / "out"), ["id"])
    assert json.loads(spark.read.text(str(tmp_path / "out/places")).first()[0])["lat"] == 51.5
    geo = tmp_path / "g.json"
    geo.write_text(json.dumps({"features": [{"properties": {"station": True, "name": " S "}, "geometry": {"type": "Point", "coordinates": [-0.1, 51.5]}}, {"properties": {"line": "L"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}]}))
    f = readers.geojson_features(spark, str(geo))
    assert [tuple(r) for r in readers.station_features(f).collect()] == [(0, "S", -0.1, 51.5)]
    assert f.where("type = 'LineString'").first().line == [[0.0, 0.0], [1.0, 1.0]]
    assert writers.csv_report(spark.range(2).selectExpr("id AS a", "'x,\"y' AS b"), str(tmp_path / "r"), ["a"]) == 2
    body = next((tmp_path / "r").glob("*.csv")).read_text(encoding="utf-8")
    assert body.startswith("﻿a,b\n0,")
    assert writers.csv_report(spark.range(0), str(tmp_path / "none"), keep_empty=False) == 0 and not (tmp_path / "none").exists()
    kept = writers.stored_bodies(spark.createDataFrame([("https://x.example.com/maps/a", "01_maps", "text/html", b"hi")], "url string, batch_folder string, content_type string, content binary"), str(tmp_path / "bodies"))
    assert kept.first().body_path.startswith("01_maps/raw/x.example.com/") and kept.first().body_path.endswith("_maps-a.html.gz")


def test_document_of_places(spark, tmp_path):
    places = spark.createDataFrame([(f"p{k}", "Café", None, k) for k in range(50)], "id string, name string, phone string, ordinal long").repartition(7)
    stats = spark.createDataFrame([((1.0, 2.0), 3)], "bounds struct<minLat: double, maxLat: double>, pageCount long")
    text_of = lambda path: "".join(f.read_text(encoding="utf-8") for f in sorted(path.glob("part-*")))
    writers.places_document(places, stats, str(tmp_path / "d"), ["ordinal"])
    document = json.loads(text_of(tmp_path / "d"))
    assert [r["id"] for r in document["restaurants"]] == [f"p{k}" for k in range(50)] and document["restaurants"][0] == {"id": "p0", "name": "Café", "phone": None}
    assert document["bounds"] == document["stats"]["bounds"] == {"minLat": 1.0, "maxLat": 2.0} and document["stats"]["pageCount"] == 3
    writers.places_document(places.limit(0), stats, str(tmp_path / "e"), ["ordinal"])
    assert json.loads(text_of(tmp_path / "e"))["restaurants"] == []
    merged = places.withColumns({"sources": F.array(F.lit("a"), F.lit("b")), "descriptions": F.array(F.lit("x")), "priceRange": F.lit("$")})
    assert tuple(writers.resolution(places.union(places), merged, stats, str(tmp_path / "f")).first()) == (100, 50, 50, 50) and not (tmp_path / "f").exists()
    writers.resolution(places.union(places), merged, stats, str(tmp_path / "f"), write=True)
    assert {k: v for k, v in json.loads(text_of(tmp_path / "f"))["stats"].items() if k.endswith("Count")} == {"pageCount": 3, "entryCount": 100, "restaurantCount": 50}


def test_tables_plans_and_features(spark, tmp_path):
    writers.table(spark.range(2), str(tmp_path / "t"), ["id", "later"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(0, None), (1, None)]
    kind = "batch_folder string, batch_order int, batch_key string, url string, input_row_number long, status string"
    rows = spark.createDataFrame([("01_a", 1, "a", f"u{k}", 9 - k, "pending") for k in range(3)] + [("02_b", 2, "b", "v", 1, "failed")], kind)
    writers.batch_plan(rows, str(tmp_path / "plan"))
    plan_rows = spark.read.option("header", True).csv(str(tmp_path / "plan/batch_folder=01_a")).collect()
    assert [r.url for r in plan_rows] == ["u2", "u1", "u0"]
    writers.manifest_reports(rows, str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports/by_batch").iterdir() if p.is_dir()} == {"batch_folder=01_a", "batch_folder=02_b"}
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/summary")).count() == 2
    features = spark.createDataFrame([(("L",), ("Point", [0.5, 51.0]))], "properties struct<line: string>, geometry struct<type: string, coordinates: array<double>>")
    writers.geojson(features, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0]) == {"type": "Feature", "properties": {"line": "L"}, "geometry": {"type": "Point", "coordinates": [0.5, 51.0]}}
    assert [tuple(r) for r in writers.metadata(spark, {"b": 1, "a": None}).orderBy("key").collect()] == [("a", "None"), ("b", "1")]
    with pytest.raises(FileNotFoundError):
        readers.saved_pages(spark, str(tmp_path / "t"))


def test_folded_case(spark):
    from placeloom.functions import text

    pairs = [("STRASSE", "straße"), ("ẞ", "ss"), ("ΟΔΟΣ", "οδος"), ("a", "b")]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.casefold_equal(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]


def test_layers_and_frames(spark):
    from placeloom.operators import search

    rows = spark.createDataFrame([("a", "$", 5.0, 1), ("b", None, 9.0, 2), ("c", None, 1.0, 3), ("d", "$", 2.0, 4), ("e", "", 0.0, 5)], "id string, priceRange string, y double, ordinal long")
    assert [r.id for r in search.drawing_order(rows, "d", ("e",)).collect()] == ["c", "b", "a", "d"]
    assert [r.id for r in search.drawing_order(rows).collect()] == ["e", "c", "b", "d", "a"]
    changes = spark.sql("SELECT timestamp_millis(t) AS ts, id AS event_id FROM VALUES (0, 1), (15, 2), (15, 3), (16, 4) v(t, id)")
    assert sorted(r.event_id for r in streams.settled(changes).collect()) == [3, 4]


def test_manifest_stream(spark, tmp_path):
    changes = spark.createDataFrame([("u1", 1, "failed"), ("u2", 2, "downloaded")], "url string, version long, status string")
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    write = streams.manifest_writer(spark, str(tmp_path / "m"))

    def run():
        q = streams.stream(spark, str(tmp_path / "in"), changes).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    run()
    spark.createDataFrame([("u1", 3, "downloaded")], changes.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(tuple(r) for r in streams.current(spark, str(tmp_path / "m")).collect()) == [("u1", 3, "downloaded"), ("u2", 2, "downloaded")]


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)], "a long, b long")
    assert sorted(tuple(r) for r in components.components(e).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components.components(path).collect()} == {0}
    star = spark.range(1, 500).selectExpr("id AS a", "0L AS b")
    assert components.components(star).where("component <> 0").count() == 0
    assert components.components(e.where("false")).count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert {r.node for r in components.reachable(ring, spark.createDataFrame([("a",)], "root string")).collect()} == {"a", "b", "c"}


def test_numbering_in_blocks(spark):
    from placeloom.operators.positions import numbered

    rows = spark.range(200).selectExpr("id AS o", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'a' ELSE 'b' END AS k")
    got = {r.o: (r.i, r.n) for r in numbered(rows, "k", "o", "i", "n", block=16).collect()}
    assert got == {o: (o // 3, 67 if o % 3 < 2 else 66) for o in range(200)}
