import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, text, url
from placeloom.operators import search, stations

PLACES = [
    (0, "a", "Alpha", "51.5", "-0.1", "$$", "Lunch", "Best Brunch guide", "Eggs."),
    (1, "b", "Beta brunch", "51.6", "-0.2", None, None, "Guide two", "Toast."),
    (2, "c", "Gamma", "51.5", "-0.1", None, None, None, None),
]


@pytest.fixture(scope="module")
def places(spark):
    return search.annotate(spark.createDataFrame(PLACES, "ordinal long, id string, name string, lat string, lon string, priceRange string, openFor string, pageTitle string, description string"))


def test_annotation(places):
    rows = {r.id: r for r in places.collect()}
    assert rows["a"].lat == 51.5 and rows["b"].offset_x == rows["b"].offset_y == 0
    assert math.hypot(rows["a"].offset_x, rows["a"].offset_y) == pytest.approx(11)
    assert math.hypot(rows["c"].offset_x, rows["c"].offset_y) == pytest.approx(11)
    assert (rows["a"].offset_x, rows["a"].offset_y) != (rows["c"].offset_x, rows["c"].offset_y)
    assert rows["a"].search_text == "alpha $$ lunch eggs. best brunch guide"


def test_filter_and_rank(places):
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(search.search(places, " Brunch ")) == ["b", "a"]  # the name before the guide
    assert ids(search.matching(places, "", "$$")) == ["a"]
    assert ids(search.matching(places, "gamma", "$$")) == []
    assert sorted(ids(search.matching(places))) == ["a", "b", "c"]
    assert ids(search.search(places.where("false"), "x")) == []


def test_distance_formats(spark):
    rows = spark.createDataFrame([(420.0,), (1234.0,), (12345.0,), (949.9,), (float("nan"),), (None,)], "m double")
    assert [r[0] for r in rows.select(text.format_distance(F.col("m"))).collect()] == ["420 m", "1.2 km", "12 km", "950 m", "", ""]


@pytest.mark.parametrize(("metres", "minutes"), [(0, 1), (80, 1), (800, 13)])
def test_walk_minutes(spark, metres, minutes):
    assert spark.range(1).select(geo.walk_minutes(F.lit(float(metres)))).first()[0] == minutes


def test_reach(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14)], "n int").select(geo.reach_minutes(F.col("n")))
    assert [r[0] for r in rows.collect()] == [9, 9, 9, 9, 15, 15, 15, 16, 17, 18, 19, 20]


STATIONS = [("Oxford Circus", 51.5152, -0.1418, ["Victoria line"]), ("Bond Street", 51.5142, -0.1494, ["Central line"]), ("Green Park", 51.5067, -0.1428, ["Piccadilly line"]), ("Bank", 51.5133, -0.0886, ["Northern line"]), ("Ghost Halt", 51.5153, -0.1420, [])]


def within(spark, rows, root=(51.5152, -0.1418), **options):
    s = spark.createDataFrame([(n, a, o, [(x,) for x in ls]) for n, a, o, ls in rows], "name string, lat double, lon double, lines array<struct<name: string>>")
    r = spark.createDataFrame([("r", *root)], "root_id string, lat double, lon double")
    return [(x.name, [y.name for y in x.lines]) for x in stations.stations_within(r, s, **options).orderBy("place").collect()]


def test_stations_within(spark):
    wide = {"bands": ((None, 99, None),), "floor": 99}
    assert [n for n, _ in within(spark, STATIONS, **wide)] == ["Oxford Circus", "Bond Street", "Green Park"]
    assert [n for n, _ in within(spark, STATIONS)] == ["Oxford Circus", "Bond Street"]
    assert within(spark, [], **wide) == []
    assert within(spark, STATIONS, root=(None, None)) == []


def test_a_line_is_listed_once(spark):
    at = [("A", 51.5155, -0.1410, ["x", "y"]), ("B", 51.5157, -0.1410, ["y"]), ("C", 51.5159, -0.1410, ["x"]), ("D", 51.5161, -0.1410, ["x", "z"])]
    assert within(spark, at, limit=2) == [("A", ["x", "y"]), ("D", ["z"])]
    assert within(spark, at, limit=1) == [("A", ["x", "y"])]


def test_merged_stations(spark):
    kind = "ordinal long, name string, lon double, lat double, lines array<struct<name: string, color: string, tfl: boolean>>"
    rows = [(0, "London Euston", -0.1, 51.5, [("N", "#0", True)]), (1, "Euston", -0.101, 51.5, [("N", "#1", True), ("V", "#2", True)]), (2, "Euston", -0.2, 51.5, []), (3, "St. Paul's", -0.3, 51.5, []), (4, "St Paul’s", -0.3, 51.5005, [])]
    got = {r.ordinal: r for r in stations.merge_stations(spark.createDataFrame(rows, kind)).collect()}
    assert sorted(got) == [0, 2, 3]
    assert got[0].name == "Euston" and got[0].members == 2 and [x.name for x in got[0].lines] == ["N", "V"] and got[0].lines[0].color == "#0"
    assert got[3].members == 2


def test_half_even_is_that_of_the_binary_value(spark):
    rng = random.Random(7)
    xs = [rng.uniform(-180, 180) for _ in range(2000)] + [k / 128 for k in range(-3000, 3000)] + [0.0000005, 2.675, 1.005, 51.1234565, -0.1234565, 1e15, 1e300, -2.5e-7]
    xs += [math.nextafter(x, up) for x in xs[2000:5000] for up in (-math.inf, math.inf)]
    for digits in (0, 2, 6):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.half_even(F.col("x"), digits).alias("y")).collect()
        assert [r.y for r in got] == [round(r.x, digits) for r in got]
    odd = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE)), (CAST('NaN' AS DOUBLE)), (CAST('Infinity' AS DOUBLE)) AS t(x)").select(text.half_even(F.col("x"), 6).alias("y")).collect()
    assert odd[0].y is None and math.isnan(odd[1].y) and odd[2].y == math.inf


def _one_by_one(rows, most=stations.MERGE_METRES):
    """The merge as it is told: node by node, the first cluster of the name whose mean is near."""
    per_lon, by_key = geo.PER_LON * math.cos(math.radians(geo.FIXED_LAT)), {}
    for ordinal, name, lon, lat, lines in rows:
        clusters = by_key.setdefault(name.removeprefix("London ").lower(), [])
        near = next((c for c in clusters if math.hypot((lon - c["lon"]) * per_lon, (lat - c["lat"]) * geo.PER_LAT) <= most), None)
        if near is None:
            clusters.append({"ordinal": ordinal, "name": name, "lon": lon, "lat": lat, "members": 1, "lines": dict(lines)})
            continue
        n = near["members"]
        near.update(name=min(near["name"], name, key=len), lon=(near["lon"] * n + lon) / (n + 1), lat=(near["lat"] * n + lat) / (n + 1), members=n + 1, lines={**dict(lines), **near["lines"]})
    return {c["ordinal"]: (c["name"], round(c["lon"], 9), round(c["lat"], 9), c["members"], sorted(c["lines"].items())) for cs in by_key.values() for c in cs}


@pytest.mark.parametrize("run_rows", [10**6, 40, 0])
@pytest.mark.parametrize("width", [0.05, 1.5])
def test_merged_stations_are_those_of_the_fold(spark, run_rows, width, monkeypatch):
    monkeypatch.setattr(stations, "TILE", 4)  # borders are many
    rng = random.Random(5)
    rows = []
    for k in range(500):
        name = "Halt" if k % 3 else rng.choice(["London Halt", "Quay", "London Quay"])
        at = rng.uniform(-width, width), 51.5 + rng.uniform(-width, width) / 2
        if rows and k % 7 == 0:
            at = rows[rng.randrange(len(rows))][2:4]  # points come again
        rows.append((k, name, *at, [(f"L{rng.randrange(4)}", f"#{k}")]))
    kind = "ordinal long, name string, lon double, lat double, lines array<struct<name: string, color: string, tfl: boolean>>"
    df = spark.createDataFrame([(*r[:4], [(*x, True) for x in r[4]]) for r in rows], kind).repartition(3)
    got = {r.ordinal: (r.name, round(r.lon, 9), round(r.lat, 9), r.members, sorted((x.name, x.color) for x in r.lines)) for r in stations.merge_stations(df, run_rows=run_rows).collect()}
    assert got == _one_by_one(rows)


def test_merged_stations_of_odd_rows(spark):
    kind = "ordinal long, name string, lon double, lat double, lines array<struct<name: string, color: string, tfl: boolean>>, extra int"
    rows = [(0, "A", None, 51.5, None, 1), (1, "A", float("nan"), 51.5, [], 1), (2, None, 0.0, 51.5, None, 1), (3, None, 0.0, 51.5, [("N", "#1", True)], 1), (4, "A", 0.0, 51.5, [("N", "#1", True)], 1)]
    got = {r.ordinal: (r.name, r.members, len(r.lines)) for r in stations.merge_stations(spark.createDataFrame(rows, kind)).collect()}
    assert got == {0: ("A", 1, 0), 1: ("A", 1, 0), 2: (None, 2, 1), 4: ("A", 1, 1)}
    assert stations.merge_stations(spark.createDataFrame([], kind)).isEmpty()


def test_line_assignment(spark):
    nodes = spark.createDataFrame([(0, "A", -0.10, 51.50), (1, " B ", -0.12, 51.50), (2, "C", -0.20, 51.55)], "ordinal long, name string, lon double, lat double")
    line = "struct<name: string, color: string, tfl: boolean>"
    stops = spark.createDataFrame([(0, 51.5001, -0.1001, ("Z", "#1", True)), (1, 51.5, -0.1002, ("Rail", "#2", False)), (2, 51.5, -0.1, ("Z", "#1", True))], f"stop_id long, lat double, lon double, line {line}")
    drawn = spark.createDataFrame([(("Q", "#3", False), [[-0.13, 51.5005], [-0.11, 51.5005]])], f"line {line}, path array<array<double>>")
    got = {r.name: [x.name for x in r.lines] for r in stations.assign_lines(nodes, stops, drawn).collect()}
    assert got == {"A": ["Z", "Rail"], "B": ["Q"]}  # C has none and goes


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://x.example.com/?r=a%20b#12.50/51.50000/-0.12000", ("a b", 12.5, 51.5, -0.12)), ("https://x.example.com/#1/2", (None, None, None, None)), ("https://x.example.com/#nonsense", (None, None, None, None)), (None, (None, None, None, None))],
)
def test_view_state(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "u string").select(url.view_state(F.col("u")).alias("v")).select("v.*").first()) == want


def test_links(spark):
    row = spark.createDataFrame([(None, "Café & Co", "1 High St", 51.5, -0.08)], "g string, name string, address string, lat double, lon double")
    one = lambda c: row.select(c).first()[0]
    assert one(url.map_link(F.col("g"), F.col("name"), F.col("address"), F.col("lat"), F.col("lon"))) == "https://www.google.com/maps/search/?api=1&query=Caf%C3%A9%20%26%20Co%2C%201%20High%20St"
    assert "endcoord=51.5%2C-0.08&endname=Caf%C3%A9+%26+Co" in one(url.transit_link(F.col("name"), F.col("address"), F.col("lat"), F.col("lon")))
    assert one(url.transit_link(F.col("name"), F.col("address"), F.col("lat"), F.col("lon"), app=True)).startswith("intent://directions?endcoord=")
    assert "startname=Current+Location" in one(url.transit_link(F.col("name"), F.col("address"), F.col("lat"), F.col("lon"), F.lit(51.0), F.lit(0.0)))
    assert one(url.geocode_url(F.lit("Soho, W1"))).endswith("viewbox=-0.62%2C51.75%2C0.35%2C51.25&q=Soho%2C+W1")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(url.retry_after(F.lit("120"), now)) == 120.0
    assert one(url.retry_after(F.lit("Mon, 01 Jan 2024 00:01:00 GMT"), now)) == 60.0
    assert one(url.retry_after(F.lit("soon"), now)) in (None, 0.0)


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    path = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (1, 0), (9, 0), (2, 0), (2, 1)]))
    assert one(geo.clipped(path, -1, -1, 3, 3)) == [[[0.0, 0.0], [1.0, 0.0]], [[2.0, 0.0], [2.0, 1.0]]]
    back = F.array(*(F.array(F.lit(float(x)), F.lit(0.0)) for x in (3, 2, 1)))
    assert one(geo.oriented(back)) == [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]]
    assert one(geo.segment_distance_squared(*(F.lit(float(x)) for x in (0, 3, -5, 0, 5, 0)))) == 9
    assert one(geo.segment_distance_squared(*(F.lit(float(x)) for x in (1, 1, 0, 0, 0, 0)))) == 2
    assert [one(text.half_up(F.lit(x))) for x in (-2.5, 2.5)] == [-2.0, 3.0]


def test_cells_of_segments(spark):
    """Every point of a segment is in one of its cells; their number grows with its length; links are those of all pairs."""
    rng = random.Random(6)
    rows = [tuple(rng.uniform(-3000, 3000) for _ in range(4)) for _ in range(60)] + [(0.0, 0.0, 2500.0, 0.0), (5.0, -900.0, 5.0, 900.0), (7.0, 7.0, 7.0, 7.0), (150.0, 150.0, 300.0, 300.0), (0.0, 0.0, 1e5, 1e5)]
    got = spark.createDataFrame(rows, "ax double, ay double, bx double, by double").select("*", geo.cells_along(*map(F.col, ("ax", "ay", "bx", "by")), 150.0).alias("cells")).collect()
    for r in got:
        cells = {(c.row, c.col) for c in r.cells}
        for k in range(400):
            t = k / 399
            assert (math.floor((r.ay + t * (r.by - r.ay)) / 150), math.floor((r.ax + t * (r.bx - r.ax)) / 150)) in cells
        assert len(cells) <= 2 * (abs(r.bx - r.ax) + abs(r.by - r.ay)) / 150 + 6
    points = [(k, f"S{k}", rng.uniform(-0.2, 0.2), 51.5 + rng.uniform(-0.1, 0.1), []) for k in range(150)]
    lines = [(f"L{k}", [[rng.uniform(-0.2, 0.2), 51.5 + rng.uniform(-0.1, 0.1)] for _ in range(3)]) for k in range(8)]
    p = spark.createDataFrame(points, "ordinal long, name string, lon double, lat double, lines array<string>")
    found = stations.lines_beside(p, spark.createDataFrame(lines, "line string, path array<array<double>>"))
    every = stations.segments(spark.createDataFrame(lines, "line string, path array<array<double>>")).join(p.select("ordinal", geo.plane_x(F.col("lon")).alias("px"), geo.plane_y(F.col("lat")).alias("py")), how="cross")
    want = every.where(geo.segment_distance_squared(*map(F.col, ("px", "py", "ax", "ay", "bx", "by"))) <= stations.LINE_METRES**2).select("ordinal", "line").distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_order_of_a_locale(spark):
    """Punctuation, digits, letters; then accents; then case, small letters first. Lists and lines go by it."""
    want = ["_a", "10", "9", "E clair", "e-clair", "eclair", "Eclair", "éclair", "Zoe", "zoo"]
    rows = spark.createDataFrame([(k, n, None, 51.5, -0.1) for k, n in enumerate(reversed(want))], "ordinal long, name string, priceRange string, lat double, lon double")
    assert [r.name for r in search.in_view(rows).collect()] == want
    lines = spark.createDataFrame([([(n, n == "zoo") for n in reversed(want)],)], "l array<struct<name: string, tfl: boolean>>")
    assert [x.name for x in lines.select(stations.ordered_lines(F.col("l"))).first()[0]] == ["zoo", *want[:-1]]


def test_fans(spark):
    rows = spark.createDataFrame([(0, "a", None, 0.0, 0.0), (1, "b", "$", 20.0, 0.0), (2, "c", None, 40.0, 0.0)], "ordinal long, id string, priceRange string, x double, y double")
    members = search.overlapping(rows, 0.0, 0.0)
    assert sorted(r.id for r in members.collect()) == ["a", "b"]
    assert [r.slot for r in search.fan(members).orderBy("slot").collect()] == [0, 1]
    assert sorted(r.id for r in search.pruned_fan(rows, "a", "c").collect()) == ["a", "b", "c"]
    assert search.pruned_fan(rows.where("id = 'a'"), "a", None).count() == 0
