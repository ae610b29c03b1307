import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import text
from placeloom.operators import dedupe

KIND = "ordinal long, id string, name string, lat double, lon double, address string, priceRange string, description string, phone string, websiteUrl string, googleMapsUrl string, entryUrl string, pageTitle string"
NORTH = 1 / 111195  # degrees of a metre


def entry(k, name, metres=0.0, address="", price=None, description="", **more):
    return (k, f"id{k}", name, 51.5 + metres * NORTH, -0.1, address, price, description, more.get("phone"), more.get("website"), more.get("maps"), more.get("url", f"https://g.example.com/{k}"), more.get("title", f"G{k}"))


def clusters(spark, rows, column="final_id"):
    got = dedupe.clustered(spark.createDataFrame(rows, KIND)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r[column], set()).add(r.ordinal)
    assert len(got) == len(rows)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Dish @ The Place", "place"), ("Dish at Place", "place"), ("A at B at C", "c"), ("40 Maltby Street", "40 maltby st"), ("40 Maltby St", "40 maltby st"), ("St John", "st john"), ("Brûlée & Co", "brulee and co"), ("The Restaurant London", ""), ("", ""), (None, "")],
)
def test_name_keys(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "n string").select(text.name_key(F.col("n"))).first()[0] == key


def test_radius_and_order(spark):
    assert clusters(spark, [entry(0, "X"), entry(1, "X", 120), entry(2, "X", 199)]) == [[0, 1, 2]]
    assert clusters(spark, [entry(0, "X"), entry(1, "X", 201)]) == [[0], [1]]
    # one that lies between joins the first and merges nothing
    assert clusters(spark, [entry(0, "X"), entry(1, "X", 390), entry(2, "X", 195)], "geo_id") == [[0, 2], [1]]
    assert clusters(spark, [entry(0, "X"), entry(1, "Y")]) == [[0], [1]]


def test_postcodes(spark):
    far = [entry(0, "X", 0, "1 A St, EC1M 4AY"), entry(1, "X", 5000, "1 a st ec1m4ay"), entry(2, "X", 9000, "2 B St, E1 6AN"), entry(3, "X", 12000, "none")]
    assert clusters(spark, far) == [[0, 1], [2], [3]]


def test_subset_names(spark):
    assert clusters(spark, [entry(0, "Ombra"), entry(1, "Ombra Bar & Restaurant", 10)]) == [[0, 1]]
    assert clusters(spark, [entry(0, "Ombra"), entry(1, "Ombra Bar & Restaurant", 61)]) == [[0], [1]]
    assert clusters(spark, [entry(0, "Ombra Wine"), entry(1, "Ombra Bar", 5)]) == [[0], [1]]
    assert clusters(spark, [entry(0, "Ombra Bar"), entry(1, "Ombra", 50), entry(2, "Ombra Wine", 100)]) == [[0, 1, 2]]


def test_places_without_names_or_coordinates(spark):
    rows = [entry(0, "The London"), entry(1, "The London"), entry(2, "X"), entry(3, "X")]
    rows[3] = (*rows[3][:3], None, None, *rows[3][5:])
    assert clusters(spark, rows) == [[0], [1], [2], [3]]
    assert dedupe.clustered(spark.createDataFrame([], KIND)).count() == 0


def reference(rows):
    """The greedy clustering, one entry after the other."""
    dist = lambda a, b: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2))
    out = {}
    for name, group in itertools.groupby(sorted(rows, key=lambda r: (r[2], r[0])), key=lambda r: r[2]):
        found = []
        for r in group:
            hit = next((c for c in found if any(dist(r, x) <= 200 for x in c)), None)
            found.append([r]) if hit is None else hit.append(r)
        out |= {r[0]: c[0][0] for c in found for r in c}
    return out


def test_greedy_as_one_by_one(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        e = list(entry(k, rng.choice(["Foo", "Bar"])))
        e[3], e[4] = 51.5 + rng.uniform(0, 0.02), -0.1 + rng.uniform(0, 0.03)
        rows.append(tuple(e))
    got = {r.ordinal: r.geo_id for r in dedupe.geo_clusters(dedupe.keyed(spark.createDataFrame(rows, KIND))).collect()}
    assert got == reference(rows)


@pytest.mark.parametrize("spread", [0.02, 0.003])
def test_greedy_in_rounds(spark, monkeypatch, spread):
    """Runs larger than a task's are clustered over links between cells: the same clusters, whatever the order and crowding."""
    monkeypatch.setattr(dedupe, "RUN_ROWS", 3)
    rng = random.Random(spread)
    rows = []
    for k in rng.sample(range(10_000), 300):
        e = list(entry(k, rng.choice(["Foo", "Foo", "Bar"])))
        e[3], e[4] = (51.5, -0.1) if rng.random() < 0.1 else (51.5 + rng.uniform(0, spread), -0.1 + rng.uniform(0, 2 * spread))
        rows.append(tuple(e))
    far = [(20_000 + k, str(k), "North", 78 + rng.uniform(0, 0.02), 15 + rng.uniform(0, 0.1), *entry(0, "")[5:]) for k in range(60)]
    alone = [(*entry(30_000, "Foo", 90_000.0),), (*entry(30_001, "None")[:3], None, None, *entry(0, "")[5:])]
    got = {r.ordinal: r.geo_id for r in dedupe.geo_clusters(dedupe.keyed(spark.createDataFrame(rows + far + alone, KIND))).collect()}
    assert got == reference(rows + far + alone[:1]) | {30_001: 30_001}
    assert len(set(got.values())) < len(got) / 2


def test_greedy_where_rows_crowd(spark):
    """Rows that repeat a point cost no more the more there are; far north a degree of longitude is short."""
    n = 40_000
    places = spark.range(n).selectExpr("id AS ordinal", "cast(id as string) AS id", "'X' AS name", "51.5D + (id % 3) * 0.0001D AS lat", "-0.1D + (id % 2) * 0.0001D AS lon")
    assert {r.geo_id for r in dedupe.geo_clusters(dedupe.keyed(places)).select("geo_id").distinct().collect()} == {0}
    rng = random.Random(5)
    rows = [(k, str(k), "X", 78 + rng.uniform(0, 0.02), 15 + rng.uniform(0, 0.1)) for k in range(200)]
    got = {r.ordinal: r.geo_id for r in dedupe.geo_clusters(dedupe.keyed(spark.createDataFrame(rows, "ordinal long, id string, name string, lat double, lon double"))).collect()}
    assert got == reference(rows)


def test_whole_resolution_as_one_by_one(spark):
    """All three passes beside a plain version: greedy, then shared postcodes, then names that hold one another."""
    rng = random.Random(11)
    names = ["Ombra", "Ombra Bar", "Ombra Bar Grill", "Kifto at Ombra", "Foo House", "Foo", "Bar"]
    rows = []
    for k in range(300):
        e = list(entry(k, rng.choice(names), price=rng.choice([None, "$"]), description="x" * rng.randrange(4)))
        e[3], e[4], e[5] = 51.5 + rng.uniform(0, 0.03), -0.1 + rng.uniform(0, 0.03), rng.choice(["", "1 St, E8 4LX", "2 St, N1 9GU", "no code"]) if rng.random() < 0.05 else ""
        rows.append(tuple(e))
    df = spark.createDataFrame(rows, KIND)
    keys = {r.ordinal: (r.key, r.code, r.clean) for r in df.select("ordinal", text.name_key(F.col("name")).alias("key"), text.full_postcode(F.col("address")).alias("code"), text.is_clean_name(F.col("name")).alias("clean")).collect()}
    geo = reference([(*r[:2], keys[r[0]][0], *r[3:]) for r in rows])

    def united(of, pairs):
        up = {v: v for v in of.values()}
        def root(v):
            while up[v] != v:
                v = up[v]
            return v
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return {k: root(v) for k, v in of.items()}

    ids = range(len(rows))
    place = united(geo, [(geo[a], geo[b]) for a, b in itertools.combinations(ids, 2) if keys[a][0] == keys[b][0] and keys[a][1] == keys[b][1] != ""])
    best = {}
    for k in sorted(ids, key=lambda k: (rows[k][6] is None, not keys[k][2], -len(rows[k][7]), rows[k][1])):
        best.setdefault(place[k], keys[k][0].split())
    dist = lambda a, b: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2))
    nested = lambda a, b: a and b and a[0] == b[0] and (set(a) <= set(b) or set(b) <= set(a))
    final = united(place, [(place[a], place[b]) for a, b in itertools.combinations(ids, 2) if nested(best[place[a]], best[place[b]]) and dist(rows[a], rows[b]) <= 60])
    got = {r.ordinal: (r.geo_id, r.place_id, r.final_id) for r in dedupe.clustered(df).collect()}
    assert got == {k: (geo[k], place[k], final[k]) for k in ids}
    assert len(set(geo.values())) > len(set(place.values())) > len(set(final.values()))


def test_merged_record(spark):
    rows = [
        entry(0, "Kifto @ Ombra", 0, "1 St", None, "Good.", phone="1", website="https://www.o.example.com/"),
        entry(1, "Ombra", 5, "1 St, London E8 4LX, UK", None, "A longer text.", phone="2", website="http://o.example.com"),
        entry(2, "Ombra Bar & Restaurant", 9, "", "$$", "good!", phone="1", maps="https://m.example.com", url="https://g.example.com/0"),
    ]
    (r,) = dedupe.resolved(spark.createDataFrame(rows, KIND)).collect()
    assert r.id == "id2" and r.priceRange == "$$"
    assert (r.name, r.namePre, r.nameCore, r.namePost) == ("Kifto at Ombra Bar & Restaurant", "Kifto at ", "Ombra", " Bar & Restaurant")
    assert r.address == "1 St, London E8 4LX, UK" and r.phones == ["1", "2"] and r.websiteUrls == ["https://www.o.example.com/"]
    assert [d.text for d in r.descriptions] == ["good!", "A longer text."]
    assert [s.entryUrl for s in r.sources] == ["https://g.example.com/0", "https://g.example.com/1"]
    counts, top = dedupe.report(spark.createDataFrame(rows, KIND), dedupe.resolved(spark.createDataFrame(rows, KIND)))
    assert tuple(counts.first()) == (3, 1, 2, 1) and top.first().sources == 2


def test_rounds_hand_on_each_row_a_few_times(spark, monkeypatch):
    """What a large run writes between its rounds grows as its rows, however many of them crowd around each."""
    monkeypatch.setattr(dedupe, "RUN_ROWS", 400)
    n, most, stored = 2000, [], dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda df, name: (most.append((out := stored(df, name)).count()), out)[1])
    rng = random.Random(7)
    rows = [(k, str(k), "X", 51.5 + rng.uniform(0, 0.02), -0.1 + rng.uniform(0, 0.03)) for k in range(n)]
    got = {r.ordinal: r.geo_id for r in dedupe.geo_clusters(dedupe.keyed(spark.createDataFrame(rows, "ordinal long, id string, name string, lat double, lon double"))).collect()}
    assert got == reference(rows)
    assert n < max(most) < 4 * n
