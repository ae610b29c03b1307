"""One document read by many tasks gives the rows of the whole read, wherever it is cut."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from placeloom.sources import readers, split


@pytest.fixture
def cuts(spark, monkeypatch):
    """Sets the bytes of a range and of a chunk; they are as before afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def at(block, chunk):
        monkeypatch.setattr(split, "CHUNK", chunk)
        spark.conf.set(names[0], block)
        spark.conf.set(names[1], 1)

    yield at
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def documents(rng):
    """JSON documents whose strings hold all that structure is made of."""
    words = ["a", "}", "{", "]", "[", ",", '"', "\\", '\\"', "é", "\n", "features", '"features": [', ":", " ", "😀"]
    text = lambda: "".join(rng.choices(words, k=rng.randint(0, 12)))
    item = lambda: rng.choice([None, {"id": text(), "tags": {text(): text(), "elements": [1, {"x": [text()]}]}, "list": [[1, 2], [text()]]}, {"id": text()}, {}])
    listed = [item() for _ in range(rng.randint(0, 30))]
    root = {text() + "k": rng.choice([text(), 3, None, {"features": [1, {"z": 2}]}, [{"features": [text()]}, 1], []]) for _ in range(rng.randint(0, 4))}
    keys = [*root.items(), ("features", listed)]
    rng.shuffle(keys)
    return dict(keys), listed


@pytest.mark.parametrize(("block", "chunk"), [(400, 1), (1500, 100), (1 << 27, 1 << 20)])
def test_items_of_one_document(spark, tmp_path, cuts, block, chunk):
    rng = random.Random(block + chunk)
    want = []
    for k in range(4):
        root, listed = documents(rng)
        (tmp_path / f"{k:02d}.json").write_text(json.dumps(root, ensure_ascii=k % 2 == 0, indent=rng.choice([None, 2])) + rng.choice(["", "\n", " \n "]))
        want += [(k, n, x) for n, x in enumerate(listed)]
    cuts(block, chunk)
    rows = split.json_items(spark, str(tmp_path), "features")
    got = [(int(r["file"][-7:-5]), r["ordinal"], json.loads(r["text"])) for r in rows.collect()]
    assert sorted(got, key=lambda x: x[:2]) == want


def test_documents_that_are_not_whole(spark, tmp_path, cuts):
    """Cut off anywhere, without the key or empty: no items, as the whole read has none."""
    for k, text in enumerate(['{"features": [{"a": 1}', '{"features": [{"a": 1}]', '{"features": [{"a": 1}]\n', '{"features": [{"a": "x}]}', "", "{}", '{"other": [{"a": 1}]}', '{"features": {"a": [1]}}', '{"features": []}', '{"x": {"features": [{"a": 1}]}}']):
        (tmp_path / f"{k}.json").write_text(text)
    cuts(1 << 20, 5)
    assert split.json_items(spark, str(tmp_path), "features").count() == 0


def test_features_and_elements_in_many_tasks(spark, tmp_path, cuts):
    """The readers give the same rows for one range and for many, and many tasks take part."""
    features = [{"properties": {"station": k % 3 == 0, "name": f" S{k}}} "}, "geometry": {"type": "Point", "coordinates": [k / 10, 51.5]}} if k % 2 else {"properties": {"line": "L"}, "geometry": {"type": "LineString", "coordinates": [[k, 0], [1, 1]]}} for k in range(200)]
    elements = [{"type": "node", "id": k, "lat": 1.5, "lon": k / 7, "tags": {"name": "a}b"}} if k % 2 else {"type": "way", "id": k, "geometry": [{"lat": 1, "lon": 2}, None]} for k in range(200)]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "e.json").write_text(json.dumps({"version": 0.6, "elements": elements}))
    read = lambda: [sorted(map(str, (tuple(r) for r in f(spark, str(tmp_path / n)).collect()))) for f, n in ((readers.geojson_features, "f.json"), (readers.osm_elements, "e.json"))]
    whole = read()
    cuts(1500, 400)
    assert read() == whole and [len(x) for x in whole] == [200, 200]
    assert split._chunks(spark, str(tmp_path / "f.json"), "}", split._json_told).select("start").distinct().count() > 8
    assert readers.station_features(readers.geojson_features(spark, str(tmp_path / "f.json"))).orderBy("ordinal").first()["name"] == "S3}"


def test_what_a_chunk_does_to_the_state():
    """Told from any start, chunks add up to the whole."""
    rng = random.Random(1)
    for _ in range(50):
        data = json.dumps(documents(rng)[0], ensure_ascii=False).encode()
        pieces = [x + b"}" for x in data.split(b"}")]
        quotes = depth = 0
        for piece in pieces:
            told = split._json_told(piece)
            depth += told["inside" if quotes % 2 else "outside"]
            quotes += told["quotes"]
        assert quotes % 2 == 0 and depth == -1


@pytest.mark.parametrize(("block", "chunk"), [(150, 1), (1 << 27, 1 << 20)])
def test_csv_records(spark, tmp_path, cuts, block, chunk):
    rng = random.Random(block)
    cells = ["", "a", "two\nlines", 'a "quoted" word', "comma, here", '"', "é\n\n", '5" pipe', "\\", "x" * 60]
    want = []
    for name in ("a", "b"):
        rows = [[rng.choice(cells) for _ in range(3)] for _ in range(20)]
        out = io.StringIO()
        w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerows([["url", "note", "third"], *rows])
        text = ("﻿" if name == "a" else "") + out.getvalue()
        (tmp_path / f"{name}.csv").write_bytes((text + "\n\n" if name == "b" else text.rstrip("\r\n")).encode())
        want += [r for r in csv.reader(io.StringIO(out.getvalue(), newline="")) if any(r)][1:] if name == "b" else list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:]
    want = [[v or None for v in r] for r in want]
    cuts(block, chunk)
    rows = readers.csv_rows(spark, str(tmp_path))
    assert rows.columns == ["url", "note", "third", "ordinal"]
    got = rows.orderBy("ordinal").collect()
    kept = [r for r in want]
    assert [r["ordinal"] for r in got] == list(range(len(got)))
    assert [[r["url"], r["note"], r["third"]] for r in got] == kept


def test_csv_state_by_function():
    """A chunk that begins inside quotes and one that doesn't, against a reader that goes byte by byte."""
    rng = random.Random(2)

    def slow(data, quoted):
        state, ends = ("in" if quoted else "start"), []
        for k, c in enumerate(data):
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote" and c == '"':
                state = "in"
            elif c == '"' and state == "start":
                state = "in"
            elif c == "\n":
                ends.append(k)
                state = "start"
            else:
                state = "start" if c == "," else "plain"
        return state == "in", ends

    for _ in range(3000):
        data = "".join(rng.choices('a",\n', k=rng.randint(0, 12))) + "\n"
        for quoted in (False, True):
            inside, ends = split._records(data.encode(), quoted)
            assert (inside, ends.tolist()) == slow(data, quoted), (data, quoted)
