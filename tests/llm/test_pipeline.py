import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: rng.choices(words, k=n)
    rows, labels = [], []
    for k in range(300):
        w = make(rng.randint(60, 160))
        if k % 5 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "vile"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(k % 5 == 0)))
    passage = " ".join(f"passage{i}" for i in range(60))
    plain = " ".join(make(200))
    edited = plain.split()
    edited[100] = "edited"
    rows += [(1000, plain, "en", "s", 0), (1001, plain, "en", "s", 0), (1002, " ".join(edited), "en", "s", 0)]
    rows += [(1100, "one " + " ".join(make(40)) + " " + passage, "en", "s", 0), (1101, "two " + " ".join(make(40)) + " " + passage + " end", "en", "s", 0)]
    rows += [(1200, "you n4sty " + " ".join(make(30)) + " vile nasty vile", "en", "s", 0), (1300, None, "en", "s", 0), (1301, "", None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), {r[0]: r[1] for r in rows}


def test_stages(spark, corpus, tmp_path):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = kept["toxicity"]
    assert not {k for k in range(0, 300, 5)} & set(first) and 1200 not in first
    assert set(first) == {k for k in texts if not (k < 300 and k % 5 == 0) and k != 1200}
    second = kept["near duplicates"]
    assert set(first) - set(second) == {1001, 1002, 1301}
    third = kept["repeated passages"]
    assert "passage30" in third[1100] and "passage30" not in third[1101] and third[1101].startswith("two ") and third[1101].endswith(" end")
    assert set(second) == set(third)  # the empty text too: nothing was taken from it
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(third)
    whole = {(r.doc_id, r.start, r.length) for r in pieces}
    assert whole == {(r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, path).collect()}


def test_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_rows_that_repeat_an_id(spark, corpus):
    """A row goes for its own text only, never for its id."""
    path, _ = corpus
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(3000)], k=150)) for _ in range(4))
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (8, c + " " + d, 5), (9, "x " + c, 6), (9, None, 7), (None, d, 8), (None, None, 9), (2, "", 10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, k, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, __kept int, __id int, own int")
    kept = corpus_pipeline.one_of_each(spark, docs, path)
    assert kept.columns == docs.columns
    got = {r.own for r in kept.collect()}
    assert got in ({1, 3, 5, 6, 8, 9, 10}, {1, 4, 5, 6, 8, 9, 10})
    rest = {r.own: r.text for r in corpus_pipeline.own_passages(spark, docs, path).collect()}
    assert set(rest) == {1, 3, 4, 5, 6, 7, 9, 10} and rest[3] == rest[4] == b and rest[6] == "x" and rest[7] is None and rest[5] == c + " " + d


def test_a_clashing_pipeline(spark, corpus, tmp_path):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS shard", "'k' AS kept", "2 AS node", "3 AS component", "'t' AS tokens", "4 AS row", "5 AS own", "6 AS label")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema["row"].dataType == docs.schema["row"].dataType
        out.write.parquet(str(tmp_path / f"c{k}"))
        docs = spark.read.parquet(str(tmp_path / f"c{k}"))
    assert corpus_pipeline.STAGES[3][1](spark, docs, path).count() > 0
