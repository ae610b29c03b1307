import json
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import html
from placeloom.operators import manifest
from placeloom.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    rows = streams.windowed_counts(streams.stream(spark, str(tmp_path / "in"), like), late="365 days")
    q = rows.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("windows").collect())
    assert got == sorted(tuple(r) for r in streams.windowed_counts(like).collect()) and got


def test_intake_of_odd_rows(spark):
    rows = spark.createDataFrame([(0, None), (1, "  "), (2, "guide.example.com/maps/x"), (3, "https://GUIDE.example.com/maps/x/"), (4, "https://guide.example.com/about?q=1#f"), (5, "https://else.example.com")], "ordinal long, url string")
    got = [(r.url, r.batch_key) for r in manifest.intake(rows).orderBy("input_row_number").collect()]
    assert ("https://guide.example.com/maps/x", "maps") in got and ("https://guide.example.com/about?q=1", "guide_example_com_rest") in got and ("https://else.example.com/", "other") in got
    assert manifest.intake(rows, limit=1).count() == 1 and manifest.intake(rows.where("false")).count() == 0
    assert [r.batch_key for r in manifest.selected(manifest.intake(rows)).orderBy("url").collect()].count("other") == 0


def test_retries(spark):
    kind = "url string, attempt int, http_status int, error string"
    rows = [("a", 1, 503, None), ("a", 2, 200, None), ("b", 1, 503, None), ("b", 2, 503, None), ("b", 3, 503, None), ("b", 4, 503, None), ("c", 1, None, "timeout"), ("c", 2, 503, None), ("c", 3, 503, None), ("c", 4, 503, None), ("d", 1, 404, None)]
    got = {r.url: tuple(r)[1:] for r in manifest.outcome(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": (2, "downloaded", 200, ""), "b": (4, "failed", None, ""), "c": (4, "failed", None, "timeout"), "d": (1, "http_error", 404, "HTTP 404")}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(manifest.backoff(F.lit(n))) for n in (1, 2, 3, 9)] == [10.0, 20.0, 40.0, 300.0]
    assert one(manifest.backoff(F.lit(1), F.lit(900))) == 900.0
    assert one(manifest.politeness(F.lit(3.0), F.lit(5.0), F.lit(0.5))) == 5.5
    assert [one(manifest.skipped_by_type(F.lit(t), html_only=True)) for t in ("text/html; x", "image/png", "")] == [False, True, True]


def test_described_points(spark):
    point = {"description": [{"plaintext": "Also at: A"}, {"plaintext": "Also at: A"}, {"plaintext": "Also at: B"}, {"plaintext": "Price range: none"}, {"html": "<p>Text <a href='https://x.example.com'>x</a></p>"}, 7]}
    df = spark.createDataFrame([(json.dumps(point),), ("{broken",), (None,)], "p string")
    a, b, c = [r.d for r in df.select(html.description(F.col("p")).alias("d")).collect()]
    assert a.additional_location_notes == "A; B" and a.price_range is None and a.text == "Price range: none Text x" and [x.url for x in a.links] == ["https://x.example.com"]
    assert b.text == c.text == "" and b.notes == "{}"
    assert html.booking({"opentable": {"naturalReservationUrl": "u"}}, {"href": "v"}) == ("opentable", "u") and html.booking({}, "v") == ("campaign_custom_link", "v") and html.booking({}, None) == (None, None)
    assert html.block_html({"__typename": "CoreListBlockType", "ordered": True, "items": [{"contents": {"html": "a"}}, {}]}) == "<ol><li>a</li></ol>" and html.block_html({"__typename": "x"}) == ""


VERSIONED = "url string, version long, status string"


def test_a_manifest_batch_may_run_again(spark, tmp_path):
    path = str(tmp_path / "manifest")
    batches = [spark.createDataFrame(rows, VERSIONED) for rows in ([("a", 1, "x"), ("b", 1, "x")], [("b", 2, "y"), ("c", 1, "x")], [("a", 0, "old"), ("d", 5, "z")])]
    write = streams.manifest_writer(spark, path)
    rows = lambda: sorted(tuple(r) for r in streams.current(spark, path).collect())
    assert streams.current(spark, path) is None
    write(batches[0], 0)
    write(batches[1], 1)
    assert rows() == [("a", 1, "x"), ("b", 2, "y"), ("c", 1, "x")]
    write(batches[1], 1)  # replayed after it was published
    assert rows() == [("a", 1, "x"), ("b", 2, "y"), ("c", 1, "x")]
    write(batches[2], 2)
    assert rows() == [("a", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("d", 5, "z")]


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    """Two streaming queries one after the other, with checkpoints of their own and each restarted: every row is there once."""
    path = str(tmp_path / "manifest")
    urls = iter("abcdefgh")
    for checkpoint in ("one", "two"):
        for run in range(2):
            spark.createDataFrame([(next(urls), 1, checkpoint)], VERSIONED).coalesce(1).write.mode("append").parquet(str(tmp_path / checkpoint))
            spark.createDataFrame([(next(urls), 1, checkpoint)], VERSIONED).coalesce(1).write.mode("append").parquet(str(tmp_path / checkpoint))
            like = spark.read.parquet(str(tmp_path / checkpoint))
            q = streams.stream(spark, str(tmp_path / checkpoint), like).writeStream.foreachBatch(streams.manifest_writer(spark, path, compact=3)).option("checkpointLocation", str(tmp_path / f"c-{checkpoint}")).start()
            q.processAllAvailable()
            q.stop()
            assert len(streams.published(spark, path)) == (0 if checkpoint == "one" else 4) + 2 * run + 2
    marks = streams.published(spark, path)
    assert len({m.query for m in marks}) == 2 and [m.batch for m in marks] == [0, 1, 2, 3] * 2
    assert sorted(r.url for r in streams.current(spark, path).collect()) == list("abcdefgh")


def test_a_log_of_changes_is_the_manifest(spark, tmp_path):
    """At every generation, whole or changes, the merged log is what upserts one after the other give; replaced data go."""
    path, rng = str(tmp_path / "manifest"), random.Random(4)
    write = streams.manifest_writer(spark, path, compact=3, query="q")
    want = spark.createDataFrame([], VERSIONED)
    for batch in range(9):
        rows = [(rng.choice([None, *"abcdef"]), rng.choice([None, 1, 2, 3]), f"{batch}-{k}") for k in range(rng.randint(0, 6))]
        changes = spark.createDataFrame(rows, VERSIONED)
        want = spark.createDataFrame([tuple(r) for r in manifest.upserted(want, changes).collect()], VERSIONED)
        write(changes, batch)
        write(changes, batch)
        assert sorted(map(tuple, streams.current(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    marks = streams.published(spark, path)
    assert [m.kind for m in marks] == ["done"] * 3 + ["whole", "changes", "changes", "whole", "changes", "changes"]
    assert len(list((tmp_path / "manifest").glob("generation=*"))) == 6


def test_a_crash_beside_the_pointer_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "manifest")
    first, second = (spark.createDataFrame(rows, VERSIONED) for rows in ([("a", 1, "x"), ("b", 1, "x")], [("c", 1, "x")]))
    write = streams.manifest_writer(spark, path)
    write(first, 0)
    publish = streams._publish

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(streams, "_publish", crash)
    with pytest.raises(KeyboardInterrupt):
        write(second, 1)
    assert sorted(r.url for r in streams.current(spark, path).collect()) == ["a", "b"]  # the last whole one
    monkeypatch.setattr(streams, "_publish", publish)
    streams.manifest_writer(spark, path)(second, 1)
    assert sorted(r.url for r in streams.current(spark, path).collect()) == ["a", "b", "c"]
    for x in (tmp_path / "manifest" / "_published").iterdir():
        x.unlink()
    with pytest.raises(RuntimeError):
        streams.manifest_writer(spark, path)(first, 2)


def test_ties_and_null_versions(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", None, "old"), ("c", 3, "old"), (None, 1, "old")], VERSIONED)
    new = spark.createDataFrame([("a", 1, "new"), ("b", None, "new"), ("c", None, "new"), ("d", None, "new"), ("e", 1, "p"), ("e", 1, "q")], VERSIONED)
    got = sorted(((r.url or "", r.version, r.status) for r in manifest.upserted(old, new).collect()), key=str)
    assert got == sorted([("", 1, "old"), ("a", 1, "new"), ("b", None, "new"), ("c", 3, "old"), ("d", None, "new"), ("e", 1, "q")], key=str)
    assert manifest.upserted(old.where("false"), new.where("false")).count() == 0


def test_rows_of_csv_files_are_numbered_without_gaps(spark, tmp_path):
    from placeloom.sources import readers

    for name, n in (("a", 3), ("b", 2), ("c", 4)):
        (tmp_path / f"{name}.csv").write_text("\ufeffurl,note\n" + "".join(f'{name}{k},"two\nlines"\n' for k in range(n)))
    got = [(r.ordinal, r.url) for r in readers.csv_rows(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == list(enumerate(["a0", "a1", "a2", "b0", "b1", "c0", "c1", "c2", "c3"]))


@pytest.mark.parametrize(
    ("pattern", "text"),
    [(r"^https?://[^/]+/en/\d+$", "http"), (r"/maps/best\-of\.html", "/maps/best-of.html"), (r"abcd?e", "abc"), (r"abc+de", "abc"), (r"ab{2,30}cdef", "cdef"), (r"(abcdef)?gh", "gh"), (r"abcd|efgh", ""), (r"(ab|cd)efg", "efg"), (r"(?i)abcd", ""), (r"[]x]abc[^]]", "abc"), (r"x[a[bcde]]y", ""), (r"", ""), (None, ""), (r"a.*bcd", "bcd"), (r"\Qa.b\E", "")],
)
def test_text_that_a_pattern_needs(pattern, text):
    from placeloom.operators import audit

    assert max(audit.required_texts(pattern), key=len, default="") == text


def test_patterns_by_index(spark, monkeypatch):
    """The index gives the matches of the nested loop, and a URL meets few patterns."""
    from placeloom.operators import audit

    rng = random.Random(9)
    words = ["maps", "best", "pubs", "soho", "guide", "list", "wine", "bars"]
    urls = spark.createDataFrame([(f"https://guide.example.com/{rng.choice(words)}/{rng.choice(words)}-{k}", k % 9 == 0) for k in range(300)], "url string, is_sitemap boolean")
    kinds = [lambda: f"/{rng.choice(words)}/", lambda: f"{rng.choice(words)}-{rng.randrange(300)}$", lambda: rf"/{rng.choice(words)}s?/[a-z]+-\d{rng.randrange(10)}", lambda: f"({rng.choice(words)}|{rng.choice(words)})-1", lambda: f"^https://.*{rng.choice(words)}-{rng.randrange(300)}", lambda: "nothing-like-it"]
    rules = spark.createDataFrame([(k, "regex", rng.choice(kinds)()) for k in range(150)], "rule_id int, kind string, value string")
    got = sorted(map(tuple, audit.matches(urls, rules).collect()))
    met = audit.candidates(urls.withColumn("norm", F.col("url")), rules.withColumns({"wanted": F.col("value"), "needs": audit._required(F.col("value"))}).where("size(needs) > 0")).count()
    monkeypatch.setattr(audit, "INDEX_FROM", 10**9)
    assert got == sorted(map(tuple, audit.matches(urls, rules).collect())) and len(got) > 500
    assert met < 300 * 150 / 10


def test_rules_by_equi_join_and_in_blocks(spark, monkeypatch):
    from placeloom.operators import audit

    urls = spark.createDataFrame([(f"https://guide.example.com/{a}/{k}", False) for a in ("maps", "mapsfoo", "x") for k in range(3)] + [("https://guide.example.com/sitemaps/1", True)], "url string, is_sitemap boolean")
    rules = spark.createDataFrame([(1, "prefix", "https://guide.example.com/maps/"), (2, "prefix", "https://guide.example.com/x/1"), (3, "regex", "/x/[01]$"), (4, "regex", "^nothing"), (5, "exact", "https://guide.example.com/maps/2"), (6, "prefix", "https://guide.example.com/sitemaps/"), (7, "prefix", None)], "rule_id int, kind string, value string")
    want = None
    for few in (10_000, 1):
        monkeypatch.setattr(audit, "FEW_RULES", few)
        found = audit.matches(urls, rules)
        got = sorted((r.rule_id, r.url.rsplit("com/")[1]) for r in found.collect())
        want = want or got
        assert got == want
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == [(1, f"{a}/{k}") for a in ("maps", "mapsfoo") for k in range(3)] + [(2, "x/1"), (3, "x/0"), (3, "x/1"), (5, "maps/2"), (6, "sitemaps/1")]
