"""One document read by many tasks: the items of a JSON list and the records of a CSV file, whatever the file's size.

Spark's text source cuts a file into ranges at a byte that items hold anyway ("}" in JSON, the line end in CSV). Tasks
put what they read into chunks and say what each does to the reader's state, whether it begins inside a string or not.
The state at the start of every chunk follows from sums over the chunks before it, first by range, then within
one; then each chunk is taken apart by itself. Items that go over the end of a chunk come as fragments, which are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.storage import stored

#: Bytes of text after which a chunk is closed.
CHUNK = 1 << 20
#: More bytes than a part of a document in parts has.
PART = 1 << 42
_KEY = ["file", "start", "part"]
_ITEMS = "file string, start long, part long, box int, key string, pos long, opens boolean, closes boolean, text string"


def _gathered(end: bytes, told) -> object:
    """Function of batches (file, start, bytes, value): chunks (file, start, part, bytes, data, ..) with what ``told`` says of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, part, where = 0, 0, None

        def chunk() -> pa.RecordBatch:
            data = end.join(held) + end
            return pa.RecordBatch.from_pylist([{"file": where[0], "start": where[1], "part": part, "bytes": where[2], "data": data} | told(data)], _chunk_schema(told))

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).to_pylist(), strict=True)
            for *source, value in rows:
                if held and (source != where or size >= CHUNK):
                    yield chunk()
                    held, size, part = [], 0, part + 1
                if source != where:
                    where, part = source, 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield chunk()

    return run


def _chunk_schema(told) -> pa.Schema:
    return pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary()), *((n, pa.int64()) for n in told(b""))])


def _chunks(spark: SparkSession, path: str, end: str, told, parts: bool = False) -> DataFrame:
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if parts:
        start = F.regexp_extract(file, "part-([0-9]+)[^/]*$", 1).cast("long") * PART + start
        file = F.regexp_replace(file, "/[^/]*$", "")
    rows = spark.read.option("lineSep", end).text(path).select(file.alias("file"), start.alias("start"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("value"))
    kind = "file string, start long, part long, bytes long, data binary, " + ", ".join(f"{n} long" for n in told(b""))
    return stored(rows.mapInArrow(_gathered(end.encode(), told), kind), "chunks")


def _before(rows: DataFrame, *values: str) -> DataFrame:
    """Rows of chunks with ``<value>_before``: the sum of each value over the file's chunks before, by range and within it."""
    sums = rows.groupBy("file", "start").agg(*(F.sum(v).alias(v) for v in values))
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "start", *(F.coalesce(F.sum(v).over(ranges), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy("file", "start").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(sums, ["file", "start"])
    return joined.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}") for v in values}).drop(*(f"__{v}" for v in values))


def _last_before(rows: DataFrame, value: str) -> DataFrame:
    """Rows of chunks with ``<value>_last``: the last value that isn't null of the file's chunks before, by range and within it."""
    latest = rows.groupBy("file", "start").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("part"))).alias("__v"))
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    latest = latest.select("file", "start", F.last("__v", ignorenulls=True).over(ranges).alias("__v"))
    within = Window.partitionBy("file", "start").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn(f"{value}_last", F.last(value, ignorenulls=True).over(within)).join(latest, ["file", "start"])
    return own.withColumn(f"{value}_last", F.coalesce(f"{value}_last", "__v")).drop("__v")


def _joined(items: DataFrame) -> DataFrame:
    """(file, start, part, at, text): items whole, those that go over chunks put together of their fragments, at the first one's place.

    items: (file, start, part, at, opens, closes, text); at: the item's number in its file. Only items at the edge of a
    chunk are grouped.
    """
    whole = items.where("opens AND closes").select(*_KEY, "at", "text")
    pieces = items.where("NOT (opens AND closes)").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("p"))
    return whole.union(pieces.select("file", F.col("p")[0]["start"], F.col("p")[0]["part"], "at", F.array_join("p.text", "")))


# JSON

_MARKS = np.zeros(256, bool)
_MARKS[list(b'"{}[],')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_NAMED = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of quotes, brackets and commas, and how many quotes are before each; what a backslash escapes isn't one."""
    plain = re.sub(rb"\\.", b"  ", data, flags=re.DOTALL) if b"\\" in data else data
    raw = np.frombuffer(plain, np.uint8)
    at = np.flatnonzero(_MARKS[raw])
    found = raw[at]
    return at, found, np.cumsum(found == 34)


def _json_told(data: bytes) -> dict[str, int]:
    """What a chunk does: its quotes, and by how much the depth grows if it begins outside or inside a string."""
    _, found, quotes = _marks(data)
    step = _STEP[found]
    inside = quotes & 1 == 1
    return {"size": len(data), "quotes": int(quotes[-1]) if len(quotes) else 0, "outside": int(step[~inside].sum()), "inside": int(step[inside].sum())}


def _json_items(target: str) -> object:
    """Function of chunks (file, start, part, data, quotes_before, depth_before): fragments of the items of lists in the root object.

    box 0 is the list or object of the root that was open when the chunk began, its key unknown here; others are told by key.
    """

    def of(data: bytes, quoted: int, depth: int) -> list[tuple]:
        at, found, quotes = _marks(data)
        free = ((quotes + quoted) & 1 == 0) & (found != 34)
        at, found = at[free], found[free]
        after = depth + np.cumsum(_STEP[found])
        opening = (_STEP[found] > 0) & (after == 2)
        closing = (_STEP[found] < 0) & (after == 1)
        edge = np.flatnonzero(opening | closing | (found == 44) & (after == 2))
        out, box, key, pos, begin, opens = [], 0, None, 0, 0, False
        within = depth >= 2  # in a list or object of the root

        def add(end: int, closes: bool) -> None:
            if box == 0 or key == target:
                out.append((box, key, pos, opens, closes, data[begin:end].decode("utf-8", "replace")))

        for p, c, is_open, is_close in zip(at[edge].tolist(), found[edge].tolist(), opening[edge].tolist(), closing[edge].tolist(), strict=True):
            if is_open:
                name = _NAMED.search(data, data.rfind(b"}", 0, p) + 1, p) if c == 91 else None
                box, key, pos, begin, opens, within = box + 1, name[1].decode("utf-8", "replace") if name else "", 0, p + 1, True, True
            elif within:
                add(p, True)
                pos, begin, opens = pos + 1, p + 1, True
                if is_close:
                    within, begin = False, p + 1
                    box, key = box + 1, ""
        if within:
            add(len(data), False)
        if box and not (within and key == target):
            out.append((box + 1, "", 0, True, True, ""))  # what was open at first has ended
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["file"], r["start"], r["part"], *x) for x in of(r["data"], r["quotes_before"], r["depth_before"])]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "start", "part", "box", "key", "pos", "opens", "closes", "text"])

    return run


def json_items(spark: SparkSession, path: str, key: str, parts: bool = False) -> DataFrame:
    """(file, ordinal, text): the items of the list that the root object of a document has under a key, in many tasks.

    The items should be objects: a file is cut at closing braces, so one without any is one task. A document that isn't whole (an open
    string or bracket at its end) has no items, nor has one without the key; null items keep their ordinal. A key that
    comes twice in the root isn't defined. Empty files have no items. parts: each folder is one document, in files part-<number> of which
    each ends with a closing brace; others have no items.
    """
    chunks = _chunks(spark, path, "}", _json_told, parts)
    state = _before(chunks.drop("data"), "quotes")
    state = state.withColumn("depth", F.when(F.col("quotes_before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    state = stored(_before(state.select(*_KEY, "bytes", "size", "quotes", "quotes_before", "depth"), "depth"), "chunk-states")
    # a brace is put after the last piece, where the file has one or not; sizes tell which, but for compressed files
    whole = state.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("depth").alias("left"), (F.sum("size") - F.max("bytes")).alias("more"))
    whole = whole.where("open = 0 AND (left = 0 AND more <> 1 OR left = -1 AND more <> 0)").select("file")
    if parts:
        sizes = state.groupBy("file", F.floor(F.col("start") / PART)).agg(F.sum("quotes").alias("quotes"), F.sum("depth").alias("depth"), (F.sum("size") - F.max("bytes")).alias("more"))
        whole = sizes.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("depth").alias("left"), F.max("more").alias("more")).where("open = 0 AND left = 0 AND more = 0").select("file")
    known = chunks.select(*_KEY, "data").join(state.select(*_KEY, "quotes_before", "depth_before"), _KEY).join(whole, "file", "left_semi")
    items = stored(known.mapInArrow(_json_items(key), _ITEMS), "chunk-items")
    # of each chunk: how it leaves the list, separators in the list it began in and in that it opened
    ends = items.groupBy(*_KEY).agg(
        F.max_by(F.when(F.col("box") > 0, (F.col("key") == key) & ~F.col("closes")), F.struct("box", "pos")).alias("leaves"),
        F.coalesce(F.max(F.when(F.col("box") == 0, F.col("pos") + F.col("closes").cast("int"))), F.lit(0)).alias("first_seps"),
        F.coalesce(F.max(F.when(F.col("key") == key, F.col("pos") + F.col("closes").cast("int"))), F.lit(0)).alias("own_seps"),
    )
    every = state.select(*_KEY).join(ends, _KEY, "left")
    ends = _last_before(every, "leaves").withColumn("began_in", F.coalesce("leaves_last", F.lit(False)))
    ends = _before(ends.withColumn("seps", F.when(F.col("began_in"), F.coalesce("first_seps", F.lit(0))).otherwise(0) + F.coalesce("own_seps", F.lit(0))), "seps")
    own = items.join(ends.select(*_KEY, "began_in", "seps_before"), _KEY).where((F.col("key") == key) | F.col("key").isNull() & F.col("began_in"))
    at = F.when(F.col("box") == 0, F.col("seps_before")).otherwise(0) + F.col("pos")
    return _joined(own.withColumn("at", at)).where(F.col("text").rlike("\\S")).select("file", F.col("at").alias("ordinal"), "text")


# CSV


def _records(data: bytes, quoted: bool) -> tuple[bool, np.ndarray]:
    """Whether a chunk of lines ends inside quotes, and the places of line ends outside of them.

    A quote opens a value only at its beginning; inside, two quotes are one character.
    """
    spans, at = [], 0
    begin = 0 if quoted else -1
    while True:
        if begin < 0:
            m = _OPEN.search(data, at)
            if m is None:
                break
            begin, at = m.start(), m.end()
        end = data.find(b'"', at)
        if end < 0:
            spans.append((begin, len(data)))
            break
        if data[end + 1 : end + 2] == b'"':
            at = end + 2
            continue
        spans.append((begin, end))
        begin, at = -1, end + 1
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    if spans:
        starts, stops = np.array(spans).T
        span = np.searchsorted(starts, ends, "right") - 1
        ends = ends[(span < 0) | (ends > stops[np.maximum(span, 0)])]
    return bool(spans) and spans[-1][1] == len(data), ends


_OPEN = re.compile(rb'(?:(?<=[,\n])|\A)"')


def _csv_told(data: bytes) -> dict[str, int]:
    """Whether a chunk ends inside quotes, begun outside or inside."""
    return {"outside": int(_records(data, False)[0]), "inside": int(_records(data, True)[0])}


def _csv_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            data, edges = r["data"], _records(r["data"], bool(r["quoted"]))[1].tolist()
            begins = [0, *(e + 1 for e in edges)]
            n = len(begins)
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(begins, [*edges, len(data)], strict=True)]
            rows = [[r["file"]] * n, [r["start"]] * n, [r["part"]] * n, [0] * n, [None] * n, list(range(n)), [k > 0 for k in range(n)], [k < n - 1 for k in range(n)], texts]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["file", "start", "part", "box", "key", "pos", "opens", "closes", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, text): records of CSV files, with line breaks inside quotes kept, in many tasks.

    ordinal: the record's number over all files in the order of their paths, without blank ones and each file's first, the header.
    Lines end with a line feed, a carriage return before it isn't part of the record. An open quote at a file's end reaches to that end.
    """
    chunks = _chunks(spark, path, "\n", _csv_told)
    # a chunk that ends the same way however it began settles the state; one that ends as it began keeps it; one that turns it counts
    turns = ((F.col("outside") == 1) & (F.col("inside") == 0)).cast("long")
    state = _before(chunks.drop("data").withColumn("turns", turns), "turns")
    settled = F.when(F.col("outside") == F.col("inside"), (F.col("outside") + F.col("turns_before")) % 2)
    state = _last_before(state.withColumn("settled", settled), "settled")
    state = state.select(*_KEY, ((F.coalesce("settled_last", F.lit(0)) + F.col("turns_before")) % 2).alias("quoted"))
    items = stored(chunks.select(*_KEY, "data").join(state, _KEY).mapInArrow(_csv_items, _ITEMS), "chunk-items")
    seps = _before(items.groupBy(*_KEY).agg(F.sum(F.col("closes").cast("long")).alias("seps")), "seps")
    rows = _joined(items.join(seps.select(*_KEY, "seps_before"), _KEY).withColumn("at", F.col("seps_before") + F.col("pos")))
    kept = rows.withColumn("text", F.regexp_replace("text", "\\r$", "")).where(F.trim("text") != "")
    counts = _before(kept.groupBy(*_KEY).agg(F.count("*").alias("kept")), "kept")
    files = counts.groupBy("file").agg((F.sum("kept") - 1).alias("kept"))  # a row a file
    files = files.select("file", F.coalesce(F.sum("kept").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files_before"))
    own = F.row_number().over(Window.partitionBy(*_KEY).orderBy("at")) - 1
    numbered = kept.withColumn("own", own).join(counts.select(*_KEY, "kept_before"), _KEY).join(files, "file").withColumn("number", F.col("kept_before") + F.col("own"))
    return numbered.where("number > 0").select("file", (F.col("files_before") + F.col("number") - 1).alias("ordinal"), "text")


def parsed_csv(text: Column, columns: list[str]) -> Column:
    """struct of the values of a record, all as text."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return F.from_csv(text, F.lit(schema), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
