"""Removal of passages that an earlier document has, by relative Lempel-Ziv parsing.

Every document is factored greedily against reference blocks: the words, in order, of
smaller documents. Blocks hold what some larger document needs, each window of 13 words
once; so a block stays as small as what is repeated.

1. Anchors, the word 6-gram of least hash of each window, tell which windows may be
   elsewhere at all: equal windows have equal anchors.
2. For those windows a smaller document that has them, and its shard, is looked up; a window
   that many shards have is handed on from shard to shard, in the order of documents.
3. Each shard asks the shards of these documents for the windows that it needs and gets
   blocks of text back: (document, position, words), runs of windows joined.
4. A shard indexes the blocks that came, and its own documents as one more, by hash of the
   13 words at each position, and parses each document: at the first position that the
   index knows, the factor (source document, position, length) is the match extended word
   by word as far as it goes; the words themselves are compared. Each window across the
   end of a factor is looked up too before the parse goes on behind it, so that no window
   is lost where the source changes. All factors are of at least 13 words: duplicate spans.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import shared_dir, table, text_bytes
from placeloom.llm.exchange import Exchange, added, distinct, heads, least, lookup, pack_sorted, pack_values, rolling, sharded, unpack_sorted, unpack_values, unpacked_docs
from placeloom.llm.words import Words, mix

WINDOW = 13
ANCHOR = 6
#: Shards that get a window from the same one, at most: so what is everywhere isn't asked of one shard.
SPREAD = 4
_LAST = np.iinfo(np.int64).max
_REQUEST = pa.schema([("owner", pa.int64()), ("asker", pa.int64()), ("keys", pa.binary())])
_BLOCK = pa.schema([("asker", pa.int64()), ("runs", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
    + [("factors", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])))]
)
RESULT_SQL = "doc_id long, text_hash long, n_words long, n_removed long, kept string, spans array<struct<start: long, length: long>>, factors array<struct<start: long, length: long, source: long, source_start: long>>"


class _Shard:
    """Words and windows of the documents of a shard, end to end, smaller documents first."""

    def __init__(self, docs: bytes, window: int):
        t = unpacked_docs(docs)
        ids = np.array([_LAST if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(pa.array(order)), ids[order]
        self.raw, self.texts = t.column("doc_id").to_pylist(), text_bytes(t.column("text"))
        self.words = Words(self.texts)
        self.hash, self.sizes = self.words.hashes(), self.words.sizes
        self.end = np.cumsum(self.sizes)
        self.window, n = window, max(0, len(self.hash) - window + 1)
        at = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)  # document of each word
        self.starts = np.flatnonzero(at[:n] == at[window - 1 :]) if n else np.zeros(0, np.int64)  # of windows inside a document
        self.at = at[self.starts]
        self.doc = ids[self.at] if len(self.at) else np.zeros(0, np.int64)

    def keys(self) -> np.ndarray:
        return rolling(self.hash, self.window, 1)[self.starts]

    def anchors(self, anchor: int) -> np.ndarray:
        grams = rolling(self.hash, anchor, 3)
        n = max(0, len(self.hash) - self.window + 1)
        out = grams[:n].copy()
        for j in range(1, self.window - anchor + 1):
            np.minimum(out, grams[j : n + j], out=out)
        return mix(out[self.starts])  # least hashes aren't uniform


def _first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, the first row of each, and the place of each row's key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    head = heads(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
    return keys[head], np.minimum.reduceat(order, head) if len(head) else order, at


def _in_two(a: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Anchors of two documents of the shard at least, ascending."""
    order = np.argsort(a)
    a, docs = a[order], docs[order]
    head = heads(a)
    return a[head][np.minimum.reduceat(docs, head) < np.maximum.reduceat(docs, head)] if len(head) else a


def _blocks(s: _Shard, askers: list[int], wanted: list[np.ndarray]) -> pa.Table:
    """A row for each asker: the runs of words that hold the windows it wants, where they come first."""
    key, row, _ = _first(s.keys())
    out = []
    for asker, keys in zip(askers, wanted, strict=True):
        at, there = lookup(key, keys)
        rows = np.sort(row[at[there]])
        if not len(rows):
            continue
        place, doc = s.starts[rows], s.at[rows]
        new = np.concatenate([[True], (np.diff(place) > s.window) | (doc[1:] != doc[:-1])])  # runs: windows that touch
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(rows)) - 1
        start, end = place[begin], place[last] + s.window
        inside = start - (s.end - s.sizes)[doc[begin]]
        text = b" ".join(s.words.slice(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True))
        out.append((asker, len(begin), pack_values([s.doc[rows[begin]], inside, end - start]), text))
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _BLOCK, strict=True)], schema=_BLOCK)


def _same(a: np.ndarray, i: int, b: np.ndarray, j: int, most: int) -> int:
    """How many values agree from a[i] and b[j] on, at most ``most``."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        differ = np.flatnonzero(a[i + done : i + done + step] != b[j + done : j + done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 4
    return done


class Reference:
    """Blocks of words and an index of them: for each window the smallest document that has it, and where.

    The shard's own words are the first block; those that came follow. ``at`` is the place in the index of each
    window of the shard.
    """

    def __init__(self, s: _Shard, runs: list[int], places: list[bytes], words: list[bytes]):
        key, row, self.at = _first(s.keys())
        self.doc, self.start, self.end = s.doc[row], s.starts[row], s.end[s.at[row]]
        self.inside = self.start - (s.end - s.sizes)[s.at[row]]
        self.own, self.came = s.words, Words(words)
        got = self.came.hashes()
        self.hash = np.concatenate([s.hash, got])
        columns = [unpack_values(p, "iii", n) for n, p in zip(runs, places, strict=True)]
        doc, begin, size = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in columns)]) for k in range(3))
        windows = np.maximum(size - s.window + 1, 0)
        block = np.repeat(np.arange(len(size)), windows)
        shift = np.arange(len(block)) - (np.cumsum(windows) - windows)[block]
        start = (np.cumsum(size) - size)[block] + shift
        at, there = lookup(key, rolling(got, s.window, 1)[start] if len(start) else np.zeros(0, np.uint64))
        better = np.flatnonzero(there & (doc[block] < self.doc[at])) if len(key) else np.zeros(0, np.int64)
        better = better[np.argsort(-doc[block][better], kind="stable")]  # the smallest document is written last
        at, block, start, shift = at[better], block[better], start[better], shift[better]
        self.doc[at], self.start[at], self.inside[at] = doc[block], len(s.hash) + start, begin[block] + shift
        self.end[at] = len(s.hash) + np.cumsum(size)[block]

    def slice(self, a: int, b: int) -> bytes:
        own = len(self.own)
        return self.own.slice(a, b) if a < own else self.came.slice(a - own, b - own)


def parsed(s: _Shard, ref: Reference) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each document of the shard with factors: its number and its factors (start, length, source document, position there)."""
    window = s.window
    found = np.flatnonzero(ref.doc[ref.at] < s.doc) if len(s.doc) else np.zeros(0, np.int64)  # windows that a smaller document has
    if not len(found):
        return
    at, place, owner = ref.at[found], s.starts[found], s.at[found]
    doc, begins, ends, inside = (x[at].tolist() for x in (ref.doc, ref.start, ref.end, ref.inside))
    head = heads(owner)
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(owner)], strict=True):
        number = int(owner[a])
        begin, end = int(s.end[number] - s.sizes[number]), int(s.end[number])
        factors, places, i = [], place[a:b].tolist(), 0
        while i < len(places):
            x, source = places[i], begins[a + i]
            length = _same(s.hash, x, ref.hash, source, min(end - x, ends[a + i] - source))
            if s.words.slice(x, x + length) != ref.slice(source, source + length):  # hashes agreed, words don't
                length = next((n for n in range(length) if s.words.slice(x, x + n + 1) != ref.slice(source, source + n + 1)), length)
            if length < window:
                i += 1
                continue
            factors.append((x - begin, length, doc[a + i], inside[a + i]))
            # windows inside the factor are settled; those across its end are looked up one by one
            i = bisect_left(places, x + length - window + 1, i + 1)
        if factors:
            yield number, factors


def factored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, kept, spans, factors): each document without the words that earlier ones have.

    A word goes if a window of ``window`` consecutive words over it also starts in a document of a
    smaller id. factors: array of (start, length, source, source_start) in words, ascending, each of at
    least ``window`` words that the document ``source`` has from source_start on; they may overlap.
    spans: their union as disjoint (start, length); kept: the other words joined by one space, '' if
    none. text_hash: xxhash64 of the text, null for null, to tell rows that repeat an id apart.

    Words are runs of non-white-space, unchanged. Null and empty texts have no words. A null id counts
    as larger than any other; rows that repeat an id, null ids too, take nothing from each other and stay
    rows of their own. A very long text is a shard by itself. An empty table gives no rows.
    """
    spark = df.sparkSession
    shared_dir(spark)
    shards = sharded(df, id_col, text_col)
    docs = shards.rows
    common = Exchange(shards.n, shards.ranges, added, answered=lambda own, total: total[0] > 1)
    where = Exchange(shards.n, shards.ranges, least, kinds="ii", keyed=True, spread=SPREAD)

    def anchors(key: tuple, t: pa.Table) -> pa.Table:
        own = distinct(_Shard(t.column("docs")[0].as_py(), window).anchors(anchor))
        return common.send(key[0].as_py(), own, [np.ones(len(own), np.int64)])

    def windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return Exchange.SENT.empty_table()
        s, shard = _Shard(left.column("docs")[0].as_py(), window), key[0].as_py()
        a = s.anchors(anchor)
        shared = distinct(np.concatenate([common.gathered(right, distinct(a))[0], _in_two(a, s.doc)]))
        rows = np.flatnonzero(lookup(shared, a)[1])
        keys, head, _ = _first(s.keys()[rows])
        return where.send(shard, keys, [s.doc[rows[head]], np.full(len(keys), shard, np.int64)])

    def requests(key: tuple, t: pa.Table) -> pa.Table:
        keys, (_, owner) = where.gathered(t, np.zeros(0, np.uint64))
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        head = heads(owner)
        ends = [*head[1:].tolist(), len(owner)]
        return pa.table([owner[head], np.full(len(head), key[0].as_py(), np.int64), pa.array([pack_sorted(keys[a:b]) for a, b in zip(head.tolist(), ends, strict=True)], pa.binary())], schema=_REQUEST)

    def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _BLOCK.empty_table()
        s = _Shard(left.column("docs")[0].as_py(), window)
        return _blocks(s, right.column("asker").to_pylist(), [unpack_sorted(x) for x in right.column("keys").to_pylist()])

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT.empty_table()
        import xxhash

        s = _Shard(left.column("docs")[0].as_py(), window)
        own = dict(parsed(s, Reference(s, *(right.column(c).to_pylist() for c in ("runs", "places", "words")))))
        out: dict[str, list] = {f.name: [] for f in RESULT}
        for number, (raw, text, end, size) in enumerate(zip(s.raw, s.texts, s.end.tolist(), s.sizes.tolist(), strict=True)):
            factors, spans = own.get(number, []), []
            for start, length, _, _ in factors:
                if spans and start <= spans[-1][0] + spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + length - spans[-1][0])
                else:
                    spans.append([start, length])
            edges = [end - size, *(end - size + x for start, length in spans for x in (start, start + length)), end]
            kept = [s.words.slice(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
            out["doc_id"].append(raw)
            out["text_hash"].append(None if text is None else int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64)))
            out["n_words"].append(size)
            out["n_removed"].append(sum(length for _, length in spans))
            out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
            out["spans"].append([{"start": a, "length": n} for a, n in spans])
            out["factors"].append([{"start": a, "length": n, "source": d, "source_start": p} for a, n, d, p in factors])
        return pa.table(out, schema=RESULT)

    shared = common.run(docs.groupBy("shard").applyInArrow(anchors, Exchange.SENT_SQL))
    found = where.run(docs.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(windows, Exchange.SENT_SQL))
    asked = found.groupBy("shard").applyInArrow(requests, "owner long, asker long, keys binary")
    got = docs.groupBy("shard").cogroup(asked.groupBy("owner")).applyInArrow(blocks, "asker long, runs long, places binary, words binary")
    return docs.groupBy("shard").cogroup(got.groupBy("asker")).applyInArrow(parse, RESULT_SQL)


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The rows of df with what ``factored`` keeps as text; all other columns stay, n_chars, if there, is counted anew.

    A text of which nothing goes stays as it is, white space included; one that goes whole becomes '',
    or its row goes with drop_emptied.
    A result goes to the rows of the same id and text, so rows that repeat an id each keep their own; null ids match each other.
    """
    own = factored(df, id_col, text_col).where("n_removed > 0").groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"))
    row, change = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")), own.select(F.struct("doc_id", "text_hash", "kept").alias("own"))
    text, kept = F.col(f"row.`{text_col}`"), F.col("own.kept")
    rows = row.join(change, F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("own.doc_id")) & (F.xxhash64(text.cast("string")) == F.col("own.text_hash")), "left")
    if drop_emptied:
        rows = rows.where(kept.isNull() | (kept != ""))
    new = {text_col: F.coalesce(kept, text.cast("string")).cast(df.schema[text_col].dataType)}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(kept.isNotNull(), F.length(kept)).otherwise(F.col("row.n_chars")).cast(df.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a row, with the digest of what is kept, and the factors of the parse."""
    return factored(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), f AS (
  SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram HAVING count(*) > 1
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (gram) WHERE f.first_doc < g.doc_id)
), r AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string([words[q] for q in range(1, len(words) + 1) if NOT list_contains(gone, q)], ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
