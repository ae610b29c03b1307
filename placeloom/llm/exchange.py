"""Packed exchange between shards of documents and ranges of hashes.

Counting or matching n-grams of every position needs one row for each in a plain
shuffle. Here documents are put into shards of bounded size, in the order in which
they are read, and written once. A task works on a shard, sends each range of hashes
one packed row with the shard's distinct hashes, and gets one packed row back. A hash
that is everywhere costs a shard one entry, so no key is hot.

A shard never sends more than ``FAN`` rows, whatever the input. Beyond ``FAN`` ranges
the rows go over levels, as in a butterfly network: a node takes the rows of a group of
shards for a range, adds them up, and sends on one row for each part of its range; the
answers come back through the same nodes. So all levels together exchange shards x FAN
x levels rows, and a node holds no more than about a shard does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import bucketed, cut, id_and_text, shuffle_partitions
from placeloom.llm.words import mix

#: Text of a shard in bytes, about; a shard is held in memory by one task at a time.
SHARD_BYTES = 8 << 20
#: What a document counts beside its text, so that empty ones can't gather.
ROW_BYTES = 16
#: Buckets of the table of shards, at most; beyond it a bucket holds several shards, one after the other.
BUCKETS = 50_000
#: Rows that a shard or a node sends at most.
FAN = 256
_C = np.uint64(0x9E3779B97F4A7C15)
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def compressed(batch: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_docs(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


@dataclass(frozen=True)
class Shards:
    """rows: (shard long, docs binary), one row a shard, dealt out by shard on disk; their number; ranges of hashes to use; bytes of text."""

    rows: DataFrame
    n: int
    ranges: int
    size: int


def sharded(df: DataFrame, id_col: str, text_col: str, shard_bytes: int = 0) -> Shards:
    """The documents in shards of about ``shard_bytes`` (0: SHARD_BYTES) of text, or one document if that is longer.

    A shard is a stretch of rows of one partition, so repeated ids, null ids and repeated rows can't
    gather in one. The shards are a table in the shared folder, in buckets by shard: later steps see the same
    ones, whatever is lost, and no step shuffles texts.
    """
    spark, limit = df.sparkSession, shard_bytes or SHARD_BYTES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def one() -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).combine_chunks()
            whole = own.to_batches()[0] if own.num_rows else pa.RecordBatch.from_pylist([], _DOCS)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([compressed(whole)], pa.binary()), pa.array([size], pa.int64())], names=["shard", "docs", "size"])

        for batch in it:
            text = batch.column(1)
            batch = pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).cast(pa.binary())], schema=_DOCS)
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
            start = 0
            while start < batch.num_rows:
                before = int(lengths[start - 1]) if start else 0
                end = min(batch.num_rows, int(np.searchsorted(lengths, before + limit - size)) + 1)
                parts.append(batch.slice(start, end - start))
                size += int(lengths[end - 1]) - before
                start = end
                if size >= limit:
                    yield one()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield one()

    docs = id_and_text(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(shuffle_partitions(spark), math.ceil(((size[0] or 0) + ROW_BYTES * size[1]) / limit))
    table = bucketed(docs.mapInArrow(run, "shard long, docs binary, size long"), "shard", min(ranges, BUCKETS), "shards")
    return Shards(table.select("shard", "docs"), table.count(), ranges, size[0] or 0)


def rolling(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each n consecutive values, by position of the first; length len(h) - n + 1, or 0."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, last = np.zeros(len(h) - n + 1, np.uint64), len(h) - n + 1
    factor = int(_C) + 2 * salt  # odd: no power of it loses bits
    for j in range(n):
        out += h[j : last + j] * np.uint64(pow(factor, j + 1, 1 << 64))
    return mix(out)


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def planes(x: np.ndarray) -> bytes:
    """The values byte plane by byte plane: planes of zeros vanish in compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


_ZSTD: dict[str, object] = {}


def squeezed(data: bytes) -> bytes:
    import zstandard

    if "in" not in _ZSTD:
        _ZSTD["in"] = zstandard.ZstdCompressor(level=1)
    return _ZSTD["in"].compress(data)


def restored(data: bytes) -> bytes:
    import zstandard

    if "out" not in _ZSTD:
        _ZSTD["out"] = zstandard.ZstdDecompressor()
    return _ZSTD["out"].decompress(data)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences."""
    return squeezed(planes(np.diff(x, prepend=np.uint64(0))))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(restored(data), "<u8"), dtype=np.uint64)


def pack_values(columns: list[np.ndarray]) -> bytes:
    """Columns of integers, or (as objects) of bytes, of which some may be None."""
    out = []
    for c in columns:
        if c.dtype == object:
            out += [planes(np.array([-1 if x is None else len(x) for x in c], np.int64)), *(x for x in c if x)]
        else:
            out.append(planes(c.astype("<i8", copy=False)))
    return squeezed(b"".join(out))


def unpack_values(data: bytes, kinds: str, n: int) -> list[np.ndarray]:
    """kinds: a letter for each column, i: integers, b: bytes."""
    data, out, at = restored(data), [], 0
    for kind in kinds:
        values, at = unplanes(data[at : at + 8 * n], "<i8"), at + 8 * n
        if kind == "b":
            texts = np.empty(n, object)
            for k, size in enumerate(values.tolist()):
                if size >= 0:
                    texts[k], at = data[at : at + size], at + size
            values = texts
        out.append(values)
    return out


def dump(keys: np.ndarray, values: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Ascending keys and their values as they travel."""
    return pack_sorted(keys), pack_values(values)


def load(keys: bytes, values: bytes, kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
    own = unpack_sorted(keys)
    return own, unpack_values(values, kinds, len(own))


def dump_texts(keys: np.ndarray, values: list[np.ndarray]) -> tuple[bytes, bytes]:
    """The same where the one value is bytes and the key its hash: only where there are no bytes the key travels."""
    none = np.array([x is None for x in values[0]], bool)
    return np.int64(len(keys)).tobytes() + keys[none].tobytes(), pack_values(values)


def load_texts(keys: bytes, values: bytes, kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int(np.frombuffer(keys[:8], np.int64)[0])
    (texts,), without = unpack_values(values, kinds, n), iter(np.frombuffer(keys[8:], np.uint64).tolist())
    return np.fromiter((next(without) if x is None else hash_of(x) for x in texts), np.uint64, n), [texts]


def lookup(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each x in sorted_keys and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(x), int), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return at, sorted_keys[at] == x


def heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    values = np.sort(values)
    return values[heads(values)]


Columns = list[np.ndarray]


def added(keys: np.ndarray, values: Columns) -> tuple[np.ndarray, Columns]:
    """Distinct keys, ascending, and the sums of their values, 64 bits wide."""
    order = np.argsort(keys)
    keys = keys[order]
    head = heads(keys)
    return keys[head], [np.add.reduceat(v[order], head) if len(head) else v[:0] for v in values]


def least(keys: np.ndarray, values: Columns) -> tuple[np.ndarray, Columns]:
    """Distinct keys, ascending, and the least tuple of values of each."""
    order = np.lexsort((*values[::-1], keys))
    keys = keys[order]
    head = heads(keys)
    return keys[head], [v[order[head]] for v in values]


def same(keys: np.ndarray, values: Columns) -> tuple[np.ndarray, Columns]:
    """Distinct keys, ascending, and the bytes of each; None if two differ."""
    order = np.argsort(keys, kind="stable")
    keys, texts = keys[order], values[0][order]
    head = heads(keys)
    first = texts[head]
    if len(head) < len(keys):
        row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
        first[np.unique(row[texts != first[row]])] = None
    return keys[head], [first]


@dataclass(frozen=True)
class Exchange:
    """How keys (hashes, uniform in their upper 32 bits) with columns of values are reduced over all shards.

    kinds: of these columns, as ``unpack_values`` takes them. reduce: keys and values, in any order, to distinct ascending keys and their values. answered: of a
    shard's own values and the reduced ones, which keys are answered (None: all). finish: what is answered
    instead of the reduced values, one column of integers for all keys. keyed: an answer holds
    its keys; else a bit for each key sent, in their order, tells whether there is an answer. tally: a number
    of the reduced keys and values of each range, answered to a shard of a negative number that doesn't exist.
    spread: with values (document, shard), an answer names a smaller document that has the key, but no more than
    ``spread`` shards get the same one from a node: the holders of a key, by document, form a tree. dump, load:
    how keys and values travel to the ranges.
    """

    shards: int
    ranges: int
    reduce: Callable[[np.ndarray, Columns], tuple[np.ndarray, Columns]]
    kinds: str = "i"
    answered: Callable[[Columns, Columns], np.ndarray] | None = None
    keyed: bool = False
    tally: Callable[[np.ndarray, Columns], int] | None = None
    finish: Callable[[np.ndarray, Columns], Columns] | None = None
    spread: int = 0
    dump: Callable[[np.ndarray, Columns], tuple[bytes, bytes]] = dump
    load: Callable[[bytes, bytes, str], tuple[np.ndarray, Columns]] = load
    most: int = field(default_factory=lambda: FAN)

    SENT = pa.schema([("node", pa.int64()), ("sender", pa.int64()), ("lane", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
    ANSWER = pa.schema([("shard", pa.int64()), ("lane", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
    SENT_SQL = "node long, sender long, lane long, keys binary, vals binary"
    ANSWER_SQL = "shard long, lane long, keys binary, vals binary"

    @property
    def levels(self) -> int:
        n = 1
        while self.most**n < self.ranges:
            n += 1
        return n

    @property
    def back(self) -> str:
        return "i" if self.finish else self.kinds

    @property
    def fan(self) -> int:
        """Parts of a range at each level."""
        return math.ceil(round(self.ranges ** (1 / self.levels), 9))

    def lanes(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Range of each key at a level, ascending with the keys."""
        return ((keys >> np.uint64(32)) * np.uint64(self.fan**level) >> np.uint64(32)).astype(np.int64)

    def send(self, sender: int, keys: np.ndarray, values: Columns, level: int = 1, group: int | None = None) -> pa.Table:
        """The rows of ascending distinct keys of a sender. group: of the level's senders; None: that of a shard."""
        if group is None:
            groups = -(-self.shards // self.fan)
            group = int(mix(np.array([sender], np.int64).view(np.uint64))[0] % np.uint64(max(1, groups)))
        if level == self.levels:
            group = 0
        lane = self.lanes(keys, level)
        head = heads(lane)
        rows = [(group * self.fan**level + int(lane[a]), sender, int(lane[a]), *self.dump(keys[a:b], [v[a:b] for v in values])) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(keys)], strict=True)] if len(keys) else []
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, self.SENT, strict=True)], schema=self.SENT)

    def _received(self, t: pa.Table) -> tuple[list[np.ndarray], list[Columns]]:
        got = [self.load(k, v, self.kinds) for k, v in zip(t.column("keys").to_pylist(), t.column("vals").to_pylist(), strict=True)]
        return [k for k, _ in got], [v for _, v in got]

    def _reduced(self, keys: list[np.ndarray], values: list[Columns]) -> tuple[np.ndarray, Columns]:
        return self.reduce(np.concatenate(keys), [np.concatenate([v[c] for v in values]) for c in range(len(self.kinds))])

    def _answers(self, t: pa.Table, keys: list[np.ndarray], values: list[Columns], known: np.ndarray, totals: Columns) -> pa.Table:
        if self.spread:
            return self._spread_answers(t, keys, values, known, totals)
        rows = []
        for sender, lane, k, own in zip(t.column("sender").to_pylist(), t.column("lane").to_pylist(), keys, values, strict=True):
            at, there = lookup(known, k)
            total = [x[at] if len(x) else np.zeros(len(k), np.int64) for x in totals]
            if self.answered:
                there = there & self.answered(own, total)
            if there.any():
                rows.append((sender, lane, pack_sorted(k[there]) if self.keyed else np.packbits(there).tobytes(), pack_values([x[there] for x in total])))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, self.ANSWER, strict=True)], schema=self.ANSWER)

    def _spread_answers(self, t: pa.Table, keys: list[np.ndarray], values: list[Columns], known: np.ndarray, totals: Columns) -> pa.Table:
        key, doc, shard = np.concatenate(keys), np.concatenate([v[0] for v in values]), np.concatenate([v[1] for v in values])
        order = np.lexsort((doc, key))
        head = heads(key[order])
        start = np.repeat(head, np.diff(np.append(head, len(key))))
        rank = np.arange(len(key)) - start
        parent = order[start + np.maximum(rank - 1, 0) // self.spread]
        source = np.empty((2, len(key)), np.int64)
        first = (rank == 0) | (doc[parent] >= doc[order])  # the least of all, from other nodes too
        at = lookup(known, key[order])[0]
        source[0, order], source[1, order] = np.where(first, totals[0][at], doc[parent]), np.where(first, totals[1][at], shard[parent])
        there = (source[0] < doc) & (source[1] != shard)
        ends = np.cumsum([len(k) for k in keys])
        rows = []
        for sender, lane, k, end in zip(t.column("sender").to_pylist(), t.column("lane").to_pylist(), keys, ends.tolist(), strict=True):
            own = there[end - len(k) : end]
            if own.any():
                rows.append((sender, lane, pack_sorted(k[own]), pack_values([c[end - len(k) : end][own] for c in source])))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, self.ANSWER, strict=True)], schema=self.ANSWER)

    def answer_of(self, keys: bytes, values: bytes, sent: np.ndarray | None) -> tuple[np.ndarray, Columns]:
        """Keys and values of one answer; sent: the keys that it answers, if it isn't keyed."""
        own = unpack_sorted(keys) if self.keyed else sent[np.unpackbits(np.frombuffer(keys, np.uint8), count=len(sent)).view(bool)]
        return own, unpack_values(values, self.back, len(own))

    def gathered(self, t: pa.Table, sent: np.ndarray, level: int = 1) -> tuple[np.ndarray, Columns]:
        """Keys, ascending, and values of all answers to a sender of the keys ``sent``, ascending."""
        lane = self.lanes(sent, level) if not self.keyed else None
        parts = []
        for own, k, v in sorted(zip(t.column("lane").to_pylist(), t.column("keys").to_pylist(), t.column("vals").to_pylist(), strict=True)):
            a, b = np.searchsorted(lane, [own, own + 1]) if lane is not None else (0, 0)
            parts.append(self.answer_of(k, v, sent[a:b]))
        return np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]), [np.concatenate([np.zeros(0, np.int64), *(v[c] for _, v in parts)]) for c in range(len(self.back))]

    def run(self, sent: DataFrame) -> DataFrame:
        """(shard, lane, keys, vals): the answers to the rows of ``send``."""
        me = self

        def up(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
            def on(key: tuple, t: pa.Table) -> pa.Table:
                node = key[0].as_py()
                return me.send(node, *me._reduced(*me._received(t)), level + 1, node // me.fan**level // me.fan)

            return on

        def top(key: tuple, t: pa.Table) -> pa.Table:
            keys, values = me._received(t)
            known, totals = me._reduced(keys, values)
            out = me._answers(t, keys, values, known, me.finish(known, totals) if me.finish else totals)
            if not me.tally:
                return out
            return pa.concat_tables([out, pa.table([pa.array(x, f.type) for x, f in zip(([-1 - key[0].as_py()], [me.tally(known, totals)], [b""], [b""]), me.ANSWER, strict=True)], schema=me.ANSWER)])

        def down(level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
            def on(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:  # a tally
                    return right.select(me.ANSWER.names)
                keys, values = me._received(left)
                known, own = me._reduced(keys, values)
                answered, above = me.gathered(right, known, level + 1)
                if me.finish:
                    return me._answers(left, keys, values, answered, above)
                at, there = lookup(answered, known)  # what isn't answered has nothing better elsewhere
                return me._answers(left, keys, values, known, [np.where(there, a[at], v) if len(a) else v for a, v in zip(above, own, strict=True)])

            return on

        rows = [sent]
        for level in range(1, self.levels):
            rows[-1] = cut(rows[-1], f"level-{level}")
            rows.append(rows[-1].groupBy("node").applyInArrow(up(level), self.SENT_SQL))
        answers = rows.pop().groupBy("node").applyInArrow(top, self.ANSWER_SQL)
        while rows:
            answers = rows[-1].groupBy("node").cogroup(answers.groupBy("shard")).applyInArrow(down(len(rows)), self.ANSWER_SQL)
            rows.pop()
        return answers
