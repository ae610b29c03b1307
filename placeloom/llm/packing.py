"""Packing of token sequences by order-preserving dynamic programming."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from placeloom.llm.bpe import PATTERN, ByteBPE, loaded, parts
from placeloom.llm.common import id_and_text, table
from placeloom.llm.tokenizer_files import path

#: Ids of one window.
WINDOW = 1024
#: Id that ends each document.
END_ID = 0
#: Costs in padding ids: of a sequence, so that padding isn't dodged by many short ones of a power of two ids; of
#: the truncation of a document between sentences, and inside a sentence.
SEQUENCE, SENTENCE_CUT, HARD_CUT = 256, 8, 64
#: Cut points inside a sentence that is longer than a window lie so many ids apart.
GRID = 64
#: Ids over which cuts are chosen together; the last window is left open for the next round.
ROUND = 1 << 18
#: Texts beyond so many characters are encoded in parts.
PART = 1 << 16


def padded(length: int, window: int = WINDOW) -> int:
    """Ids that a sequence of this length takes: a power of two stands as it is."""
    return length if length & (length - 1) == 0 else window


def cuts(points: list[int], penalty: list[int], window: int = WINDOW, sequence: int = 0) -> list[int]:
    """Indexes of the points to cut at, the first and the last among them, of least total cost.

    points: ascending places, at most ``window`` apart; a window from a to b costs the ids added to
    it plus ``sequence`` plus the penalty of b. best[j] is the least cost to cut at j. Of the starts within a
    window's reach, the one of least best[i] + points[i] is kept at the head of a monotone queue
    (padding to the full window grows with the start alone); the starts a power of two back, which
    pad nothing, are looked up.
    """
    n = len(points)
    place = np.array(points)
    at = np.full(points[-1] + 1, -1, np.int64)
    at[place] = np.arange(n)
    ends, starts = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(window.bit_length()):
        j = np.flatnonzero(place >= 1 << k)
        i = at[place[j] - (1 << k)]
        ends.append(j[i >= 0])
        starts.append(i[i >= 0])
    end, start = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(end, kind="stable")
    exact, first = start[order].tolist(), np.searchsorted(end[order], np.arange(n + 1)).tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(points[0], 0)])  # (best + place, index), values ascending
    for j in range(1, n):
        here = points[j]
        while points[queue[0][1]] < here - window:
            queue.popleft()
        value, start = queue[0]
        cost = value + window - here
        for i in exact[first[j] : first[j + 1]]:
            if best[i] <= cost:
                cost, start = best[i], i
        best[j], back[j] = cost + sequence + penalty[j], start
        value = best[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, by the faster library with the same ranks."""

    def __init__(self, json_file: str | None, rank_file: str | None):
        import tiktoken

        self.exact: ByteBPE = loaded(json_file)
        lines = open(path("byte_bpe_50k.tiktoken", rank_file), "rb")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        ends = (b".", b"!", b"?")
        self.sentence_end = np.array([x.rstrip().endswith(ends) or b"\n" in x for x in self.exact.bytes])

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.exact.added) or self.exact.is_odd(text):
            return np.frombuffer(self.exact.encode(text), "<u4")
        if len(text) <= PART:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(self.fast.encode_ordinary(p), "<u4") for p in parts(text, PART)])


_LOADED: dict[tuple, Encoder] = {}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Documents of one partition, in their order, as one line of ids cut into sequences."""

    def __init__(self, partition: int, sentence_end: np.ndarray, window: int):
        self.base, self.next = partition << 40, 0
        self.sentence_end, self.window = sentence_end, window
        self.docs: deque[list] = deque()  # [doc_id, ids, ids of it that are in sequences already]
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)

    def points(self) -> tuple[list[int], list[int]]:
        """Places to cut the waiting ids at, and their penalties."""
        place, cost, start = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, ids, done in self.docs:
            inner = np.flatnonzero(self.sentence_end[ids[done:-1]]) + 1  # the last id is the end's
            inner = inner[inner < len(ids) - done - 1]
            place += [inner + start, np.array([start + len(ids) - done])]
            cost += [np.full(len(inner), SENTENCE_CUT), np.zeros(1, np.int64)]
            start += len(ids) - done
        p, c = np.concatenate(place), np.concatenate(cost)
        wide = np.flatnonzero(np.diff(p) > self.window)
        if len(wide):
            extra = np.concatenate([np.arange(p[i] + GRID, p[i + 1], GRID) for i in wide])
            order = np.argsort(np.concatenate([p, extra]), kind="stable")
            p, c = np.concatenate([p, extra])[order], np.concatenate([c, np.full(len(extra), HARD_CUT)])[order]
        return p.tolist(), c.tolist()

    def pack(self, last: bool) -> pa.RecordBatch:
        """Sequences of the waiting ids; all but the last window unless these are the last."""
        places, penalty = self.points()
        chosen = [places[i] for i in cuts(places, penalty, self.window, SEQUENCE)]
        out: dict[str, list] = {f.name: [] for f in _SCHEMA}
        for a, b in zip(chosen[:-1] if last else chosen[:-2], chosen[1:] if last else chosen[1:-1], strict=True):
            room, offset = b - a, 0
            while room:
                doc = self.docs[0]
                doc_id, ids, done = doc
                n = min(room, len(ids) - done)
                for name, x in zip(out, (doc_id, done, n, ids[done : done + n].tobytes(), len(ids), self.base + self.next, offset), strict=True):
                    out[name].append(x)
                doc[2] += n
                if doc[2] == len(ids):
                    self.docs.popleft()
                room, offset = room - n, offset + n
            self.next += 1
            self.waiting -= b - a
        return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    Documents are taken in the order of their partition, which is not shuffled; each partition
    makes its own sequences. A document is its ids and END_ID: null and empty texts are END_ID
    alone. Null and repeated ids and repeated rows are documents of their own; very long texts are
    encoded in parts and packed like others. An empty table gives no rows. Cuts fall between documents
    or sentences; only a sentence longer than a window is cut inside. Which sequence a piece is in
    depends on the input's partitions; its ids don't. Cuts are chosen over ROUND ids at a time, of which
    the last window stays open for the next.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _LOADED.get((tokenizer, ranks)) or Encoder(tokenizer, ranks)
        _LOADED[tokenizer, ranks] = encode
        packer = Packer(TaskContext.get().partitionId(), encode.sentence_end, window)
        end = np.array([END_ID], "<u4")
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
                if packer.waiting >= ROUND:
                    yield packer.pack(last=False)
        if packer.waiting:
            yield packer.pack(last=True)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")
