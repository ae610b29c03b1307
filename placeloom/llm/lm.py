"""Language-model scores by deleted interpolation.

The model of order k mixes the maximum-likelihood estimate c(h, w) / c(h) with the
model of order k - 1; order 0 is uniform over the training vocabulary and one
unknown word. The weight of an estimate depends on the bucket of its context's
count (powers of two) and is learned by expectation-maximisation on deleted
counts: each training token is held out of the counts that predict it.

Counts of all n-grams of all documents are gathered by packed exchange: a shard
of documents sends each range of hashes its distinct n-grams with their training
counts and gets the totals back in the same order. They are 64 bits wide. Words
are told apart by hashes of 63 bits, longer n-grams by as many bits as leave one in
about a million with another's count, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import cut, shared_dir, table, text_bytes
from placeloom.llm.exchange import Exchange, added, compressed, heads, pack_sorted, pack_values, planes, sharded, unpack_sorted, unpack_values, unpacked_docs, unplanes
from placeloom.llm.words import Words, mix

ORDER = 3
FOLDS, HELD_OUT = 7, 2
#: Bits of a context's count bucket, and bins of a probability's logarithm to base 2: QUARTER a unit, down to 2^-40.
QUARTER, FLOOR = 4, 160
ROUNDS, ENOUGH = 200, 1e-7
#: Tokens whose counts are in one row, about.
TOGETHER = 1 << 17
#: Bits of an n-gram's hash beyond the logarithm of the bytes of the corpus; there are five or more of these to a
#: distinct n-gram, so about one n-gram in a million meets another of its hash.
TOLD = 17
#: Marks the hashes of words.
_WORD = np.uint64(1)
_END, _START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x27D4EB2F165667C5)
_COUNTED = pa.schema([("docs", pa.binary()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())])


def fold(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class _Shard:
    """Tokens of a shard's documents end to end, and the n-grams that end at each."""

    def __init__(self, docs: bytes, order: int, dropped: int):
        """dropped: bits that the hashes of n-grams of two and more words do without."""
        t = unpacked_docs(docs)
        self.ids = t.column("doc_id").to_pylist()
        self.held = np.array([fold(i, FOLDS) == HELD_OUT for i in self.ids])
        words = Words(text_bytes(t.column("text")), lower=True)
        self.sizes = words.sizes + 1
        word = np.full(int(self.sizes.sum()), _END)
        inside = np.ones(len(word), bool)
        inside[np.cumsum(self.sizes) - 1] = False
        word[inside] = words.hashes()
        del words, t, inside
        trained = np.repeat(~self.held, self.sizes).view(np.uint8)
        place = np.arange(len(word), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        keys, counts, self._rows, gram = [], [], [], word
        for n in range(1, order + 1):
            if n > 1:
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) ^ np.where(place >= n - 1, np.roll(word, n - 1), _START))
            own = word | _WORD if n == 1 else gram >> np.uint64(dropped) << np.uint64(dropped)
            by = np.argsort(own).astype(np.int32)
            own = own[by]
            head = heads(own)
            keys.append(own[head])
            counts.append(np.add.reduceat(trained[by], head, dtype=np.int64))
            row = np.empty(len(own), np.int32)
            row[by] = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(np.append(head, len(own))))
            self._rows.append(row)
        self._ends = np.cumsum([len(k) for k in keys])
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        self._order = np.argsort(keys)
        #: Distinct n-grams, ascending, and how often they are in training documents here.
        self.keys, self.counts = keys[self._order], counts[self._order]

    def by_token(self, values: np.ndarray) -> list[np.ndarray]:
        """Of values in the order of keys, for each n that of the n-gram that ends at each token."""
        back = np.empty(len(values), values.dtype)
        back[self._order] = values
        return [back[end - int(row.max()) - 1 : end][row] for end, row in zip(self._ends.tolist(), self._rows, strict=True)]


def packed(sizes: np.ndarray, ids: list[int | None], held: np.ndarray, counts: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Documents of a shard (id, held_out, n_tokens) and the counts of their n-grams, each order as narrow as it can be."""
    docs = pa.record_batch([pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes)], names=["doc_id", "held_out", "n_tokens"])
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in counts]
    planed = pa.record_batch([pa.array([x], pa.binary()) for c in narrow for x in (planes(c), c.dtype.str.encode())], names=[f"{x}{n}" for n in range(len(counts)) for x in ("counts", "kind")])
    return compressed(docs), compressed(planed)


def unpacked(docs: bytes, counts: bytes) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    """The documents, where each begins, and by order the counts of each token's n-gram."""
    t, c = unpacked_docs(docs), unpacked_docs(counts)
    sizes = t.column("n_tokens").to_numpy()
    return t, np.cumsum(sizes) - sizes, [unplanes(c.column(2 * n)[0].as_py(), c.column(2 * n + 1)[0].as_py().decode()).astype(np.int64) for n in range(c.num_columns // 2)]


def counted(df: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """(docs, counts, types, tokens, documents): some documents a row, with training counts of the 1- to order-grams that end at each token.

    tokens, documents: those learned from. One row for each range of hashes has nothing but the number of training types in it.
    """
    shards = sharded(df, id_col, text_col)
    dropped = max(1, 63 - TOLD - math.ceil(math.log2(shards.size + 2)))  # the last bit tells words from longer n-grams
    words = lambda keys, totals: int(((keys & _WORD).astype(bool) & (totals[0] > 0)).sum())

    def dump(keys: np.ndarray, values: list[np.ndarray]) -> tuple[bytes, bytes]:
        word = (keys & _WORD).astype(bool)
        words = pack_sorted(keys[word])
        return np.int64(len(words)).tobytes() + words + pack_sorted(keys[~word] >> np.uint64(dropped)), pack_values(values)

    def load(keys: bytes, values: bytes, kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
        n = 8 + int(np.frombuffer(keys[:8], np.int64)[0])
        own = np.sort(np.concatenate([unpack_sorted(keys[8:n]), unpack_sorted(keys[n:]) << np.uint64(dropped)]))
        return own, unpack_values(values, kinds, len(own))

    net = Exchange(shards.n, shards.ranges, added, tally=words, dump=dump, load=load)

    def send(key: tuple, t: pa.Table) -> pa.Table:
        s = _Shard(t.column("docs")[0].as_py(), order, dropped)
        return net.send(key[0].as_py(), s.keys, [s.counts])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # lane: the tally
            return pa.table([pa.array([x], f.type) for x, f in zip((None, None, sum(right.column("lane").to_pylist()), 0, 0), _COUNTED, strict=True)], schema=_COUNTED)
        s = _Shard(left.column("docs")[0].as_py(), order, dropped)
        _, (totals,) = net.gathered(right, s.keys)
        counts, ends, out = s.by_token(totals), np.cumsum(s.sizes), []
        part = ends // TOGETHER  # documents in rows of about so many tokens
        for a, b in zip(heads(part).tolist(), [*heads(part)[1:].tolist(), len(part)], strict=True):
            sizes, held, start = s.sizes[a:b], s.held[a:b], int(ends[a] - s.sizes[a])
            own = packed(sizes, s.ids[a:b], held, [c[start : int(ends[b - 1])] for c in counts])
            out.append((*own, 0, int(sizes[~held].sum()), int((~held).sum())))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    back = net.run(shards.rows.groupBy("shard").applyInArrow(send, Exchange.SENT_SQL))
    return shards.rows.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(join, "docs binary, counts binary, types long, tokens long, documents long")


def contexts(counts: list[np.ndarray], n: int, begins: np.ndarray, documents: int) -> np.ndarray:
    """Count of the context of each token in an n-gram, n > 1: of the (n-1)-gram before it; a document begins at ``begins``."""
    before = np.roll(counts[n - 2], 1)
    before[begins] = documents  # the start alone
    return before


def estimates(counts: list[np.ndarray], begins: np.ndarray, total: int, documents: int, deleted: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By order from 1: maximum-likelihood estimates and context buckets; ``deleted`` is taken from each count."""
    ps, buckets = [], []
    for n, c in enumerate(counts, 1):
        context = np.full(len(c), total, np.int64) if n == 1 else contexts(counts, n, begins, documents)
        context = np.maximum(context - deleted, 0)
        p = np.where(context > 0, np.maximum(c - deleted, 0) / np.maximum(context, 1), 0.0)
        ps.append(np.minimum(p, 1.0))  # two n-grams of one hash could come to more
        buckets.append(np.ceil(np.log2(context + 1)).astype(np.int64))
    return ps, buckets


def interpolated(ps: list[np.ndarray], buckets: list[np.ndarray], weights: list[np.ndarray], uniform: float) -> np.ndarray:
    """Probability by the model of order len(weights)."""
    p = np.full(len(ps[0]), uniform)
    for own, bucket, weight in zip(ps, buckets, weights, strict=False):
        lam = weight[np.minimum(bucket, len(weight) - 1)]
        p = lam * own + (1 - lam) * p
    return p


def binned(p: np.ndarray) -> np.ndarray:
    """Bin of the logarithm; FLOOR: 0 or nearly."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-QUARTER * np.log2(np.maximum(p, 1e-300))), FLOOR), FLOOR).astype(np.int64)


def em(bucket: np.ndarray, own: np.ndarray, lower: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weight of the estimate by bucket, at a maximum of the held-out likelihood; a bucket without tokens takes that of the one below.

    own, lower: probabilities of each cell; count: its tokens.
    """
    size = 64
    lam = np.full(size, 0.5)
    tokens = np.bincount(bucket, weights=count, minlength=size)
    for _ in range(ROUNDS):
        a = lam[bucket] * own
        share = a / np.maximum(a + (1 - lam[bucket]) * lower, 1e-300)
        new = np.bincount(bucket, weights=count * share, minlength=size) / np.maximum(tokens, 1)
        moved = np.abs(new - lam)[tokens > 0].max(initial=0)
        lam = np.where(tokens > 0, new, lam)
        if moved < ENOUGH:
            break
    known = np.flatnonzero(tokens > 0)
    lam[0] = 0.0  # a context never seen
    for b in range(1, size):
        if tokens[b] == 0:
            lam[b] = lam[known[known < b][-1]] if (known < b).any() else 0.5
    return np.minimum(lam, 1 - 1e-9)


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10.

    held_out: crc32 of the id as text, modulo 7, is 2; such documents are scored but not learned from. Tokens are
    the words, A-Z lower-cased, and one end; null and empty texts are the end alone. Null ids count as the id of
    no digits. Rows that repeat an id are documents of their own, so are repeated rows. A very long text is a
    shard by itself, which a task holds whole. Other columns aren't read. An empty table gives no rows; without
    training documents all words are unknown.
    """
    shared_dir(df.sparkSession)
    rows = cut(counted(df, id_col, text_col, order), "lm-counts")
    types, total, documents = (int(x or 0) for x in rows.agg(F.sum("types"), F.sum("tokens"), F.sum("documents")).first())
    uniform, weights = 1.0 / (types + 1), []
    shards = rows.where("docs IS NOT NULL").select("docs", "counts")
    for n in range(1, order + 1):
        fixed = list(weights)

        def tally(it: Iterator[pa.RecordBatch], n: int = n, fixed: list[np.ndarray] = fixed) -> Iterator[pa.RecordBatch]:
            cells: dict[int, int] = {}
            for batch in it:
                for docs, data in zip(batch.column(0), batch.column(1), strict=True):
                    t, begins, counts = unpacked(docs.as_py(), data.as_py())
                    trained = np.repeat(~t.column("held_out").to_numpy(), t.column("n_tokens").to_numpy())
                    ps, buckets = estimates(counts[:n], begins, total, documents, 1)
                    lower = interpolated(ps[:-1], buckets[:-1], fixed, uniform) if n > 1 else np.full(len(trained), uniform)
                    cell, count = np.unique((buckets[-1] << 16 | binned(ps[-1]) << 8 | binned(lower))[trained], return_counts=True)
                    for c, k in zip(cell.tolist(), count.tolist(), strict=True):
                        cells[c] = cells.get(c, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], names=["cell", "tokens"])

        # at most 64 buckets x 161 x 161 cells, whatever the input
        cells = shards.mapInArrow(tally, "cell long, tokens long").groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()
        if not cells:
            weights.append(np.zeros(64))
            continue
        cell, count = np.array([x.cell for x in cells]), np.array([x.tokens for x in cells], float)
        own, low = cell >> 8 & 255, cell & 255
        weights.append(em(cell >> 16, np.where(own == FLOOR, 0.0, 2.0 ** (-own / QUARTER)), 2.0 ** (-low / QUARTER), count))
    learned = list(weights)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for docs, data in zip(batch.column(0), batch.column(1), strict=True):
                t, begins, counts = unpacked(docs.as_py(), data.as_py())
                base = np.log10(counts[0] + 1.0) - (math.log10(total + types + 1))
                own = np.log10(interpolated(*estimates(counts, begins, total, documents, 0), learned, uniform))
                sums = [np.add.reduceat(x, begins) for x in ((counts[0] > 0).astype(np.int64), base, own)]
                yield pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in t.columns), *(pa.array(x) for x in sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    result = shards.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
