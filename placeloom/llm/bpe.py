"""Byte-level BPE encoding with a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import id_and_text, table
from placeloom.llm.tokenizer_files import path

#: Pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a generation of those that a worker remembers; it keeps two.
REMEMBERED = 180_000
#: Bits of a leaf's key for its place; its rank stands above them.
PLACE = 40
NEVER = 1 << 62
#: Pre-tokens of up to so many bytes are merged in rows together, so many rows at once, and texts of so many characters at once.
LONGEST, ROWS, TOGETHER = 32, 1 << 14, 1 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Up to U+0377 every code point is assigned: a quick look for texts that hold others.
BEYOND = re.compile("[^\\x00-\\u0377]")


def unassigned_characters() -> re.Pattern:
    """Matches a character that Python's Unicode tables don't know.

    Libraries differ in such characters only (each has its own Unicode version), so texts that
    hold one are cut into pre-tokens by the tokenizers library itself.
    """
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


def merged(ids: list[int], rank_of: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The ids after all merges. rank_of: pair of ids -> rank << PLACE; made: id that the pair of a rank becomes.

    A segment tree stands over the pairs of neighbours: a leaf holds its pair's rank and place, NEVER
    and more if the pair has none, and an inner node the least of its two, so the root is the leftmost
    pair of the lowest rank. A merge changes three leaves and the nodes above them.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = rank_of.get
    size = 1 << (n - 1).bit_length()  # a leaf for the last id too: it has no pair
    leaves = [get(pair, NEVER) | i for i, pair in enumerate(zip(ids, ids[1:]))]
    level = leaves + [NEVER] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [NEVER]
    for level in reversed(levels):
        tree += level
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < NEVER:
        left = least & (1 << PLACE) - 1
        right = after[left]
        ids[left], ids[right] = new, _ = made[least >> PLACE], -1
        nxt = after[left] = after[right]
        low, high = size + left, size + right
        tree[high] = NEVER
        if nxt < n:
            before[nxt] = left
            tree[low] = get((new, ids[nxt]), NEVER) | left
        else:
            tree[low] = NEVER
        prev = before[left]
        if prev >= 0:
            low = size + prev
            tree[low] = get((ids[prev], new), NEVER) | prev
        if high - low < 8:  # close together: all nodes above the range
            while low > 1:
                low >>= 1
                high >>= 1
                for i in range(low, high + 1):
                    a, b = tree[2 * i], tree[2 * i + 1]
                    tree[i] = a if a < b else b
        else:
            for i in (low, size + left, high):
                while i > 1:
                    i >>= 1
                    a, b = tree[2 * i], tree[2 * i + 1]
                    tree[i] = a if a < b else b
    return [i for i in ids if i >= 0]


def parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about so many characters, cut before a space after anything but white space: there a pre-token always begins."""
    start = 0
    while len(text) - start > size:
        k = text.find(" ", start + size)
        while k > 0 and text[k - 1].isspace():
            k = text.find(" ", k + 1)
        if k < 0:
            break
        yield text[start:k]
        start = k
    yield text[start:]


class ByteBPE:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, file: str):
        import regex

        spec = json.load(open(file, encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault((vocab[a], vocab[b]), rank << PLACE)
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.file, self.odd, self.library = file, unassigned_characters(), None
        self.pattern = regex.compile(PATTERN).findall
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        # the same tables for many pre-tokens at once
        pairs = sorted((a << 32 | b, rank >> PLACE) for (a, b), rank in self.rank_of.items())
        self.pairs, self.ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        self.first_of, self.made_of = np.array(self.first, np.int64), np.array(self.made, np.int64)

    def is_odd(self, text: str) -> bool:
        """Whether libraries may cut the text differently."""
        return not text.isascii() and bool((first := BEYOND.search(text)) and self.odd.search(text, first.start()))

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if not self.is_odd(text):
            return self.pattern(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        first = self.first
        return merged([first[b] for b in piece], self.rank_of, self.made)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pre-tokens of 2 to ``size`` bytes, size a power of two: as ``merged``, a row of segment trees a pre-token.

        All rows take their step together; a row whose root has no pair is done.
        """
        n = np.array([len(p) for p in pieces])
        m, inner = len(pieces), np.arange(size)
        ids = self.first_of[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)]
        ids[inner >= n[:, None]] = -1
        leaf = np.full((m, size), NEVER)
        r, c = np.nonzero(inner[:-1] < n[:, None] - 1)
        rank = self._rank(ids[r, c], ids[r, c + 1])
        leaf[r, c] = np.where(rank < NEVER, rank << 8 | c, NEVER)
        levels = [leaf]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
        after, before = np.tile(inner + 1, (m, 1)), np.tile(inner - 1, (m, 1))
        rows = np.flatnonzero(levels[-1][:, 0] < NEVER)
        while len(rows):
            least = levels[-1][rows, 0]
            left, new = least & 255, self.made_of[least >> 8]
            right = after[rows, left]
            ids[rows, left], ids[rows, right] = new, -1
            nxt = after[rows, right]
            after[rows, left] = nxt
            inside = nxt < n[rows]
            before[rows[inside], nxt[inside]] = left[inside]
            key = np.full(len(rows), NEVER)
            rank = self._rank(new[inside], ids[rows[inside], nxt[inside]])
            key[inside] = np.where(rank < NEVER, rank << 8 | left[inside], NEVER)
            leaf[rows, right] = NEVER
            leaf[rows, left] = key
            prev = before[rows, left]
            some = prev >= 0
            rank = self._rank(ids[rows[some], prev[some]], new[some])
            leaf[rows[some], prev[some]] = np.where(rank < NEVER, rank << 8 | prev[some], NEVER)
            places = (left, right, np.maximum(prev, 0))
            for low, high in zip(levels, levels[1:]):
                places = tuple(p >> 1 for p in places)
                for p in places:
                    high[rows, p] = np.minimum(low[rows, 2 * p], low[rows, 2 * p + 1])
            rows = rows[levels[-1][rows, 0] < NEVER]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = ids[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, pieces: set[str]) -> None:
        """Makes the ids of pre-tokens known. Two generations are kept: what is met again is taken over from the last."""
        if len(self.known) >= REMEMBERED:
            self.last, self.known = self.known, {}
        known, last = self.known, self.last
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            if p in known:
                continue
            if p in last:
                known[p] = last[p]
                continue
            raw = p.encode("utf-8")
            if 2 <= len(raw) <= LONGEST:
                sizes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
            else:
                known[p] = np.array(self.merge(raw), "<u4").tobytes()
        for size, own in sizes.items():
            for k in range(0, len(own), ROWS):
                part = own[k : k + ROWS]
                known.update(zip([p for p, _ in part], self.merge_many([raw for _, raw in part], size)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of added tokens are those tokens."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            if len(t) > TOGETHER:  # a very long text goes in parts
                out += self._encoded(part)
                out.append(b"".join(self._encoded([p])[0] for p in parts(t, TOGETHER)))
                part, size = [], 0
                continue
            part.append(t)
            size += len(t)
            if size >= TOGETHER:
                out += self._encoded(part)
                part, size = [], 0
        return out + self._encoded(part)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        cut = [[(None, t)] if not any(a in t for a in self.added) else [((x, None) if k % 2 else (None, x)) for k, x in enumerate(self.at_added.split(t))] for t in texts]
        pieces = [[self.added[a].to_bytes(4, "little") if a else self.find(t) for a, t in row] for row in cut]
        self.learn(set(chain.from_iterable(x for row in pieces for x in row if type(x) is list)))
        known = self.known
        return [b"".join([x if type(x) is bytes else b"".join([known[p] for p in x]) for x in row]) for row in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(file: str | None = None) -> ByteBPE:
    file = path("byte_bpe_50k.json", file)
    if file not in _LOADED:
        _LOADED[file] = ByteBPE(file)
    return _LOADED[file]


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are binary, little-endian unsigned 32-bit integers. With decode also decoded, the text of the ids.

    Null and empty texts have no ids. Null and repeated ids of documents stay rows of their own.
    """
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decode]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in it:
            ids = bpe.encode_many([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decoded(df: DataFrame, ids_col: str = "ids", out_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """df with the decoded text of its ids beside its columns. Null ids give null, no ids the empty text.

    A column of the name ``out_col`` is replaced.
    """
    def texts(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(tokenizer)
        for ids in it:
            yield pa.array([None if x is None else bpe.decode(x) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out_col, F.arrow_udf(texts, "string")(F.col(f"`{ids_col}`")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents"), decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
