"""Token counts from pre-token frequencies, without ids.

The vocabulary has no piece with a space after another character, so what lies
between the start of a run of spaces and the start of the next is merged on its
own: it is a pre-token. Each shard of documents gives its distinct pre-tokens; by
packed exchange each distinct pre-token of the corpus reaches one task, where the
library counts its pieces once; the counts come back, are joined to the frequency of
each pre-token in each document, and are summed by document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import shared_dir, table
from placeloom.llm.exchange import Exchange, dump_texts, hash_of, load_texts, lookup, same, sharded, unpacked_docs
from placeloom.llm.tokenizer_files import path

#: Pre-tokens that the library gets at once.
TOGETHER = 1 << 16
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class PieceCounts:
    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.space = "▁"
        for i in range(self.model.get_piece_size()):
            if self.space in self.model.id_to_piece(i).lstrip(self.space):
                raise ValueError("a piece has a space inside: pre-tokens don't stand alone")

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens without their first space."""
        if not text:
            return []
        text = text.replace(self.space, " ")
        words = text.split(" ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            joined, run = [], 0
            for i, w in enumerate(words):
                if w == "" and i < len(words) - 1:
                    run += 1
                else:
                    joined.append(" " * run + w)
                    run = 0
            words = joined
        return words

    def counts(self, pre_tokens: list[str]) -> list[int]:
        # the library puts a space before each text, but not before an empty one
        out = []
        for k in range(0, len(pre_tokens), TOGETHER):
            part = pre_tokens[k : k + TOGETHER]
            out += [len(x) if p else 1 for p, x in zip(part, self.model.encode(part, num_threads=1), strict=True)]
        return out


_LOADED: dict[str, PieceCounts] = {}


def loaded(file: str) -> PieceCounts:
    if file not in _LOADED:
        _LOADED[file] = PieceCounts(file)
    return _LOADED[file]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), without begin, end or added special tokens.

    Null and empty texts have no bytes and no tokens. Null and repeated ids and repeated rows stay rows
    of their own. A very long text is a shard by itself, which a task holds whole. Other columns aren't
    read. An empty table gives no rows. Pre-tokens travel as they are, named by 64-bit hashes; should two
    have one hash, the shards that have them count these themselves.
    """
    shared_dir(df.sparkSession)
    shards = sharded(df, id_col, text_col)

    def model() -> PieceCounts:
        return loaded(path("piece_bpe_32k.model", tokenizer))

    def counted(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        known = [x.decode() for x in values[0] if x is not None]
        out = np.full(len(keys), -1, np.int64)
        out[[x is not None for x in values[0]]] = model().counts(known)
        return [out]

    net = Exchange(shards.n, shards.ranges, same, kinds="b", finish=counted, dump=dump_texts, load=load_texts)

    def distinct(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, ascending but not always distinct, and the pre-tokens."""
        texts = np.empty(len(words), object)
        texts[:] = [w.encode() for w in words]
        keys = np.fromiter(map(hash_of, texts), np.uint64, len(texts))
        order = np.argsort(keys, kind="stable")
        return keys[order], texts[order]

    def send(key: tuple, t: pa.Table) -> pa.Table:
        split, words = model().pre_tokens, set()
        for text in unpacked_docs(t.column("docs")[0].as_py()).column("text").to_pylist():
            words.update(split((text or b"").decode()))
        keys, texts = distinct(words)
        keys, (texts,) = same(keys, [texts])
        return net.send(key[0].as_py(), keys, [texts])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        t, split = unpacked_docs(left.column("docs")[0].as_py()), model().pre_tokens
        texts = t.column("text").to_pylist()
        place: dict[str, int] = {}
        rows, times, sizes = [], [], []
        for text in texts:
            own = Counter(split((text or b"").decode()))
            rows.append(np.fromiter((place.setdefault(p, len(place)) for p in own), np.int64, len(own)))
            times.append(np.fromiter(own.values(), np.int64, len(own)))
            sizes.append(len(own))
        keys = np.fromiter((hash_of(p.encode()) for p in place), np.uint64, len(place))
        known, (pieces,) = net.gathered(right, np.unique(keys))
        pieces = pieces[lookup(known, keys)[0]] if len(keys) else keys.astype(np.int64)
        shared = np.flatnonzero(pieces < 0)
        if len(shared):
            words = list(place)
            pieces[shared] = model().counts([words[k] for k in shared.tolist()])
        total = np.append(0, np.cumsum(pieces[np.concatenate(rows)] * np.concatenate(times)))
        ends = np.cumsum(sizes)
        n = total[ends] - total[ends - sizes]
        return pa.table([t.column("doc_id").combine_chunks(), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(n, pa.int64())], schema=_RESULT)

    back = net.run(shards.rows.groupBy("shard").applyInArrow(send, Exchange.SENT_SQL))
    counts = shards.rows.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(join, "doc_id long, n_bytes long, n_tokens long")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
