"""SimHash fingerprints and near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import trie
from placeloom.llm.common import cut, drop, id_and_text, shared_dir, shuffle_partitions, table, text_bytes
from placeloom.operators.components import components

SEED = 42
#: Rows of a first block above which its subtree is dealt out as node pairs further down.
HOT = 1 << 17
#: Rows that a task of the trie join holds at once.
CHUNK = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if shorter; none: empty."""
    import xxhash

    words = (text or b"").lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate([[0], end[:-1]])
    n = max(1, len(words) - k + 1)
    last = (end[k - 1 :] if len(words) >= k else end[-1:]) - 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; none: 0."""
    n = len(hashes)
    if n == 0:
        return 0
    lanes = np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _remixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th independent 64 bits of each hash (0: the hash itself)."""
    if i == 0:
        return h
    h = h + np.uint64(i * int(_MIX[0]) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp_0 .. fp_{lanes-1}): 64 bits a lane as signed longs.

    Null and empty texts have the fingerprint 0 in every lane. Rows with a null id stay.
    """
    names = [f"fp_{i}" for i in range(lanes)]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.zeros((lanes, batch.num_rows), np.uint64)
            for r, text in enumerate(text_bytes(batch.column(1))):
                h = shingle_hashes(text, shingle)
                for i in range(lanes):
                    out[i, r] = majority(_remixed(h, i))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", *names])

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


def trie_links(values: DataFrame, bits: int, budget: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs of ids whose values differ in at most ``budget`` bits.

    values: id long (not null), part int, value long of which the low ``bits`` bits count. Only
    values of one part are compared; repeated values of a part link their ids. A subtree whose
    first block holds more than HOT rows is dealt out by the node pairs below it. With a column
    label (long) ids of one label count as linked already.
    """
    spark = values.sparkSession
    own_label = [c for c in values.columns if c == "label"]
    widths = [trie.rotated_widths(bits, budget, r) for r in range(budget + 1)]
    mask = (1 << bits) - 1

    def rotated(r: int):
        v = F.col("value").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
        shift = sum(trie.blocks(bits, budget)[:r])
        if shift:
            v = F.shiftleft(v, shift).bitwiseOR(F.shiftrightunsigned(v, bits - shift)).bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
        return v

    turned = values.select("id", "part", *own_label, F.posexplode(F.array(*(rotated(r) for r in range(budget + 1)))).alias("rot", "value"))
    first = F.expr("CASE rot " + " ".join(f"WHEN {r} THEN shiftrightunsigned(value, {bits - w[0]})" for r, w in enumerate(widths)) + " END")
    turned = turned.withColumn("block", first)
    # (part, rot, block) is at most parts x rotations x 2^width; only those above HOT come to the driver
    hot = {(x.part, x.rot, x.block): x.n for x in turned.groupBy("part", "rot", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).collect()}
    split = {k: min(int(np.ceil(np.log2(n / HOT))) + 1, *(w for w in widths[k[1]][1:2])) for k, n in hot.items()} if budget else {}

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "part", "rot", "value", "block", *own_label, "low", "high"]
        for batch in it:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names[:-2]]
            zero = np.full(batch.num_rows, -1, np.int64)
            if not split:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, zero, zero)], names=names)
                continue
            depth = np.array([split.get(k, 0) for k in zip(*(x.tolist() for x in (cols[1], cols[2], cols[4])), strict=True)])
            for s in np.unique(depth):
                own = [x[depth == s] for x in cols]
                if s == 0:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, zero[: len(own[0])], zero[: len(own[0])])], names=names)
                    continue
                below = np.array([bits - w[0] - s for w in widths], np.uint64)[own[2]]
                node = ((own[3].view(np.uint64) >> below) & np.uint64((1 << int(s)) - 1)).astype(np.int64)
                for flip in (0, *(1 << i for i in range(int(s)))):  # the second block holds one differing bit at most
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.minimum(node, node ^ flip), np.maximum(node, node ^ flip))], names=names)

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def linked(t: pa.Table) -> pa.RecordBatch:
            label = t.column("label").to_numpy() if own_label else None
            part, rot, block, low, high, ident, value = (t.column(n).to_numpy() for n in ("part", "rot", "block", "low", "high", "id", "value"))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in np.unique(rot):
                at = rot == r
                keys = np.stack([part[at], block[at], low[at], high[at]])
                order = np.lexsort(keys[::-1])
                keys = keys[:, order]
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
                turn = (group, value[at].view(np.uint64), ident[at])
                x, y = trie.links(*turn, bits, widths[r], label[at] if own_label else None)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        rows = 0
        for batch in it:  # sorted by subtree: a chunk ends where one does
            kept.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= CHUNK:
                t = pa.concat_tables(kept)
                last = [t.column(n)[rows - 1].as_py() for n in ("part", "rot", "block", "low", "high")]
                same = np.logical_and.reduce([t.column(n).to_numpy() == v for n, v in zip(("part", "rot", "block", "low", "high"), last, strict=True)])
                end = int(np.argmax(same))
                if end:
                    yield linked(t.slice(0, end))
                    kept, rows = [t.slice(end)], rows - end
        if rows:
            yield linked(pa.concat_tables(kept))

    keys = ["part", "rot", "block", "low", "high"]
    dealt = turned.mapInArrow(deal, "id long, part int, rot int, value long, block long, " + "label long, " * len(own_label) + "low long, high long")
    return dealt.repartition(max(shuffle_partitions(spark), 1), *keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long").distinct()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose 64-bit fingerprints are linked, directly or over others.

    Two fingerprints link at ``budget`` or fewer differing bits. Null and empty texts have
    fingerprint 0 and are linked like any other. Rows with a null id are left out; rows
    that repeat an id stay rows of their own, each in the group of its own text. An empty table gives no rows.
    """
    shared_dir(df.sparkSession)
    own = cut(fingerprints(df, id_col, text_col, shingle).where("doc_id is not null"), "fingerprints")
    heads = cut(own.groupBy("fp_0").agg(F.min("doc_id").alias("id")), "heads")
    groups = components(trie_links(heads.select("id", F.lit(0).alias("part"), F.col("fp_0").alias("value")), 64, budget))
    named = heads.join(groups, heads.id == groups.node, "left").select("fp_0", F.coalesce("component", "id").alias("component_id"))
    return own.join(cut(named, "named"), "fp_0").select("doc_id", F.lpad(F.lower(F.hex("fp_0")), 16, "0").alias("fingerprint"), "component_id")


#: 64-bit lanes of a near-duplicate fingerprint; the low LANE_BITS of each go through a trie with LANE_BUDGET.
LANES, LANE_BITS, LANE_BUDGET = 12, 42, 4
#: Where the bits of a lane begin that each join after the first goes by.
SHIFTS = (22,)


def differing_share(similarity: float) -> float:
    """Share of SimHash bits expected to differ between equally large shingle sets of this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


#: Sets of at most SHORT shingles are too small for bits to estimate their similarity: their pairs are found by shared shingles.
SHORT = 64
#: Standard deviations above the expected differing bits up to which a pair met is compared.
WIDE = 5


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text, node, n, fp_0 .. fp_{LANES-1}): node names the set of distinct shingles, n is its size; bits are those of the set. Rows with a null id are left out."""
    names = [f"fp_{i}" for i in range(LANES)]
    schema = "doc_id long, text string, node long, n int, " + ", ".join(f"{n} long" for n in names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in it:
            node, n, out = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32), np.zeros((LANES, batch.num_rows), np.uint64)
            for r, text in enumerate(text_bytes(batch.column(1))):
                h = np.unique(shingle_hashes(text, shingle))
                node[r], n[r] = xxhash.xxh3_64_intdigest(h.tobytes()), len(h)
                for i in range(LANES):
                    out[i, r] = majority(_remixed(h, i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(n), *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", "text", "node", "n", *names])

    return id_and_text(df, id_col, text_col).where("doc_id is not null").mapInArrow(run, schema)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct values have this Jaccard similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def verified(pairs: DataFrame, own: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar, by the texts themselves; a table.

    own: (doc_id, node, text); heads: (node, id), the document whose text stands for a node. Only texts of nodes in pairs move.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left, right = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            yes = [similar(np.unique(shingle_hashes(x, shingle)), np.unique(shingle_hashes(y, shingle)), similarity) for x, y in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(heads.select("node", F.col("id").alias("doc_id")), "node")
    texts = cut(own.join(met, ["doc_id", "node"], "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    links = cut(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "links")
    drop(texts)
    return links


#: Sets of one key that a task compares; more are split by their next shared shingle, LEVELS deep, and then into pairs of blocks.
GROUP, LEVELS = 2000, 4


def _links_of_group(similarity: float):
    """Function of the sets (node, hs) of one key: spanning edges of all its similar pairs."""

    def linked(key: tuple, t: pa.Table) -> pa.Table:
        node, lists = t.column("node").to_numpy(), t.column("hs").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(node)), size)
        _, shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(shingle, kind="stable")  # sets by shingle, each shingle's ascending
        start, having = np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2)), owner[order]
        at, label, out = np.concatenate([[0], np.cumsum(size)]), np.arange(len(node)), []
        for i in range(1, len(node)):
            own = shingle[at[i] : at[i + 1]].tolist()
            shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *(having[start[x] : start[x + 1]] for x in own)]), minlength=len(node))[:i]
            for j in np.flatnonzero((shared >= similarity * (size[i] + size[:i] - shared) - 1e-9) & (label[:i] != label[i])).tolist():
                if label[j] != label[i]:
                    out.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return linked


def short_pairs(texts: DataFrame, shingle: int, similarity: float, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """Spanning edges (a, b) of all similar pairs of the short texts (node, text).

    Shingles of a set are ordered by how few sets have them. Similar sets of n and m shingles share o(n, m) of them or more, so the l-th
    that they share has n - o + l, m - o + l places before its end at most. Sets meet by the first shingle shared; of a key only those are kept that
    have another one of a size and place that allows it (counted by size and place first), so texts that differ too much by their rare
    shingles don't meet, however many have the common ones. A key of more than ``group`` sets is split by the next shingle
    shared, ``levels`` times; what is still larger is compared by pairs of blocks, each a task of its own. No pair is lost.
    """
    t = float(similarity)
    levels = min(levels, max(1, math.ceil(t / (1 - t) - 1e-9))) if t < 1 else 1  # different sets share at least so many

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [np.unique(shingle_hashes(x, shingle)) for x in text_bytes(batch.column(1))]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["node", "h"])

    each = cut(texts.select("node", "text").mapInArrow(spread, "node long, h long"), "short-shingles")
    counts = each.groupBy("h").agg(F.count("*").alias("k"))
    # a shingle of one set only is in no pair, but has its place among the rarest
    sets = each.join(counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("x"))  # SHORT / similarity shingles at most
    last = lambda level: f"least(n, n - cast(ceil({t!r} * n - 1e-9) as int) + {level})"
    first = sets.select("node", F.size("x").alias("n"), F.col("x.h").alias("hs"), "x").select("*", F.posexplode(F.expr(f"slice(x, 1, {last(1)})")).alias("pos", "s"))
    rows = cut(first.where("s.k > 1").select("node", "n", "hs", F.array("s.h").alias("key"), (F.col("pos") + 1).alias("pos")), "short-keys")
    drop(each)
    links, level = [], 1
    while True:
        sizes = f"least(a.n, b.n) >= {t!r} * greatest(a.n, b.n) - 1e-9"
        allowed = f"{sizes} AND {level} + least(a.n - a.pos, b.n - b.pos) >= ceil({t / (1 + t)!r} * (a.n + b.n) - 1e-9) AND (a.n <> b.n OR a.pos <> b.pos OR a.c > 1)"
        classes = rows.groupBy("key", "n", "pos").agg(F.count("*").alias("c")).groupBy("key").agg(F.collect_list(F.struct("n", "pos", "c")).alias("cs"))  # sizes x places at most
        kept = classes.select("key", F.expr(f"filter(cs, a -> exists(cs, b -> {allowed}))").alias("cs")).where(F.size("cs") > 0)
        kept = kept.select("key", F.aggregate("cs", F.lit(0).cast("long"), lambda x, c: x + c["c"]).alias("total"), F.explode("cs").alias("own")).select("key", "own.n", "own.pos", "total")
        met = cut(rows.join(kept, ["key", "n", "pos"]), f"short-met-{level}")
        drop(rows)
        links.append(cut(met.where(F.col("total") <= group).select("key", "node", "hs").groupBy("key").applyInArrow(_links_of_group(t), "a long, b long").distinct(), f"short-links-{level}"))
        hot = met.where(F.col("total") > group)
        if hot.isEmpty():
            drop(met)
            break
        if level == levels:
            blocks = F.ceil(F.col("total") / group).cast("long")
            own = hot.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            own = own.select(F.concat("key", F.array(F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "node", "hs")
            links.append(cut(own.groupBy("key").applyInArrow(_links_of_group(t), "a long, b long").distinct(), "short-links-blocks"))
            drop(met)
            break
        level += 1
        places = hot.withColumn("next", F.explode(F.expr(f"CASE WHEN pos < {last(level)} THEN sequence(pos + 1, {last(level)}) END")))
        rows = cut(places.select("node", "n", "hs", F.concat("key", F.array(F.element_at("hs", F.col("next")))).alias("key"), F.col("next").alias("pos")), f"short-keys-{level}")
        drop(met)
    return reduce(DataFrame.union, links).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of documents of at least this Jaccard similarity of their sets of shingles, directly or over others.

    component_id is the smallest id of the group. Null and empty texts are one group. Rows with a null id
    are left out; rows that repeat an id are each in the group of their own text. Very long texts are compared
    whole. An empty table gives no rows.
    """
    rows = grouped(df, id_col, text_col, shingle, similarity)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(cut(least, "least"), "component").select("doc_id", "component_id")


def grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, component): the group of each row; text_hash: of the text, null like empty.

    Every link is verified on the sets themselves; bits only find pairs. At 0.8 about 15 % of the bits
    differ, too many for the budget of one trie, so each of twelve lanes has a trie of its own over 42 bits
    with a budget of 4: a pair at 0.8 is met in a lane with probability 0.21 (in any: 0.94), one at
    0.9 in 0.56 (0.9999). A join gives spanning edges, those of the fewest differing bits first; edges that
    don't hold may have hidden others, so another join, over other bits of the lanes, spans the groups
    verified so far. The edges of a join are at most lanes x rotations times the documents, however dense a
    group is. All pairs with a set of at most SHORT shingles are found by shared shingles.
    """
    shared_dir(df.sparkSession)
    own = cut(shingle_sets(df, id_col, text_col, shingle), "fingerprints")
    lanes = [f"fp_{i}" for i in range(LANES)]
    heads = cut(own.groupBy("node", "n", *lanes).agg(F.min("doc_id").alias("id")), "heads")
    long = heads.where(F.col("n") > SHORT)
    share, bits = differing_share(similarity), 64 * LANES
    most = math.floor(bits * share + WIDE * math.sqrt(bits * share * (1 - share)))

    def met(values: DataFrame, shift: int, name: str) -> DataFrame:
        """Pairs met in a lane, by its bits from ``shift`` on, that sizes and all bits allow, with the number of differing ones."""
        kept = [c for c in values.columns if c == "label"]
        parts = values.select(F.col("node").alias("id"), *kept, F.posexplode(F.array(*(F.shiftrightunsigned(x, shift) for x in lanes))).alias("part", "value"))
        pairs = trie_links(parts, LANE_BITS, LANE_BUDGET).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = (values.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), *(F.col(x).alias(f"{k}{x}") for x in lanes)) for k in "ab")
        differing = reduce(add, (F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in lanes))
        sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
        return cut(pairs.join(left, "a").join(right, "b").where(sizes & (differing <= most)).select("a", "b", differing.alias("d")), name)

    def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The pairs whose ends aren't of one group."""
        a, b = (groups.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    some = met(long, 0, "met")
    best = some.groupBy("a").agg(F.min_by("b", "d").alias("b")).union(some.groupBy("b").agg(F.min_by("a", "d").alias("a")).select("a", "b")).distinct()
    best = cut(best, "best")
    links = verified(best, own, heads, shingle, similarity)
    groups = cut(components(links), "groups-best")
    tried = cut(across(some.join(best, ["a", "b"], "left_anti"), groups), "rest").union(best)
    links = links.union(verified(tried.join(best, ["a", "b"], "left_anti"), own, heads, shingle, similarity))
    for shift in SHIFTS:
        groups = cut(components(links), f"groups-{shift}")
        named = long.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        near = met(named, shift, f"met-{shift}")
        more = cut(near.select("a", "b").join(tried, ["a", "b"], "left_anti"), f"more-{shift}")
        drop(near)
        links, tried = links.union(verified(more, own, heads, shingle, similarity)), tried.union(more)
    short = F.col("n").between(1, math.floor(SHORT / similarity + 1e-9))
    texts = own.where(short).join(heads.where(short).select(F.col("id").alias("doc_id"), "node"), ["doc_id", "node"], "left_semi").select("node", "text")
    links = links.union(cut(short_pairs(texts.dropDuplicates(["node"]), shingle, similarity), "links-short"))
    groups = cut(components(links), "groups")
    named = cut(heads.select("node", "id").join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")), "named")
    return own.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "node").join(named.select("node", "component"), "node").select("doc_id", "text_hash", "component")


def near_deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id; all columns stay.

    Rows are told apart by id and text, so of rows that repeat an id each stays or goes with the group of its
    own text; where a group's smallest id has several rows, one of them stays. Rows with a null id stay.
    An empty table gives no rows.
    """
    rows = grouped(df, id_col, text_col, shingle, similarity).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keep = cut(rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("own")).select("own"), "keep")
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    ident = F.col(f"row.`{id_col}`").cast("long")
    match = (ident == F.col("own.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))) == F.col("own.text_hash"))
    single = row.join(keep.where("own.n = 1"), match, "left").where(F.col("own").isNotNull() | ident.isNull())
    repeated = row.join(keep.where("own.n > 1"), match).groupBy("own").agg(F.first("row").alias("row"))
    return single.select("row").unionByName(repeated.select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
