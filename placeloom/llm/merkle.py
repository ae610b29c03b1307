"""Merkle manifest of a dataset: a tree for each group of rows and one over the groups' roots, with proofs.

A hash is the lower-case hex SHA-256 of its inputs one after the other; digests go in as hex text. Nodes of a tree
are held in blocks of a fixed number of places, ordered arrays that higher-order functions collapse by DEPTH levels at
once. The roots of the blocks have known places, so they are the nodes of the next round, until one is left.
Then the way back adds to each node's own siblings those of its block. A group of any size is many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.llm.common import cut, shuffle_partitions, table

#: Nodes that become one, and the levels that a block collapses.
RUN = 16
DEPTH = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of which a check changes the text: those whose id's CRC-32 this divides.
TAMPER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """SHA-256 of fields: a null is ``-``, others are their byte count, a colon and the value."""
    named = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*named), 256)


def leaves(df: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(key, id, leaf, altered) of each row, as a table of its own: whole texts are read once.

    key orders as the group does, null first, and is never null. altered: the leaf that the row has with the given
    columns in place of its own where the condition holds, else null.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    changed = F.when(where, digest(*(own | altered).values())) if altered and where is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("g"), F.col(f"`{group}`").cast("string")), F.lit(""))
    return cut(df.select(key.alias("key"), F.col(f"`{order}`").cast("long").alias("id"), digest(*own.values()).alias("leaf"), changed.alias("altered")), "merkle-leaves")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their place in their key's order (pos, from 0) and the rows of the key (n), whatever a key's share of all.

    Rows are dealt by ranges of key and order, ties by where they are read, so a key lies in as many ranges as it needs; only
    counts by range and key, no more than ranges and keys together, are summed.
    """
    spark = rows.sparkSession
    ranges = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), "key", *order, "tie")
    dealt = cut(ranges.sortWithinPartitions("key", *order).drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-ranges")
    counts = dealt.groupBy("key", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return dealt.join(counts, ["key", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _bound(value: Column, use) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * RUN + 1, RUN), ""), 256))


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(key, block, n, rows, levels): rows (pos, node, ..) of a block in order; levels: the nodes of each level, the rows' first.

    A key of one node is its own root; one of at most a block collapses until one is left, others by DEPTH levels.
    """
    n, least = F.col("n"), F.lit(0)
    for k in range(DEPTH):
        least = least + (n > RUN**k).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("pos", "node", *more)))
    grouped = nodes.groupBy("key", F.floor(F.col("pos") / RUN**DEPTH).alias("block")).agg(F.max("n").alias("n"), rows.alias("rows"))
    steps = F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), least)
    levels = F.aggregate(steps, F.array(F.col("rows.node")), lambda found, _: F.concat(found, F.array(_parents(F.element_at(found, -1)))))
    return grouped.withColumn("levels", levels)


def collapsed(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, the lowest first, and (key, node): the root of each key. nodes: (key, pos, n, node, ..)."""
    most, rounds = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        rounds.append(cut(_blocks(nodes, *(more if not rounds else ())), f"merkle-round-{len(rounds)}"))
        most = -(-most // RUN**DEPTH)
        root = F.element_at(F.element_at("levels", -1), 1)
        nodes = rounds[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / RUN**DEPTH).cast("long").alias("n"), root.alias("node"))
        if most <= 1:
            return rounds, nodes.select("key", "node")


def _siblings(levels: Column, i: Column) -> Column:
    """Of the i-th row of a block, for each level below its root: the run's nodes on the left and on the right, joined."""

    def side(k: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(RUN), k)).cast("int")
        own = at % RUN
        nodes = F.element_at(levels, k.cast("int") + 1)
        left = F.slice(nodes, at - own + 1, own)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(F.slice(nodes, at + 2, RUN - 1 - own), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.lit(1), F.size(levels) - 1), side)


def _descended(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(key, block, path, ..) of each block of the lowest round; top: (key, path, ..), the siblings above each key's root."""
    upper = top.withColumn("block", F.lit(0).cast("long"))
    carried = [c for c in top.columns if c not in ("key", "path")]
    for blocks in reversed(rounds[1:]):
        rows = F.transform("rows", lambda r, i: F.struct(r["pos"].alias("block"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))
        upper = blocks.join(upper, ["key", "block"]).select("key", *carried, F.inline(rows))
    return upper


def proved(rows: DataFrame) -> DataFrame:
    """(key, id, leaf, altered, subroot, root, proof, folded) of each leaf.

    proof: the hash of all siblings, from the leaf's run up to the root's; folded: the root as computed from the altered
    leaf (the leaf where that is null) and the siblings of the tree. Leaves of a key go by id (null first), then by
    themselves, so repeated rows have each a place of their own.
    """
    rounds, subroots = collapsed(numbered(rows, "id", "leaf").withColumnRenamed("leaf", "node"), "id", "altered")
    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "node")
    tops, root = collapsed(numbered(groups, "group"), "group")
    top = root.select("key", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node").alias("root"))
    heads = tops[0].join(_descended(tops, top), ["key", "block"])
    heads = heads.select("root", F.inline(F.transform("rows", lambda r, i: F.struct(r["group"].alias("key"), r["node"].alias("subroot"), F.concat(_siblings(F.col("levels"), i), F.col("path")).alias("path")))))
    joined = rounds[0].join(_descended(rounds, heads), ["key", "block"])
    told = lambda path: F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")

    def leaf(r: Column, i: Column, above: Column) -> Column:
        def of(own: Column) -> Column:
            fold = F.aggregate(F.concat(own, F.col("path")), F.coalesce(r["altered"], r["node"]), lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))
            return F.struct(r["id"].alias("id"), r["node"].alias("leaf"), r["altered"].alias("altered"), F.sha2(F.concat(told(own), above), 256).alias("proof"), fold.alias("folded"))

        return _bound(_siblings(F.col("levels"), i), of)

    each = _bound(told(F.col("path")), lambda above: F.transform("rows", lambda r, i: leaf(r, i, above)))
    return joined.select("key", "subroot", "root", F.inline(each))


def manifest(df: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(group, rows, subroot, root): a row for each group, the null one first when ordered by it.

    Nulls of any field are told from empty values. Empty and very long texts are hashed whole. Ids that repeat, and repeated
    rows, are leaves of their own, in the order of their hashes. Columns that aren't named have no part. An empty table
    gives no rows.
    """
    rows = proved(leaves(df, group, order, fields))
    return rows.groupBy("key").agg(F.count("*").alias("rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root")).select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("group"), "rows", "subroot", "root")


def audited(df: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, text_col: str = "text", every: int = TAMPER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, where some texts are tampered with.

    Where ``every`` divides the CRC-32 of the id in decimal, the leaf that is folded is that of the row with A-Z of its text in
    lower case: it is verified only if there are none. Null ids and null texts aren't tampered with. Nulls, empty and
    very long texts, repeated ids and rows, other columns and empty tables: as in manifest().
    """
    id_ = F.col(f"`{order}`").cast("long").cast("string")
    lowered = {text_col: F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)}
    rows = proved(leaves(df, group, order, fields, lowered, F.crc32(id_.cast("binary")) % every == 0))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, key: str, levels: int) -> str:
    """Nodes {name}0 (key, pos, node) collapsed level by level; {name}r<k>: the runs of level k, as lists."""
    out = ""
    for k in range(levels):
        out += f"""
, {name}r{k} AS (
  SELECT {key}, pos // 16 AS pos, list(node ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY {key}) AS n FROM {name}{k} GROUP BY {key}, pos // 16
), {name}{k + 1} AS (
  SELECT {key}, pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM {name}r{k}
)"""
    return out


def _fold_sql(name: str, key: str, levels: int, of: str) -> str:
    """Rows of ``of`` (key, spot, proof, folded, ..) led up through the runs, as f_{name}{levels}."""
    out = f", f_{name}0 AS (SELECT * FROM {of})"
    for k in range(levels):
        sides = "array_to_string(r.run[1:f.spot % 16], '') AS a, array_to_string(r.run[f.spot % 16 + 2:], '') AS b, r.n"
        out += f"""
, f_{name}{k + 1} AS (
  SELECT * EXCLUDE (spot, proof, folded, a, b, n), spot // 16 AS spot, CASE WHEN n = 1 THEN proof ELSE proof || a || b END AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(a || folded || b) END AS folded
  FROM (SELECT f.*, {sides} FROM f_{name}{k} f JOIN {name}r{k} r ON r.{key} IS NOT DISTINCT FROM f.{key} AND r.pos = f.spot // 16)
)"""
    return out


def _op11_sql(levels: int = 8) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    whole = " || ".join(field(f) for f in FIELDS[:-1])
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x // 2, 3988292384 * (x % 2))))"
    return f"""
WITH d AS (
  SELECT doc_id, source, sha256({whole} || {field("text")}) AS node,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({whole} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS altered
  FROM documents
), t AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d
), s0 AS (SELECT source, pos, node FROM t){_levels_sql("s", "source", levels)}
, g0 AS (
  SELECT 0 AS one, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, source, node FROM s{levels}
){_levels_sql("g", "one", levels)}
, under AS (SELECT doc_id, source, node AS leaf, pos AS spot, '' AS proof, coalesce(altered, node) AS folded FROM t){_fold_sql("s", "source", levels, "under")}
, above AS (
  SELECT f.* EXCLUDE (spot), g.pos AS spot, g.node AS subroot, 0 AS one FROM f_s{levels} f JOIN g0 g ON g.source IS NOT DISTINCT FROM f.source
){_fold_sql("g", "one", levels, "above")}
SELECT f.doc_id, f.leaf, f.subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = r.node AS verified
FROM f_g{levels} f JOIN g{levels} r ON r.one = f.one
"""


OP11_SQL = _op11_sql()
