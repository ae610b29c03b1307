"""Exact top-k by inner product with a pivot-distance index.

A vector x of integers gets one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm, so that the inner product with a query q falls as the distance
between (q, 0) and x grows: d^2 = |q|^2 + M^2 - 2 q.x. Every vector is keyed by
its nearest pivot and its distance r to it; a cell is one annulus around a pivot,
sorted by r. For a query at distance d from the pivot the triangle inequality
gives |d - r| <= distance, so no vector with r outside [d - t, d + t] can be
within t. A query starts with the distance t of its k-th best among the rows the
pivots were fitted on, goes only to annuli that its interval meets, and in each
expands from d to both sides until its bound stops it, tightening t on the way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.llm.common import cut, shared_dir, table

#: Rows the pivots are fitted on, by hash of their id; also the first candidates of each query.
SAMPLE = 4096
PIVOTS = 16
#: Annuli of a pivot at most; rows of a cell's part that one task joins; queries that it takes at once.
ANNULI, PART, QUERIES = 64, 1 << 14, 1 << 12
#: Rows that an expanding step adds on each side.
STEP = 1024
#: Distances are rounded; bounds are widened by so much of their size.
SLACK = 1e-9


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every partial sum is below 2^53, else by Python integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ x.T
    limit = 2**63 - 1
    return np.array([[max(-limit, min(limit, sum(int(a) * int(b) for a, b in zip(r, s, strict=True)))) for s in x] for r in q], np.int64).reshape(len(q), len(x))


def _fit(x: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots far from each other, the first the row of the smallest id."""
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)):
        k = int(near.argmax())
        if near[k] == 0:
            break
        chosen.append(k)
        near = np.minimum(near, _distances(x, x[k : k + 1])[:, 0])
    return x[chosen]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller id.

    Components become floor(scale * x); a component or score beyond 64 bits is the nearest that fits. Vectors that are null or hold null, NaN or infinite
    components take no part, nor do rows with a null id; all others must have one length (ValueError).
    A vector is no candidate of the query of its own id. Rows that repeat an id are candidates of their own, and queries
    of their own, each with its ranks. Fewer candidates: all. No vectors or queries: no rows.
    """
    spark = vectors.sparkSession
    shared_dir(spark)

    def integers(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
        return df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    rows, asked = cut(integers(vectors), "vectors"), cut(integers(queries).withColumn("key", F.monotonically_increasing_id()), "queries")
    out_sql = "query_id long, rank int, vec_id long, score long"
    facts = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    n, dim, widest, square = facts
    if not n or asked.isEmpty():
        return spark.createDataFrame([], out_sql)
    if dim != widest or dim != asked.agg(F.max(F.size("v"))).first()[0]:
        raise ValueError("vectors differ in length")
    most = math.sqrt(square)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().sort_by("id")
    first_ids, first = sample.column("id").to_numpy(), _matrix(sample.column("v"), dim)
    pivots = _fit(_augmented(first, most), PIVOTS)

    def keyed(batches):
        for b in batches:
            d = _distances(_augmented(_matrix(b.column(1), dim), most), pivots) if b.num_rows else np.zeros((0, len(pivots)))
            p = d.argmin(axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["id", "v", "pivot", "r"])

    index = cut(rows.mapInArrow(keyed, "id long, v array<long>, pivot int, r double"), "index")
    # annuli by count: equal widths between the smallest and largest distance of a pivot; PIVOTS x ANNULI cells at most
    around = {x.pivot: x for x in index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    rings = {p: (x.low, (x.high - x.low) / max(1, min(ANNULI, x.n // PART)) or 1.0, max(1, min(ANNULI, x.n // PART))) for p, x in around.items()}
    low = F.create_map(*(F.lit(y) for p, x in rings.items() for y in (p, float(x[0]))))
    width = F.create_map(*(F.lit(y) for p, x in rings.items() for y in (p, float(x[1]))))
    ring = F.least(F.floor((F.col("r") - low[F.col("pivot")]) / width[F.col("pivot")]), F.create_map(*(F.lit(y) for p, x in rings.items() for y in (p, x[2] - 1)))[F.col("pivot")])
    cell_of = index.withColumn("cell", (F.col("pivot") * ANNULI + F.greatest(ring, F.lit(0))).cast("int"))
    cells = {x.cell: x for x in cell_of.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    parts = {c: math.ceil(x.n / PART) for c, x in cells.items()}
    n_queries = asked.count()
    groups = max(1, math.ceil(n_queries / QUERIES))
    bound = [(c, c // ANNULI, x.low, x.high) for c, x in sorted(cells.items())]

    def visits(batches):
        """A row for each cell part that a query may have to see."""
        for b in batches:
            ids, q = b.column(0).to_numpy(), _matrix(b.column(1), dim) if b.num_rows else np.zeros((0, dim), np.int64)
            keys_of, out = b.column(2).to_numpy(), []
            far = _distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), pivots) if len(q) else None
            for r in range(len(ids)):
                s = _products(q[r : r + 1], first)[0]
                s = s[first_ids != ids[r]]
                kth = np.sort(s)[-k] if len(s) >= k else None
                norm = float((q[r].astype(np.float64) ** 2).sum())
                t = math.inf if kth is None else math.sqrt(max(0.0, norm + most * most - 2.0 * float(kth))) * (1 + SLACK) + 1e-6 * most
                floor = np.iinfo(np.int64).min if kth is None else int(kth)
                for c, p, lo, hi in bound:
                    if far[r, p] - t <= hi and far[r, p] + t >= lo:
                        for j in range(parts[c]):
                            out.append((c, j, int(ids[r]) % groups, int(keys_of[r]), int(ids[r]), q[r].tolist(), float(far[r, p]), floor))
                            if len(out) == STEP:
                                yield told(out)
                                out = []
            if out:
                yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["cell", "part", "block", "key", "query_id", "q", "d", "floor"])

    going = asked.select("id", "v", "key").mapInArrow(visits, "cell int, part int, block int, key long, query_id long, q array<long>, d double, floor long")
    of_part = F.create_map(*(F.lit(y) for c, m in parts.items() for y in (c, m)))
    dealt = cell_of.select("id", "v", "r", "cell", F.pmod(F.xxhash64("id"), of_part[F.col("cell")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"))
    result = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result.empty_table()
        ids, r, x = left.column("id").to_numpy(), left.column("r").to_numpy(), _matrix(left.column("v"), dim)
        order = np.argsort(r, kind="stable")
        ids, r, x = ids[order], r[order], x[order]
        qs, ds, floors, asked_by = _matrix(right.column("q"), dim), right.column("d").to_numpy(), right.column("floor").to_pylist(), right.column("query_id").to_numpy()
        keys_of = right.column("key").to_numpy()
        key_all, a_all, b_all, c_all = [], [], [], []
        for i in range(len(qs)):
            norm, need, d = float((qs[i].astype(np.float64) ** 2).sum()), floors[i], ds[i]
            lo = hi = int(np.searchsorted(r, d))
            got_id, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
            while lo > 0 or hi < len(r):
                t = math.inf if need == np.iinfo(np.int64).min else math.sqrt(max(0.0, norm + most * most - 2.0 * float(need))) * (1 + SLACK) + 1e-6 * most
                left_end, right_end = int(np.searchsorted(r, d - t)), int(np.searchsorted(r, d + t, side="right"))
                a, b = max(left_end, lo - STEP, 0), min(right_end, hi + STEP, len(r))
                if a >= lo and b <= hi:
                    break  # the annulus holds nothing more within the bound
                a, b = min(a, lo), max(b, hi)
                for u, v in ((a, lo), (hi, b)):
                    if v > u:
                        own = ids[u:v] != asked_by[i]
                        s = _products(qs[i : i + 1], x[u:v])[0][own]
                        got_id, got = np.concatenate([got_id, ids[u:v][own]]), np.concatenate([got, s])
                keep = _best(got_id, got, k)
                got_id, got = got_id[keep], got[keep]
                if len(got) == k:
                    need = max(need, int(got[-1]))
                lo, hi = a, b
            key_all.append(np.full(len(got), keys_of[i]))
            a_all.append(np.full(len(got), asked_by[i]))
            b_all.append(got_id)
            c_all.append(got)
        return pa.table([np.concatenate(x) for x in (key_all, a_all, b_all, c_all)], schema=result)

    keys = ["cell", "part", "block"]
    found = dealt.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInArrow(search, "key long, query_id long, vec_id long, score long")
    # each part sends k rows a query at most, of which every task keeps k before they are shuffled
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
