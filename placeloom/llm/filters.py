"""What five filters take from a corpus in every order, and each filter's Shapley value.

Of a part (a language) only the documents by the set of filters that they fail are counted: 32 masks. The documents
removed when filter i is applied with probability x_i are a polynomial, linear in each x_i,

    v(x) = sum over masks of count * (1 - product of (1 - x_i) over the mask) = sum over T of a_T * product of x_i over T,

whose values at the corners are what any sequence of filters has removed. The Shapley value of a filter is the integral
of its partial derivative along the diagonal, sum of a_T / |T| over the sets T that have it: a rational number over 60.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import cut, table

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
ORDERS = 120
#: Common denominator of the integrals of t^0 .. t^4 over the unit interval.
DENOMINATOR = 60


def failures(text: Column) -> Column:
    """Bits 0 to 3: a text has under 100 words (A), under 80 % distinct words (B), over 10 % of A-Z (C), one of #$%&*| (D)."""
    words = F.filter(F.split(text, "[ \t-\r]+", -1), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))[0]
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    plain = F.when(capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    counted = F.transform(F.array(sizes), lambda s: F.when(s["n"] < 100, 1).otherwise(0) + F.when(s["own"].cast("long") * 100 < s["n"].cast("long") * 80, 2).otherwise(0))[0]
    return (counted + plain).cast("int")


def masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of a mask, and how many are labelled so.

    Bit 4 (E): a smaller id has the same text, in whatever part; texts are compared by their SHA-256. Whole texts are read
    once; what is joined and shuffled has a fixed width. A null text is an empty one, a null part the empty string. Rows with a
    null id are larger than all others and aren't copies of each other; of rows that repeat the smallest id none is a copy.
    If an id has several labels, any of them counts. Other columns aren't read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    own = cut(own, "filter-masks")
    copies = own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(copies, "filter-copies")  # a table of its own: else a hot text's side of the join can't be split
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = own.join(copies, "digest", "left").join(told, "id", "left")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(F.count("*").alias("n"), *sums)


def polynomial(of: str) -> str:
    """Coefficients a_T of the removal polynomial, by T, from the array ``masks`` of (mask, n, good, toxic), in SQL.

    A set T gets, with the sign of its size, the documents that fail all its filters.
    """
    fail_all = f"aggregate(filter(masks, m -> m.mask & t = t), 0L, (x, m) -> x + m.{of})"
    return f"transform(sequence(0, {FULL}), t -> if(t = 0, 0L, if(bit_count(t) % 2 = 1, 1, -1) * {fail_all}))"


def corners(terms: str) -> str:
    """Values of the polynomial at its corners, by set of filters: what these filters remove together, in whatever order."""
    return f"transform(sequence(0, {FULL}), s -> aggregate(filter(sequence(0, {FULL}), t -> t & s = t), 0L, (x, t) -> x + {terms}[t]))"


def integrals(terms: str) -> str:
    """For each filter the integral of its partial derivative along the diagonal, as numerator over DENOMINATOR."""
    return f"transform(sequence(0, {len(FILTERS) - 1}), i -> aggregate(filter(sequence(1, {FULL}), t -> bit_get(t, i) = 1), 0L, (x, t) -> x + {terms}[t] * ({DENOMINATOR} div bit_count(t))))"


def _steps() -> Column:
    """(filter_order, step, f, before, after) of all orders; before and after: sets of filters."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    counted: (part, mask, n, good, toxic). An empty table has no parts and gives no rows.
    """
    parts = counted.groupBy("part").agg(F.sum("n").cast("long").alias("documents"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    terms = F.expr(f"array(struct({', '.join(f'{polynomial(c)} AS {c}' for c in ('n', 'good', 'toxic'))}))")
    values = f"transform(terms, p -> struct({', '.join(f'{corners(f"p.{c}")} AS {c}' for c in ('n', 'good', 'toxic'))}, {integrals('p.n')} AS shapley))[0]"
    parts = cut(parts.select("part", "documents", terms.alias("terms")).select("part", "documents", F.expr(values).alias("at")).select("part", "documents", "at.*"), "filter-polynomials")
    rows = parts.select("*", F.inline(_steps()))
    at = lambda c, s: F.get(F.col(c), s)
    lost = lambda c: at(c, F.col("after")) - at(c, F.col("before"))
    only = F.pow(F.lit(2), F.col("f")).cast("int")
    return rows.select(
        "part", "filter_order", "step",
        (F.col("documents") - at("n", F.col("after"))).alias("kept"),
        lost("n").alias("removed"),
        (at("n", only) - lost("n")).alias("redundant"),
        (at("n", F.lit(FULL)) - at("n", F.lit(FULL) - only)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.expr(f"get(shapley, f) * {ORDERS} div {DENOMINATOR}").alias("shapley"),
    )


def audited(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """interactions() of the masks() of a corpus: nulls, empty and very long texts, repeats, other columns and empty tables as there."""
    return interactions(masks(df, labels, id_col, text_col, part_col))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), d AS (
  SELECT doc_id, part, len(words) < 100 AS A, 100 * list_unique(words) < 80 * len(words) AS B,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, doc_id > first AS E
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT d.part, d.doc_id, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)
), o AS (
  SELECT a || b || c || d || e AS filter_order FROM unnest(['A','B','C','D','E']) t1(a), unnest(['A','B','C','D','E']) t2(b), unnest(['A','B','C','D','E']) t3(c), unnest(['A','B','C','D','E']) t4(d), unnest(['A','B','C','D','E']) t5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), r AS (
  SELECT g.*, filter_order, step, filter_order[step] AS letter, contains(fails, filter_order[step]) AS fail,
    length(fails) - length(translate(fails, filter_order[1:step - 1], '')) > 0 AS gone
  FROM g, s
), q AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant,
    sum(n) FILTER (fails = letter) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM q
"""
