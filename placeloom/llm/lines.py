"""Lines that several documents share are kept in one of them only.

DataFrame functions all the way: lines are exploded with their places, normalised and hashed; distinct documents are counted
by hash; places of lines over the threshold go back to their documents, which are cut at these places and joined again.
What is shuffled by line has a fixed width; texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import cut, table

#: Code points a key needs to count, and the distinct documents from which on it is a duplicate.
LEAST_LENGTH = 10
LEAST_DOCUMENTS = 2
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty ones have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normal(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case. Where all is ASCII that is plain lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _bits(value: Column) -> list[Column]:
    """128 bits of a string, as two longs of different seeds."""
    return [F.xxhash64(F.lit(seed), value).alias(f"h{seed}") for seed in (1, 2)]


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t1, t2) with every column under an own name: rows of one id and text have one answer."""
    text = F.col(f"`{text_col}`").cast("string")
    own = F.coalesce(text, F.lit(""))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(3), own).alias("t1"), F.xxhash64(F.lit(4), own).alias("t2"))


def places(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of each line long enough, as a table that two steps read."""
    each = docs.select("doc_id", "t1", "t2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = each.select("doc_id", "t1", "t2", "pos", normal(F.col("line")).alias("key")).where(F.char_length("key") >= least_length)
    return cut(keys.select("doc_id", "t1", "t2", "pos", *_bits(F.col("key"))), "line-places")


def shared(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(h1, h2, documents, first) of each line that so many distinct documents hold; first: the smallest of their ids.

    Rows without an id count as one document, larger than all others.
    """
    last = F.lit((1 << 63) - 1)
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct(F.coalesce("doc_id", last)).alias("documents"), F.min("doc_id").alias("first"))
    return counted.where(F.col("documents") >= least_documents)


def _kept(lines: Column, gone: Column) -> Column:
    """The lines but for those at the places gone (ascending): the stretches between them, one after the other."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))

    def stretches(bounds: Column) -> Column:
        return F.flatten(F.transform(F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda b, k: F.slice(lines, bounds[k] + 2, b - bounds[k] - 1)))

    return F.transform(F.array(ends), stretches)[0]


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, text, kept, n_lines, n_dropped) of each row: kept is its text without the lines that go.

    Lines of one key (normal()) of at least least_length code points in at least least_documents documents go, except in the
    smallest id that holds it, where all stay. A document is an id: rows that repeat an id, and repeated rows, share their
    fate and take nothing from each other; rows with a null id are one document, larger than all. Null and empty texts are one
    empty line; very long texts are read whole; columns of other names aren't read. An empty table gives no rows. Keys are
    told apart by 128 bits of two 64-bit hashes.
    """
    docs = _documents(df, id_col, text_col)
    lines = places(docs, least_length)
    last = F.lit((1 << 63) - 1)
    several = cut(shared(lines, least_documents), "line-shared")  # a table of its own: else a hot line's side of the join can't be split
    gone = lines.join(several, ["h1", "h2"]).where(F.coalesce("doc_id", last) > F.coalesce("first", last))
    marks = gone.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("gone")).withColumnsRenamed({"doc_id": "m_id", "t1": "m1", "t2": "m2"})
    own = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    none = F.array().cast("array<int>")
    parts = F.transform(F.array(lines_of(F.col("text"))), lambda x: F.struct(F.size(x).alias("n"), F.array_join(_kept(x, F.coalesce("gone", none)), "\n").alias("kept")))[0]
    found = own.select("doc_id", "text", "gone", parts.alias("parts"))
    return found.select("doc_id", "text", F.col("parts.kept").alias("kept"), F.col("parts.n").cast("long").alias("n_lines"), F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
