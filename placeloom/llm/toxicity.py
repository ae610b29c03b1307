"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, turns look-alike letters of other scripts and full-width
forms into Latin ones and digits that stand for letters into those, so that
spellings meant to escape a list meet it. An entry matches at the start of a
word (an entry marked as whole, at its end too). What lies inside an exception
phrase doesn't count. The weights of the matches are summed and divided by the
words of the text; a logistic function of that density is the score.

The lexicon, its weights and the logistic function are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import cut, id_and_text, shared_dir, table

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the lexicon is fitted on, by hash of their id.
SAMPLE = 20_000
#: Lengths of word beginnings that may become entries; documents an entry needs; least G2 and log rate ratio.
SHORTEST, LONGEST, DOCUMENTS, G2, RATIO = 3, 12, 5, 25.0, 2.5
#: Entries at most (a lexicon's size, whatever the input); hits of an entry that one training document counts for.
ENTRIES, CLIP = 500, 4

#: Least ratio of the shares of clean and toxic documents that hold an exception phrase; DOCUMENTS clean ones have to.
BENIGN = 2.0

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
CYRILLIC = ("авекмнорстухіјѕԁһѵԛԝ", "abekmhopctyxijsdhvqw")
GREEK = ("αβεικνοπρτυχω", "abeikvonptuxw")
DIGITS = ("0134578@", "oieastba")
_WORD = re.compile(r"[^\W\d_]+")


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for source, target in (CYRILLIC, GREEK, DIGITS):
        table |= {ord(a): b for a, b in zip(source, target, strict=True)}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF21 + i: chr(97 + i) for i in range(26)}
    table |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # not seen
    return table


FOLDING = _folding()
_DOLLAR = re.compile(r"\$(?=\w)")


def folded(text: str) -> str:
    text = text.lower()
    if "$" in text:
        text = _DOLLAR.sub("s", text)
    return text.translate(FOLDING)


@dataclass
class Lexicon:
    """entries: text -> (weight, whole word). exceptions: phrases whose matches don't count. score = logistic(intercept + slope * ln(FLOOR + density))."""

    entries: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = -20.0
    slope: float = 0.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, (weight, whole) in self.entries.items():
            a.add_word(folded(e), (len(folded(e)), weight, whole))
        for e in self.exceptions:
            f = folded(e)
            old = a.get(f, None)
            a.add_word(f, (len(f), -1.0, True) if old is None else (len(f), 0.0, True))
        a.make_automaton()
        return a


FLOOR = 1e-3
#: Words without a match that each text is taken to have besides its own: one match in a short text tells little.
PRIOR = 20


def density(automaton, text: str) -> float:
    """Sum of the weights of the matches by the number of words and PRIOR."""
    words = len(text.split())
    if not words or not len(automaton):
        return 0.0
    text, total = folded(text), 0.0
    hits, benign = [], []
    for end, (size, weight, whole) in automaton.iter(text):
        start = end + 1 - size
        if start and text[start - 1].isalpha() or whole and end + 1 < len(text) and text[end + 1].isalpha():
            continue
        (benign if weight < 0 else hits).append((start, end, weight))
    last = -1
    for start, end, weight in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start <= last or any(a <= start and end <= b for a, b, _ in benign):
            continue  # inside a longer match or an exception
        total, last = total + weight, end
    return total / (words + PRIOR)


def logistic(lexicon: Lexicon, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(lexicon.intercept + lexicon.slope * np.log(FLOOR + x), -40, 40)))


def _beginnings(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for word in _WORD.findall(folded(text)):
        for n in range(SHORTEST, min(len(word), LONGEST) + 1):
            b = word[:n]
            counts[b] = counts.get(b, 0) + 1
    return counts


def _tally(wanted: frozenset[str] | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, int] = {}
        hits: dict[str, int] = {}
        for batch in it:
            for text in batch.column(0).to_pylist():
                counts = _beginnings(text or "")
                own = [(b, k) for b, k in counts.items() if wanted is None or b in wanted]
                for b, k in [*own, ("", len(_WORD.findall(text or "")))]:
                    docs[b] = docs.get(b, 0) + 1
                    hits[b] = hits.get(b, 0) + (min(k, CLIP) if b else k)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([hits[b] for b in docs], pa.int64())], names=["b", "docs", "hits"])

    return run


def _phrases(text: str, entries: frozenset[str]) -> set[str]:
    """Folded words that go on beyond an entry, and pairs of neighbours of which one begins with an entry."""
    text = folded(text)
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    starts = [any(w[:n] in entries for n in range(SHORTEST, min(len(w), LONGEST) + 1)) for _, _, w in words]
    out = {w for (_, _, w), begins in zip(words, starts, strict=True) if begins and w not in entries}
    for (_, end, w), (start, _, v), x, y in zip(words, words[1:], starts, starts[1:], strict=False):
        if (x or y) and text[end:start] == " ":
            out.add(f"{w} {v}")
    return out


def _tally_phrases(entries: frozenset[str], wanted: frozenset[str] | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, int] = {}
        for batch in it:
            for text in batch.column(0).to_pylist():
                for f in _phrases(text or "", entries):
                    if wanted is None or f in wanted:
                        docs[f] = docs.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["b", "docs"])

    return run


def _g2(a: float, n: float, b: float, m: float) -> float:
    """Likelihood ratio of a of n against b of m."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    return 2 * sum(x * math.log(x / e) for x, e in cells if x > 0 and e > 0)


def fit(documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most ``sample`` labelled documents, none of the held-out fold.

    Rows without a label, an id or a document are no examples; if labels repeat an id, the highest
    counts. Exceptions are learned besides those given: words that only begin with an entry, and pairs of words
    around one, that clean texts hold and toxic ones seldom do. Without examples of both kinds the lexicon is empty and every score is near 0.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = cut(id_and_text(documents, id_col, text_col).join(F.broadcast(marks), "doc_id"), "labelled")  # at most `sample` pairs of integers
    toxic, clean = (rows.where(f"toxic {op} 0").select("text") for op in ("<>", "="))
    kind = "b string, docs long, hits long"

    def gathered(texts: DataFrame, wanted: frozenset[str] | None, least: int) -> dict[str, tuple[int, int]]:
        got = texts.mapInArrow(_tally(wanted), kind).groupBy("b").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
        return {r.b: (r.docs, r.hits) for r in got.where((F.col("docs") >= least) | (F.col("b") == "")).collect()}  # bounded by the sample

    bad = gathered(toxic, None, DOCUMENTS)
    good = gathered(clean, frozenset(bad), 1)
    (n, n_words), (m, m_words) = bad.pop("", (0, 0)), good.pop("", (0, 0))
    if not n or not m:
        return Lexicon(exceptions=exceptions)
    ranked = []
    for b, (docs, hits) in bad.items():
        others, theirs = good.get(b, (0, 0))
        rate = math.log((hits + 0.5) / (n_words + 1)) - math.log((theirs + 0.5) / (m_words + 1))
        g = _g2(hits, n_words, theirs, m_words)
        if docs / n > others / m and g >= G2 and rate >= RATIO:
            ranked.append((-round(g, 6), -len(b), b, min(rate, 8.0)))
    entries: dict[str, tuple[float, bool]] = {}
    for _, _, b, rate in sorted(ranked):
        if len(entries) < ENTRIES and not any(b.startswith(e) or e.startswith(b) for e in entries):
            entries[b] = (rate, False)

    def phrases(texts: DataFrame, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
        got = texts.mapInArrow(_tally_phrases(frozenset(entries), wanted), "b string, docs long").groupBy("b").agg(F.sum("docs").alias("docs"))
        return {r.b: r.docs for r in got.where(F.col("docs") >= least).collect()}  # bounded by the sample

    benign = phrases(clean, None, DOCUMENTS) if entries else {}
    used = phrases(toxic, frozenset(benign), 1) if benign else {}
    learned = sorted(f for f, k in benign.items() if k / m >= BENIGN * used.get(f, 0) / n)
    lexicon = Lexicon(entries, (*exceptions, *(f for f in learned if f not in exceptions)))
    points = []
    for r in rows.select("text", "toxic").mapInArrow(_densities(lexicon), "x double, toxic int").collect():  # at most `sample` pairs
        points.append((r.x, r.toxic != 0))
    x, y = np.log(FLOOR + np.array([p[0] for p in points])), np.array([p[1] for p in points], float)
    lexicon.intercept, lexicon.slope = _logistic_fit(x, y)
    return lexicon


def _densities(lexicon: Lexicon):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([density(a, t or "") for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["x", "toxic"])

    return run


def _logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of least penalised deviance, by Newton steps; the slope isn't negative."""
    mean, sd = x.mean(), x.std() or 1.0
    z = np.stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(2)
    ridge = np.diag([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + ridge + 1e-9 * np.eye(2), z @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(0.0, float(w[1] / sd))
    return float(w[0] - slope * mean), slope


def toxicity(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, density, score, predicted): the score lies in 0 to 1 and is higher for likelier toxic texts.

    Null and empty texts have density 0. Null and repeated ids stay rows of their own.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in it:
            x = np.array([density(a, t or "") for t in batch.column(1).to_pylist()], float)
            s = logistic(lexicon, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "density", "score", "predicted"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, density double, score double, predicted int")


def accepts(lexicon: Lexicon):
    """A column function: true for texts that aren't toxic by the lexicon."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = lexicon.automaton()
        for texts in it:
            yield pa.array(logistic(lexicon, np.array([density(a, t or "") for t in texts.to_pylist()], float)) < 0.5)

    return F.arrow_udf(run, "boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return toxicity(docs, lexicon).select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"), "score", "predicted")
