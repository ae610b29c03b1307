"""Merkle manifest, line dedup and filter audit against one-by-one versions."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from placeloom.llm import filters, lines, merkle
from placeloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, pos int, gone string"


def make(spark, rows):
    """(doc_id, text, lang, source) as documents, with columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", 7, "z") for i, t, lang, s in rows], KIND)


def odd(rng, n, sources=("a", "b", None, "", "é")):
    texts = [None, "", "\n", "\n\n", "Same Line of Words\nanother one here\n", "  same line of words\t\nx", "ÀÉ same Line öf words\nshort", "x" * 200_000, "A B C D E F " * 20, "one two # three"]
    texts += [" ".join(rng.choices(["alpha", "Beta", "gamma", "DELTA"], k=rng.randint(1, 150))) for _ in range(10)]
    rows = [(rng.choice([None, *range(n // 2)]), rng.choice(texts), rng.choice(["en", None, "", "de"]), rng.choice(sources)) for _ in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("name", ["op11_merkle", "op12_lines", "op13_filters"])
def test_same_as_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    want = relation.select(*columns).fetchall()
    assert want and sorted(map(str, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(str, want))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, siblings of each node with its place): level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            run = level[at[k] // 16 * 16 : at[k] // 16 * 16 + 16]
            path.append((run[: at[k] % 16], run[at[k] % 16 + 1 :]))
            at[k] //= 16
        level = [sha(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0], paths


def merkle_one_by_one(rows):
    def leaf(i, text, lang, source):
        fields = (i, source, lang, None if text is None else len(text), text)
        return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    low = lambda t: t and re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    groups = {}
    for i, text, lang, source in rows:
        own, changed = leaf(i, text, lang, source), None
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            fields = (i, source, lang, None if text is None else len(text), low(text))
            changed = sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
        groups.setdefault(source, []).append(((i is not None, i or 0), own, changed or own, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, heads = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, heads, strict=True):
        for (_, own, altered, i), path in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            node = altered
            for left, right in path + above:
                node = sha(*left, node, *right)
            out.append((i, own, trees[s][0], root, sha(*(x for a, b in path + above for x in a + b)), node, node == root))
    return out


@pytest.mark.parametrize(("n", "sources"), [(1, ("a",)), (40, ("a", "b", None, "", "é", "Z")), (300, ("hot",)), (4500, ("hot",) * 30 + ("b", None))])
def test_merkle(spark, n, sources):
    """Lone leaves, runs of one, three rounds of blocks, null and empty sources, repeated ids and rows, a hot source."""
    rows = odd(random.Random(n), n, sources)[: n if n == 1 else None]
    rows = [r if len(r[1] or "") < 1000 or k < 3 else (r[0], "y", *r[2:]) for k, r in enumerate(rows)]
    got = [tuple(r) for r in merkle.audited(make(spark, rows).repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(merkle_one_by_one(rows), key=str)


def test_merkle_sources_and_empty(spark):
    """More sources than a block has places; no rows at all; the summary of groups."""
    rows = [(k, f"T{k}", "en", f"s{k % 300}") for k in range(700)]
    got = [tuple(r) for r in merkle.audited(make(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(merkle_one_by_one(rows), key=str)
    assert merkle.audited(make(spark, [])).count() == 0 and merkle.manifest(make(spark, [])).count() == 0
    found = {r["group"]: r for r in merkle.manifest(make(spark, rows)).collect()}
    assert len(found) == 300 and found["s1"]["rows"] == 3 and len({r["root"] for r in found.values()}) == 1


def test_merkle_finds_every_change(spark):
    """A change of any field of any row changes the root; other columns and the order of rows don't."""
    rows = [(k, f"text {k}", "en", f"s{k % 3}") for k in range(40)]
    root = lambda r: merkle.manifest(make(spark, r)).first()["root"]
    own = root(rows)
    assert root(rows[::-1]) == own
    assert len({own, *(root([*rows[:7], change, *rows[8:]]) for change in ((7, "text 7 ", "en", "s1"), (7, "text 7", None, "s1"), (7, "text 7", "en", "s2")))}) == 4


def lines_one_by_one(rows, least=10, documents=2):
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t.strip(" \t\n\x0b\x0c\r"))
    last = float("inf")
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= least:
                held.setdefault(low(x), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(low(x)) < least or len(held[low(x)]) < documents or min(held[low(x)]) == (last if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("seed", "least", "documents"), [(1, 10, 2), (2, 10, 2), (3, 1, 3)])
def test_lines(spark, seed, least, documents):
    """Nulls in every column, empty and very long texts, white space of all kinds, repeated ids and rows, a hot line."""
    rng = random.Random(seed)
    some = ["Common line of all", " common LINE of all\r", "", "short", "exactly10c", "nine char", "ÄÖ line with Umlauts", "äö line with umlauts", " nbsp kept at ends ", "nbsp kept at ends", "😀😀😀😀😀😀😀😀😀😀", "😀" * 9]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "\n".join(rng.choices(some, k=rng.randint(0, 30)))])) for _ in range(120)]
    rows += rows[:9] + [(99, "\n".join(["Common line of all", "own line number one"] * 20000)), (98, "z" * 300_000), (97, "\n" * 5000)]
    got = lines.deduplicated(make(spark, [(i, t, "en", "s") for i, t in rows]), least_length=least, least_documents=documents)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == sorted(lines_one_by_one(rows, least, documents), key=str)


def test_lines_native(spark):
    """No Python in any plan of the query, and an empty table."""
    df = QUERIES["op12_lines"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert lines.deduplicated(make(spark, [])).count() == 0


def filters_one_by_one(rows, labels):
    first, good, toxic = {}, {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or x == 1
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^ \t-\r]+", t)
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), t in first and (i is None or i > first[t])), strict=True) if x}
        parts.setdefault(lang or "", []).append((fails, good.get(i, False), toxic.get(i, False)))
    out = []
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                share = sum(Fraction(120, len(d[0])) for d in docs if f in d[0])
                out.append((part, "".join(order), step, len(left), len(lost), sum(f in d[0] for d in docs) - len(lost), sum(d[0] == {f} for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost), int(share)))
    return out


def test_filters(spark):
    """Null ids, texts, parts and labels, repeated ids, rows and labels, very long texts, no copies of null ids only."""
    rng = random.Random(5)
    rows = [(i, t, lang) for i, t, lang, _ in odd(rng, 150)] + [(None, "only null ids have this", "en"), (None, "only null ids have this", "en"), (7, "twice one id", "de"), (7, "twice one id", "de")]
    rows += [(1000 + k, " ".join(f"w{k}x{j}" for j in range(100 + k)) + (" #" if k % 3 == 0 else ""), "fr") for k in range(20)]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = filters.audited(make(spark, [(*r, "s") for r in rows]), told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(filters_one_by_one(rows, labels))
    assert filters.audited(make(spark, []), told).count() == 0
    unlabelled = filters.audited(make(spark, [(*r, "s") for r in rows]), told.limit(0)).collect()
    assert len(unlabelled) == 600 * len({r[2] or "" for r in rows}) and not any(r["good_lost"] or r["toxic_lost"] for r in unlabelled)


def test_polynomial_corners_are_unions(spark):
    """Corner values are the documents that any of the set's filters removes; integrals are counts over the mask's size."""
    rng = random.Random(3)
    counts = {m: rng.randint(0, 50) for m in range(32)}
    masks = ", ".join(f"named_struct('mask', {m}, 'n', {n}L)" for m, n in counts.items())
    row = spark.sql(f"SELECT array({masks}) AS masks").selectExpr(f"{filters.polynomial('n')} AS terms").selectExpr(f"{filters.corners('terms')} AS at", f"{filters.integrals('terms')} AS whole").first()
    assert row["at"] == [sum(n for m, n in counts.items() if m & s) for s in range(32)]
    assert [Fraction(x, 60) for x in row["whole"]] == [sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1) for i in range(5)]
