import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.llm import simhash, trie

KIND = "doc_id long, text string, a int, fp_0 string, component_id string"


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, budget):
    parent = {k: k for k in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (values[a] ^ values[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in values}


def near(rng, bits, n, flips):
    base = [rng.getrandbits(bits) for _ in range(n)]
    out = list(base)
    for v in base:
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(bits)
            out.append(v)
    return out


@given(st.integers(0, 10**9), st.sampled_from([(64, 4), (42, 4), (16, 3), (9, 2), (10, 0)]))
@settings(max_examples=40, deadline=None)
def test_trie_finds_every_link(seed, shape):
    bits, budget = shape
    values = near(random.Random(seed), bits, 25, 6)
    v, ids = np.array(values, np.uint64), np.arange(len(values))
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, turned in enumerate(trie.rotations(v, bits, budget)):
        widths = trie.rotated_widths(bits, budget, r)
        for a, b in zip(*trie.links((turned >> np.uint64(bits - widths[0])).astype(np.int64), turned, ids, bits, widths)):
            assert (values[a] ^ values[b]).bit_count() <= budget
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {k: find(k) for k in range(len(values))} == groups(dict(enumerate(values)), budget)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    edited = []
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "Changed"
        edited.append(" ".join(w))
    return [*base, *edited, base[0], base[0].upper(), "", None, " \t", "a", "A", "é ÉÉ", "x " * 30000]


def test_groups_by_brute_force(spark, texts, monkeypatch):
    want = groups({k: fingerprint(t) for k, t in enumerate(texts)}, 4)
    df = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in enumerate(texts)], KIND)
    for hot in (1 << 17, 3):  # the second splits subtrees
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.exact_groups(df).collect()}
        assert got == {k: (f"{fingerprint(t):016x}", want[k]) for k, t in enumerate(texts)}


def test_dense_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    values = near(random.Random(1), 64, 3, 6) + near(random.Random(2), 64, 20, 1)
    values += [values[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    want = groups(dict(enumerate(values)), 4)
    df = spark.createDataFrame([(k, 0, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "id long, part int, value long")
    edges = [(r.a, r.b) for r in simhash.trie_links(df, 64, 4).collect()]
    assert len(edges) < 8 * len(values)  # a forest for each rotation and task, not all pairs
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {k: find(k) for k in range(len(values))} == want


def test_odd_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert simhash.exact_groups(empty).count() == 0 and simhash.near_deduplicated(empty).columns == empty.columns
    rows = [(None, "x y z", 1, "", ""), (3, "x y z", 1, "", ""), (3, "x y z", 2, "", ""), (5, None, 1, "", ""), (7, "", 1, "", "")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.exact_groups(spark.createDataFrame(rows, KIND)).collect())
    assert got == [(3, 3), (3, 3), (5, 5), (7, 5)]
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, KIND)).collect()
    # one row of each group stays, repeated rows too; rows without an id stay
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 5), (True, 0)]


def test_near_duplicates(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for k in range(60):
        w = rng.choices(words, k=rng.randint(120, 400))
        rows.append((2 * k, " ".join(w), 1, "", ""))
        if k % 2:
            w[rng.randrange(len(w))] = "changed"
            rows.append((2 * k + 1, " ".join(w), 1, "", ""))
            pairs.append(2 * k + 1)
    kept = {r.doc_id for r in simhash.near_deduplicated(spark.createDataFrame(rows, KIND)).collect()}
    assert kept == {r[0] for r in rows} - set(pairs)


def test_near_duplicates_are_verified(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = own(10)
    rows = [(k, " ".join([line] * 20 + [own(n)])) for k, n in enumerate([300, 300, 450, 450])]  # repeated line, else different
    for k in range(10, 70):  # sets of 5 to 64 shingles, with one more
        t = own(k - 1)
        rows += [(2 * k, t), (2 * k + 1, t + " more")]
    base = [f"b{i}" for i in range(200)]
    for k in range(200, 230):  # a family of similarities below and above the limit
        w = list(base)
        for i in rng.sample(range(200), rng.randint(1, 6)):
            w[i] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {k: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in range(4)} == {k: k for k in range(4)}
    assert {k: v for k, v in got.items() if 4 <= k < 200} == {k: find(k) for k in sets if 4 <= k < 200}
    assert all(find(got[k]) == find(k) for k in sets)  # no link that isn't one


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_forests_span_labels(seed):
    """With labels the edges join all labels that links join, and none within a label."""
    rng = np.random.default_rng(seed)
    bits, budget, n = 12, 2, 40
    value, label = rng.integers(0, 1 << bits, n).astype(np.uint64), rng.integers(0, 25, n)
    root = list(range(25))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if int(value[i] ^ value[j]).bit_count() <= budget:
                root[find(label[i])] = find(label[j])
    want = [find(x) for x in range(25)]
    root = list(range(25))
    for r, turned in enumerate(trie.rotations(value, bits, budget)):
        widths = trie.rotated_widths(bits, budget, r)
        for a, b in zip(*trie.links((turned >> np.uint64(bits - widths[0])).astype(np.int64), turned, np.arange(n), bits, widths, label), strict=True):
            assert label[a] != label[b]
            root[find(label[a])] = find(label[b])
    got = [find(x) for x in range(25)]
    assert {frozenset(k for k in range(25) if want[k] == w) for w in want} == {frozenset(k for k in range(25) if got[k] == w) for w in got}


def test_edges_of_dense_groups_are_few(spark):
    """A group of n near copies meets in at most lanes x rotations x n pairs, not in all."""
    rng = random.Random(5)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(150):
        own = list(text)
        for at in rng.sample(range(300), 9):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    own = simhash.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    parts = own.select(F.col("doc_id").alias("id"), F.posexplode(F.array(*(f"fp_{i}" for i in range(simhash.LANES)))).alias("part", "value"))
    assert simhash.trie_links(parts, simhash.LANE_BITS, simhash.LANE_BUDGET).count() <= simhash.LANES * 5 * 150


def _groups(links, nodes):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        of[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize(("group", "levels"), [(2000, 4), (3, 4), (3, 1), (1, 9)])
def test_short_pairs_are_all_similar_pairs(spark, group, levels):
    rng = random.Random(3)
    texts = ["", "a", "a b c d e", "a b c d e f", "x y"]
    for size in (8, 14, 30, 60, 80):
        template = [f"w{rng.randrange(30)}" for _ in range(size)]
        for _ in range(45):
            own = list(template)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(size)] = rng.choice("pqrs")
            texts.append(" ".join(own[: size - rng.randrange(3)]))
    texts = sorted(set(texts))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    want = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    own = {min(i for i, x in enumerate(sets) if x == y) for y in sets}  # a node is a set
    df = spark.createDataFrame([(i, texts[i]) for i in sorted(own)], "node long, text string").repartition(3)
    got = [(r.a, r.b) for r in simhash.short_pairs(df, 5, 0.8, group, levels).collect()]
    want = [(i, j) for i, j in want if i in own and j in own]
    assert len(want) > 80 and {(min(x), max(x)) for x in got} <= set(want)
    assert _groups(got, own) == _groups(want, own)


def test_templates_that_differ_too_much_do_not_meet(spark, monkeypatch):
    """One line of boilerplate with a word of its own in each: no pair is similar, so no sets are compared."""
    template, rows = [f"t{k}" for k in range(41)], []
    for i in range(1500):
        own = list(template)
        own[20] = f"own{i}"
        rows.append((i, " ".join(own)))
    met = []
    cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: met.append((name, cut(df, name))) or met[-1][1])
    assert simhash.short_pairs(spark.createDataFrame(rows, "node long, text string"), 5, 0.8).isEmpty()
    assert [name for name, _ in met if name.startswith("short-keys")] == ["short-keys"]  # nothing had to be split
