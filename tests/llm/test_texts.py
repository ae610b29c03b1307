"""Substring removal, language model, toxicity."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.llm import exchange, lm, substring, toxicity
from placeloom.llm.words import Words

KIND = "doc_id long, text string, shard int, n_chars long, kept string"


def make(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 9, len(t or ""), "x") for i, t in zip(ids or range(len(texts)), texts)], KIND)


def brute(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@given(st.lists(st.none() | st.text(st.sampled_from("ab \t\n\x0b\x0c\ré\xa0\x1c") , max_size=30).map(str.encode), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    w, split = Words(texts), [(t or b"").split() for t in texts]
    flat = [x for s in split for x in s]
    assert w.sizes.tolist() == [len(s) for s in split] and [w.slice(k, k + 1) for k in range(len(w))] == flat
    assert w.slice(0, len(w)) == b" ".join(flat)
    seen = {}
    for word, h in zip(flat, w.hashes().tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words():
    """Hashes of words don't depend on their place, nor on how the buffer is cut."""
    rng = random.Random(1)
    some = [bytes(rng.choices(b"abcdefgh", k=n)) for n in (1, 2, 255, 256, 257, 3000, 1 << 20, (1 << 20) + 1)] + [b"x%d" % k for k in range(300000)]
    once = dict(zip(some, Words([b" ".join(some)]).hashes().tolist(), strict=True))
    rng.shuffle(some)
    assert once == dict(zip(some, Words([b"\t".join(some[:99]), b" ".join(some[99:])]).hashes().tolist(), strict=True)) and len(set(once.values())) == len(once)


def passages(rng):
    own = [" ".join(f"p{k}x{i}" for i in range(n)) for k, n in enumerate((12, 13, 14, 40, 200))]
    texts = []
    for _ in range(120):
        parts = [" ".join(rng.choices(["a", "b", "ü", "the\xa0x"], k=rng.randint(0, 30))) for _ in range(3)] + rng.choices(own, k=rng.randint(0, 3))
        rng.shuffle(parts)
        texts.append("\n\t".join(parts))
    return texts + [texts[3], texts[3] + " tail", "a " * 500, "a " * 700, "", None, "b a " * 3000]


@pytest.mark.parametrize(("size", "fan", "spread"), [(8 << 20, 256, 4), (3000, 256, 1), (1500, 3, 2)])
def test_substrings_by_brute_force(spark, monkeypatch, size, fan, spread):
    """One shard; some, each asked by one other; many, over three levels of exchange and more."""
    monkeypatch.setattr(exchange, "SHARD_BYTES", size)
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(substring, "SPREAD", spread)
    rng = random.Random(4)
    texts = passages(rng)
    ids = rng.sample(range(1000), len(texts))
    rows = substring.factored(make(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute(list(zip(ids, texts)))
    words = {i: (t or "").encode().split() for i, t in zip(ids, texts)}
    for r in rows:
        for f in r.factors:
            assert f.source < r.doc_id and f.length >= 13
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source][f.source_start : f.source_start + f.length]
        covered = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert covered == {k for x in r.spans for k in range(x.start, x.start + x.length)} and len(covered) == r.n_removed


def test_factors_are_as_long_as_they_can_be(spark):
    p, q = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(30)]
    df = make(spark, [" ".join(["x"] + p), " ".join(q), " ".join(p[5:] + q + ["end"])], [1, 2, 3])
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring.factored(df).collect()}
    assert got == {1: [], 2: [], 3: [(0, 35, 1, 6), (35, 30, 2, 0)]}


def test_no_shard_is_asked_by_many():
    """Of 50 shards with one window each gets a smaller document, and none is named more than SPREAD times."""
    net = exchange.Exchange(50, 1, exchange.least, kinds="ii", keyed=True, spread=4)
    key = np.array([7 << 40, 9 << 50], np.uint64)
    t = pa.concat_tables([net.send(k, key, [np.array([(k * 7) % 50, 3], np.int64), np.full(2, k)]) for k in range(50)])
    named = collections.Counter()
    keys, values = net._received(t)
    answers = net._answers(t, keys, values, *net._reduced(keys, values))
    got = {s: net.gathered(answers.filter(pa.array([x == s for x in answers.column("shard").to_pylist()])), key) for s in answers.column("shard").to_pylist()}
    assert len(got) == 49  # the smallest has none; the documents of one id have nothing from each other
    for s, (k, (doc, shard)) in got.items():
        assert k.tolist() == [7 << 40] and doc[0] < (s * 7) % 50 and doc[0] == (shard[0] * 7) % 50
        named[int(shard[0])] += 1
    assert max(named.values()) <= 4 + 1


@pytest.mark.parametrize("fan", [4, 256])
def test_rows_of_an_exchange_are_linear(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 400)
    monkeypatch.setattr(exchange, "FAN", fan)
    rng = random.Random(5)
    sizes, sent = (40, 160), []
    for n in sizes:
        texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(n)]
        shards = exchange.sharded(make(spark, texts).repartition(4), "doc_id", "text")
        net = exchange.Exchange(shards.n, shards.ranges, exchange.added)

        def send(key, t):
            words = [w for x in exchange.unpacked_docs(t.column("docs")[0].as_py()).column("text").to_pylist() for w in x.split()]
            keys = np.array([exchange.hash_of(w) for w in words], np.uint64)
            return net.send(key[0].as_py(), *exchange.added(keys, [np.ones(len(keys), np.int64)]))

        def back(key, left, right):
            words = [w for x in exchange.unpacked_docs(left.column("docs")[0].as_py()).column("text").to_pylist() for w in x.split()]
            h = {w: exchange.hash_of(w) for w in words}
            keys, (totals,) = net.gathered(right, np.unique(np.array(list(h.values()), np.uint64)))
            assert keys.tolist() == sorted({h[w] for w in words})
            count = dict(zip(keys.tolist(), totals.tolist(), strict=True))
            return pa.table({"w": [w.decode() for w in dict.fromkeys(words)], "n": [count[h[w]] for w in dict.fromkeys(words)]})

        rows = shards.rows.groupBy("shard").applyInArrow(send, exchange.Exchange.SENT_SQL)
        sent.append((rows.count(), shards.n))
        got = {tuple(r) for r in shards.rows.groupBy("shard").cogroup(net.run(rows).groupBy("shard")).applyInArrow(back, "w string, n long").collect()}
        assert got == set(collections.Counter(w for t in texts for w in t.split()).items())
    assert all(r <= n * fan for r, n in sent)
    if fan == 4:  # four times the input, four times the rows, not sixteen
        assert net.levels >= 3 and sent[1][0] <= 5 * sent[0][0]


def test_spans_and_cleaning(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = make(spark, [p + " own words", "before " + p + " after", None, p], [1, 2, None, 3])
    spans = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in substring.factored(df).collect()}
    assert spans == {1: [], 2: [(1, 20)], None: [], 3: [(0, 20)]}
    rows = {r.doc_id: (r.text, r.n_chars, r.kept) for r in substring.cleaned(df).collect()}
    assert rows[2] == ("before after", 12, "x") and rows[1] == (p + " own words", len(p) + 10, "x") and rows[3] == ("", 0, "x") and rows[None] == (None, 0, "x")
    assert substring.factored(make(spark, [])).count() == 0
    same = make(spark, [p, p], [5, 5])  # one id: nothing is earlier
    assert [r.n_removed for r in substring.factored(same).collect()] == [0, 0]
    other = make(spark, [p, p + " x", "y", "", None], [5, 8, 8, 8, 8])  # rows of one id keep their own texts
    assert sorted((r.doc_id, r.text or "") for r in substring.cleaned(other).collect()) == [(5, p), (8, ""), (8, ""), (8, "x"), (8, "y")]
    clash = spark.createDataFrame([(1, p, "a", 2, "b"), (2, p, "c", 3, "d")], "doc_id long, text string, __kept string, __id int, kept string")
    assert sorted(tuple(r) for r in substring.cleaned(clash).collect()) == [(1, p, "a", 2, "b"), (2, "", "c", 3, "d")]
    null = make(spark, [p, p], [None, 5])
    assert sorted((r.doc_id is None, r.n_removed) for r in substring.factored(null).collect()) == [(False, 0), (True, 20)]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\0end"]


def counted_by_hand(texts, ids, order):
    """Counters of n-grams, contexts first, of the training documents."""
    grams = [collections.Counter() for _ in range(order)]
    documents = 0
    for i, text in zip(ids, texts):
        if zlib.crc32(str(i).encode()) % 7 == 2:
            continue
        documents += 1
        t = ["\0start"] * (order - 1) + tokens(text)
        for k in range(order - 1, len(t)):
            for n in range(1, order + 1):
                grams[n - 1][tuple(t[k - n + 1 : k + 1])] += 1
    return grams, documents


def test_language_model(spark, monkeypatch):
    """Counts, weights and scores by loops over tokens; the corpus is in many shards."""
    monkeypatch.setattr(exchange, "SHARD_BYTES", 3000)
    monkeypatch.setattr(exchange, "FAN", 3)
    order = 3
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "cat", "Sat", "on", "mat", "a", "é"], weights=[9, 5, 4, 4, 3, 8, 1], k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "new " * 2000, "the cat sat"]
    rows = {r.doc_id: r for r in lm.scored(make(spark, texts)).collect()}
    grams, documents = counted_by_hand(texts, range(len(texts)), order)
    total, types = sum(grams[0].values()), len(grams[0])

    def estimate(t, k, n, deleted):
        """Estimate of the n-gram that ends at a token and the bucket of its context's count, without ``deleted`` occurrences."""
        gram = tuple(t[k - n + 1 : k + 1])
        context = total if n == 1 else documents if all(w == "\0start" for w in gram[:-1]) else grams[n - 2][gram[:-1]]
        context = max(0, context - deleted)
        return (max(0, grams[n - 1][gram] - deleted) / context if context else 0.0), math.ceil(math.log2(context + 1))

    def mixed(t, k, weights, deleted):
        p = 1 / (types + 1)
        for n, weight in enumerate(weights, 1):
            own, bucket = estimate(t, k, n, deleted)
            p = weight[bucket] * own + (1 - weight[bucket]) * p
        return p

    bin_of = lambda p: lm.FLOOR if p <= 0 else min(lm.FLOOR, round(-lm.QUARTER * math.log2(p)))
    weights = []
    for n in range(1, order + 1):
        cells = collections.Counter()
        for i, text in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 7 != 2:
                t = ["\0start"] * (order - 1) + tokens(text)
                for k in range(order - 1, len(t)):
                    own, bucket = estimate(t, k, n, 1)
                    cells[bucket, bin_of(own), bin_of(mixed(t, k, weights, 1))] += 1
        back = lambda b: 0.0 if b == lm.FLOOR else 2.0 ** (-b / lm.QUARTER)
        bucket, own, low = (np.array(x) for x in zip(*cells, strict=True))
        weights.append(lm.em(bucket, np.array([back(b) for b in own]), np.array([2.0 ** (-b / lm.QUARTER) for b in low]), np.array(list(cells.values()), float)))
    for i, text in enumerate(texts):
        r, own = rows[i], tokens(text)
        t = ["\0start"] * (order - 1) + own
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(own) and r.train_tokens == total and r.n_known == sum(grams[0][(x,)] > 0 for x in own)
        assert r.base_score == pytest.approx(sum(math.log10((grams[0][(x,)] + 1) / (total + types + 1)) for x in own), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(mixed(t, k, weights, 0)) for k in range(order - 1, len(t))), rel=1e-6)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the probabilities of all words and of one unknown word after a context sum to one
    words = [w for (w,) in grams[0]] + ["never seen"]
    for before in (["\0start", "\0start"], ["\0start", "the"], ["the", "cat"], ["nothing", "known"], ["cat", "nothing"]):
        assert sum(mixed([*before, w], 2, weights, 0) for w in words) == pytest.approx(1.0, abs=1e-9)


def test_counts_are_wide():
    """Totals beyond 32 bits stay whole on their way."""
    net = exchange.Exchange(1, 1, exchange.added)
    keys = np.array([5 << 40, 9 << 50], np.uint64)
    t = net.send(0, keys, [np.array([1 << 40, 3], np.int64)])
    got, (values,) = net._reduced(*net._received(pa.concat_tables([t, t])))
    assert got.tolist() == keys.tolist() and values.tolist() == [2 << 40, 6]
    docs, counts = lm.packed(np.array([2]), [7], np.array([False]), [values, values])
    assert [x.tolist() for x in lm.unpacked(docs, counts)[2]] == [[2 << 40, 6]] * 2


def test_em_finds_the_weight():
    import numpy as np

    own, lower = np.array([0.5, 0.0]), np.array([0.1, 0.1])
    lam = lm.em(np.array([3, 3]), own, lower, np.array([60.0, 40.0]))
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax(60 * np.log(grid * 0.5 + (1 - grid) * 0.1) + 40 * np.log((1 - grid) * 0.1))]
    assert lam[3] == pytest.approx(best, abs=2e-3) and lam[0] == 0 and lam[10] == lam[3]


def test_small_corpora(spark):
    texts = ["a b", "b a a", "a"]
    df = make(spark, texts, [0, 1, 3])
    assert lm.scored(make(spark, [])).count() == 0
    only_held = make(spark, ["a b"], [next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)])
    r = lm.scored(only_held).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0.0)  # one unknown word has all the probability
    assert lm.scored(df).count() == 3 and lm.scored(make(spark, ["x", "x"], [None, None])).count() == 2


def labelled(spark, n=1500):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        words = rng.choices([f"word{i}" for i in range(300)], k=rng.randint(8, 120))
        bad = k % 6 == 0
        if bad:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "Horrid,", "brutXing"])
        rows.append((k, " ".join(words), 0, 0, ""))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(docs, labels)
    assert {"nasty", "vile", "horrid"} <= set(lexicon.entries) and len(lexicon.entries) < 12
    rows = toxicity.toxicity(docs, lexicon).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = make(spark, ["you are n4sty and v1le indeed", "nаsty vіle", "ｎａｓｔｙ vi​le", "dynasty servile words here", "", None, "nasty " * 50000, "fine words " * 20])
    got = [r.predicted for r in toxicity.toxicity(odd, lexicon).orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 0, 0, 0, 1, 0]
    assert toxicity.toxicity(make(spark, []), lexicon).count() == 0
    assert sorted(r.doc_id for r in odd.where(toxicity.accepts(lexicon)(F.col("text"))).collect()) == [3, 4, 5, 7]


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = labelled(spark, 600)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, changed)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.entries == {} and toxicity.toxicity(docs, none).where("score > 0.01").count() == 0


def test_exceptions():
    lexicon = toxicity.Lexicon({"trash": (5.0, False), "clown": (5.0, True)}, ("trash can", "clown fish"), -1.0, 1.0)
    a = lexicon.automaton()
    hits = lambda t: round(toxicity.density(a, t) * (len(t.split()) + toxicity.PRIOR) / 5)
    assert [hits(t) for t in ("trash", "trash can", "a trash can of trash", "clown fish", "clowns", "Clown!", "trashy", "xtrash", "")] == [1, 0, 1, 0, 0, 1, 1, 0, 0]


def test_digests(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_exceptions_are_learned(spark):
    words = [f"{a}{b}" for a in ("mo", "ka", "ri", "te") for b in ("lan", "dor", "vis", "pel")]
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        w = rng.choices(words, k=40)
        if k % 4 == 0:
            w[::8] = ["grubb"] * 5
        elif k % 4 == 1 and k % 8 == 1:
            w[7] = "grubbworth"
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grubbworth" in lexicon.exceptions and "grubb" not in lexicon.exceptions
    a = lexicon.automaton()
    assert toxicity.density(a, "molan grubbworth kador") == 0.0 and toxicity.density(a, "molan grubb kador") > 0.0
