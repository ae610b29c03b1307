"""TIFF, packing, tokens, top-k, WARC, BPE."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeloom.llm import bpe, exchange, packing, tiff, token_counts, topk, warc

KIND = "doc_id long, text string, media string, n_tokens string, ids string"
ODD = ["", None, "a", "é" * 40, "x" * 64, "word " * 60000, "tab\tand\nline", "<|endoftext|> and </s><s>", "  two  spaces ", "▁under", "🙂🏳️‍🌈", "͸\U0003d000 rare", "a" * 5000, "don't WE'LL 123 ...", "\x00", "ß İ ſ"]


def make(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "m", "n", "i") for i, t in zip(ids or range(len(texts)), texts)], KIND)


# TIFF


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_compressions(compression, data):
    assert tiff.DECODERS[compression](tiff.ENCODERS[compression](data), len(data)) == data


def test_long_lzw():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 60000, np.uint8).tobytes(), b"ab" * 40000, bytes(70000), rng.integers(0, 3, 50000, np.uint8).tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # the example of the format's description: codes 256 7 258 8 8 7 6 6 257 by hand
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw_decode(stream, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@pytest.mark.parametrize("tile", [0, 16, 64])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages(compression, tile, predictor, order):
    payload = np.random.default_rng(2).integers(97, 110, 64 * 150, np.uint8).tobytes()
    data = tiff.encode(payload, compression, predictor, tile, page=100, strip=30, order=order)
    read = list(tiff.pages(data))
    assert [(p, w, h) for p, w, h, _ in read] == [(0, 64, 100), (1, 64, 50)]
    assert b"".join(s.tobytes() for *_, s in read) == payload


def test_other_samples():
    rows = np.arange(2 * 5 * 3, dtype=">u2").reshape(2, 5, 3)
    strip = tiff.difference(rows).astype(">u2").tobytes()
    tags = [(256, 3, 1, 5), (257, 3, 1, 2), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 1, len(strip)), (317, 3, 1, 2)]
    bits_at = 8 + len(strip)
    entries = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags if t < 258) + struct.pack(">HHII", 258, 3, 3, bits_at) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags if t > 258)
    data = b"MM" + struct.pack(">HI", 42, bits_at + 6) + strip + struct.pack(">HHH", 16, 16, 16) + struct.pack(">H", 9) + entries + b"\0\0\0\0"
    (page,) = tiff.pages(data)
    assert page[1:3] == (5, 2) and (page[3] == rows).all()


def test_broken_tiffs(spark):
    good = tiff.encode(b"a" * 64 * 5, page=2)
    cases = [good, good[:50], b"", None, b"II*\0\xff\xff\0\0", good[:4] + struct.pack("<I", 4) + good[8:]]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c), 1) for k, c in enumerate(cases)], "doc_id long, media binary, page int")
    rows = tiff.tiff_pages(df).collect()
    assert [(r.page, r.height) for r in rows if r.doc_id == 0] == [(0, 2), (1, 2), (2, 1)]
    assert {r.doc_id for r in rows if r.error} == {1, 2, 4, 5} and not [r for r in rows if r.doc_id == 3]
    assert tiff.tiff_pages(df.where("false")).count() == 0


def mutants():
    """TIFFs of all kinds with bytes changed, inserted, dropped or cut off."""
    kinds = [tiff.encode(bytes(range(256)) * 4 + b"a" * 256, c, p, tile, page=9, order=o) for c in tiff.ENCODERS for p in (1, 2) for tile in (0, 16) for o in "<>"]
    edits = st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from(["set", "drop", "double", "cut"]), st.integers(0, 255)), min_size=1, max_size=6)

    def edited(base, changes):
        data = bytearray(base)
        for at, how, value in changes:
            at %= max(1, len(data))
            if how == "set" and data:
                data[at] = value
            elif how == "drop":
                del data[at : at + value % 5]
            elif how == "double":
                data[at:at] = data[at : at + value]
            elif how == "cut":
                del data[max(8, at) :]
        return bytes(data)

    return st.builds(edited, st.sampled_from(kinds), edits)


@given(mutants())
@settings(max_examples=600, deadline=None)
def test_malformed_media_give_error_rows(data):
    """Rows come, or rows and one error; never an exception, never more samples than the bytes can hold."""
    rows = list(tiff.page_rows(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([data, None], pa.binary())], names=["a", "b", "c"])])))
    assert all(r["doc_id"] == 1 and (r["error"] is None) != (r["page"] is None) for r in rows)
    assert not [r for r in rows[:-1] if r["error"]]
    assert sum(len(r["samples"] or b"") for r in rows) <= 4096 * (len(data) + 64) * max(1, len(rows))


def test_media_that_crashed_readers():
    def entry(tag, kind, n, value):
        return struct.pack("<HHII", tag, kind, n, value)

    def image(entries, body=b""):
        return b"II" + struct.pack("<HIH", 42, 8, len(entries)) + b"".join(entries) + b"\0\0\0\0" + body

    base = {256: (3, 1, 64), 257: (3, 1, 4), 258: (3, 1, 8), 259: (3, 1, 5), 273: (4, 1, 200), 278: (3, 1, 4), 279: (4, 1, 20)}
    cases = {
        "lzw": (base, struct.pack(">H", 300 << 7) + b"\xff" * 30),
        "count 0": (base | {256: (3, 0, 64)}, b""),
        "huge": (base | {256: (4, 1, 1 << 31), 257: (4, 1, 1 << 31), 259: (3, 1, 8), 278: (4, 1, 1 << 31)}, b"x" * 300),
        "text": (base | {256: (2, 1, 64)}, b"x" * 300),
        "no channels": (base | {277: (3, 1, 0)}, b"x" * 300),
    }
    for name, (tags, body) in cases.items():
        data = image([entry(t, *v) for t, v in sorted(tags.items())])
        data = data.ljust(200, b"\0") + body
        (row,) = tiff.page_rows(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([data], pa.binary())], names=["a", "b", "c"])]))
        assert row["error"] and row["page"] is None, name


@pytest.mark.parametrize(("tile", "page", "compression"), [(0, 4096, tiff.DEFLATE), (16, 16, tiff.LZW), (64, 1024, tiff.PACKBITS)])
def test_stored_texts(spark, tile, page, compression):
    kept = {r.doc_id: r for r in tiff.stored(make(spark, ODD), tile=tile, page=page, compression=compression).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        back = b"".join(s.tobytes() for *_, s in tiff.pages(bytes(kept[k].media)))
        assert back == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0") and kept[k].n_bytes == len(raw)
    assert kept[0].media == kept[1].media
    assert tiff.stored(make(spark, [])).count() == 0 and tiff.stored(make(spark, ["a", "a", None], [None, None, 4])).count() == 3


def test_op2(spark, tmp_path):
    make(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in tiff.op2_tiff(spark, str(tmp_path)).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[0][3:] == rows[1][3:]


# packing


def check_packing(rows, encode):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(ODD):
        ids = [*encode(t or ""), 0]
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and list(struct.unpack(f"<{r.length}I", r.ids)) == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    return by_seq


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    for size in (packing.ROUND, 3000):
        monkeypatch.setattr(packing, "ROUND", size)
        rows = packing.packed(make(spark, ODD).repartition(2)).collect()
        by_seq = check_packing(rows, encode)
        used = sum(r.length for r in rows)
        assert sum(packing.padded(sum(r.length for r in s)) for s in by_seq.values()) < 1.05 * used
    assert packing.packed(make(spark, [])).count() == 0
    assert packing.packed(make(spark, ["a", "a"], [None, None])).count() == 2


def test_few_short_sequences(spark):
    """Sequences of fewer than half the ids are rare, padding stays small, most documents aren't cut where they needn't be."""
    rows = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "length", "doc_tokens", "sequence_id").collect()
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    used = sum(size.values())
    assert sum(n < 512 for n in size.values()) <= 0.05 * len(size)
    assert sum(packing.padded(n) for n in size.values()) < 1.03 * used and len(size) < 1.1 * used / 1024


@given(st.lists(st.integers(1, 12), min_size=1, max_size=40), st.integers(0, 10**6), st.sampled_from([0, 3, 20]))
@settings(max_examples=120, deadline=None)
def test_cuts_are_optimal(steps, seed, each):
    rng = random.Random(seed)
    points = [0, *np.cumsum(steps).tolist()]
    penalty = [rng.choice([0, 1, 5]) for _ in points]
    window = 16
    cost = lambda chosen: sum((0 if (n := b - a) & (n - 1) == 0 else window - n) for a, b in zip(chosen, chosen[1:])) + sum(each + penalty[points.index(b)] for b in chosen[1:])
    best = [0] + [10**9] * (len(points) - 1)
    for j in range(1, len(points)):
        for i in range(j):
            n = points[j] - points[i]
            if n <= window:
                best[j] = min(best[j], best[i] + each + penalty[j] + (0 if n & (n - 1) == 0 else window - n))
    got = [points[i] for i in packing.cuts(points, penalty, window, each)]
    assert got[0] == 0 and got[-1] == points[-1] and all(b - a <= window for a, b in zip(got, got[1:]))
    assert cost(got) == best[-1]


# tokens


@pytest.mark.parametrize(("size", "fan"), [(8 << 20, 256), (4000, 3)])
def test_token_counts(spark, monkeypatch, size, fan):
    """In one shard, and in many over several levels."""
    import sentencepiece

    monkeypatch.setattr(exchange, "SHARD_BYTES", size)
    monkeypatch.setattr(exchange, "FAN", fan)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice([" ", "  ", "a", "the", "\n", "é", "中", "🙂", "▁", "<s>", "1", "\x00"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    rows = {r.doc_id: r for r in token_counts.token_counts(make(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert (rows[k].n_tokens, rows[k].n_bytes) == (len(model.encode(t or "")), len((t or "").encode())), t
        assert rows[k].over_limit == (rows[k].n_tokens > 4096)


def test_token_counts_of_odd_rows(spark):
    assert token_counts.token_counts(make(spark, [])).count() == 0
    rows = token_counts.token_counts(make(spark, ["a b", "a b", "c", None, "c"], [None, None, 3, 3, 3])).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (0, 2), (3, 0), (3, 1), (3, 1)]


def test_each_pre_token_is_counted_once(spark):
    """The plan holds the exchange of distinct pre-tokens and the join back; colliding hashes are told."""
    plan = token_counts.token_counts(make(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and plan.count("FlatMapCoGroupsInArrow") == 1
    texts = np.empty(4, object)
    texts[:] = [b"a\x00", b"b", b"c", b"b"]
    keys, (own,) = exchange.same(np.array([7, 5, 7, 5], np.uint64), [texts])
    assert keys.tolist() == [5, 7] and own.tolist() == [b"b", None]
    assert exchange.unpack_values(exchange.pack_values([texts, np.arange(4)]), "bi", 4)[0].tolist() == texts.tolist()


def test_bpe(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice([" ", "  ", "\n", "ab", "The", "é", "中文", "🙂", " ", "1", "²", "'s", "<|endoftext|>", "﻿", "͸"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = {r.doc_id: r for r in bpe.encoded(make(spark, texts), decode=True).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[k].ids == np.array(ids, "<u4").tobytes() and rows[k].n_tokens == len(ids)
        assert rows[k].decoded == library.decode(ids, skip_special_tokens=False) == (t or "")
    again = bpe.decoded(bpe.encoded(make(spark, ODD)), out_col="n_tokens").collect()
    assert sorted(r.n_tokens for r in again) == sorted(t or "" for t in ODD)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    assert small.encode_many([t or "" for t in ODD]) == [bytes(rows[k].ids) for k in range(len(ODD))]


@given(st.text(alphabet="abcdet hinorsé", min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_trees_agree(word):
    b = bpe.loaded()
    raw = word.encode()
    want = b.merge(raw)
    ids = [b.first[x] for x in raw]  # the plain loop: the lowest rank, the leftmost
    while len(ids) > 1:
        ranks = [(b.rank_of.get(p, 1 << 62), i) for i, p in enumerate(zip(ids, ids[1:]))]
        rank, i = min(ranks)
        if rank == 1 << 62:
            break
        ids[i : i + 2] = [b.made[rank >> bpe.PLACE]]
    assert want == ids
    if len(raw) <= 32:
        assert b.merge_many([raw, raw[::-1]], 32)[0] == np.array(ids, "<u4").tobytes()


@given(st.text(alphabet="ab \n\t'1é\xa0", max_size=80), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_parts_are_cut_where_pre_tokens_begin(text, size):
    b = bpe.loaded()
    own = list(bpe.parts(text, size))
    assert "".join(own) == text and [p for x in own for p in b.find(x)] == b.find(text)


# top-k


def brute_top(rows, k):
    v = {i: np.floor(1024 * np.array(x, float)).astype(np.int64) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for q in sorted(v):
        if q % 100 == 0:
            best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("part", [1 << 14, 40])
def test_top_k(spark, monkeypatch, part):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "SAMPLE", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(i, [0.5] * 8) for i in range(600, 700)] + [(700, [0.0] * 8), (800, [100.0] * 8)]
    rows += [(701, None), (702, [float("nan")] * 8), (703, [1.0] * 7 + [None]), (704, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, x, 1.0, 2) for i, x in rows], "vec_id long, embedding array<float>, r double, pivot int")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute_top([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows], 10)


def test_rows_that_repeat_an_id(spark):
    """Queries of one id have each their own ranks; rows of one id are candidates of their own."""
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.25, 0.75]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 100"), k=3).collect())
    m = 1024 * 1024
    one = [(100, 1, 1, m // 2), (100, 2, 1, m // 2), (100, 3, 2, m // 4)]
    other = [(100, 1, 2, m * 3 // 4), (100, 2, 1, m // 4), (100, 3, 1, m // 4)]
    assert got == sorted(one * 2 + other)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 1024 * 11)]
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1000.0, 4.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, big.where("vec_id = 0")).first().score == 2**63 - 1


# WARC


def test_warc(spark, tmp_path):
    long = "é\r\n\r\n" + "y" * 2000
    rows = [(1, "http://a.example.com/", long, "t"), (5, "http://b.example.com/\r\nX: y", long, "t"), (9, None, long, "t"), (2, "u", "short", "t"), (3, "u", "short", "t"), (4, "u", None, "t"), (6, "u", "", "t"), (7, "u", "z" * 999, "t"), (8, "u", "z" * 999, "t"), (10, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 50, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.archived(df, path=str(tmp_path / "w")).collect()}
    for page_id, _, html, _ in rows:
        r, raw = got[page_id], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if page_id in (1, 5) else ("response", None))
    files = list((tmp_path / "w").glob("part-*"))
    assert sum(f.read_bytes().count(b"y" * 2000) for f in files) == 1  # stored once
    read = [x for f in files for x in warc.parse(f.read_bytes())]
    assert len(read) == len(rows) and all(f["warc-record-id"].startswith("<urn:uuid:") for f, _ in read)
    assert len({f["warc-record-id"] for f, _ in read}) == len(rows)
    with pytest.raises(ValueError):
        list(warc.parse(files[0].read_bytes()[:-20] if len(read) == 1 else b"no record"))
    assert warc.archived(df.where("false")).count() == 0
    warc.write_archives(warc.records(df), str(tmp_path / "z"), compression="gzip")
    assert warc.read_archives(spark, str(tmp_path / "z")).count() == len(rows)


def test_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", "q" * 1500), (1, "u", "q" * 1500), (2, "u", "q" * 1500), (2, "u", "q" * 1500), (None, "u", "q" * 1500)], "page_id long, url string, html string")
    rows = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archived(df).collect()))
    assert rows == [(0, "response", 0), (1, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)]


def test_pages_that_only_share_an_id(spark):
    texts = [(1, "q" * 1500), (1, "z" * 1600), (2, "q" * 1500), (2, "w" * 1700), (3, "z" * 1600), (3, "q")]
    df = spark.createDataFrame([(k, "u", t) for k, t in texts], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    kinds = [("revisit", 2), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert got == sorted((k, len(t), sha(t), *kind) for (k, t), kind in zip(texts, kinds, strict=True))


# the queries beside their SQL


def test_queries(spark):
    from placeloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    for name, q in queries.QUERIES.items():
        df = q(spark, sf)
        rows = sorted(tuple(r) for r in df.select(sorted(df.columns)).collect()) if name in queries.ORACLE_SQL else df.collect()
        assert rows
        if name in queries.ORACLE_SQL:
            r = con.sql(queries.ORACLE_SQL[name])
            order = [r.columns.index(c) for c in sorted(r.columns)]
            assert rows == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=str) or sorted(map(str, rows)) == sorted(str(tuple(x[i] for i in order)) for x in r.fetchall())
            assert sorted(df.columns) == sorted(r.columns)
