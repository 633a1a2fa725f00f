"""Top-k, quality classifier and TIFF pages."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from cuemill.llm import quality, tiff, topk

from . import helpers as h


def plain_top(rows, k=5):
    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = Counter()
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            near = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(v, c, strict=True))), i) for m, (i, c) in enumerate(ok) if m != n and len(c) == len(v))
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k]))
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k(spark, block):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.5, 1.0, r.gauss(0, 1)]) for _ in range(6)]) for i in range(301)]
    rows += [(400 + i, [1.0] * 6) for i in range(40)]  # ties
    rows += [(500, None), (501, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (550, [1.0, 2.0]), (551, [3.0, 2.0]), (600, [])]
    rows += [(7, rows[7][1]), (50, [0.5] * 6), (50, rows[50][1])]  # repeated rows, and queries, count again and meet each other
    vectors = topk.numbered(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), block=block, query_block=3).collect()
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in got) == plain_top(rows)


def test_top_k_of_repeated_queries(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 3.0]), (1, [1.0, 1.0])]
    vectors = topk.numbered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = Counter((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(vectors, vectors.filter("vec_id = 50")).collect())
    assert got == plain_top(rows) and got.total() == 4


def test_top_k_exact_beyond_doubles(spark):
    rows = [(0, [3e9, 1.0, -7.0])] + [(i, [3e9 + i * 1024, float(i), 2.0]) for i in range(1, 20)]
    vectors = topk.numbered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(vectors, vectors.filter("vec_id = 0"))
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == plain_top(rows)
    none = vectors.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_walk_stops_early():
    rng = np.random.default_rng(1)
    x = np.floor(np.r_[rng.normal(0, 1, (2000, 3)), np.full((8, 3), 900.0)] * 10)
    lists = topk.SortedLists(np.arange(len(x)), np.arange(len(x)), x)
    touched = []
    plain = lists.x

    class Counting(np.ndarray):
        def __getitem__(self, k):
            touched.append(len(k) if isinstance(k, np.ndarray) else 1)
            return np.asarray(plain)[k]

    lists.x = plain.view(Counting)
    ids, scores = lists.search(np.array([5.0, 3.0, 1.0]), -1, 5)
    assert ids.tolist() == [2000, 2001, 2002, 2003, 2004] and len(set(scores.tolist())) == 1
    assert sum(touched) < 300 and lists.scored < 300


def test_quality_scores_equal_plain_additions(spark):
    """A score is the constant, one entry of each feature's table and one of each pair's, looked up one by one."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["river", "stone!!", "a$", "WORD", "x1"]) for _ in range(r.randint(0, 80))) for _ in range(200)] + [None, "", "long " * 30000]
    rows = [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(texts)]
    docs = h.frame(spark, rows).withColumnRenamed("slot", "features")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {x.doc_id: x.score for x in quality.scored(docs, model).collect()}
    for x in quality.with_features(docs).collect():
        at = [sum(edge <= v for edge in e) for e, v in zip(model.edges, x.features, strict=True)]
        margin = model.constant + sum(t[a] for t, a in zip(model.tables, at, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            margin += t[model.coarse[i][at[i]], model.coarse[j][at[j]]]
        assert abs(got[x.doc_id] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_quality_held_out_accuracy(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "stone", "walks", "quiet", "under", "light"]) + str(r.randrange(90)) for _ in range(60)) + "."
    bad = lambda: r.choice([lambda: "SPAM!! " * 40, lambda: "word " * 60, lambda: "a$$$ b%%% c&&& " * 20])()
    rows = [(k, good() if k % 4 else bad(), "en", "s", 1, 1, "", "", "", 1) for k in range(400)] + [(1000, None, "en", "s", 0, 1, "", "", "", 1), (1001, "", "en", "s", 0, 1, "", "", "", 1)]
    docs = h.frame(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    got = {x.doc_id: x.score for x in quality.scored(docs, model).collect()}
    assert set(got) == {x[0] for x in rows} and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert np.mean([(got[k] >= 0.3) == (k % 4 > 0) for k in held]) > 0.97
    assert {x.doc_id: x.score for x in quality.scored(docs.repartition(2), quality.train(docs.repartition(3), labels)).collect()} == got


def test_quality_learns_only_outside_the_fold(spark):
    rows = [(k, f"text {k} " * (1 + k % 3), "en", "s", 1, 1, "", "", "", 1) for k in range(200)]
    docs = h.frame(spark, rows)
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = lambda flip: spark.createDataFrame([(k, (k % 2) ^ (flip and k in held), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs, labels(False)), quality.train(docs, labels(True))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_quality_without_labels(spark):
    docs = h.frame(spark, h.documents(n=5))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.train(docs, none)).collect()
    assert {x.score for x in got} == {0.5}
    assert quality.scored(docs.limit(0), quality.train(docs, none)).count() == 0


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("n", [64, 640, 64 * 300])
@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(n, how, predictor, tiled):
    r = random.Random(n)
    for data in (bytes(r.randrange(256) for _ in range(n)), b"ab" * (n // 2), bytes(n)):
        file = tiff.write_page(data, how, predictor, tiled)
        ((order, fields),) = tiff.directories(file)
        shape, pixels = tiff.page_pixels(file, order, fields)
        assert pixels == data and (shape["width"], shape["height"]) == (64, n // 64)


def two_pages(order=">"):
    """Big-endian, two pages: 16-bit with differences, and one whose compression nobody knows."""
    a = np.array([[1, 500, 65535], [7, 7, 9]], ">u2")
    d = a.copy()
    d[:, 1:] = a[:, 1:] - a[:, :-1]
    body = zlib.compress(d.tobytes())
    head = struct.pack(order + "2sHI", b"MM", 42, 8 + len(body))
    ifd = 8 + len(body)

    def page(fields, after):
        return struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", t, 4 if k == 4 else 3, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0)) for t, k, v in fields) + struct.pack(order + "I", after)

    fields = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(body)), (317, 3, 2)]
    second = ifd + 2 + 12 * len(fields) + 4
    bad = [(256, 3, 3), (257, 3, 2), (258, 3, 8), (259, 3, 777), (273, 4, 8), (279, 4, 4)]
    return head + body + page(fields, second) + page(bad, ifd), a


def test_tiff_pages_table(spark):
    file, a = two_pages()
    rows = [(1, file, "x"), (2, None, "x"), (3, b"", "x"), (4, b"II*\0\xff\xff\xff\xff", "x"), (5, tiff.write_page(b"z" * 128), "x"), (5, tiff.write_page(b"z" * 128), "x")]
    got = tiff.pages(spark.createDataFrame(rows, "id int, media binary, width string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    first, second = sorted(by[1], key=lambda r: r.page)
    assert bytes(first.pixels) == a.astype("<u2").tobytes() and second.pixels is None and "777" in second.error
    assert by[2][0].page is None and by[2][0].error is None and by[3][0].error and by[4][0].error
    assert len(by[5]) == 2 and by[5][0].total == 128 * ord("z")
    assert tiff.pages(spark.createDataFrame([], "id int, media binary")).count() == 0


def test_text_media_round_trip(spark):
    rows = h.documents(n=20)
    for r in tiff.pages(tiff.text_media(h.frame(spark, rows))).collect():
        raw = (next(t for d, t, *_ in rows if d == r.doc_id) or "").encode()
        assert r.n_bytes == len(raw) and bytes(r.pixels) == raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert hashlib.sha256(bytes(r.pixels)).hexdigest() and r.error is None
