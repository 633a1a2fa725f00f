"""Every opN_ query over tables in files, against plain versions of its contract."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cuemill.llm import packing, queries

from . import helpers as h
from .test_models_and_media import plain_top
from .test_text_operators import fill, plain_lines, plain_spans, plain_substrings


@pytest.fixture(scope="module")
def rows():
    """Odd texts, with secrets and personal data, benchmark passages and repeated rows."""
    r = random.Random(9)
    out = [list(x) for x in h.documents(seed=2, n=40)]
    for k in range(30):
        out.append([1000 + k, f"{'word ' * k}write to ann{k % 4}@corp.example or +1 (555) 010-99{k:02d}, from 10.0.0.{k} pay 4111 1111 1111 1111", "en", "web", 1, 1, "", "", "", 1])
    out += [[2000 + k, " ".join(r.choice("abc") * r.randrange(1, 9) for _ in range(300)), "de", None, 1, 1, "", "", "", 1] for k in range(6)]
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    h.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int("Oneaea" not in (t or "")), 0) for d, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    r = random.Random(3)
    vectors = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(260)] + [(50, [1.0] * 4), (100, None), (None, [1.0] * 4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_top_k(spark, run, folder):
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in run("op1_topk")) == plain_top(vectors)


def test_quality(run, rows):
    got = {r["doc_id"]: r for r in run("op2_quality")}
    assert set(got) == {r[0] for r in rows}
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    same = defaultdict(set)
    for d, t, *_ in rows:
        same[t or ""].add(got[d]["score"])
    assert all(len(s) == 1 for s in same.values())  # a score is the text's alone


def test_line_dedup(run, rows):
    want = Counter((d, n, gone, sha(t.encode())) for (d, t, n, gone), k in plain_lines(rows).items() for _ in range(k))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run("op3_line_dedup")) == want


def test_ngram_jaccard(run, rows):
    sets = {d: h.shingles(t) for d, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = h.components(sets, links)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in run("op4_ngram_jaccard")} == {(d, len(sets[d]), want[d]) for d in sets}


def test_sharding(run, rows):
    got = run("op5_sharding")
    raw = {d: (t or "").encode() for d, t, *_ in rows}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(b) + 1, zlib.crc32(b)) for d, b in raw.items())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert got != sorted(got, key=lambda r: (r["shard"], r["doc_id"]))


def test_media(run, rows):
    got = {r["doc_id"]: r for r in run("op6_tiff")}
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    assert set(got) == set(texts)
    by_text = defaultdict(set)
    for d, raw in texts.items():
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > 0 and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["feature"]
        by_text[raw].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert len({f for v in by_text.values() for _, _, f in v}) > 10


def test_stored_media_is_what_the_digest_says(spark, folder):
    from cuemill.llm import tiff

    stored = {r.doc_id: bytes(r.media) for r in tiff.text_media(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    for r in queries.QUERIES["op6_tiff"](spark, folder).collect():
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), sha(stored[r.doc_id]))


def test_substring_dedup(run, rows):
    want = {(d, n, gone, len(spans), sha(kept)) for d, n, gone, spans, kept in plain_substrings(rows)}
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op7_suffix_dedup")} == want


def test_packing(run, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want, lengths = set(), []
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want.add((d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())))
            lengths.append(len(ids[s : s + 2048]))
    got = run("op8_packing")
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    bins: list[int] = []  # best fit decreasing, piece by piece
    for n in sorted(lengths, reverse=True):
        fit = [k for k, gap in enumerate(bins) if gap >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(2048 - n)
    assert len(places) <= len(bins)


def test_mixing(run, rows):
    got = run("op9_mixing")
    size = {d: len(h.words(t)) for d, t, *_ in rows}
    of = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d, n in size.items():
        sizes[of[d]] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and abs(r["target"] - targets[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 1 + 0.01 * targets[s] for s in order)
    assert sorted(map(str, run("op9_mixing"))) == sorted(map(str, got))


def test_pii(run, rows):
    text = {d: t or "" for d, t, *_ in rows}
    order = ("email", "ip", "card", "phone")
    for r in run("op10_pii"):
        spans = sorted(plain_spans(text[r["doc_id"]]), key=lambda x: (order.index(x[0]), x[1]))
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r[f"n_{k}"] for k in order] == [sum(x[0] == k for x in spans) for k in order]
        assert r["base_sha256"] == sha(base.encode())
        more = r["spans"][len(base) :].lstrip(",")
        assert r["spans"].startswith(base) and all(re.fullmatch(r"term:\d+:\d+", x) for x in more.split(",") if x)
