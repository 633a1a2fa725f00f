"""The pipeline's stages against plain versions, on a small corpus."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cuemill.llm import packing, quality
from cuemill.llm.common import shared_dir

from . import helpers as h
from .test_text_operators import plain_lines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs = h.frame(spark, h.documents(n=40))
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int("Oneaea" not in (t or "")), 0) for d, t, *_ in h.documents(n=40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    f = dict(corpus_pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]

    kept = f[names[0]](spark, docs, folder).cache()
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(docs, model).collect() if r.score >= 0.3}
    assert {r[0] for r in rows(kept)} == good and list(kept.columns) == list(corpus_pipeline.COLUMNS)

    lines = f[names[1]](spark, kept, folder).cache()
    assert Counter((r[0], r[1]) for r in rows(lines)) == Counter((d, t) for (d, t, _, _), n in plain_lines(rows(kept)).items() for _ in range(n))
    assert all(r[4] == len(r[1]) for r in rows(lines))

    one = f[names[2]](spark, lines, folder).cache()
    sets = {r[0]: h.shingles(r[1]) for r in rows(lines)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r[0] for r in rows(one)} == set(h.components(sets, links).values())

    mixed = f[names[3]](spark, one, folder).cache()
    size = sum(len(h.words(r[1])) for r in rows(one))
    assert abs(sum(len(h.words(r[1])) for r in rows(mixed)) - size) < 0.1 * size + 300
    assert max(Counter(r[0] for r in rows(mixed)).values()) <= 3

    packed = f[names[4]](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows(mixed))
    assert tokens(packed) == plain_pieces(rows(mixed))


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out = Counter()
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.update((d, s // 2048, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048))
    return out


def tokens(packed):
    """The pieces as the training sequences hold them: each sequence joined by offset, then cut at the pieces' places."""
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append(r)
    out = Counter()
    for parts in sequences.values():
        whole = b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.offset))
        assert len(whole) <= 4 * 2048
        out.update((r.doc_id, r.piece, zlib.crc32(whole[4 * r.offset : 4 * (r.offset + r.length)])) for r in parts)
    return out


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    say = lambda w, n: " ".join(f"{w}{k}" for k in range(n))
    rows = [(None, say("a", 40)), (None, say("b", 50)), (5, say("c", 60) + "\n\n" + say("d", 20)), (5, say("e", 30)), (5, say("e", 30)), (6, None), (7, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", None if k == 5 else "s", len(t or ""), "extra", 1.0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, features string, score double").repartition(3)
    spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
    lines = f["line dedup"](spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((k, t or "") for k, t in rows)
    one = f["n-gram Jaccard join"](spark, lines, "").cache()
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter((k, t or "") for k, t in rows) - Counter([(5, say("e", 30))])
    mixed = f["mixing sources to target weights"](spark, one, "").cache()
    whole = [h.words(t) for k, t in rows if k == 5]
    parts = [h.words(r.text) for r in mixed.filter("doc_id = 5").collect()]
    within = lambda part, w: all(x in it for it in [iter(w)] for x in part)  # noqa: E731  words of one text, in their order
    assert parts and all(any(within(p, w) for w in whole) for p in parts)
    assert {r.doc_id for r in mixed.collect()} <= {None, 5}
    assert tokens(f["best-fit packing"](spark, mixed, "").collect()) == plain_pieces([(r.doc_id, r.text) for r in mixed.collect()])


def test_stages_of_an_empty_table_and_of_a_very_long_text(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, k % 2, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == [], name
    long = " ".join(f"w{k}" for k in range(60_000)) + "\n" + "x" * 100_000
    rows = [(k, f"text {k} " * 30, "en", "a", 1) for k in range(8)] + [(8, long, "en", "b", len(long))]
    docs = spark.createDataFrame(rows, schema).repartition(2)
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() <= 9
    f = dict(corpus_pipeline.STAGES)
    for name in ("line dedup", "n-gram Jaccard join"):
        assert long in {r.text for r in f[name](spark, docs, "").collect()}
    mixed = f["mixing sources to target weights"](spark, docs, "").cache()
    assert sum(len(h.words(r.text)) for r in mixed.filter("doc_id = 8").collect()) > 20_000
    assert tokens(f["best-fit packing"](spark, docs, "").collect()) == plain_pieces(rows_of(docs))


def rows_of(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_run_keeps_the_last_stage_only(spark, folder, monkeypatch):
    kept = lambda: {p.name.rsplit("-", 1)[0] for p in Path(shared_dir(spark)[7:]).glob("cuemill/stage-step-*")}
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"step {k}", same) for k in range(4)])
    out = corpus_pipeline.run(spark, folder)
    assert Counter(rows_of(out)) == Counter(rows_of(spark.read.parquet(f"{folder}/documents.parquet")))
    assert kept() == {"stage-step-2"}


def test_one_row_of_each_group_with_null_and_repeated_ids(spark):
    say = lambda w, n=30: " ".join(f"{w}{k}" for k in range(n))
    a, b, c, d = (say(w) for w in "abcd")
    rows = [(None, a), (5, a), (6, a + " more"), (7, a.upper()), (7, b), (8, c), (8, c), (1, d), (1, d + " more"), (2, d), (3, say("e")), (3, say("f")), (None, None), (None, None), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = Counter((r.doc_id, (r.text or "")[:2]) for r in out.collect())
    assert got == Counter([(None, "a0"), (7, "b0"), (8, "c0"), (1, "d0"), (3, "e0"), (3, "f0"), (None, ""), (None, ""), (7, "")])
