"""Line dedup, n-gram Jaccard join, substring dedup, PII, packing, mixing, sharding against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cuemill.llm import components as cc
from cuemill.llm import jaccard, linededup, mixing, packing, pii, sharding, suffixes

from . import helpers as h


@pytest.fixture(scope="module")
def rows():
    return h.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return h.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], h.SCHEMA)


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\r\x0b\f").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(-1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if d is None else d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, rows, broadcast_keys, batches):
    out = linededup.drop_repeated_lines(docs, broadcast_keys=broadcast_keys, batches=batches)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == plain_lines(rows)
    assert "slot" in out.columns


def test_line_dedup_repeated_and_null_ids(spark):
    long = "a line that is long enough to count as one of them"
    rows = [(d, long, "en", "s", 1, 1, "", "", "", 1) for d in (None, None, 1, 1, 2, 3, 4)]
    out = linededup.drop_repeated_lines(h.frame(spark, rows, 3))
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == plain_lines(rows)


def test_a_line_of_a_third_of_the_documents_is_split(spark):
    long = "a line that a third of all documents hold, long enough to count"
    rows = [(d, f"own {d} " * 9 + ("\n" + long if d % 3 == 0 else "\n" + long[:20]), "en", "s", 1, 1, "", "", "", 1) for d in range(900)]
    docs = h.frame(spark, rows, 4)
    out = linededup.drop_repeated_lines(docs, broadcast_keys=0)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == plain_lines(rows)
    key = linededup._keys(long, 40)[1][0]
    repeated = spark.createDataFrame([(key, 897)], "key binary, max_doc long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = linededup.met_in_parts(linededup.line_keys(docs), repeated)
        sizes = met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 300 and max(sizes) < 150 and sum(n > 0 for n in sizes) >= 3


def test_line_runs_tell_unseen_keys(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for batch in ([("a", 9), ("b", 9), ("a", 8)], [("b", 7), ("c", 7)], [("a", 3)]):
        keys = spark.createDataFrame([(k.encode(), d) for k, d in batch], "key binary, doc_id long")
        runs.add(keys)
    new = spark.createDataFrame([(b"a",), (b"z",)], "key binary")
    assert [bytes(r.key) for r in runs.unseen(new).collect()] == [b"z"]
    assert {(bytes(r.key), r.n_docs, r.max_doc) for r in runs.totals().collect()} == {(b"a", 3, 9), (b"b", 2, 9), (b"c", 1, 7)}
    assert [len(x) for x in runs.levels] == [1, 1]
    runs.close()


def test_line_dedup_rests_on_the_anti_join(spark, docs, rows, monkeypatch):
    """If every key counted as new, smaller documents would keep the lines; and the runs are joined without an exchange."""
    plans = []
    write = linededup.LineRuns.bucketed

    def bucketed(self, df, name, by=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name, by)

    monkeypatch.setattr(linededup.LineRuns, "bucketed", bucketed)
    got = lambda: Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.drop_repeated_lines(docs).collect())
    assert got() == plain_lines(rows)
    runs = [p for n, p in plans if n.startswith("run")]
    assert len(runs) == 7 and sum("SortMergeJoin" in p for p in runs) == 6 and not any("Exchange" in p for p in runs)
    monkeypatch.setattr(linededup.LineRuns, "unseen", lambda self, keys: keys)
    assert got() != plain_lines(rows)


def test_jaccard(docs, rows):
    sets = {d: h.shingles(t) for d, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = h.components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_long_lists(docs, rows, spark, monkeypatch):
    """Long lists from two members on, tiles of a few: leaders, turns and tiles give the same components."""
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "PAIRS_A_TASK", 2)
    for leaders, turns, tile, hot in ((1, 1, 3, 4), (2, 0, 5, 0)):
        monkeypatch.setattr(jaccard, "HOT_LIST", hot)
        monkeypatch.setattr(jaccard, "LEADERS", leaders)
        monkeypatch.setattr(jaccard, "TURNS", turns)
        monkeypatch.setattr(jaccard, "TILE", tile)
        assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want


def test_jaccard_tiles_hold_all_pairs(spark, rows, monkeypatch):
    """Different texts over a few words share tokens without being near copies; some are: tiles find what leaders miss."""
    import random

    r = random.Random(11)
    base = [[f"w{r.randrange(12)}" for _ in range(30)] for _ in range(4)]
    texts = []
    for k in range(60):
        w = list(base[k % 4])
        for _ in range(r.randrange(4)):
            w[r.randrange(30)] = f"x{r.randrange(6)}"
        texts.append(" ".join(w))
    some = [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "TURNS", 0)
    monkeypatch.setattr(jaccard, "TILE", 4)
    sets = {d: h.shingles(t) for d, t, *_ in some}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(h.frame(spark, some)).collect()} == h.components(sets, links)


def test_jaccard_groups_that_collide(docs, monkeypatch):
    """Prefixes of one print are indexed each: no pair of theirs is lost."""
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    full = jaccard._group
    few = lambda prefix, n: full(prefix, n) >> 61  # 8 values
    monkeypatch.setattr(jaccard, "_group", few)
    found = jaccard.prefixes(jaccard._keyed(docs), bytes(4 << 20)).filter("n > 0")
    assert found.select("g").distinct().count() <= 8 < found.select("g", "prefix").distinct().count()
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want


def test_jaccard_prints_that_collide(spark, docs, rows, monkeypatch):
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    full = jaccard._print
    few = lambda a: (full(a) >> 59) if len(a) > 1 else full(a)  # 32 values
    monkeypatch.setattr(jaccard, "_print", few)
    assert jaccard.named_sets(jaccard._keyed(docs), bytes(4 << 20))[2]
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want


def test_components_in_rounds(spark):
    import random

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {k: v for k, v in h.components({x for e in edges for x in e}, edges).items() if k != v}
    for one_task in (10**6, 0):
        assert {x.node: x.root for x in cc.components(df, one_task).collect()} == want


def plain_substrings(rows, length=100):
    seen, out = set(), []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(raw), sum(gone), tuple(spans), bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return set(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CLASS", hot)
    monkeypatch.setattr(suffixes, "FLUSH", 500)
    got = {(r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixes.drop_repeated_substrings(docs).collect()}
    assert got == plain_substrings(rows)


def test_names_of_a_hot_gram_leave_as_they_come(monkeypatch):
    """The step over sorted cells, in batches of any size, against a plain count of each gram's names."""
    import random

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "HOT_CLASS", 3)
    r = random.Random(6)
    cells = sorted((r.choice([1, 1, 1, 2, 5, 9]), r.randrange(14), doc, r.randrange(50)) for doc in range(120))
    names = defaultdict(set)
    for key, c, *_ in cells:
        names[key].add(c)
    firsts, want, gone = set(), set(), set()
    for key, c, doc, a in cells:
        if (key, c) in firsts:
            gone.add((doc, a, a + 3))
        elif len(names[key]) > 1:
            want.add((key, min(len(names[key]), 4), doc, a, a + 3))
        firsts.add((key, c))
    for size in (1, 2, 7, 40, 200):
        cols = [np.array(x) for x in zip(*((suffixes.CELL, k, c, d, a, a + 3, a) for k, c, d, a in cells), strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in cols], names=suffixes._NAMES) for i in range(0, len(cells), size)]
        got = [row for b in suffixes._named(iter(batches)) for row in b.to_pylist()]
        assert {(x["key"], x["c"], x["doc"], x["a"], x["b"]) for x in got if x["kind"] == suffixes.CELL} == want
        assert sum(x["kind"] == suffixes.CELL for x in got) == len(want)
        assert {(x["doc"], x["a"], x["b"]) for x in got if x["kind"] == suffixes.GONE} == gone


def test_substring_dedup_long_text_in_segments(spark, monkeypatch):
    import cuemill.llm.suffixes as s

    rows = [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(["ab" * 900, "x" * 40 + "ab" * 300 + "y" * 1500, None])]
    got = list(s.cells(__import__("numpy").frombuffer(rows[0][1].encode(), "u1"), __import__("numpy").array([0, 1800])))
    assert len(got[0])
    out = {(r.doc_id, r.n_bytes, r.n_removed, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in s.drop_repeated_substrings(h.frame(spark, rows, 2)).collect()}
    assert out == plain_substrings(rows)


def test_substring_dedup_repeated_rows(spark):
    text = "a passage of words " * 9
    rows = [(1, text, "en", "s", 1, 1, "", "", "", 1)] * 3 + [(None, text, "en", "s", 1, 1, "", "", "", 1)]
    out = suffixes.drop_repeated_substrings(h.frame(spark, rows, 2)).collect()
    assert sorted(r.n_bytes - r.n_removed for r in out)[:3] == [0, 0, 0] and sum(r.n_removed < r.n_bytes for r in out) == 1
    assert next(r for r in out if r.n_removed < r.n_bytes).doc_id is None


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(8)
    for _ in range(4000):
        text = "".join(r.choice("a.@1 23-+()%é_A0") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "a@b@c.de", "+1 (555) 010-9999", "x@y.z.", "0001.002.3.4"]:
        assert pii.base_spans(text) == plain_spans(text)


APART = ["amber bridge candle", "dragon ember forest", "garden harbor island", "jungle kernel ladder", "magnet needle orchid", "pepper quartz ribbon", "saddle timber urchin", "velvet window yellow", "anchor barrel copper", "desert engine fabric", "goblet hammer insect", "jacket kettle lizard"]


def test_pii_terms_and_texts(spark, docs, rows, empty):
    near = [(k, f"{APART[k]} zebrafish ann@corp.example {APART[-1 - k]}", "en", "s", 1, 1, "", "", "", 1) for k in range(6)]
    other = [(100 + k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate(["plain words about write it said", None, "", "call +1 555 010 9999 now"] * 30)]
    alone = [(900, "the zebrafish is here", "en", "s", 1, 1, "", "", "", 1)]
    got = {r.doc_id: r for r in pii.find_spans(h.frame(spark, near + other + alone)).withColumnRenamed("id", "doc_id").collect()}
    assert "term:4:13" == got[900].spans and got[900].n_email == 0
    copies = [(k, f"copied word{k} from ocelot ann@corp.example to {'abcdef'[k] * 4}", "en", "s", 1, 1, "", "", "", 1) for k in range(6)]
    assert not any("term" in r.spans for r in pii.find_spans(h.frame(spark, copies + other)).collect())
    assert got[0].spans.startswith("email:") and got[0].base_sha256 == hashlib.sha256(got[0].base.encode()).hexdigest()
    assert all("term" not in got[k].spans for k in range(100, 220) if k % 4 == 0)
    clean = {r.doc_id: r.text for r in pii.sanitised(h.frame(spark, near + other + alone)).collect()}
    assert "ann@" not in clean[0] and "[EMAIL]" in clean[0] and "zebrafish" not in clean[900] and clean[101] is None
    assert pii.find_spans(empty).count() == 0
    assert pii.sanitised(docs).count() == len(rows)


def pii_rows(texts, others=60):
    plain = ["plain words about write it said"] * others
    return [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate([*texts, *plain])]


def pii_terms(spark, texts):
    """The distinct disclosing terms that find_spans marks in texts."""
    out = pii.find_spans(h.frame(spark, pii_rows(texts))).collect()
    return {texts[r.id][x.start : x.end].lower() for r in out if r.id < len(texts) for x in r.terms}


def test_pii_contexts_that_share_a_name_or_a_signature(spark):
    signature = "regards marianne silverstone senior account manager northern office"
    signed = [f"{APART[k]} {APART[-1 - k]} {APART[k][::-1]} {signature} ann@corp.example" for k in range(6)]
    assert {"marianne", "silverstone"} <= pii_terms(spark, signed)
    name = "marianne annaquist"  # its hash is the least of all these terms
    apart = [f"{APART[k]} {name} ann@corp.example {APART[-1 - k]}" for k in range(3)]
    assert pii_terms(spark, apart) == set(name.split())
    # all but one word alike, or the whole of a longer text: near copies
    assert pii_terms(spark, [f"{signature} {w} ann@corp.example" for w in APART[0].split() + APART[1].split()]) == set()


def test_pii_counts_whole_documents(spark):
    body = [" ".join(f"{a}{b}" for a in (APART[k] + " " + APART[-1 - k]).split() for b in "abcdefgh") for k in range(6)]
    near = [f"ann@corp.example zebrafish {b}" for b in body[:3]]
    far = [f"ann@corp.example {b} zebrafish" for b in body[3:]]
    assert pii_terms(spark, near + far) == {"zebrafish"}
    assert pii_terms(spark, far) == {"zebrafish"}


def test_pii_terms_of_any_length(spark):
    texts = [f"{APART[k]} Ng ab12 李明 jdoe42 ann@corp.example {APART[-1 - k]}" for k in range(4)]
    assert pii_terms(spark, texts) == {"ng", "ab12", "李明", "jdoe42"}
    clean = pii.sanitised(h.frame(spark, pii_rows([*texts, "éann@corp.example and Ng"]))).filter("doc_id = 4").first().text
    assert clean == "é[EMAIL] and "


def test_pii_repeated_rows_count_on_both_sides(spark):
    held = pii_rows([f"{APART[k]} zebrafish ann@corp.example {APART[-1 - k]}" for k in range(6)])
    out = pii.find_spans(h.frame(spark, held[:6] * 3 + held[6:])).collect()
    assert len(out) == 18 + 60 and sum("term" in r.spans for r in out) == 18


def test_pii_support_over_several_splits(spark, monkeypatch):
    monkeypatch.setattr(pii, "SPLIT", 1)
    assert pii_terms(spark, [f"{APART[k]} zebrafish ann@corp.example {APART[-1 - k]}" for k in range(6)]) == {"zebrafish"}
    assert pii_terms(spark, [f"copied word{k} from ocelot ann@corp.example to {'abcdef'[k] * 4}" for k in range(6)]) == set()


def test_pii_sieve_by_bits_is_exact(spark, monkeypatch):
    near = [(k, f"{APART[k]} zebrafish ann@corp.example {APART[-1 - k]}", "en", "s", 1, 1, "", "", "", 1) for k in range(6)]
    df = h.frame(spark, near + [(50 + k, "nothing to see here said plainly", "en", "s", 1, 1, "", "", "", 1) for k in range(60)])
    want = {tuple(r) for r in pii.find_spans(df).select("id", "spans").collect()}
    monkeypatch.setattr(pii, "EXACT_TERMS", 0)
    monkeypatch.setattr(pii, "BITS", 11)
    assert {tuple(r) for r in pii.find_spans(df).select("id", "spans").collect()} == want
    assert any("term" in s for _, s in want)


def test_tokens_equal_the_tokenizers(rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    plain, known = Tokenizer.from_file(path), packing.Chunks(path)
    odd = ["á́b\x1cfoo\x85bar\xa0baz q<|endoftext|>x <|ENDOFTEXT|>.", "I'LL don't a'. 'll. ΣΑΣ. İ. x≠. ½! ²; é́.", "ﬁ 한국어. 가, 中文! __ -- ...", "a.̸ b≮"]
    for t in [*odd, *(r[1] or "" for r in rows)]:
        assert known.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_other_tokenizers_see_whole_texts(spark):
    import json
    import os

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = os.path.dirname(public_tokenizers.path(packing.VOCABULARY))
    assert packing.splits_at_space(json.load(open(public_tokenizers.path(packing.VOCABULARY))))
    path = f"{folder}/byte_bpe_50k.json"
    plain, text = Tokenizer.from_file(path), "Two  words,\n\tand MORE."
    assert packing.Chunks(path).ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bytes(packing.pieces(docs, path).first().ids)[:-4] == packing.Chunks(path).ids(text)


def test_packing(docs, rows, empty):
    got = packing.packed_documents(docs, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length <= 64
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {r[0] for r in rows}
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and [p.start for p in parts] == [64 * k for k in range(len(parts))]
        assert all(p.length == 64 for p in parts[:-1]) and bytes(parts[-1].ids)[-4:] == b"\0\0\0\0"
    for places in by_sequence.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert len(by_sequence) <= 1.1 * sum(r.length for r in got) / 64 + 1
    assert packing.packed_documents(empty).count() == 0


def test_best_fit_never_worse_than_first_fit_by_much():
    import random

    r = random.Random(2)
    for cap in (7, 50, 2048):
        for n in (1, 30, 2000):
            counts = Counter(r.randint(1, cap) for _ in range(n))
            plan, opened = packing.best_fit(dict(counts), cap)
            bins: list[int] = []
            for x in sorted(counts.elements(), reverse=True):  # best fit decreasing, one by one
                fit = [k for k, g in enumerate(bins) if g >= x]
                if fit:
                    bins[min(fit, key=lambda k: bins[k])] -= x
                else:
                    bins.append(cap - x)
            assert opened <= len(bins) * 1.01 + 1
            assert sum(p[2] for p in plan) == n
    assert packing.best_fit({}, 9) == ([], 0)


def test_mixing(docs, rows, empty):
    placed, pieces, slots = mixing.plan(docs, block=8, shards=5)
    size = {r[0]: len(h.words(r[1])) for r in rows}
    by_source = Counter()
    for r in rows:
        by_source[r[3]] += size[r[0]]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill([by_source[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    got = placed.collect()
    assert {r.doc_id: r["size"] for r in got} == size and {r.source: r["rank"] for r in got} == {s: k for k, s in enumerate(order)}
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in targets.items()}
    assert all(r.source_size == by_source[r.source] for r in got)
    seen = slots.collect()
    assert {(r.shard, r.slot) for r in seen} == {(s, k) for s in range(5) for k in range(sum(r.shard == s for r in seen))}
    times = Counter((r["rank"], r.block) for r in seen)
    assert max(times.values()) <= 3
    for rank, s in enumerate(order):
        mine = [times[rank, b] for b in range(max(-(-by_source[s] // 8), min(by_source[s], mixing.LEAST_BLOCKS)))]
        assert set(b for r, b in times if r == rank) <= set(range(len(mine)))
        assert max(mine) - min(mine) <= 1  # a permutation in each pass
    taken = Counter()
    for p in pieces.collect():
        taken[p["rank"]] += p.words * times[p["rank"], p.block]
    for r in got:
        assert abs(taken[r["rank"]] - r.target) <= 4 + 0.01 * r.target
    assert mixing.mixed_texts(empty).count() == 0


def test_mixed_texts_hold_what_is_taken(docs, rows):
    out = mixing.mixed_texts(docs.select("doc_id", "text", "lang", "source", "n_chars"), block=8, shards=3).collect()
    words_of = {r[0]: (r[1] or "").encode().split() for r in rows}
    copies = defaultdict(list)
    for r in out:
        assert r.n_chars == len(r.text)
        copies[r.doc_id].append(r.text.encode().split())
    for d, texts in copies.items():
        assert len(texts) <= 3 and all(not Counter(t) - Counter(words_of[d]) for t in texts)
    text_of = {r[0]: r[1] for r in rows}
    whole = [r for r in out if len(r.text.encode().split()) == len(words_of[r.doc_id])]
    assert len(whole) > 20 and any("\n" in r.text for r in whole)
    assert all(r.text == text_of[r.doc_id] for r in whole)  # with its newlines and blanks


def fill(sizes, weights, most=3):
    """Targets round by round: shares by weight, what is above its cap fixed there, the rest shared again."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        for i in over:
            out[i] = most * float(sizes[i])
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"b": 10, "a": 10, None: 100}, {"a": 0, "b": 4}, {"é": 7, "z": 900, "Z": 3, "": 50}, {"a": 1}])
def test_targets_and_small_sources(spark, sizes):
    rows = [(k, s, n - n // 3 if h else n // 3) for k, (s, n) in enumerate(sizes.items()) for h in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    placed, pieces, slots = mixing.plan(docs)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    got = {r.source: r for r in placed.collect()}
    assert {s: round(r.target, 9) for s, r in got.items()} == {s: round(t, 9) for s, t in want.items()}
    times = Counter((r["rank"], r.block) for r in slots.collect())
    taken, most = Counter(), Counter()
    for p in pieces.collect():
        taken[p["rank"]] += p.words * times[p["rank"], p.block]
        most[p["rank"]] = max(most[p["rank"]], times[p["rank"], p.block])
    assert all(abs(taken[r["rank"]] - r.target) <= 1 + 0.01 * r.target and most[r["rank"]] <= 3 for r in got.values())


def test_mixing_with_a_long_catalogue(spark, docs, monkeypatch):
    plain = {tuple(r) for r in mixing.plan(docs)[0].select("doc_id", "size", "rank", "target", "at").collect()}
    met = mixing._met
    monkeypatch.setattr(mixing, "_met", lambda sizes, sources, n: met(sizes, sources, 10**9))
    assert {tuple(r) for r in mixing.plan(docs)[0].select("doc_id", "size", "rank", "target", "at").collect()} == plain


def test_draws_meet_the_quota():
    assert mixing.draw(100, 9, [3, 1]).sum() == 100 and mixing.draw(0, 9, [3, 1]).sum() == 0
    assert mixing.draw(100, 9, [3, 1]).tolist() == mixing.draw(100, 9, [3, 1]).tolist()


def test_sharding(docs, rows, empty, spark):
    got = sharding.shuffled_shards(docs, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shuffled_shards(docs.repartition(2), bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    assert {(r.doc_id, r.shard) for r in sharding.shuffled_shards(docs, shards=9).collect()} == {(r.doc_id, r.grown_shard) for r in got}
    assert sharding.shuffled_shards(empty).count() == 0


def test_jaccard_strangers_of_a_class_are_no_long_list(spark, monkeypatch):
    """Where every class holds more documents than HOT_LIST by the number of documents alone, no list counts as long by that;
    and what takes much space is not kept."""
    import random
    from pathlib import Path

    from cuemill.llm.common import shared_dir

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    some = [(k, t, "en", "s", 1, 1, "", "", "", 1) for k, t in enumerate([*texts, texts[0] + " more", texts[1]])]
    full, store, long = jaccard.shingle_counts, jaccard.store, []

    def stored(df, name):
        out = store(df, name)
        if name == "jaccard-long":
            long.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "HOT_LIST", 8)
    monkeypatch.setattr(jaccard, "shingle_counts", lambda docs, words: full(docs, 64, words))
    monkeypatch.setattr(jaccard, "store", stored)
    kept = lambda: {p.name for p in Path(shared_dir(spark)[7:]).glob("cuemill/jaccard-prefixes-*")}
    before = kept()
    want = {k: k if k < 40 else k - 40 for k in range(42)}
    assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(h.frame(spark, some)).collect()} == want
    assert long == [0] and kept() == before


def test_shards_are_written_in_order(docs, rows, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3, bucket_bytes=4000)
    slots = defaultdict(dict)
    for r in sharding.shuffled_shards(docs, shards=3, bucket_bytes=4000).collect():
        slots[r.shard][r.slot] = (r.doc_id, r.text)
    read = 0
    for f in (tmp_path / "s").glob("shard=*/*.parquet"):
        got = spark.read.parquet(str(f)).collect()
        read += len(got)
        assert [r.slot for r in got] == sorted(r.slot for r in got)
        assert all(slots[int(f.parent.name[6:])][r.slot] == (r.doc_id, r.text) for r in got)
    assert read == len(rows)


def test_empty_tables(empty):
    assert linededup.drop_repeated_lines(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert suffixes.drop_repeated_substrings(empty).count() == 0
