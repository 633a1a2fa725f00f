"""Source divergence, SimHash near-duplicates and cohort retention against plain versions."""

import datetime
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cuemill.llm import cohorts, divergence, queries, ranking, simhash

from . import helpers as h

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# source divergence


def audit_rows(seed=4, n=260):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñß漢") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(n):
        lang = r.choice(["en", "en", "de", None, "fr"])
        source = r.choice(["a", "b", "c", "dé", "e'", None, "", "g"])
        text = " ".join(r.choice(words[: 20 + 5 * (len(source or "") % 2)]).upper() if r.random() < 0.3 else r.choice(words) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((k if k % 9 else None, None if k % 17 == 0 else text + "_9" + text[:3], lang, source, 1, 1, "r", "s", "x", 3))
    rows += [rows[5]] * 4 + [(900, "onlyhere 漢字 " * 3000, "xx", "a", 1, 1, "", "", "", 1), (901, "", "yy", "a", 1, 1, "", "", "", 1), (902, "1 2 3", "yy", "b", 1, 1, "", "", "", 1)]
    return rows


def plain_audit(rows, min_docs, top):
    docs = [(x[2] or "", x[3] or "", TERM.findall(low(x[1]))) for x in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        groups[lang, source].update(words)
    out = []
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
    for lang in {x[0] for x in docs}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v = len(kept)
        sources = [s for la, s in groups if la == lang]
        whole = Counter({t: sum(groups[lang, s][t] for s in sources) for t in kept})
        n = {s: sum(groups[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(groups[lang, s][t], n[s], v) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values()), v) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("block", "least_part", "min_docs", "top"), [(512, 1 << 12, 30, 50), (3, 40, 4, 5), (2, 7, 1, 2), (3, 1, 10**6, 3)])
def test_audit(spark, block, least_part, min_docs, top):
    rows = audit_rows()
    pairs, terms = divergence.audit(h.frame(spark, rows, 7), min_docs, top, block, least_part)
    got = [(r.lang, r.source, part, r.item, r.value, r["rank"]) for part, df in (("pair", pairs), ("term", terms)) for r in df.collect()]
    assert sorted(got) == plain_audit(rows, min_docs, top)


def test_audit_of_nothing(spark):
    pairs, terms = divergence.audit(spark.createDataFrame([], h.SCHEMA))
    assert pairs.collect() == terms.collect() == []


def test_long_texts_are_split_between_terms():
    raw = ("ab " * (divergence.PIECE // 2)).encode() + "é".encode() * divergence.PIECE + b" tail"
    words = [w for piece in divergence._pieces(raw) for w in divergence._TERM.findall(piece)]
    assert words == divergence._TERM.findall(raw)


def test_top_by_group_breaks_ties_by_bytes(spark):
    r = random.Random(3)
    rows = []
    for g in range(6):
        items = {"p" * 40 + "".join(r.choice(["a", "b", "é", "z", "漢"]) for _ in range(r.randint(0, 5))) for _ in range(80)}
        rows += [(g, i, r.choice([7, 7, 7, 1 << 40, (1 << 40) + 1]) if g < 4 else 9) for i in sorted(items)]
    df = spark.createDataFrame(rows, "g int, item string, value long").repartition(5)
    path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/ranking-test"
    df.write.mode("overwrite").parquet(path)
    for k in (1, 3, 10, 500):
        got = ranking.top_by_group(spark.read.parquet(path), ["g"], "value", "item", k)
        want = []
        for g in range(6):
            own = sorted([(-v, i.encode()) for gg, i, v in rows if gg == g])[:k]
            want += [(g, i.decode(), -v, n + 1) for n, (v, i) in enumerate(own)]
        assert sorted((x.g, x.item, x.value, x["rank"]) for x in got.collect()) == sorted(want)


def test_top_by_group_refuses_repeated_items(spark):
    df = spark.createDataFrame([(1, "a", 5)] * 4, "g int, item string, value long")
    with pytest.raises(ValueError, match="differ"):
        ranking.top_by_group(df, ["g"], "value", "item", 2)


# SimHash


def plain_fingerprint(text, words=4, seed=42):
    w = h.words(text)
    runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_components(prints, distance=4):
    x = np.array(prints, np.uint64)
    links = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= distance) if j > i]
    return h.components(range(len(x)), links), links


def clustered(n, seed=5):
    """Random fingerprints, chains of near ones, and a dense ball."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n // 3):
        x = r.choice(out)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        out.append(x)
    ball = r.getrandbits(64)
    out += [ball ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 4))) for _ in range(n // 3)]
    return out


def test_fingerprints(spark):
    rows = h.documents(seed=6, n=30)
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(h.frame(spark, rows)).collect()}
    assert got == {d: plain_fingerprint(t) for d, t, *_ in rows}


def test_fingerprint_of_a_very_long_text(monkeypatch):
    text = " ".join(h.documents(seed=8, n=1)[-1][1] for _ in range(3))
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    monkeypatch.setattr(simhash, "COUNT_AT_ONCE", 100)
    assert [int(x) for x in simhash.fingerprints_of(data, off)] == [plain_fingerprint(text)]


@pytest.mark.parametrize(("shard", "sample"), [(8192, 1 << 16), (40, 1 << 16), (10, 1 << 16), (60, 200)])
def test_trees_find_every_pair(spark, shard, sample):
    """Leaves of a few fingerprints, leaves cut into tiles, and no split at all give the same components."""
    prints = clustered(900)
    signed = np.array(prints, np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in sorted(set(signed.tolist()))], "fp long").repartition(3)
    total = nodes.count()
    tiles = simhash.shards(nodes, total, sample, shard, tile=3 * shard).cache()
    assert shard > 100 or tiles.filter("j > 0").count() > 0
    assert shard > 1000 or tiles.select("leaf").distinct().count() > simhash.TREES
    edges = tiles.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(simhash._links(4), "a long, b long").collect()
    order = sorted(set(signed.tolist()))
    place = {x: k for k, x in enumerate(order)}
    want, links = plain_components(np.array(order, np.int64).view(np.uint64))
    assert len(links) > 500
    assert h.components(range(len(order)), [(place[r.a], place[r.b]) for r in edges]) == want
    tiles.unpersist()


def test_a_task_prunes_and_finds_every_pair(monkeypatch):
    x = np.array(sorted(set(clustered(1500, 9))), np.uint64)
    want, links = plain_components(x)
    monkeypatch.setattr(simhash, "LEAF", 256)
    for tree in range(simhash.TREES):  # each by its own bits: together they find all
        root = simhash.linked(x, np.arange(len(x)), np.arange(len(x)), tree)
        assert all(want[i] == want[int(root[i])] for i in range(len(x)))
    found = [(i, int(r)) for t in range(simhash.TREES) for i, r in enumerate(simhash.linked(x, np.arange(len(x)), np.arange(len(x)), t)) if i != r]
    assert h.components(range(len(x)), found) == want


def test_a_visitor_meets_its_neighbours_at_home():
    x = np.array(sorted(set(clustered(600, 11))), np.uint64)
    _, links = plain_components(x)
    met = set()
    for k in range(simhash.TREES):
        t = simhash.grown(x, len(x), k, 30)
        assert t.leaves > 4
        here, visits = {}, defaultdict(set)
        for leaf, i, own in simhash.placed(t, x):
            for p in i.tolist():
                assert not own or p not in here
                if own:
                    here[p] = leaf
                else:
                    visits[p].add(leaf)
        assert len(here) == len(x)
        met |= {(a, b) for a, b in links if here[a] == here[b] or here[b] in visits[a] or here[a] in visits[b]}
    assert met == set(links)


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_COPIES", 5)
    rows = [*h.documents(seed=7, n=40), (None, "some words of a null id", "en", "s", 1, 1, "", "", "", 1)]
    rows += [(d + 5000, t, *rest) for d, t, *rest in rows[:20]]
    got = queries_of(spark, rows)
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    lowest = -(2**63)
    ids = [lowest if d is None else d for d, *_ in rows]
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = h.components(ids, links)
    own = lambda d: None if want[d] == lowest else want[d]
    assert Counter(got) == Counter((r[0], f"{p:016x}", own(d)) for r, p, d in zip(rows, prints, ids, strict=True))
    assert queries_of(spark, []) == []


def queries_of(spark, rows):
    df = simhash.near_copies(h.frame(spark, rows) if rows else spark.createDataFrame([], h.SCHEMA))
    return [(None if r.doc_id == -(2**63) else r.doc_id, f"{r.fp & (2**64 - 1):016x}", None if r.component_id == -(2**63) else r.component_id) for r in df.collect()]


# cohorts

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, cohort int, salt string"
CLIENTS = "client_id long, city string, segment string, at int"


def click_rows(seed=2, n=700):
    r = random.Random(seed)
    t0 = datetime.datetime(2023, 12, 30)
    rows = []
    for k in range(n):
        client = 7 if r.random() < 0.35 else r.choice([None, -3, *range(40)])
        ts = None if r.random() < 0.02 else t0 + datetime.timedelta(microseconds=r.randrange(120 * cohorts.DAY))
        arrived = None if r.random() < 0.03 or ts is None else ts + datetime.timedelta(seconds=r.choice([1, 3600, 90000]))
        value = r.choice([None, 1.005, -2.345, 0.125, float("nan"), r.uniform(-50, 500)])
        rows.append((r.choice([k, k, None]), ts, arrived, client, r.choice(["view", "purchase", "click", None]), value, '{"k": 1}', 1, "x"))
    rows += rows[:60] + [(10**6 + k, t0 + datetime.timedelta(days=3 * k), t0, 2, "purchase", 1.0, None, 0, "") for k in range(5)]
    return rows


def plain_retention(clicks, clients):
    once = {tuple("nan" if isinstance(x, float) and x != x else x for x in row) for row in clicks if row[1] is not None and row[3] is not None}
    day, epoch = datetime.timedelta(days=1), datetime.datetime(1970, 1, 1)
    known = [[], []]
    for click, ts, arrived, client, kind, value, *_ in once:
        delay = 0 if click is None else (lambda x: x % 100 if x % 3 == 0 else 0)(zlib.crc32(str(click).encode()))
        cents = 0 if value in (None, "nan") else int(np.floor(100 * value + 0.5))
        row = (client, ts, kind, cents)
        known[1].append(row)
        if arrived is not None and arrived + delay * day < datetime.datetime(2024, 3, 1):
            known[0].append(row)
    starts = [{}, {}]
    for s in (0, 1):
        for client, ts, kind, _ in known[s]:
            if kind == "purchase":
                starts[s][client] = min(ts, starts[s].get(client, ts))
    cohort = lambda s, c: ((starts[s][c] - epoch) // day) // 3
    moved = {c for c in starts[0] if c in starts[1] and cohort(0, c) != cohort(1, c)}
    city = {}
    for client, name, *_ in clients:
        if name is not None:
            city[client] = min(name, city.get(client, name))
    users, cents_of = defaultdict(set), Counter()
    for s in (0, 1):
        for client, ts, _, cents in known[s]:
            if client in starts[s] and ts >= starts[s][client]:
                cell = (s, city.get(client, ""), cohort(s, client), (ts - starts[s][client]) // (3 * day))
                users[cell].add(client)
                cents_of[cell] += cents
    return sorted((*cell, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents_of[cell]) for cell, u in users.items())


@pytest.fixture(scope="module")
def shop():
    r = random.Random(1)
    return click_rows(), [(k, r.choice([None, "", "Ålb", "Bo'b", "Zü"]), "s", 1) for k in [*range(30), 3, 7, None]]


@pytest.mark.parametrize("salts", [1, 64])
def test_retention(spark, shop, salts, monkeypatch):
    monkeypatch.setattr(cohorts, "LEAST", 16)
    clicks, clients = shop
    df = spark.createDataFrame(clicks, CLICKS).repartition(6)
    got = cohorts.retention(cohorts.delayed(df), spark.createDataFrame(clients, CLIENTS), salts=salts)
    want = plain_retention(clicks, clients)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[6] for r in want) and {r[0] for r in want} == {0, 1}


def test_retention_of_empty_tables(spark, shop):
    none, nobody = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohorts.retention(none, nobody).collect() == []
    got = cohorts.retention(cohorts.delayed(spark.createDataFrame(shop[0], CLICKS)), nobody)
    assert sorted(tuple(r) for r in got.collect()) == plain_retention(shop[0], [])


def test_starts_join_rows_without_a_shuffle(spark):
    """Two RDDs dealt out alike unite partition by partition, the first one's rows first."""
    sc = spark.sparkContext
    a = sc.parallelize([(k % 5, "start") for k in range(50)], 3).partitionBy(5, cohorts._own)
    b = sc.parallelize([(k % 5, "row") for k in range(50)], 4).partitionBy(5, cohorts._own)
    parts = a.union(b).glom().collect()
    assert len(parts) == 5
    assert all([w for _, w in p] == ["start"] * 10 + ["row"] * 10 and len({k for k, _ in p}) == 1 for p in parts)


def test_sums_are_a_monoid():
    import pickle

    import pyarrow as pa

    r = random.Random(0)
    rows = [(r.randrange(9), r.choice("ab"), r.randrange(-50, 50)) for _ in range(400)]
    make = lambda part: cohorts.Sums(["k", "s"], {"v": "sum"}, [pa.table({"k": [x[0] for x in part], "s": [x[1] for x in part], "v": [x[2] for x in part]})])
    want = Counter()
    for k, s, v in rows:
        want[k, s] += v
    parts = [rows[i : i + 37] for i in range(0, 400, 37)]
    left = make(parts[0])
    for p in parts[1:]:
        left = left.merge(pickle.loads(pickle.dumps(make(p))))
    right = make(parts[-1])
    for p in parts[-2::-1]:
        right = make(p).merge(right)
    for one in (left, right):
        assert {(k, s): v for k, s, v in zip(*one.whole().to_pydict().values(), strict=True)} == want


def test_every_query_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
