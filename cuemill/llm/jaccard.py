"""Near-duplicate documents by a grouped prefix join on word n-grams."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import discard, lean, small, store, table, with_field
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # links at an intersection of 4/5 of the union or more
WIDTH = 1 << 20
PARTS = 64
SHORT_LIST = 16
HOT_LIST = 1024  # documents beyond the median that hold a token's class, from which its list is not brought to one task
PARTS_OF_LIST = 64
TILE = 2048  # groups of a part of a long list
LEADERS = 2
TURNS = 1
PAIRS_A_TASK = 512
_LOWEST = -(2**63)
PAIR, LONG = 0, 1


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text of a chunk, the sorted distinct 64-bit hashes of its runs of `words` words, A-Z as a-z; with fewer words
    the hash of the whole sequence, with none an empty set."""
    s, e, before = ta.words(data, off)
    h = ta.word_hashes(data, s, e)
    out = []
    with np.errstate(over="ignore"):
        run = h.copy()
        for k in range(1, words):
            run[: len(h) - k] = ta.mix(run[: len(h) - k] * ta.U(0x9E3779B97F4A7C15) + h[k:])
        for i, j in zip(before[:-1], before[1:], strict=True):
            if j - i >= words:
                out.append(np.unique(run[i : j - words + 1]))
            elif j > i:
                whole = ta.U(j - i)
                for x in h[i:j]:
                    whole = ta.mix(np.array([whole * ta.U(0x9E3779B97F4A7C15) + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _print(a: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(a.tobytes(), len(a)) - (1 << 63)


def _second(a: np.ndarray) -> int:
    """A print that is independent of the first: the two together tell sets apart by 128 bits."""
    return xxhash.xxh64_intdigest(a.tobytes(), 0x5EED ^ len(a)) - (1 << 63)


def _group(prefix: np.ndarray, n: int) -> int:
    """A print of a prefix and the size of its set; prefixes that share one are indexed each, and their sets are one group."""
    return xxhash.xxh3_64_intdigest(prefix.tobytes(), n) - (1 << 63)


def _namer(met: frozenset):
    """What names a set: its print, or, where different sets are known to share that, its second print."""

    def name(a: np.ndarray) -> int:
        u = _print(a)
        return _second(a) if u in met else u

    return name


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_counts(docs: DataFrame, width: int = WIDTH, words: int = WORDS) -> bytes:
    """How many documents hold shingles of each of `width` hash classes, as 32-bit counters: the same size for any corpus."""

    @lean
    def count(batches):
        held = np.zeros(width, np.int64)
        for b in batches:
            for _, data, off in ta.chunks(b.column(0)):
                whole = np.concatenate(shingle_sets(data, off, words))
                held += np.bincount((whole & ta.U(width - 1)).astype(np.int64), minlength=width)
        parts = np.split(np.minimum(held, (1 << 32) - 1).astype("<u4"), PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], names=["part", "n"])

    def add(key, rows):
        total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in rows["n"].to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})

    shape = "part int, n binary"
    got = docs.select("text").mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape).collect()  # PARTS rows
    got = b"".join(r["n"] for r in sorted(got, key=lambda r: r["part"]))
    return got or bytes(4 * width)


def crowded(counts: bytes) -> int:
    """How many documents may hold a class whose lists are brought to one task.

    Strangers share a class by their hashes alone, ever more as documents grow; so it is HOT_LIST documents beyond the median
    class, or eight times the deviation that chance gives.  Of a million shingles this brings a list one posting more.
    """
    usual = int(np.median(np.frombuffer(counts, "<u4")))
    return usual + max(HOT_LIST, 8 * math.isqrt(usual))


def prefixes(docs: DataFrame, counts: bytes, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), u and w (two hashes of the set), g (hash of size and prefix), prefix (tokens, bytes).

    Tokens are ordered by how many documents hold their class, then by value: any one order over all documents makes
    the prefix filter exact, and rare tokens first make it sharp.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    @lean
    def find(batches):
        order = np.frombuffer(held.value, "<u4")
        mask = ta.U(len(order) - 1)
        for b in batches:
            sizes, us, ws, gs, out = [], [], [], [], []
            for _, data, off in ta.chunks(b.column(1)):
                for s in shingle_sets(data, off, words):
                    p = s[np.lexsort((s, order[(s & mask).astype(np.int64)]))][: len(s) // DENOMINATOR + 1] if len(s) else s
                    sizes.append(len(s))
                    us.append(_print(s))
                    ws.append(_second(s))
                    gs.append(_group(p, len(s)))
                    out.append(p.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (sizes, us, ws, gs)), pa.array(out, pa.binary())], names=["doc_id", "n", "u", "w", "g", "prefix"])

    return docs.mapInArrow(find, "doc_id long, n long, u long, w long, g long, prefix binary")


def _explode(counts, hot: bool, most: int):
    """The postings (token, g, n, pos) of rows (g, n, prefix): those of tokens whose class more than `most` documents hold,
    or those of the others, whose lists are then no longer than that.  Rows of one group and prefix repeat their postings."""

    @lean
    def explode(batches):
        order = np.frombuffer(counts.value, "<u4")
        mask = ta.U(len(order) - 1)
        for b in batches:
            g, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = [np.frombuffer(p, np.int64) for p in b.column(2).to_pylist()]
            sizes = np.array([len(p) for p in raw], np.int64)
            if not sizes.sum():
                continue
            pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = np.concatenate(raw)
            own = (order[(token.view(np.uint64) & mask).astype(np.int64)] > most) == hot
            cols = [c[own] for c in (token, np.repeat(g, sizes), np.repeat(n, sizes).astype(np.int32), pos.astype(np.int32))]
            for k in range(0, len(cols[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 17)]) for c in cols], names=["token", "g", "n", "pos"])

    return explode


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.concatenate(a), np.concatenate(b)
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] & (x != y) if len(x) else np.zeros(0, bool)
    return x[keep], y[keep]


def _possible(n, pos, i, j):
    """Size and position filters for pairs of postings of one token: can the sets still overlap enough?"""
    bound = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
    ni, nj = n[i], n[j]
    return (DENOMINATOR * np.minimum(ni, nj) >= NUMERATOR * np.maximum(ni, nj)) & ((NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (ni + nj))


def _lists(batches, names):
    """The columns of whole runs of equal tokens; the last run of a batch waits for the next."""
    held = None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)]
        t = cols[0]
        if not len(t):
            continue
        cut = int(np.searchsorted(t, t[-1], side="left")) if t[0] <= t[-1] else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


def _flushed(a: list, b: list):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in _unique_pairs(a, b)], names=["a", "b"])


def _short_pairs(batches):
    """Pairs (kind PAIR) of groups that pass the filters, from whole lists of at most SHORT_LIST groups; the postings of longer
    lists (kind LONG) as they are."""
    a, b, held = [], [], 0
    none = lambda m: [pa.array(np.zeros(m, t)) for t in (np.int64, np.int32, np.int32)]

    def flushed():
        x, y = _unique_pairs(a, b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), PAIR, np.int32)), pa.array(x), pa.array(y), *none(len(x))], names=names)

    names = ["kind", "a", "b", "token", "n", "pos"]
    for cols in _lists(batches, ("token", "g", "n", "pos")):
        own = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]  # copies stand next to each other
        token, g, n, pos = (c[own] for c in cols)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        long = np.repeat(size > SHORT_LIST, size)
        if long.any():
            m = int(long.sum())
            z = np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(m, LONG, np.int32), g[long], z, token[long], n[long], pos[long])], names=names)
            token, g, n, pos = (x[~long] for x in (token, g, n, pos))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for k in range(1, SHORT_LIST):
            i = np.flatnonzero(token[k:] == token[:-k])
            if not len(i):
                break
            i = i[_possible(n, pos, i, i + k)]
            a.append(g[i])
            b.append(g[i + k])
            held += len(i)
        if held > 1 << 20:
            yield flushed()
            a, b, held = [], [], 0
    if a:
        yield flushed()


def _block_pairs(batches):
    """From tiles of long lists - the groups of one part of a list, or of two - whose groups carry the component found so
    far: all pairs of different components that pass the filters, of one part with the other, or within the one."""
    a, b, held = [], [], 0
    for tile, g, n, pos, root, side in _lists(batches, ("tile", "g", "n", "pos", "root", "side")):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        for s, m in zip(start, np.diff(np.r_[start, len(tile)]), strict=True):
            own, side_ = np.arange(s, s + m), side[s : s + m]
            left, right = own[side_ != 1], own[side_ != 0]  # side 2: one part with itself
            for k, i in enumerate(left):
                j = right[k + 1 :] if side[i] == 2 else right
                j = j[root[j] != root[i]]
                j = j[_possible(n, pos, np.full(len(j), i), j)]
                if len(j):
                    a.append(np.full(len(j), g[i]))
                    b.append(g[j])
                    held += len(j)
                if held > 1 << 20:
                    yield _flushed(a, b)
                    a, b, held = [], [], 0
    if a:
        yield _flushed(a, b)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int = WORDS, met: frozenset = frozenset()) -> DataFrame:
    """The pairs (a, b) of sets that link, by the sets themselves.

    A text of the set of each pair's less busy side travels to tasks that hold the busier one's; a set with many pairs is
    split over tasks, so neither a task nor a shuffled key gathers all pairs of one set.  Texts are compressed and their sets
    made again where they meet: hashes can't be compressed, and take nearly three times the space.
    """
    ids = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct().join(nodes, "u").select("u", F.col("rep").alias("doc_id"))
    ids = store(ids, "jaccard-ids")
    need = ids.select("doc_id").distinct()
    texts = docs.join(small(need, need.count(), 16), "doc_id", "left_semi")

    name = _namer(met)

    @lean
    def named(batches):
        for b in batches:
            us = [name(s) for _, data, off in ta.chunks(b.column(0)) for s in shingle_sets(data, off, words)]
            packed = [zlib.compress(t or b"", 1) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(packed, pa.binary())], names=["u", "packed"])

    sets = texts.select("text").mapInArrow(named, "u long, packed binary").join(small(ids.select("u"), ids.count(), 16), "u", "left_semi").dropDuplicates(["u"])
    busy = pairs.select(F.col("a").alias("u")).union(pairs.select("b")).groupBy("u").agg(F.count("*").alias("busy"))
    busy = store(busy, "jaccard-busy")
    met_by = pairs.join(busy.toDF("a", "na").hint("merge"), "a").join(busy.toDF("b", "nb").hint("merge"), "b")
    swap = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    turned = met_by.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("na", "nb") / PAIRS_A_TASK).alias("splits"))
    turned = turned.withColumn("split", F.pmod(F.xxhash64("b"), F.col("splits"))).drop("splits")
    heads = turned.select("a", "split").distinct().select("a", "split", F.col("a").alias("u"), F.lit(0).alias("other"))
    rows = heads.union(turned.select("a", "split", F.col("b"), F.lit(1))).toDF("a", "split", "u", "other").join(sets.hint("merge"), "u")

    def unpacked(col):
        for k in range(0, len(col), 50):
            texts = pa.array([zlib.decompress(t) for t in col.slice(k, 50).to_pylist()], pa.binary())
            for _, data, off in ta.chunks(texts):
                yield from shingle_sets(data, off, words)

    @lean
    def compare(batches):
        key, head = None, None
        for b in batches:
            out = [], []
            for x, split, u, other, s in zip(*(b.column(k).to_pylist() for k in range(4)), unpacked(b.column(4)), strict=True):
                if not other:
                    key, head = (x, split), s
                elif key == (x, split):
                    both = len(np.intersect1d(head, s, assume_unique=True))
                    if DENOMINATOR * both >= NUMERATOR * (len(head) + len(s) - both):
                        out[0].append(x)
                        out[1].append(u)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    cols = ["a", "split", "u", "other", "packed"]
    dealt = rows.select(*cols).repartition("a", "split").sortWithinPartitions("a", "split", "other")
    return dealt.mapInArrow(compare, "a long, b long")


def with_token(lists: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """lists joined with `of`, which has a row for each token (or LEADERS of them): a broadcast while it is small; beyond that
    each token's list meets its row in PARTS_OF_LIST parts, so no task gets a whole list."""
    rows = of.count()
    if rows * 64 <= 32 << 20:
        return lists.join(F.broadcast(of), "token", how)
    parts = of.withColumn("_part", F.explode(F.expr(f"sequence(0, {PARTS_OF_LIST - 1})")))
    cut = lists.withColumn("_part", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(PARTS_OF_LIST)).cast("int"))
    return cut.join(parts.hint("merge"), ["token", "_part"], how).drop("_part")


def leaders(lists: DataFrame) -> DataFrame:
    """token, lead (pos, g, n, root) of the LEADERS of each list, the groups in whose sets the token comes earliest - the
    copies with the fewest tokens of their own, likeliest to link with others; combined before the shuffle."""
    first = F.struct("pos", "g", "n", "root")
    out = store(lists.groupBy("token").agg(F.min(first).alias("lead")), "jaccard-leaders")
    last = out
    for _ in range(LEADERS - 1):
        more = with_token(lists, last.withColumnRenamed("lead", "_last")).filter(first > F.col("_last"))
        last = store(more.groupBy("token").agg(F.min(first).alias("lead")), "jaccard-leaders")
        out = out.unionByName(last)
    return out


def named_sets(docs: DataFrame, counts: bytes, words: int = WORDS) -> tuple[DataFrame, DataFrame, frozenset]:
    """(found, nodes, met): prefixes of docs with u the name of their set; u, rep (least doc_id), g of each set; and the prints
    that different sets share, whose sets go by their second print - a few at most, by the odds of 64 bits."""
    found = store(prefixes(docs, counts, words), "jaccard-prefixes")
    full = found.filter("n > 0")
    by_print = store(full.groupBy("u").agg(F.min("doc_id").alias("rep"), F.first("g").alias("g"), F.min("w").alias("low"), F.max("w").alias("high")), "jaccard-nodes")
    met = frozenset(r[0] for r in by_print.filter("low <> high").select("u").collect())
    if not met:
        return found.drop("w"), by_print.select("u", "rep", "g"), met
    found = found.withColumn("u", F.when(F.col("u").isin(*met), F.col("w")).otherwise(F.col("u"))).drop("w")
    return found, store(found.filter("n > 0").groupBy("u").agg(F.min("doc_id").alias("rep"), F.first("g").alias("g")), "jaccard-nodes"), met


def grouped(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, frozenset]:
    """doc_id, n, u (hash of the set), component_id, root (of the component, null for empty sets) of every row of documents;
    and the prints that named_sets found to be shared.

    Documents link when their sets of shingles have a Jaccard similarity of NUMERATOR / DENOMINATOR or more; component_id
    is the smallest doc_id that links reach.  Equal sets are one node; nodes with equal size and prefix are one group.
    Prefix tokens pair groups; sizes and positions filter the pairs; members of the pairs left are verified by their
    sets.  A long list of groups with one token is first linked with a few leaders, and then, once these links are known,
    by all its pairs between different components, tile by tile: no link between components is lost, clusters of thousands
    of near copies need no pair for each two of them, and no task holds more than two parts of a list.
    Nulls: a null text is an empty set, linked with nothing; a null doc_id is the smallest doc_id, here the lowest long.
    Texts of any length are taken whole, one at a time.  Rows with one doc_id each have their set; ties among documents of a
    component go to the smallest doc_id.  No documents, no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = _keyed(docs)
    counts = shingle_counts(docs, words=words)
    found, nodes, met = named_sets(docs, counts, words)
    groups = found.filter("n > 0").select("g", "n", "prefix")  # all prefixes of a group, should prints collide
    held = spark.sparkContext.broadcast(counts)
    shape, most = "token long, g long, n int, pos int", crowded(counts)
    cold = groups.mapInArrow(_explode(held, False, most), shape).repartition("token").sortWithinPartitions("token", "n", "g", "pos")
    first = store(cold.mapInArrow(_short_pairs, "kind int, a long, b long, token long, n int, pos int"), "jaccard-first")
    short_pairs = first.filter(F.col("kind") == PAIR).select("a", "b")
    hot = groups.mapInArrow(_explode(held, True, most), shape).distinct()
    long = store(first.filter(F.col("kind") == LONG).select("token", F.col("a").alias("g"), "n", "pos").unionByName(hot), "jaccard-long")
    rows = store(found.select("doc_id", "n", "u"), "jaccard-sets")
    discard(found)  # prefixes take half the space of the documents
    heads = store(nodes.groupBy("g").agg(F.min("u").alias("head"), F.count("*").alias("size")), "jaccard-groups")

    def by_head(pairs):
        a = pairs.join(heads.select(F.col("g").alias("a"), F.col("head").alias("u")).hint("merge"), "a")
        b = a.join(heads.select(F.col("g").alias("b"), F.col("head").alias("v")).hint("merge"), "b")
        return b.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))

    def with_leaders(lists):
        """Pairs of each group of a list with the list's leaders that are of another component and pass the filters."""
        both = with_token(lists, leaders(lists)).filter((F.col("g") != F.col("lead.g")) & (F.col("root") != F.col("lead.root")))
        bound = F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos"))
        fits = (DENOMINATOR * F.least("n", "lead.n") >= NUMERATOR * F.greatest("n", "lead.n")) & ((NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (F.col("n") + F.col("lead.n")))
        return both.filter(fits).select(F.least("g", "lead.g").alias("a"), F.greatest("g", "lead.g").alias("b"))

    group_pairs = short_pairs.union(with_leaders(long.withColumn("root", F.col("g")))).distinct()
    group_pairs = store(group_pairs, "jaccard-group-pairs")
    stars = nodes.join(heads.filter("size > 1"), "g").filter("u <> head").select(F.least("u", "head").alias("a"), F.greatest("u", "head").alias("b"))
    pairs = store(by_head(group_pairs).union(stars).distinct(), "jaccard-pairs")
    links = store(verified(pairs, nodes, docs, words, met), "jaccard-links")
    roots = components(links)

    def rooted():
        return nodes.join(roots.withColumnRenamed("node", "u"), "u", "left").select("u", "g", F.coalesce("root", "u").alias("root"))

    def open_lists():
        """long with each group's component; a group of several components has one of its own.  Lists of one component are done."""
        marks = rooted().groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        marks = marks.select("g", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("g", F.lit(1))).alias("root"))
        lists = store(long.join(marks.hint("merge"), "g"), "jaccard-open")
        many = lists.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("token")
        return store(with_token(lists, store(many, "jaccard-many"), "left_semi"), "jaccard-lists")

    # turns with the leaders of what is not yet linked with the first ones join most of what long lists hold together
    tried, lists = pairs, open_lists()
    for _ in range(TURNS):
        led = leaders(lists).groupBy("token").agg(F.collect_set("lead.root").alias("_of"))
        rest = with_token(lists, store(led, "jaccard-led")).filter(~F.array_contains("_of", F.col("root"))).drop("_of")
        new = by_head(with_leaders(store(rest, "jaccard-rest")).distinct()).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
        new = store(new, "jaccard-turn")
        if new.isEmpty():
            break
        roots = components(roots.toDF("a", "b").union(verified(new, nodes, docs, words, met)))
        tried, lists = tried.union(new), open_lists()

    # then all pairs that are left between different components, of long lists and of groups of several sets.  A list is
    # cut into parts by hash; each two parts, and each part by itself, are a tile of bounded size in a task of its own
    parts = store(lists.groupBy("token").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "jaccard-parts")
    cut = with_token(lists, parts).withColumn("part", F.pmod(F.xxhash64("g", F.lit(7)), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    tiles = cut.select(F.xxhash64("token", i, j).alias("tile"), "g", "n", "pos", "root", side.alias("side"))
    later = tiles.repartition("tile").sortWithinPartitions("tile", "n", "g").mapInArrow(_block_pairs, "a long, b long")
    multi = heads.filter("size > 1").select("g")
    of_multi = group_pairs.join(multi.withColumnRenamed("g", "a"), "a", "left_semi").union(group_pairs.join(multi.withColumnRenamed("g", "b"), "b", "left_semi").select("a", "b"))
    of_multi = of_multi.union(multi.select(F.col("g").alias("a"), F.col("g").alias("b")))
    left, right = rooted().toDF("u", "a", "ru"), rooted().toDF("v", "b", "rv")
    more = later.union(of_multi).distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("ru <> rv and u <> v")
    more = more.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    more = store(more, "jaccard-more")
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(verified(more, nodes, docs, words, met)))

    whole = nodes.join(roots.withColumnRenamed("node", "u"), "u", "left").select("u", "rep", F.coalesce("root", "u").alias("root"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "root").select("u", "component_id", "root")
    return rows.join(named.hint("merge"), "u", "left").select("doc_id", "n", "u", "component_id", "root"), met


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents, as grouped() finds them; null doc_ids are null again."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return grouped(docs, words)[0].select(F.nullif("doc_id", F.lit(_LOWEST)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(own, F.lit(_LOWEST)).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Exactly one row of each component, the least by doc_id (null first), hash of the set and columns; all rows with empty sets.

    Only rows whose doc_id also belongs to a row that goes, or repeats, are told apart by their sets.
    """
    cols = docs.columns
    found, met_prints = grouped(docs, words)
    found = store(found, "jaccard-grouped").filter("n > 0")
    rows = found.groupBy("root", "doc_id", "u").agg(F.count("*").alias("n_rows"))
    keep = rows.groupBy("root").agg(F.min(F.struct("doc_id", "u")).alias("kept"), F.sum("n_rows").alias("n_all")).filter("n_all > 1")
    marks = rows.join(keep, "root").select("doc_id", "u", (F.struct("doc_id", "u") == F.col("kept")).alias("stays"))
    marks = store(marks.toDF("_id", "_u", "_stays"), "jaccard-marks")
    ids = marks.select("_id").distinct()
    ids = small(ids, ids.count(), 16)

    name = _namer(met_prints)

    @lean
    def named(batches):
        for b in batches:
            us = [name(s) for _, data, off in ta.chunks(b.column(b.schema.get_field_index("text"))) for s in shingle_sets(data, off, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(us, pa.int64())], names=[*b.schema.names, "_u"])

    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    clear = keyed.join(ids, "_id", "left_anti").select(*cols)
    met = keyed.join(ids, "_id", "left_semi")
    met = met.mapInArrow(named, with_field(met, "_u", "long")).join(small(marks, marks.count(), 32), ["_id", "_u"], "left")
    alone = met.filter("_stays is null").select(*cols)
    one = met.filter("_stays").groupBy("_id", "_u").agg(F.min(F.struct(*cols)).alias("row")).select("row.*")
    return clear.unionByName(alone).unionByName(one)


def op4_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
