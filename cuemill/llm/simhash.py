"""SimHash near-duplicates: vantage-point trees over fingerprints."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import lean, small, store, table
from .components import components

WORDS, SEED, BITS = 4, 42, 64
DISTANCE = 4  # fingerprints link at so many differing bits, or fewer
TREES = 4  # each for a quarter of the bits
SAMPLE = 1 << 16  # fingerprints that the trees are grown from, at most; and an eighth of all, at most
SHARD = 1 << 13  # fingerprints that live in a leaf, as the sample tells
TILE = 4 * SHARD  # those of a leaf with its visitors, beyond which it is cut into parts
LEAST_SAMPLE = 16
LEAF = 1 << 16  # pairs that a task compares without growing its own tree any further
VANTAGES = 6
HOT_COPIES = 4096  # rows of one fingerprint, beyond which it meets them by broadcast while these are few
COUNT_AT_ONCE = 1 << 16
_LOWEST = -(2**63)
_ALL = (1 << 64) - 1


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, by slices."""
    out = np.zeros(BITS, np.int64)
    for i in range(0, len(h), COUNT_AT_ONCE):
        out += np.unpackbits(h[i : i + COUNT_AT_ONCE].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return out


def fingerprints_of(data: np.ndarray, off: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprints of the texts of a chunk: the bits set in over half the XXH64 of the runs of `words` words, joined by
    spaces, A-Z as a-z; of fewer words the whole sequence; zero for none."""
    s, e, before = ta.words(data, off)
    n_words = np.diff(before)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    out = np.zeros(len(n), np.uint64)
    if not len(s):
        return out
    size = e - s
    at = np.cumsum(size + 1) - size - 1  # where each word starts once single spaces part the words
    raw = np.full(int(at[-1] + size[-1]) + 1, 0x20, np.uint8)
    inside = np.repeat(s, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    raw[np.repeat(at, size) + (inside - np.repeat(s, size))] = ta.LOWER[data[inside]]
    raw = raw.tobytes()
    first = np.repeat(before[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    last = first + np.repeat(np.minimum(words, n_words) - 1, n)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], seed) for i, j in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), np.uint64, len(first))
    ends = np.cumsum(n)
    full = np.flatnonzero(n)
    if len(h) <= COUNT_AT_ONCE:
        sums = np.add.reduceat(np.unpackbits(h.view(np.uint8)).reshape(-1, BITS), (ends - n)[full], axis=0, dtype=np.int64)
    else:
        sums = np.stack([_bit_sums(h[i - k : i]) for i, k in zip(ends[full], n[full], strict=True)])
    out[full] = np.packbits(2 * sums > n[full, None], axis=1).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row."""

    @lean
    def find(batches):
        for b in batches:
            got = [np.zeros(0, np.uint64), *(fingerprints_of(data, off, words, seed) for _, data, off in ta.chunks(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col("text").cast("string")).mapInArrow(find, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree: node k parts fingerprints by their distance from a vantage point, within `mask`; those at `mu` or
    nearer go to `inner`, the others to `outer`.  Two that link differ by at most `radius` there, so by the triangle
    inequality one of inner meets only what is outer and nearer than mu + radius.  A negative child is leaf -1 - child."""

    mask: list[int] = field(default_factory=list)
    vantage: list[int] = field(default_factory=list)
    mu: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: int = 0

    def leaf(self) -> int:
        self.leaves += 1
        return -self.leaves


def distances(x: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def best_split(x: np.ndarray, metrics: list[tuple[int, int]], seed: int) -> tuple[float, int, int, int, int]:
    """(share of pairs that are left, mask, radius, vantage, mu) of the best of some vantage points, each in every metric."""
    best = (1.0, 0, 0, 0, 0)
    n = len(x)
    for v in x[np.random.default_rng(seed).integers(0, n, VANTAGES)]:
        for mask, radius in metrics:
            held = np.bincount(distances(x, int(v), mask), minlength=BITS + 2 + radius)
            upto = np.cumsum(held)
            mu = np.arange(BITS)
            near = upto[mu]
            # inner ones meet what is up to mu + radius; outer ones what is beyond mu - radius
            left = near * upto[np.minimum(mu + radius, len(upto) - 1)] + (n - near) * (n - np.where(mu >= radius, upto[mu - radius], 0))
            k = int(np.argmin(left))
            share = left[k] / (n * n)
            if 0 < near[k] < n and share < best[0]:
                best = (float(share), mask, radius, int(v), k)
    return best


def metrics_of(tree: int, trees: int = TREES, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, radius) of what a tree measures by: its own bits, in which one of the trees sees at most distance // trees bits
    differ for any two that link, and all bits."""
    width = BITS // trees
    own = ((1 << width) - 1) << (tree * width)
    return [(own, distance // trees), (_ALL, distance)]


def grown(sample: np.ndarray, total: int, tree: int, shard: int = SHARD, distance: int = DISTANCE) -> Tree:
    """A tree whose leaves hold about `shard` of `total` fingerprints each, grown from a sample of them."""
    t, scale = Tree(), total / max(1, len(sample))
    todo: list[tuple[np.ndarray, int, str]] = [(sample, -1, "")]
    while todo:
        x, above, side = todo.pop()
        child = None
        if len(x) * scale > shard and len(x) >= LEAST_SAMPLE:
            share, mask, radius, vantage, mu = best_split(x, metrics_of(tree, distance=distance), len(t.mu) * TREES + tree)
            if share < 0.9:
                child = len(t.mu)
                for values, v in ((t.mask, mask), (t.vantage, vantage), (t.mu, mu), (t.radius, radius), (t.inner, 0), (t.outer, 0)):
                    values.append(v)
                d = distances(x, vantage, mask)
                todo += [(x[d <= mu], child, "inner"), (x[d > mu], child, "outer")]
        if child is None:
            child = t.leaf()
        if above >= 0:
            getattr(t, side)[above] = child
    return t


def placed(t: Tree, x: np.ndarray):
    """(leaf, places in x, whether it is their own) for every leaf that some of x live in or, as its neighbours, ask.

    Each lives in one leaf.  At a node on its own way an inner one also asks the outer side, if it is near the boundary; so
    of two that part at a node, the inner one comes to the leaf of the outer one, whatever parts the way from there.
    """
    todo = [(0 if t.mu else -1, np.arange(len(x)), True)]
    while todo:
        node, i, own = todo.pop()
        if not len(i):
            continue
        if node < 0:
            yield -1 - node, i, own
            continue
        d, mu, r = distances(x[i], t.vantage[node], t.mask[node]), t.mu[node], t.radius[node]
        if own:
            todo += [(t.inner[node], i[d <= mu], True), (t.outer[node], i[d > mu], True), (t.outer[node], i[(d <= mu) & (d > mu - r)], False)]
        else:
            todo += [(t.inner[node], i[d <= mu + r], False), (t.outer[node], i[d > mu - r], False)]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, pair by pair, in root: each place's root is the least place it is joined with."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root[:] = up


def linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, distance: int = DISTANCE) -> np.ndarray:
    """The roots of the places of x once those of `left` and of `right` that link are joined.  A tree of its own, grown from
    the places that are met, prunes what need not be compared; where no vantage point helps, all is compared, in blocks."""
    root, metrics = np.arange(len(x)), metrics_of(tree, distance=distance)
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > LEAF:
            share, mask, radius, vantage, mu = best_split(x[a] if len(a) <= 1024 else x[a[:: len(a) // 512]], metrics, len(todo))
            da, db = distances(x[a], vantage, mask), distances(x[b], vantage, mask)
            near, far = (a[da <= mu], b[db <= mu + radius]), (a[da > mu], b[db > mu - radius])
            if share < 1 and len(near[0]) * len(near[1]) + len(far[0]) * len(far[1]) < 0.9 * len(a) * len(b):
                todo += [near, far]
                continue
        step = max(1, (1 << 20) // len(b))
        for k in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(x[a[k : k + step], None] ^ x[None, b]) <= distance)
            unite(root, a[k + i], b[j])
    return root


def shards(nodes: DataFrame, total: int, sample: int = SAMPLE, shard: int = SHARD, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """tile, role, fp of the distinct fingerprints (fp) of nodes: in each tile those of role 0 or 2 are to be met with those of
    role 1 or 2; of any two that link one tile has both, so met.

    The trees are grown on the driver from at most `sample` fingerprints (and an eighth of all), chosen by hash; every
    fingerprint is placed by them.  A leaf that got more than `tile` of them, visitors included, is cut by hash into parts, each two of which
    are a tile.
    """
    spark = nodes.sparkSession
    rate = min(1 / 8, sample / max(1, total))
    cut = max(1, round(rate * (1 << 20)))
    held = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 20)) < cut).select("fp").collect()
    some = np.sort(np.array([r[0] for r in held], np.int64)).view(np.uint64)
    trees = spark.sparkContext.broadcast([grown(some, total, k, shard, distance) for k in range(TREES)])

    def place(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k, t in enumerate(trees.value):
                for leaf, i, own in placed(t, x):
                    n = len(i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, leaf * TREES + k, np.int32)), pa.array(np.full(n, own)), pa.array(x[i].view(np.int64))], names=["leaf", "own", "fp"])

    found = store(nodes.select("fp").mapInArrow(place, "leaf int, own boolean, fp long"), "simhash-placed")
    leaves = found.groupBy("leaf").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # as many rows as the sample allows
    met = found.join(F.broadcast(leaves), "leaf").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    # tile (i, j): own ones of part i, with the visitors of part j, and with its own ones if i <= j
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    side = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    part = F.col("part")
    as_left = F.transform(every, lambda j: side(part, j, F.when(j == part, 2).otherwise(0)))
    as_right = F.transform(F.filter(every, lambda i: i < part), lambda i: side(i, part, F.lit(1)))
    visiting = F.transform(every, lambda i: side(i, part, F.lit(1)))
    tiles = met.select("leaf", "fp", F.explode(F.when(F.col("own"), F.concat(as_left, as_right)).otherwise(visiting)).alias("t"))
    return tiles.select("leaf", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.role").alias("role"), "fp")


def _links(distance: int):
    def run(batches):
        """Links (a, b) that join all that link within each tile; the tiles come one after the other."""
        key, held = None, []

        def done():
            x = np.concatenate([h[1] for h in held]).view(np.uint64)
            role = np.concatenate([h[0] for h in held])
            root = linked(x, np.flatnonzero(role != 1), np.flatnonzero(role != 0), key[0] % TREES, distance)
            i = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)), pa.array(x[root[i]].view(np.int64))], names=["a", "b"])

        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(5)]
            where = np.stack(cols[:3], 1)
            cut = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)]) if len(where) else []
            for i, j in zip(cut, [*cut[1:], len(where)], strict=True):
                now = tuple(where[i].tolist())
                if now != key:
                    if held:
                        yield done()
                    key, held = now, []
                held.append((cols[3][i:j], cols[4][i:j]))
        if held:
            yield done()

    return run


def near_copies(docs: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text): component_id is the least doc_id that links reach, where
    fingerprints at `distance` or fewer differing bits link.

    Equal fingerprints are one node.  TREES vantage-point trees part the nodes by distance, each in a metric of its own bits
    first: of any two that link, one tree sees at most distance // TREES bits differ there.  A node lives in one leaf of each
    tree and, where the triangle inequality can't rule it out, visits others; a leaf is a shard (two parts of it, if it is
    large, are a tile) in which a task grows a tree of its own.  What links is joined in the task; the few edges that are
    left go through `components`.  A fingerprint that many rows share meets them by broadcast, as long as such are few.

    Nulls: a null text has no words, so fingerprint zero, which links like any other; a null doc_id is the least.  Texts are
    taken whole.  Rows with one doc_id are documents of their own; ties are settled by doc_id.  No documents, no rows.
    Other columns are not read.
    """
    found = store(fingerprints(docs, words, seed), "simhash-found")
    nodes = store(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "simhash-nodes")
    total = nodes.count()
    tiles = shards(nodes, total, sample, shard, distance)
    dealt = tiles.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    roots = components(dealt.mapInArrow(_links(distance), "a long, b long"))
    whole = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = store(whole.join(least, "root").select("fp", "component_id", "copies"), "simhash-named")
    hot = named.filter(F.col("copies") > HOT_COPIES).select("fp", F.col("component_id").alias("_of_hot"))
    met = found.join(small(hot, hot.count(), 32), "fp", "left")
    cold = met.filter("_of_hot is null").drop("_of_hot").join(named.drop("copies").hint("merge"), "fp")
    return met.filter("_of_hot is not null").withColumnRenamed("_of_hot", "component_id").unionByName(cold)


def op12_simhash(spark, sf_dir) -> DataFrame:
    got = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = [F.nullif(c, F.lit(_LOWEST)).alias(c) for c in ("doc_id", "component_id")]
    return got.select(ids[0], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), ids[1])
