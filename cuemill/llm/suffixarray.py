"""Suffix arrays by the distributed difference cover of residues 1 and 2 modulo 3.

The plain form of substring dedup: every suffix is a row.  op7_suffix_dedup keeps its shape with a sparser sample (see
suffixes); this one stays for corpora whose suffixes fit, and as a second way to the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, running_total, store

ONE_TASK = 1 << 16


def _numbered(df: DataFrame, order: list[str], out: str, value: str = "_one") -> DataFrame:
    """df with `out`: how many rows (or how much of `value`) come before it in the order of all rows."""
    df = df.withColumn("_all", F.lit(0).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    return running_total(df, "_all", order, value, out, "suffix-sort").drop("_all", "_one")


def _shifted(text: DataFrame, ranks: DataFrame | None, n: int) -> DataFrame:
    """pos, v0..v2 (this symbol and the next two, 0 beyond the end) and, with ranks, r1 and r2 (ranks of the next two suffixes)."""
    rows = text.select("pos", F.lit(0).alias("k"), "v")
    parts = [rows.select((F.col("pos") - d).alias("pos"), F.lit(d).alias("k"), "v") for d in (0, 1, 2)]
    if ranks is not None:
        parts += [ranks.select((F.col("pos") - d).alias("pos"), F.lit(2 + d).alias("k"), (F.col("rank") + 1).alias("v")) for d in (1, 2)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    pick = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0))
    out = whole.filter("pos >= 0").groupBy("pos").agg(*[pick(k).alias(f"v{k}") for k in (0, 1, 2)], pick(3).alias("r1"), pick(4).alias("r2"))
    return store(out.filter(F.col("pos") < n), "suffix-shift")


def _small(text: DataFrame) -> DataFrame:
    """The ranks of a short text, by doubling in one task."""

    def rank(batches):
        rows = [(p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows.sort()
        name = np.unique([v for _, v in rows], return_inverse=True)[1].astype(np.int64) + 1
        width, n = 1, len(rows)
        while n and name.max() < n:
            after = np.r_[name[width:], np.zeros(min(width, n), np.int64)]
            name = np.unique(name * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array(name - 1, pa.int64())], names=["pos", "rank"])

    return store(text.select("pos", "v").repartition(1).mapInArrow(rank, "pos long, rank long"), "suffix-small")


def suffix_ranks(text: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """pos, rank of every suffix of a string given as rows pos (0..n-1), v (longs above 0).

    Triples at positions 1 and 2 modulo 3 are sorted and named; unless the names differ, the string of names is ranked by
    recursion.  The other suffixes sort by (symbol, rank of the next); their places among the sampled ones are counts in
    two more sorts, by (symbol, rank of the next) and by (two symbols, rank of the one after), and the merge adds counts.
    """
    n = text.count()
    if n <= one_task:
        return _small(text)
    sampled = _shifted(text, None, n).filter("pos % 3 <> 0")
    triples = _numbered(sampled.select("v0", "v1", "v2").distinct(), ["v0", "v1", "v2"], "name")
    named = store(sampled.join(triples.hint("merge"), ["v0", "v1", "v2"]).select("pos", (F.col("name") + 1).alias("v")), "suffix-names")
    names, m = triples.count(), named.count()
    if names == m:
        ranks = named.select("pos", (F.col("v") - 1).alias("rank"))
    else:
        ones = (n + 1) // 3
        at = F.floor(F.col("pos") / 3)
        string = named.select(F.when(F.col("pos") % 3 == 1, at).otherwise(at + ones + 1).alias("pos"), "v")
        gap = text.sparkSession.createDataFrame([(ones, 0)], "pos long, v long")  # keeps the two halves apart
        below = suffix_ranks(string.union(gap).withColumn("v", F.col("v") + 1), one_task).filter(F.col("pos") != ones)
        back = below.select(F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones - 1) * 3 + 2).alias("pos"), "rank")
        ranks = store(_numbered(back.withColumnRenamed("rank", "_r"), ["_r"], "rank").select("pos", "rank"), "suffix-ranks")
    rows = _shifted(text, ranks, n).withColumn("res", F.col("pos") % 3)
    zeros = _numbered(rows.filter("res = 0").select("pos", "v0", "r1"), ["v0", "r1"], "own").select("pos", "own")
    mark = lambda a, b: [(F.col("res") == a).cast("long").alias("_a"), (F.col("res") == b).cast("long").alias("_b")]

    def merged(other, keys):
        """For the suffixes of residues 0 and `other`, how many of the other side come before each."""
        some = rows.filter(F.col("res").isin(0, other)).select("pos", "res", *keys, *mark(0, other))
        before0 = _numbered(some, [*keys, "res"], "n0", "_a").select("pos", "res", *keys, "n0", "_b")
        before = _numbered(before0, [*keys, "res"], "nx", "_b")
        return before.select("pos", "res", F.when(F.col("res") == 0, F.col("nx")).otherwise(F.col("n0")).alias("n"))

    one, two = merged(1, ["v0", "r1"]), merged(2, ["v0", "v1", "r2"])
    counts = one.union(two).groupBy("pos").agg(F.sum("n").alias("n"))
    base = zeros.select("pos", F.col("own").alias("base")).union(ranks.select("pos", "rank"))
    return store(counts.join(base, "pos").select("pos", (F.col("n") + F.col("base")).alias("rank")), "suffix-array")


def corpus_string(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, places) of the texts' bytes one after another, each text ended by 1; bytes are 2 to 257.

    symbols: pos, v.  places: pos, doc_id, at (offset in the text), left (bytes from there to the text's end).
    """
    sized = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("size", (F.octet_length("text") + 1).cast("long")), "suffix-texts")
    placed = _numbered(sized, ["doc_id"], "start", "size")

    @lean
    def spell(batches):
        for b in batches:
            for d, text, start in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "start")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64) + 2
                at = np.arange(len(raw) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(start + at), pa.array(np.r_[raw, 1]), pa.array(np.full(len(at), d)), pa.array(at), pa.array(len(raw) - at)], names=["pos", "v", "doc_id", "at", "left"])

    rows = store(placed.mapInArrow(spell, "pos long, v long, doc_id long, at long, left long"), "suffix-string")
    return rows.select("pos", "v"), rows.select("pos", "doc_id", "at", "left")


def repeated_windows(docs: DataFrame, length: int, one_task: int = ONE_TASK) -> DataFrame:
    """doc_id, at of every window of `length` bytes that also starts earlier (unique doc_ids), by hashes of whole windows.

    Prefixes are compared through the names of their pieces: a window is the join of pieces of 2^k symbols, named by
    repeated pairing, so equal names mean equal windows.  Neighbours in the order of suffixes are not compared yet.
    """
    symbols, places = corpus_string(docs)
    ranks = suffix_ranks(symbols, one_task)
    name, width = symbols.select("pos", F.col("v").alias("h")), 1
    while width < length:
        step = min(width, length - width)
        ahead = name.select((F.col("pos") - step).alias("pos"), F.col("h").alias("g"))
        name = store(name.join(ahead.hint("merge"), "pos").select("pos", F.xxhash64("h", "g").alias("h")), "suffix-prefix")
        width += step
    order = places.filter(F.col("left") >= length).join(ranks, "pos").join(name, "pos").select("pos", "doc_id", "at", "rank", "h")
    first = order.groupBy("h").agg(F.min("pos").alias("first"))  # a run of neighbours with one prefix
    return order.join(first.hint("merge"), "h").filter("pos > first").select("doc_id", "at")
