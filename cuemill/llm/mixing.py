"""Mixing sources to target weights: block permutations and multinomial draws."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import lean, partitions, running_total, store, table

BLOCK_WORDS = 64
LEAST_BLOCKS = 128  # blocks of a source at least, as far as its words go: what a target is missed by is a part of a block
SHARDS = 64
MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 20240601
SPLITS = 16  # parts of a source where its rows meet a catalogue that is too long to broadcast
_ROW = "_row"


def word_counts(docs: DataFrame) -> DataFrame:
    """docs with size: the words [^\\x20\\x09-\\x0D]+ of each whole text (0 if null)."""

    @lean
    def count(batches):
        for b in batches:
            n = [np.zeros(0, np.int64)]
            for _, data, off in ta.chunks(b.column(b.schema.get_field_index("text"))):
                n.append(np.diff(ta.words(data, off)[2]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n), pa.int64())], names=[*b.schema.names, "size"])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("size", T.LongType())]))


def catalogue(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, rank, source_size, target of each source of sizes (source, size); no row of it comes to the driver.

    rank is the source's place by code point, null last; weights[rank % len] is its weight.  Targets share the sum of all
    sizes by weight, none above `most` times its source's size, the excess reshared among the others: target = min(most *
    size, level * weight).  In the order of size / weight the sources that are capped come first, so the level follows from
    the running totals of sizes and weights: it is what the rest has left, at the first source that stays below its cap.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rows = store(rows.withColumn("_all", F.lit(0).cast("long")).withColumn("_one", F.lit(1).cast("long")).withColumn("_null", F.col("source").isNull()), "mix-sources")
    ranked = running_total(rows, "_all", ["_null", "source"], "_one", "rank", "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = store(ranked.withColumn("weight", weight).withColumn("_order", F.col("source_size") / weight), "mix-weights")
    total, whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    below = running_total(ranked, "_all", ["_order", "rank"], ["source_size", "weight"], ["_sizes", "_weights"], "mix-below")
    # if all sources before this one are capped: what a unit of weight gets of the rest, which includes this source
    level = (F.lit(float(total)) - most * F.col("_sizes")) / (F.lit(whole) - F.col("_weights"))
    levels = below.withColumn("_level", level).filter(F.col("_level") * F.col("weight") <= most * F.col("source_size"))
    first = levels.agg(F.min_by("_level", F.struct("_order", "rank"))).first()[0]
    cap = F.lit(float(most)) * F.col("source_size")
    target = cap if first is None else F.least(cap, F.lit(first) * F.col("weight"))
    return store(ranked.select("source", "rank", "source_size", target.alias("target")), "mix-catalogue")


def draw(quota: int, shards: int, key: list[int]) -> np.ndarray:
    """How many of a source's slots each output shard has: a multinomial draw, so that a shard's counts of all sources are
    multinomial by what the sources give in all, and the totals are met."""
    return np.random.default_rng(key).multinomial(quota, np.full(shards, 1 / shards))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, at i: a Feistel cipher that walks its cycle until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            h, m, y = half[todo], mask[todo], x[todo]
            left, right = y >> h, y & m
            for r in range(4):
                left, right = right, left ^ (ta.mix(right + key[todo] + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & m)
            x[todo] = (left << h) | right
            todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


def _with_blocks(sources: DataFrame, block: int) -> DataFrame:
    """sources with blocks (how many), low (words of a block; the first `longer` blocks have one more) and quota (slots)."""
    n = F.col("source_size")
    blocks = F.greatest(F.ceil(n / block), F.least(n, F.lit(LEAST_BLOCKS))).cast("long")
    out = sources.withColumn("blocks", blocks)
    some = F.greatest(F.col("blocks"), F.lit(1))
    low = F.expr("source_size div greatest(blocks, 1)")
    quota = F.least(MOST_REPEATS * F.col("blocks"), F.round(F.col("target") / F.greatest(n, F.lit(1)) * F.col("blocks")).cast("long"))
    return out.withColumn("low", low).withColumn("longer", n % some).withColumn("quota", quota)


def _met(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """sizes with the columns of their source; a long catalogue meets each source's rows in SPLITS parts."""
    s = sources.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).drop("source")
    d = sizes.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    if n_sources * 160 <= 32 << 20:
        return d.join(F.broadcast(s), ["_s", "_n"]).drop("_s", "_n")
    s = s.withColumn("_k", F.explode(F.expr(f"sequence(0, {SPLITS - 1})")))
    d = d.withColumn("_k", F.pmod(F.xxhash64("doc_id", "size", F.monotonically_increasing_id()), F.lit(SPLITS)).cast("int"))
    return d.join(s.hint("merge"), ["_s", "_n", "_k"]).drop("_s", "_n", "_k")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, pieces, slots) of the mix.

    placed: the columns of docs but text, with size, rank, source_size, target and at (the words of its source before it).
    pieces: the parts of documents that make up each block: rank, at, block, first (word in the document), words.
    slots: the blocks of each output shard in order: shard, slot, rank, block.

    The words of a source, by doc_id and size, are cut into blocks of `block` words (shorter by at most one word where they
    don't come out even; a source of less than LEAST_BLOCKS such blocks has shorter ones, down to a word, so that its target
    is met as well).  Each source gets target / size of its blocks as slots, and each output shard draws how many of them it
    holds; a source's i-th slot takes the block that a permutation, another one for each pass through the source, gives for
    i.  No block is taken more than MOST_REPEATS times.
    Nulls: a null text has no words; a null source is a source, the last; a null doc_id is a document.  Repeated rows
    are documents of their own; which of two that are alike in doc_id and size comes first is settled by their place in the
    files.  Texts are counted whole, whatever their length.  No documents, no rows.  docs has doc_id, source and text, or
    size in place of text; a clashing column is replaced.
    """
    sizes = (docs if "text" not in docs.columns else word_counts(docs.drop("size"))).drop("rank", "source_size", "target", "at", "blocks", "low", "longer", "quota")
    sizes = store(sizes.drop("text"), "mix-sizes")
    sources = store(_with_blocks(catalogue(sizes, weights), block), "mix-blocks")
    n_sources = sources.count()
    met = _met(sizes, sources.select("source", "rank", "source_size", "target", "blocks", "low", "longer"), n_sources)
    order = ["doc_id", "size"] + [_ROW] * (_ROW in met.columns)
    placed = running_total(store(met, "mix-met"), "rank", order, "size", "at", "mix-at")
    edge = "longer * (low + 1)"  # the words in the longer blocks
    of = lambda w: f"if({w} < {edge}, ({w}) div (low + 1), longer + ({w} - {edge}) div greatest(low, 1))"
    start = lambda b: F.expr(f"{b} * low + least({b}, longer)")
    pieces = (
        placed.filter("size > 0")
        .select("rank", "at", "size", "low", "longer", F.explode(F.expr(f"sequence({of('at')}, {of('at + size - 1')})")).alias("block"))
        .withColumn("first", F.greatest(F.lit(0), start("block") - F.col("at")))
        .withColumn("words", F.least(F.col("size"), start("(block + 1)") - F.col("at")) - F.col("first"))
        .select("rank", "at", "block", "first", "words")
    )

    def runs(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = draw(r["quota"], shards, [seed, r["rank"]])
                out += [(k, r["rank"], int(i - c), int(c), r["blocks"]) for k, (c, i) in enumerate(zip(n, np.cumsum(n), strict=True)) if c]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["shard", "rank", "first", "n", "blocks"])

    drawn = sources.select("rank", "blocks", "quota").filter("quota > 0").mapInArrow(runs, "shard long, rank long, first long, n long, blocks long")
    drawn = running_total(store(drawn, "mix-draws"), "shard", ["rank"], "n", "at", "mix-shards")
    per_row = 1 << 16
    spark = docs.sparkSession
    drawn = drawn.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {per_row}L)"))).repartition(partitions(spark), "shard", "rank", "part")

    def slots(batches):
        for b in batches:
            for r in b.to_pylist():
                i = np.arange(r["part"] * per_row, min(r["n"], (r["part"] + 1) * per_row))
                of, n = i + r["first"], r["blocks"]
                with np.errstate(over="ignore"):
                    key = ta.mix(np.uint64(seed) + np.uint64(r["rank"]) * np.uint64(1 << 32) + (of // n).astype(np.uint64))
                got = permuted(of % n, np.full(len(i), n), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), r["shard"], np.int32)), pa.array(i + r["at"]), pa.array(np.full(len(i), r["rank"], np.int64)), pa.array(got)],
                    names=["shard", "slot", "rank", "block"],
                )

    return placed.drop("blocks", "low", "longer"), pieces, drawn.mapInArrow(slots, "shard int, slot long, rank long, block long")


def taken_blocks(slots: DataFrame) -> DataFrame:
    """rank, block, times: how often the mix takes each block."""
    return slots.groupBy("rank", "block").agg(F.count("*").alias("times"))


def op9_mixing(spark, sf_dir) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed, pieces, slots = plan(docs)
    taken = pieces.join(taken_blocks(slots).hint("merge"), ["rank", "block"]).groupBy("rank", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    whole = placed.join(taken.withColumn("_n", F.lit(True)), (placed["rank"] == taken["rank"]) & (placed["at"] == taken["at"]) & (placed["size"] > 0), "left")
    return whole.select(placed["doc_id"].cast("long").alias("doc_id"), placed["size"], placed["source_size"], placed["target"], F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@lean
def _cut(batches):
    """texts of rows with text and parts (first, words, times): the c-th holds the words that are taken c times or more, each
    with the space that follows it, and the space before the first word."""
    for b in batches:
        out, all_parts = [], b.column(b.schema.get_field_index("parts")).to_pylist()
        for i, data, off in ta.chunks(b.column(b.schema.get_field_index("text"))):
            starts, _, before = ta.words(data, off)
            for k in range(len(off) - 1):
                raw, parts = data[off[k] : off[k + 1]], sorted(all_parts[i + k], key=lambda p: p["first"])
                at = np.r_[starts[before[k] : before[k + 1]] - off[k], len(raw)]
                at[0] = 0
                out.append(
                    [
                        b"".join(raw[at[p["first"]] : at[p["first"] + p["words"]]].tobytes() for p in parts if p["times"] >= c).decode()
                        for c in range(1, max(p["times"] for p in parts) + 1)
                    ]
                )
        keep = [n for n in b.schema.names if n not in ("text", "parts")]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + [pa.array(out, pa.list_(pa.string()))], names=[*keep, "texts"])


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents (doc_id, text, lang, source, n_chars): a row for each time that some of its words are taken.

    Row c of a document holds, in order, the words of its blocks that are taken at least c times, with the white space that
    follows them: a document that is taken whole has its text.  A document of which nothing is taken has no row.  Rows are
    placed and drawn by their sizes; the texts are moved once, to the rows that are taken.
    """
    docs = docs.select("doc_id", "text", "lang", "source")
    whole = store(word_counts(docs).withColumn(_ROW, F.monotonically_increasing_id()), "mix-texts")
    placed, pieces, slots = plan(whole.select(_ROW, "doc_id", "source", "size"), **options)
    parts = pieces.join(taken_blocks(slots).hint("merge"), ["rank", "block"]).groupBy("rank", "at").agg(F.collect_list(F.struct("first", "words", "times")).alias("parts"))
    taken = placed.filter("size > 0").select(_ROW, "rank", "at").join(parts.hint("merge"), ["rank", "at"]).select(_ROW, "parts")
    cut = whole.drop("size").join(taken.hint("merge"), _ROW).select("doc_id", "lang", "source", "text", "parts")
    schema = T.StructType([f for f in cut.schema.fields if f.name not in ("text", "parts")]).add("texts", T.ArrayType(T.StringType()))
    return cut.mapInArrow(_cut, schema).select("doc_id", F.explode("texts").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
