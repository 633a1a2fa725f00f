"""Source divergence audit: how the term shares of sources differ, and which terms make a source stand out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, store, table
from .ranking import by_group, top_by_group

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
BLOCK = 512  # sources of a language that one tile has on either side
LEAST_PART = 1 << 12  # rows of a part of a tile, at least
HELD = 200_000  # terms that a task counts before it hands them on
PIECE = 1 << 22  # bytes of a text that are split at a time
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about PIECE bytes that end where no term does."""
    at = 0
    while len(raw) - at > PIECE:
        gap = _GAP.search(raw, at + PIECE)
        if not gap:
            break
        yield raw[at : gap.start()]
        at = gap.end()
    yield raw[at:] if at else raw


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); and for each group (lang, source) a row with term '' and n 0.

    Terms are the runs of letters A-Z (as a-z) and of characters beyond ASCII in the whole text.  Each task adds up
    what it meets before the one shuffle, so a term of every document weighs as much as there are tasks.
    """

    @lean
    def count(batches):
        held: dict = {}

        def flushed():
            rows = [(lang, source, t.decode(), n, d[t]) for (lang, source), (c, d) in held.items() for t, n in c.items()]
            rows += [(lang, source, "", 0, 0) for lang, source in held]
            held.clear()
            for i in range(0, len(rows), 1 << 16):
                cols = list(zip(*rows[i : i + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["lang", "source", "term", "n", "docs"])

        size = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                c, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(c), set()
                for piece in _pieces((text or "").encode().lower()):
                    words = _TERM.findall(piece)
                    c.update(words)
                    own.update(words)
                d.update(own)
                size += len(c) - before
            if size > HELD:
                yield from flushed()
                size = 0
        yield from flushed()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH)
    return F.lit(1).cast("long") + F.call_function("div", scaled, wide(total + SMOOTH * terms)).cast("long")


def _tile_sums(block: int):
    """From the rows (lang, lo, hi, part, term, source, gi, p) of each tile part, sorted: for each pair of its sources the sum
    over its terms of what |p - q| exceeds the distance of the two baselines by; part 0 adds that distance for all `terms`.

    A tile has the sources of block lo on one side and of block hi on the other.  Its first rows (term '') are all of its
    sources, with their baselines as p.  A term that one of two sources has counts against the baseline of the other; if
    both have it, what was counted twice is taken back and the distance of the two shares put in its place.
    """

    def run(batches):
        key, tile = None, None
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            lang = cols["lang"].dictionary_encode()
            keys = np.stack([lang.indices.to_numpy(), *(cols[n].to_numpy() for n in ("lo", "hi", "part"))], 1).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
            for i, j in zip(cut, [*cut[1:], len(keys)], strict=True):
                now = (lang.dictionary[int(keys[i, 0])].as_py(), *keys[i, 1:].tolist())
                if now != key:
                    if tile:
                        yield from tile.sums()
                    key, tile = now, _Tile(block, *now)
                tile.add(*(cols[n].slice(i, j - i) for n in ("term", "source", "gi", "p", "terms")))
        if tile:
            yield from tile.sums()

    return run


class _Tile:
    """Sums of one part of a tile, as batches of its rows come."""

    def __init__(self, block: int, lang: str, lo: int, hi: int, part: int):
        self.block, self.lang, self.lo, self.hi, self.part = block, lang, lo, hi, part
        self.names: dict[int, str] = {}
        self.base: dict[int, int] = {}
        self.ready, self.terms, self.tail = False, 0, None

    def add(self, term, source, gi, p, terms) -> None:
        gi, p = gi.to_numpy(), p.to_numpy()
        heads = int(np.sum(source.is_valid().to_numpy(zero_copy_only=False)))  # they come first
        if heads:
            self.names.update(zip(gi[:heads].tolist(), source.slice(0, heads).to_pylist(), strict=True))
            self.base.update(zip(gi[:heads].tolist(), p[:heads].tolist(), strict=True))
            self.terms = terms[0].as_py()
        if heads == len(gi):
            return
        if not self.ready:
            self.ids = np.array(sorted(self.base))
            self.b = np.array([self.base[k] for k in self.ids.tolist()])
            self.m = np.zeros((len(self.ids), len(self.ids)), np.int64)
            self.ready = True
        code = term.slice(heads).dictionary_encode().indices.to_numpy()
        at, p = np.searchsorted(self.ids, gi[heads:]), p[heads:]
        words = term.slice(heads)
        # a term may go on in the next batch: its rows so far are met with those of the next
        last, first = words[len(words) - 1].as_py(), words[0].as_py()
        self._one_sided(at, p)
        if self.tail and self.tail[0] == first:
            at, p, code = np.r_[self.tail[1], at], np.r_[self.tail[2], p], np.r_[np.zeros(len(self.tail[1]), code.dtype), code]
            skip = len(self.tail[1])
        else:
            skip = 0
        self._met(at, p, code, skip)
        own = code == code[-1]
        self.tail = (last, at[own], p[own])

    def _one_sided(self, at: np.ndarray, p: np.ndarray) -> None:
        """Adds, for each source and each other, the sum of |p - baseline of the other| - |own baseline - baseline of the other|."""
        order = np.lexsort((p, at))
        at, p = at[order], p[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for i, j in zip(start, [*start[1:], len(at)], strict=True):
            x, a = p[i:j], int(at[i])
            total = np.r_[0, np.cumsum(x)]
            below = np.searchsorted(x, self.b, side="right")
            far = total[-1] - 2 * total[below] + (2 * below - len(x)) * self.b
            self.m[a] += far - len(x) * np.abs(self.b[a] - self.b)

    def _met(self, at: np.ndarray, p: np.ndarray, code: np.ndarray, skip: int) -> None:
        """For each two rows of one term, of which the later is not among the first `skip`: puts the distance of the shares in place."""
        n, b = len(self.ids), self.b
        flat = self.m.reshape(-1)
        for k in range(1, n):
            same = code[k:] == code[:-k]
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[i + k >= skip]
            x, y = at[i], at[i + k]
            c = np.abs(p[i] - p[i + k]) - np.abs(p[i] - b[y]) - np.abs(b[x] - p[i + k]) + np.abs(b[x] - b[y])
            np.add.at(flat, x * n + y, c)

    def sums(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.ids = np.array(sorted(self.base))
            self.b = np.array([self.base[k] for k in self.ids.tolist()])
            self.m = np.zeros((len(self.ids), len(self.ids)), np.int64)
        m = self.m + self.m.T
        if self.part == 0:
            m = m + self.terms * np.abs(self.b[:, None] - self.b[None, :])
        block = self.ids // self.block
        x, y = np.nonzero((block[:, None] == self.lo) & (block[None, :] == self.hi) & (self.ids[:, None] != self.ids[None, :]))
        names = pa.array([self.names[k] for k in self.ids.tolist()], pa.string())
        for i in range(0, len(x), 1 << 16):
            a, c = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(a)), names.take(pa.array(a)), names.take(pa.array(c)), pa.array(np.full(len(a), self.lo < self.hi)), pa.array(m[a, c])], names=["lang", "a", "b", "cross", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, least_part: int = LEAST_PART) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms) of docs (lang, source, text): lang, source, item, value, rank.

    A document is a row.  A language keeps the terms that min_docs of its documents or more hold; V is their number.  A group
    (lang, source), or a whole language, gives a kept term the share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)),
    where N is the sum of its counts of kept terms.  pairs: each other source of the language, by the sum of |p - q| over all
    kept terms.  terms: the `top` terms that the group has, and gives a larger share than its language does, by p - q.

    Only counts above zero are rows.  Of a term that a source lacks it gives the baseline share, so the distance of two
    sources is V times that of their baselines, and corrections for the terms that one or both have (_tile_sums).  Terms
    are dealt out by hash, in parts, and sources in blocks, so neither a language nor a source comes to one task, and what a
    task gives for a tile is no more than it has read.  Ranks of terms are found by radix selection (ranking.top_by_group);
    those of pairs by sorting the sources of one group, which are as few as the result has rows for it.

    Nulls: a null lang, source or text is ''.  A group without terms, or a language that keeps none, has distances of what
    baselines give (0 if V is 0) and no terms.  Texts are read whole, in pieces.  Repeated rows are documents of their own;
    ties of value go by the item's UTF-8 bytes.  Other columns are not read.  No documents, no rows.
    """
    counts = store(term_counts(docs), "audit-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = store(kept.select("lang", "term", "whole"), "audit-kept")
    found = store(counts.filter("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-found")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("of_lang"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("of_group"), F.count("*").alias("rows"))
    groups = counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["of_group", "rows", "terms", "of_lang"])
    here = Window.partitionBy("lang")  # the sources of a language: a pair of any two of them is in the result
    groups = groups.withColumn("gi", F.row_number().over(here.orderBy("source")) - 1)
    groups = groups.withColumn("blocks", F.ceil(F.count("*").over(here) / block).cast("int"))
    part_rows = F.greatest(F.lit(least_part), F.pow(F.least(F.count("*").over(here), F.lit(block)), 2))
    groups = groups.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.sum("rows").over(here) / part_rows)).cast("int"))
    base = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("of_group"), F.greatest("terms", F.lit(1)))).otherwise(F.lit(1)).cast("long")
    groups = store(groups.withColumn("base", base), "audit-groups")
    n_groups = groups.count()

    met = by_group(found, groups.select("lang", "source", "of_group", "of_lang", "terms", "gi", "blocks", "parts"), ["lang", "source"], n_groups, "term", 256)
    shares = met.select("lang", "source", "term", "gi", "blocks", "parts", "terms", share(F.col("n"), F.col("of_group"), F.col("terms")).alias("p"), share(F.col("whole"), F.col("of_lang"), F.col("terms")).alias("q"))
    shares = store(shares, "audit-shares")

    own = F.expr(f"gi div {block}").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tile = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    rows = shares.select("lang", "term", "gi", "p", "terms", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), own.alias("block"), other)
    heads = groups.select("lang", "source", "gi", "base", "terms", own.alias("block"), "parts", other).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["lang", "lo", "hi", "part", "term", "source", "gi", "p", "terms"]
    rows = rows.select("*", *tile).withColumn("source", F.lit(None).cast("string")).select(*cols)
    heads = heads.select("*", *tile).withColumn("term", F.lit("")).withColumnRenamed("base", "p").select(*cols)
    dealt = heads.unionByName(rows).repartition("lang", "lo", "hi", "part").sortWithinPartitions("lang", "lo", "hi", "part", "term", "gi")
    sums = dealt.mapInArrow(_tile_sums(block), "lang string, a string, b string, cross boolean, value long").groupBy("lang", "a", "b", "cross").agg(F.sum("value").alias("value"))
    sums = store(sums, "audit-sums")
    turned = sums.filter("cross").select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")  # a tile of two blocks has one order
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(turned)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pairs.withColumn("rank", ranked)

    above = store(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "audit-above")
    return pairs, top_by_group(above, ["lang", "source"], "value", "item", top)


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    pairs, terms = audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(terms.withColumn("part", F.lit("term")).select(*cols))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM kept GROUP BY lang),
sets AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM sets LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (t.n + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (whole + 5)) // (l.n + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value
  FROM sets x JOIN sets y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN shares a ON a.lang = x.lang AND a.source = x.source
  LEFT JOIN shares b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
