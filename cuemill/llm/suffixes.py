"""Exact substring dedup: a content-defined difference cover, named and compared like sampled suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import lean, running_total, store, table

LENGTH = 100
GRAM = 32
SEGMENT = 4 << 20  # bytes of one long text that are held at a time
FLUSH = 1 << 20
HOT_CLASS = 4096
_LOWEST = -(2**63)
_PLACE = ta.U((1 << 24) - 1)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, ta.U)
    np.cumsum(ta._VALUES[data] * ta._power("up", len(data)), out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed=0) -> np.ndarray:
    return ta.mix((sums[end] - sums[start]) * ta._power("down", len(sums))[start] + ta.U(0x9E37) * (end - start).astype(ta.U) + np.asarray(seed, ta.U))


def cells(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, a, b, place, g, c) of the cells of a chunk of texts: the runs of windows of `length` bytes with one sample.

    The sample of a window is the place in it of the gram with the least hash, the leftmost of equals: a function of the
    window's bytes, so equal windows take alike samples - what the residues of a difference cover give two suffixes only
    after a shift.  Windows starting at a..b have the sample at place; g names its gram, c all bytes of the cell and the
    place in them.
    """
    n, span = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, ta.U),) * 2
    if n < length:
        return none
    with np.errstate(over="ignore"):
        sums = _prefix_sums(data)
        i = np.arange(n - gram + 1)
        g = _hashes(sums, i, i + gram)
        low = (g & ~_PLACE) | i.astype(ta.U)
        have = 1
        while have < span:  # least over `have` places, doubled up to the span
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        place = (low & _PLACE).astype(np.int64)  # of each window start 0..n-length
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
        fits = np.arange(len(place)) + length <= off[text + 1]
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]] & fits
        a = np.flatnonzero(new)
        if not len(a):
            return none
        last = np.r_[~(fits[1:] & ~new[1:]), True] & fits
        b = np.flatnonzero(last)
        p = place[a]
        return text[a], a, b, p, g[p], _hashes(sums, a, b + length, (p - a).astype(ta.U) * ta.U(0xBF58476D1CE4E5B9))


def _segments(col: pa.Array, length: int):
    """(row, base, bytes, offsets) of runs of texts; one text longer than SEGMENT comes in pieces that overlap by length - 1."""
    for first, data, off in ta.chunks(col):
        if len(data) <= SEGMENT:
            yield first, 0, data, off
            continue
        for k in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[k : k + SEGMENT + length - 1]
            yield first, k, part, np.array([0, len(part)])


def _merge_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Ranges of window starts, sorted by document and start, with ranges that touch made one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)])
    return doc[cut], lo[cut], np.maximum.reduceat(hi, cut)


_NAMES = ["kind", "key", "c", "doc", "a", "b", "p"]
_SHAPE = "kind int, key long, c long, doc long, a long, b long, p long"
GONE, CELL = 0, 1


def _rows(kind, key, c, doc, a, b, p):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (key, c, doc, a, b, p))], names=_NAMES)


def _firsts(g, c, doc, a, b, p):
    """Sorts cells by name, then place in the corpus; says which are the first of their name."""
    order = np.lexsort((a, doc, c, g))
    g, c, doc, a, b, p = (x[order] for x in (g, c, doc, a, b, p))
    first = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])] if len(g) else np.zeros(0, bool)
    return first, g, c, doc, a, b, p


def _gone(doc, a, b):
    """Rows of ranges that are known to repeat; dealt out by document."""
    doc, a, b = _merge_runs(doc, a, b)
    z = np.zeros(len(doc), np.int64)
    return _rows(GONE, ta.mix(doc.view(np.uint64)).view(np.int64), z, doc, a, b, z)


def _sampled(length, gram):
    def step(batches):
        held, n = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            first, g, c, doc, a, b, p = _firsts(*cols)
            yield _gone(doc[~first], a[~first], b[~first])  # an equal cell of this task stands before them
            yield _rows(CELL, g[first], c[first], doc[first], a[first], b[first], p[first])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, base, data, off in _segments(batch.column(1), length):
                text, a, b, p, g, c = cells(data, off, length, gram)
                start = off[text] - base
                held.append((g.view(np.int64), c.view(np.int64), ids[row + text], a - start, b - start, p - start))
                n += len(a)
                if n > FLUSH:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return lean(step)


def _named(batches):
    """Of cells sorted by (key, c, doc, a): later cells of a name are gone; the firsts of a gram with several names go on.

    In the rows that go on, c is the number of names that their gram has, or HOT_CLASS + 1 if there are more: once that many
    are held for one gram they leave as they come, so what is held does not grow with a gram's names.
    """
    held, hot = None, None

    def gone(cols):
        """Passes on what is known to be gone, drops later cells of a name, and gives the firsts."""
        kind, key, c, doc, a, b, p = cols
        cell = kind == CELL
        out = [_rows(GONE, *(x[~cell] for x in cols[1:]))]
        cols = [x[cell] for x in cols]
        key, c = cols[1], cols[2]
        first = np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1])] if len(key) else np.zeros(0, bool)
        out.append(_gone(*(cols[k][~first] for k in (3, 4, 5))))
        return out, [x[first] for x in cols]

    def go(cols, many):
        _, key, _, doc, a, b, p = cols
        return _rows(CELL, key, many, doc, a, b, p)

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(7)]
        if held is not None:
            cols = [np.r_[h, x] for h, x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        out, cols = gone(cols)
        yield from out
        key = cols[1]
        if not len(key):
            held = cols
            continue
        if hot is not None:  # names of a gram that is known to be hot; its last one stays, to know it again
            end = int(np.searchsorted(key, hot, side="right"))
            if end:
                yield go([x[1:end] for x in cols], np.full(end - 1, HOT_CLASS + 1))
                cols = [np.r_[x[end - 1 : end], x[end:]] for x in cols]
                if end < len(key):
                    cols = [x[1:] for x in cols]
                    hot = None
            key = cols[1]
        if hot is None and len(key):
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                start = np.flatnonzero(np.r_[True, key[1:cut] != key[: cut - 1]])
                names = np.diff(np.r_[start, cut])
                many = np.minimum(np.repeat(names, names), HOT_CLASS + 1)
                yield go([x[:cut][many > 1] for x in cols], many[many > 1])
                cols = [x[cut:] for x in cols]
            if len(cols[0]) > max(HOT_CLASS, 1):
                hot = cols[1][-1]
                yield go(cols, np.full(len(cols[0]), HOT_CLASS + 1))
                cols = [x[-1:] for x in cols]
        held = cols
    if held is not None and len(held[0]) and hot is None:
        many = np.full(len(held[0]), min(len(held[0]), HOT_CLASS + 1))
        if len(held[0]) > 1:
            yield go(held, many)


def _contents(length):
    """Text rows with their open cells: the bytes of each cell under its gram's name; the windows of hot grams one by one, by
    two hashes of 64 bits."""
    names = ["kind", "key", "doc", "a", "content"]

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = [], [], [], [], []
            docs, texts, lists = batch.column(at("doc")).to_pylist(), batch.column(at("text")), batch.column(at("cells")).to_pylist()
            for k, (doc, found) in enumerate(zip(docs, lists, strict=True)):
                if not found:
                    continue
                raw = (texts[k].as_py() or "").encode()
                hot = [x for x in found if x["c"] > HOT_CLASS]
                for x in found:
                    if x["c"] <= HOT_CLASS:
                        for col, v in zip(out, (CELL, x["key"], doc, x["a"], raw[x["a"] : x["b"] + length]), strict=True):
                            col.append(v)
                for x in hot:
                    part = np.frombuffer(raw[x["a"] : x["b"] + length], np.uint8)
                    i = np.arange(len(part) - length + 1)
                    with np.errstate(over="ignore"):
                        h = _hashes(_prefix_sums(part), i, i + length).view(np.int64)
                    for k, w in zip(i.tolist(), h.tolist(), strict=True):
                        own = xxhash.xxh3_64_digest(part[k : k + length].tobytes())
                        for col, v in zip(out, (GONE, w, doc, k + x["a"], own), strict=True):
                            col.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for s in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)], t) for c, t in zip(out, kinds, strict=True)], names=names)

    return lean(step)


def _compared(length):
    """Of windows sorted by name and place, all but the first: those of cells within their gram's class, single ones by hash."""

    def ranges(doc, a):
        doc, lo, hi = _merge_runs(doc, a, a)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, lo, hi)], names=["doc", "a", "b"])

    def step(batches):
        held, last, met = None, None, set()

        def settle(key, doc, a, content):
            sizes = np.array([len(x) for x in content], np.int64)
            data = np.frombuffer(b"".join(content), np.uint8)
            base = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            of = np.repeat(np.arange(len(content)), windows)
            shift = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            i = base[of] + shift
            with np.errstate(over="ignore"):
                h = _hashes(_prefix_sums(data), i, i + length)
            owner, start = doc[of], a[of] + shift
            order = np.lexsort((start, owner, h, key[of]))
            k, h = key[of][order], h[order]
            again = np.r_[False, (k[1:] == k[:-1]) & (h[1:] == h[:-1])]
            return ranges(owner[order][again], start[order][again])

        for batch in batches:
            kind, key, doc, a = (batch.column(k).to_numpy() for k in range(4))
            single = kind == GONE
            if single.any():
                k, d, s = key[single], doc[single], a[single]
                again = np.zeros(len(k), bool)
                for i, (w, own) in enumerate(zip(k.tolist(), batch.column(4).filter(pa.array(single)).to_pylist(), strict=True)):
                    if w != last:
                        last, met = w, set()
                    again[i] = own in met
                    met.add(own)  # one, but for windows whose first hashes collide
                yield ranges(d[again], s[again])
            if not single.all():
                now = [key[~single], doc[~single], a[~single], [x for x, y in zip(batch.column(4).to_pylist(), single, strict=True) if not y]]
                if held is not None:
                    now = [np.r_[h, x] if isinstance(x, np.ndarray) else h + x for h, x in zip(held, now, strict=True)]
                cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
                held = [x[cut:] for x in now]
                if cut:
                    yield settle(*(x[:cut] for x in now))
        if held is not None:
            yield settle(*held)

    return step


def _apply(length):
    """Texts without their gone ranges, joined range by range: nothing as long as a text but the text is held."""

    def step(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = []
            texts, lists = batch.column(at("text")), batch.column(at("ranges")).to_pylist()
            for k, found in enumerate(lists):
                raw = (texts[k].as_py() or "").encode()
                spans: list[list[int]] = []
                for x in sorted((x["a"], x["b"] + length) for x in found or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), [{"start": s, "end": e} for s, e in spans], kept))
            cols = list(zip(*out, strict=True)) or [()] * 4
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(at("doc_id")), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), span, pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return lean(step)


def drop_repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, byte offsets), kept (the remaining bytes) of every row of documents.

    A byte goes if a string of `length` bytes over it also starts earlier: in a smaller doc_id, or before it in its own.

    1. Sample: of the suffixes starting in each window of `length` bytes, one; equal windows sample alike.
    2. Name the cells (all windows of one sample); sort names.  A cell whose name is not the first is gone whole.
    3. Only samples whose gram has several names are open: their windows are compared in the order of their place, a
       gram's class together, or one by one where the class is hot.
    Equal cells of one task leave one row before the shuffle, so passages that a third of all documents share weigh as
    much as there are tasks.  The text is shuffled by document twice: to its open cells, and to what is cut from it.
    Nulls: a null text is empty; a null doc_id is the smallest.  Rows with one doc_id are documents ordered by a hash of
    their text; equal ones, in any order, repeat each other.  Long texts are searched in overlapping segments.  No
    documents, no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"))
    n, distinct = rows.agg(F.count("*"), F.count_distinct("doc")).first()
    if n > distinct:
        tied = rows.drop("doc").withColumn("_all", F.lit(0).cast("long")).withColumn("_one", F.lit(1).cast("long")).withColumn("_hash", F.xxhash64("text"))
        rows = running_total(tied, "_all", ["doc_id", "_hash"], "_one", "doc", "suffix-rows").select("doc_id", "text", "doc")
    sampled = rows.select("doc", "text").mapInArrow(_sampled(length, gram), _SHAPE)
    named = sampled.repartition("key").sortWithinPartitions("key", "kind", "c", "doc", "a").mapInArrow(_named, _SHAPE)
    named = store(named, "suffix-names")
    opened = named.filter(F.col("kind") == CELL).groupBy("doc").agg(F.collect_list(F.struct("key", "c", "a", "b")).alias("cells"))
    with_cells = rows.join(opened.hint("merge"), "doc", "left").select("doc", "text", "cells")
    contents = with_cells.mapInArrow(_contents(length), "kind int, key long, doc long, a long, content binary")
    compared = contents.repartition("key").sortWithinPartitions("kind", "key", "doc", "a").mapInArrow(_compared(length), "doc long, a long, b long")
    gone = named.filter(F.col("kind") == GONE).select("doc", "a", "b").union(compared)
    ranges = gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    whole = rows.join(ranges.hint("merge"), "doc", "left").select("doc_id", "text", "ranges")
    return whole.mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def op7_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = drop_repeated_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
