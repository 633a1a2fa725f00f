"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles over its features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import lean, table

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5

# Classes of bytes; what is in none of them, ASCII letters and digits among it, is left to its own class.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\x0b\f\r", "newline": b"\n", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "quote": b"'\"-()"}
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(CLASSES) + 1
_N = len(CLASSES) + 2
FEATURES = ("bytes", "words", "word_bytes", "line_words", *CLASSES, "symbol", "wide", "capital_words", "repeats", "distinct", "pair_distinct")


def features_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a chunk."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * _N + _CLASS[data], minlength=n * _N).reshape(n, _N).astype(float)
    s, e, before = ta.words(data, off)
    words = np.diff(before)
    h = ta.word_hashes(data, s, e)
    of = np.repeat(np.arange(n), words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])

    def distinct(hashes, owners):
        key = np.sort((owners.astype(np.uint64) << ta.U(40)) | (hashes >> ta.U(24)))
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        return np.bincount((key[new] >> ta.U(40)).astype(np.int64), minlength=n)

    with np.errstate(over="ignore"):
        pairs = ta.mix(h[:-1] * ta.U(3) + h[1:])
    within = of[1:] == of[:-1]
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    capital = np.bincount(of[(_CLASS[data[s]] == 0) & (_CLASS[data[e - 1]] != 1)], minlength=n) if len(s) else np.zeros(n)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            size * per_word,
            words / (counts[:, list(CLASSES).index("newline")] + 1),
            counts * per_byte[:, None],
            capital * per_word,
            np.bincount(of[same], minlength=n) * per_word,
            distinct(h, of) * per_word,
            distinct(pairs[within], of[1:][within]) / np.maximum(words - 1, 1),
        ]
    )


@dataclass
class Additive:
    """Bin edges, a lookup table for each feature and for each pair of features (on coarser bins), and a constant."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    constant: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        if not len(x) or not self.tables:
            return out
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _steps(g: np.ndarray, h: np.ndarray, ridge: float, depth: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins, as the value of each bin, from sums of gradients and weights."""
    G, H = g.sum(), h.sum()
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + ridge) + (G - a) ** 2 / (H - b + ridge) - G * G / (H + ridge)
        gain[(b < least) | (H - b < least)] = -1
        k = int(gain.argmax()) + 1
        if gain[k - 1] > 1e-6:
            return np.r_[_steps(g[:k], h[:k], ridge, depth - 1, least), _steps(g[k:], h[k:], ridge, depth - 1, least)]
    return np.full(len(g), G / (H + ridge))


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut of each feature over a grid of bins: its values, and its gain."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H, best, cut = a[-1, -1], b[-1, -1], 0.0, None
    part = lambda m: (m[:-1, :-1], m[:-1, -1:] - m[:-1, :-1], m[-1:, :-1] - m[:-1, :-1], m[-1, -1] - m[:-1, -1:] - m[-1:, :-1] + m[:-1, :-1])
    if min(g.shape) > 1:
        gain = sum(p * p / (q + ridge) for p, q in zip(part(a), part(b), strict=True)) - G * G / (H + ridge)
        k = np.unravel_index(int(gain.argmax()), gain.shape)
        best, cut = float(gain[k]), (int(k[0]) + 1, int(k[1]) + 1)
    out = np.zeros_like(g)
    if cut:
        for rows in (slice(None, cut[0]), slice(cut[0], None)):
            for cols in (slice(None, cut[1]), slice(cut[1], None)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 8, rounds: int = 80, pairs: int = 8, rate: float = 0.15, depth: int = 2, ridge: float = 2.0, least: float = 1.0) -> Additive:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on what all others leave unexplained.

    Then the pairs whose best tree gains most on the residuals are boosted likewise, on coarser bins.  With no rows, or
    rows of one class, the model is a constant.
    """
    rest = len(y) and 0 < y.mean() < 1
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    if not rest:
        return Additive([], [], [], [], [], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    constant = float(np.log(p / (1 - p)))
    margin = np.full(len(y), constant)

    def slopes():
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for b, t in zip(at, tables, strict=True):
            g, h = slopes()
            step = rate * _steps(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), ridge, depth, least)
            t += step
            margin += step[b]
    small = [np.arange(len(t)) * coarse // len(t) if len(t) > coarse else np.arange(len(t)) for t in tables]
    low = [s[b] for s, b in zip(small, at, strict=True)]
    width = [int(s[-1]) + 1 for s in small]

    def grid(i, j, v):
        return np.bincount(low[i] * width[j] + low[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    gains = sorted(((_quarters(grid(i, j, g), grid(i, j, h), ridge)[1], i, j) for i in range(len(at)) for j in range(i)), reverse=True)
    chosen = [(i, j) for _, i, j in gains[:pairs]]
    pair_tables = [np.zeros((width[i], width[j])) for i, j in chosen]
    for _ in range(rounds // 2):
        for (i, j), t in zip(chosen, pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quarters(grid(i, j, g), grid(i, j, h), ridge)[0]
            t += step
            margin += step[low[i], low[j]]
    return Additive(edges, tables, small, chosen, pair_tables, constant)


def _held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def with_features(docs: DataFrame) -> DataFrame:
    """docs with features (of each whole text; a null one is empty) in place of text; a column of that name is replaced."""
    docs = docs.drop("features")

    @lean
    def find(batches):
        for b in batches:
            rows = [np.zeros((0, len(FEATURES)))]
            for _, data, off in ta.chunks(b.column(b.schema.get_field_index("text"))):
                rows.append(features_of(data, off))
            x = np.concatenate(rows)
            got = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), got], names=[*keep, "features"])

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(find, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """The model of labels.quality from at most `sample` labelled documents outside the held-out fold: those with the
    lowest hashes of doc_id.  Labels that are null or neither 0 nor 1 are passed over; of two for one document the lower counts."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)")
        .filter(~_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    got = with_features(rows).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    got.sort(key=lambda r: (r["doc_id"], r["features"]))
    return fit(np.array([r["features"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["quality"] for r in got], float))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with score (0 to 1, higher: better), by additions of table entries.

    Nulls: a null text is empty; a null doc_id is a document (op2_quality counts it as held out: its label could not be used).
    Texts of any length are scored whole, one at a time; equal texts have equal scores, and repeated rows a row each.  No
    documents, no rows.  Other columns stay; one named score is replaced.
    """
    docs = docs.drop("score")

    @lean
    def add(batches):
        for b in batches:
            out = [np.zeros(0)]
            for _, data, off in ta.chunks(b.column(b.schema.get_field_index("text"))):
                out.append(model.score(features_of(data, off)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op2_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
