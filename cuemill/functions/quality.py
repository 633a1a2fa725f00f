"""Repetition metrics of transcribed segments and the reasons to suspect them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, let, words

METRICS = ("word_count", "unique_ratio", "dominant_ratio", "bigram_ratio", "trigram_ratio")


@dataclass(frozen=True)
class Thresholds:
    repetition: float = 0.60
    compression: float = 2.4
    logprob: float = -1.0
    no_speech: float = 0.6
    min_words: int = 8


def repeated_ngrams(h: Column, n: int) -> Column:
    """The share of n-grams that repeat an earlier one: 1 - distinct / all; 0 for fewer than n words.

    h: the words' 64-bit hashes.  An n-gram is a hash of its words' hashes, so neighbours are zipped and no text is built.
    """
    last = F.size(h) - n + 1
    grams = h
    for k in range(1, n):
        grams = F.zip_with(F.slice(grams, F.lit(1), F.greatest(last + n - 1 - k, F.lit(0))), F.slice(h, F.lit(k + 1), F.greatest(last + n - 1 - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    return F.when(last < 1, F.lit(0.0)).otherwise((last - F.size(F.array_distinct(grams))) / last)


def most_frequent(h: Column) -> Column:
    """How often the most frequent of the hashes occurs: the longest run once they are sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["word"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("word"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(h), zero, step)["best"]


def metrics(text: Column) -> Column:
    """word_count, unique_ratio, dominant_ratio, bigram_ratio, trigram_ratio and repetition of a text, as a struct."""

    def measured(w):
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("word_count"),
            F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / n).alias("unique_ratio"),
            F.when(n == 0, 0.0).otherwise(most_frequent(w) / n).alias("dominant_ratio"),
            repeated_ngrams(w, 2).alias("bigram_ratio"),
            repeated_ngrams(w, 3).alias("trigram_ratio"),
        )

    whole = let(F.transform(words(text), lambda w: F.xxhash64(casefold(w))), measured)
    return let(whole, lambda m: F.struct(*[m[k].alias(k) for k in METRICS], F.greatest(m["dominant_ratio"], m["bigram_ratio"], m["trigram_ratio"]).alias("repetition")))


def _is(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def reasons(t: Thresholds = Thresholds()) -> Column:
    """The ordered reasons to suspect a segment, over word_count, repetition, compression_ratio, avg_logprob, no_speech_prob.

    Nulls raise no suspicion; silence alone does not either, only beside another of the last three.
    """
    repetition = _is((F.col("word_count") >= t.min_words) & (F.col("repetition") >= t.repetition))
    compression = _is(F.col("compression_ratio") > t.compression)
    logprob = _is(F.col("avg_logprob") < t.logprob)
    silence = _is(F.col("no_speech_prob") > t.no_speech) & (repetition | compression | logprob)
    found = (("empty", _is(F.col("word_count") == 0)), ("repetition", repetition), ("compression", compression), ("low_logprob", logprob), ("no_speech", silence))
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found]))


def candidate_key(t: Thresholds = Thresholds(), seq: str = "seq") -> Column:
    """What orders candidates, the least the best: suspicion, then how far each metric is off, then more unique words, then seq."""
    value = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0.0, F.lit(default)).otherwise(F.col(c))
    return F.struct(
        (F.size("reasons") > 0).alias("suspicious"),
        F.size("reasons").alias("n"),
        F.col("repetition").alias("repetition"),
        F.greatest(F.lit(0.0), value("compression_ratio", 0.0) - t.compression).alias("compression"),
        F.greatest(F.lit(0.0), t.logprob - value("avg_logprob", t.logprob)).alias("logprob"),
        F.greatest(F.lit(0.0), value("no_speech_prob", 0.0) - t.no_speech).alias("silence"),
        (-F.col("unique_ratio")).alias("unique"),
        F.col(seq).alias("seq"),
    )
