"""Duplicate media: exact, then by name, then by fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import IdentityRule, identity_score
from ..functions.names import name_similarity, token_jaccard
from .running import BROADCAST, stored

NAME_THRESHOLD = 0.82
#: Parts of a name's likeness: of the sequence ratio, and of the words' Jaccard similarity.
RATIO, WORDS = 0.65, 0.35
FEW_WORDS = 1 / 3  # words' Jaccard similarity, below which names are found by their letters
TILE = 2048  # names of one word (or letter) on a side of one tile


def _tiled(a: DataFrame, b: DataFrame, on: list[str], tile: int) -> DataFrame:
    """The join of a and b on `on`, in tiles: rows of a key that more than `tile` rows of either side hold are dealt into parts, and
    each two parts are a join key of their own, so no task gets all rows of a hot key."""
    hot = lambda df, name: df.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > tile).select(*on, F.ceil(F.col("_n") / tile).cast("int").alias(name))
    parts = stored(hot(a, "_pa").join(hot(b, "_pb"), on, "full"), "pairs-parts")
    n = parts.count()
    parts = F.broadcast(parts) if n * 64 <= BROADCAST else parts  # at most 1 / tile of all rows
    one = F.lit(1)

    def dealt(df, side, own, other):
        met = df.join(parts, on, "left")
        mine = F.pmod(F.xxhash64(side), F.coalesce(own, one)).cast("int")
        return met.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("_pa", "_pb")

    x = dealt(a, "left_id", F.col("_pa"), F.col("_pb")).withColumnsRenamed({"_mine": "_i", "_other": "_j"})
    y = dealt(b, "right_id", F.col("_pb"), F.col("_pa")).withColumnsRenamed({"_mine": "_j", "_other": "_i"})
    return x.join(y, [*on, "_i", "_j"])


def _rare_first(df: DataFrame, i: str, key: str, held: DataFrame, n_held: int, keep: Column) -> DataFrame:
    """Of the tokens of each name (i, key, _size, _w) those that `keep` counts, the rarest of all names first, with their places (_at)."""
    met = df.join(F.broadcast(held) if n_held * 48 <= BROADCAST else held, "_w")
    place = F.row_number().over(Window.partitionBy(i, key).orderBy("_n", "_w"))
    return met.withColumn("_at", place).filter(F.col("_at") <= keep).drop("_n")


def _by_words(a: DataFrame, b: DataFrame, least: float, tile: int) -> DataFrame:
    """Candidates among names whose words' Jaccard similarity is `least` or more: of n words all but ceil(least * n) - 1 are looked
    up, the rarest first."""
    split = lambda df, i, k: df.select(i, k, F.explode(F.array_distinct(F.split(k, " "))).alias("_w"), F.size(F.array_distinct(F.split(k, " "))).alias("_size"))
    x, y = split(a, "left_id", "_a"), split(b, "right_id", "_b")
    held = stored(x.select("_w").unionAll(y.select("_w")).groupBy("_w").agg(F.count("*").alias("_n")), "pairs-words")
    n = held.count()
    keep = F.col("_size") - F.ceil(least * F.col("_size") - 1e-9) + 1
    cut = lambda df, i, k: _rare_first(df, i, k, held, n, keep).select(i, k, "_w")
    return _tiled(cut(x, "left_id", "_a"), cut(y, "right_id", "_b"), ["_w"], tile).select("left_id", "_a", "right_id", "_b")


def _by_letters(a: DataFrame, b: DataFrame, least: float, tile: int) -> DataFrame:
    """Candidates among names whose sequence ratio is `least` or more.

    The blocks that match hold at most as many letters as the names have in common, each as often as both have it.  So a
    name of n letters is a set of n tokens - the first a, the second a, ... - and two names with m and n of them share
    least * (m + n) / 2 or more, of which one is among the rarest n - least * n / (2 - least) + 1 of either.  Their lengths
    differ by a factor of (2 - least) / least at most, so a token is looked up by band of lengths; the places of the token
    in both names bound what can still be shared.
    """
    letters = F.array_sort(F.split("_k", ""))
    tokens = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c) + 1).cast("string")))
    split = lambda df, i, k: df.filter(F.col(k) != "").withColumn("_k", F.col(k)).select(i, k, F.size(letters).alias("_size"), F.explode(tokens).alias("_w"))
    x, y = split(a, "left_id", "_a"), split(b, "right_id", "_b")
    held = stored(x.select("_w").unionAll(y.select("_w")).groupBy("_w").agg(F.count("*").alias("_n")), "pairs-letters")
    n = held.count()
    keep = F.col("_size") - F.ceil(F.col("_size") * (least / (2 - least)) - 1e-9) + 1
    factor = (2 - least) / least
    band = F.lit(0).cast("int") if factor < 1 + 1e-6 else F.floor(F.log(F.col("_size").cast("double")) / math.log(factor) + 1e-9).cast("int")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)) if factor >= 1 + 1e-6 else F.array(F.lit(0))
    left = _rare_first(x, "left_id", "_a", held, n, keep).select("left_id", "_a", "_w", F.col("_size").alias("_m"), F.col("_at").alias("_p"), band.alias("_own"), F.explode(near).alias("_step")).withColumn("_band", F.col("_own") + F.col("_step")).drop("_own", "_step")
    right = _rare_first(y, "right_id", "_b", held, n, keep).select("right_id", "_b", "_w", F.col("_size").alias("_n"), F.col("_at").alias("_q"), band.alias("_band"))
    need = least * (F.col("_m") + F.col("_n")) / 2 - 1e-9
    fits = (F.least("_m", "_n") >= need) & (1 + F.least(F.col("_m") - F.col("_p"), F.col("_n") - F.col("_q")) >= need)
    # the rarest token that both look up: what comes before it in either name is not in the other, so the places bound the rest
    return _tiled(left, right, ["_w", "_band"], tile).groupBy("left_id", "_a", "right_id", "_b").agg(F.min_by(fits, "_p").alias("_fits")).filter("_fits").drop("_fits")


def name_pairs(left: DataFrame, right: DataFrame, threshold: float = NAME_THRESHOLD, tile: int = TILE) -> DataFrame:
    """left_id, right_id, similarity of names at or above threshold (more than 0), without meeting every pair.

    left, right: id, key (comparison keys).  The similarity is RATIO of the sequence ratio and WORDS of the words' Jaccard
    similarity j.  The ratio is 1 at most, so names that pass have j of (threshold - RATIO) / WORDS or more: where that is
    a third or more, they share one of their rarest words (_by_words).  Below, names of smaller j pass too, and must have
    a ratio of at least (threshold - WORDS * j) / RATIO: they share some of their rarest letters (_by_letters).  Words and
    letters of many names are met in tiles.  Before the ratio is worked out, pairs are filtered by j itself, the lengths
    and the letters in common.  Empty keys are alike (1) and pair with empty ones only; null keys with none.
    """
    if not threshold > 0:
        raise ValueError("a threshold of 0 or less is met by every pair")
    a, b = (df.filter("key is not null").select(F.col("id").alias(i), F.col("key").alias(k)) for df, i, k in ((left, "left_id", "_a"), (right, "right_id", "_b")))
    by_ratio = (threshold - RATIO) / WORDS
    found = min(FEW_WORDS, threshold / (2 * WORDS)) if by_ratio < FEW_WORDS else by_ratio
    pairs = _by_words(a, b, found, tile)
    if by_ratio < FEW_WORDS:
        pairs = pairs.unionByName(_by_letters(a, b, (threshold - WORDS * found) / RATIO, tile))
    m, n = F.length("_a"), F.length("_b")
    jaccard = token_jaccard(F.col("_a"), F.col("_b"))
    bound = RATIO * (2 * F.least(m, n) / F.nullif(m + n, F.lit(0))) + WORDS * jaccard
    pairs = pairs.select("left_id", "_a", "right_id", "_b").distinct().filter(F.coalesce(bound >= threshold - 1e-9, F.lit(True)))
    return pairs.withColumn("similarity", name_similarity(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")


def probable(pairs: DataFrame, rule: IdentityRule = IdentityRule()) -> DataFrame:
    """For each id its best candidate of at least `probable`, the earlier of equals.  pairs: id, pos, current, candidate (identities)."""
    rows = pairs.withColumn("score", identity_score("current", "candidate", rule)).filter(F.col("score") >= rule.probable)
    return rows.groupBy("id").agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("m")).select("id", "m.pos", "m.score")


def cascade(media: DataFrame, registry: DataFrame, threshold: float = NAME_THRESHOLD, rule: IdentityRule = IdentityRule()) -> DataFrame:
    """id, pos, status, score: an equal hash first; for the rest the names' candidates and the fingerprints' best.

    media: id, sha256, key, identity.  registry: pos, sha256, key, identity, output_folder.
    """
    exact = media.join(registry.filter(F.coalesce("output_folder", F.lit("")) != "").select("sha256", "pos"), "sha256").groupBy("id").agg(F.min("pos").alias("pos"))
    exact = exact.select("id", "pos", F.lit("duplicate_exact").alias("status"), F.lit(1.0).alias("score"))
    rest = media.join(exact, "id", "left_anti")
    near = name_pairs(rest.select("id", "key"), registry.select(F.col("pos").alias("id"), "key"), threshold)
    pairs = near.join(rest.select(F.col("id").alias("left_id"), F.col("identity").alias("current")), "left_id").join(registry.select(F.col("pos").alias("right_id"), F.col("identity").alias("candidate")), "right_id")
    best = probable(pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("pos"), "current", "candidate"), rule)
    return exact.unionByName(best.select("id", "pos", F.lit("duplicate_probable").alias("status"), "score"))


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in a stated order: the case-blind listing choices."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def by_source(rows: DataFrame, source: str = "source") -> DataFrame:
    """rows in the order of their source, rows without one as if it were empty."""
    return rows.orderBy(F.coalesce(F.col(source), F.lit("")))
