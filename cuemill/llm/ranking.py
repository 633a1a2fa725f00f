"""The first k rows of every group, by radix selection: histograms over the bits of the value, then over UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, store

DIGIT = 10  # bits of a value that one pass looks at
SPLITS = 64  # parts of a group where the groups are too many to be broadcast


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int, spread: str, row_bytes: int = 128) -> DataFrame:
    """rows joined with the one row that groups has for each of the keys: a broadcast while the groups are few; beyond that the
    rows of a group meet their row in SPLITS parts, by the hash of `spread`, so no task gets a whole group."""
    if n_groups * row_bytes <= 32 << 20:
        return rows.join(small(groups, n_groups, row_bytes), keys)
    parts = groups.withColumn("_part", F.explode(F.expr(f"sequence(0, {SPLITS - 1})")))
    return rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPLITS)).cast("int")).join(parts.hint("merge"), [*keys, "_part"]).drop("_part")


def top_by_group(rows: DataFrame, keys: list[str], value: str, item: str, k: int, rank: str = "rank") -> DataFrame:
    """The rows of the k largest values of each group, with `rank` (int, from 1): value descending, then item by its UTF-8 bytes.

    No group is sorted, and none comes to one task.  Each pass counts, by group, the rows whose value has a certain next
    digit of DIGIT bits, among those that agree with the digits chosen so far; counts are combined before the shuffle and a
    group has 2^DIGIT of them at most.  The digit in which the kth row lies narrows the group's threshold; after the last one
    the threshold is the kth value itself, and `need` tells how many of the rows that tie with it belong to the result.
    Where more of them tie, their items are told apart byte by byte: past the longest prefix that the least and
    the greatest of them share, counts by the next byte choose the byte in which the last needed item lies, and so on.
    At last at most k rows of a group are left, and only these are ranked.

    value is a long of 0 or more and item a text, both without nulls, as are the keys; a group's items differ.  Groups of
    fewer than k rows are returned whole; no rows, no groups.  rows is to be read from files: every pass reads it.
    """
    digits = F.col(value)
    most = rows.agg(F.max(value)).first()[0]
    if most is None:
        return rows.withColumn(rank, F.lit(1).cast("int")).limit(0)
    passes = max(1, -(-int(most).bit_length() // DIGIT))
    state = rows.select(*keys).distinct().withColumn("_high", F.lit(0).cast("long")).withColumn("_need", F.lit(k).cast("long"))
    state = store(state, "rank-groups")
    n = state.count()
    for p in range(passes - 1, -1, -1):
        met = by_group(rows, state, keys, n, item).filter(F.shiftright(digits, (p + 1) * DIGIT) == F.col("_high"))
        digit = F.shiftright(digits, p * DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        counted = met.groupBy(*keys, "_high", "_need", digit.alias("_digit")).agg(F.count("*").alias("_n"))
        above = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_digit"))) - F.col("_n")  # 2^DIGIT rows a group
        low = F.min("_digit").over(Window.partitionBy(*keys))
        counted = counted.withColumn("_above", above).withColumn("_low", low)
        # the digit that holds the row that is still needed; the least digit where the group is shorter than k
        last = (F.col("_above") < F.col("_need")) & ((F.col("_above") + F.col("_n") >= F.col("_need")) | (F.col("_digit") == F.col("_low")))
        state = store(
            counted.filter(last).select(*keys, (F.col("_high") * (1 << DIGIT) + F.col("_digit")).alias("_high"), (F.col("_need") - F.col("_above")).alias("_need"), F.col("_n").alias("_ties")),
            "rank-threshold",
        )
    met = by_group(rows, state, keys, n, item)
    over = met.filter((digits > F.col("_high")) | ((digits == F.col("_high")) & (F.col("_ties") <= F.col("_need")))).select(*rows.columns)
    chosen = [over]
    raw = F.col(item).cast("binary")
    open_ties = store(state.filter("_ties > _need").select(*keys, "_high", "_need", F.lit("").cast("binary").alias("_prefix")), "rank-ties")
    tied = None  # only rows that tie at an open threshold: what the passes below read
    while n_open := open_ties.count():
        if tied is None:
            tied = by_group(rows, open_ties.select(*keys, "_high"), keys, n_open, item).filter(digits == F.col("_high"))
            tied = store(tied.select(*rows.columns).withColumn("_raw", raw), "rank-tied")
        held = lambda groups: by_group(tied, groups, keys, n_open, item).filter(F.substring("_raw", F.lit(1), F.length("_prefix")) == F.col("_prefix"))  # noqa: E731, B023
        ends = held(open_ties).groupBy(*keys, "_need").agg(F.min("_raw").alias("_least"), F.max("_raw").alias("_most"))
        ends = store(ends.withColumn("_prefix", _shared("_least", "_most")), "rank-shared")
        if not ends.filter("_least = _most").isEmpty():
            raise ValueError(f"the values of {item} in a group are to differ")
        step = F.substring("_raw", F.lit(1), F.length("_prefix") + 1)  # one byte more; an item that ends there has none
        here = held(ends.select(*keys, "_need", "_prefix")).withColumn("_step", step)
        counted = here.groupBy(*keys, "_need", "_step").agg(F.count("*").alias("_n"))
        counted = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_step")) - F.col("_n"))  # 257 rows a group
        cut = counted.filter("_before < _need and _before + _n >= _need").select(*keys, F.col("_step").alias("_last"), "_n", (F.col("_need") - F.col("_before")).alias("_rest"))
        cut = store(cut, "rank-cut")
        chosen.append(by_group(here.drop("_need"), cut, keys, n_open, item).filter("_step < _last or (_step = _last and _n = _rest)").select(*rows.columns))
        open_ties = store(cut.filter("_n > _rest").select(*keys, F.col("_rest").alias("_need"), F.col("_last").alias("_prefix")), "rank-ties")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), raw)).cast("int"))  # k rows a group


def _shared(least: str, most: str) -> Column:
    """The longest common prefix of two binary columns."""
    both = f"least(length({least}), length({most}))"
    same = F.expr(f"coalesce(array_position(transform(sequence(1, greatest({both}, 1)), i -> substring({least}, i, 1) = substring({most}, i, 1)), false) - 1, {both})")
    n = F.when(same < 0, F.expr(both)).otherwise(same)  # 0 is said of what is not there
    return F.substring(F.col(least), F.lit(1), n.cast("int"))
