"""Ordered fallback over providers, batches, quotas."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from . import running

# What providers give for free.
LIMITS = {"deepl": ("month", 500_000, "characters"), "mymemory": ("day", 100, "requests"), "my_memory": ("day", 100, "requests")}


def cascade(rows: DataFrame, outputs: list[tuple[str, str, str | None]], text: str = "text") -> DataFrame:
    """rows with translated, provider, failed and errors: the first output that is not blank wins.

    outputs: (provider, output column, error column) in order.  The errors of the providers before the winner add up in
    that order; without a winner the text stays and the row has failed.
    """
    found = [blank_to_null(F.col(c)) for _, c, _ in outputs]
    name = F.coalesce(*[F.when(f.isNotNull(), F.lit(p)) for f, (p, _, _) in zip(found, outputs, strict=True)])
    errors, open_ = [], F.lit(True)
    for f, (p, _, e) in zip(found, outputs, strict=True):
        if e:
            errors.append(F.when(open_ & f.isNull() & F.col(e).isNotNull(), F.concat(F.lit(p + ": "), F.col(e))))
        open_ = open_ & f.isNull()
    return rows.withColumns({
        "translated": F.coalesce(*found, F.col(text)),
        "provider": name,
        "failed": name.isNull(),
        "errors": F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"),
    })


def passes(rows: DataFrame, providers: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str = "seq", text: str = "text") -> DataFrame:
    """The cascade for providers that cost: each is asked only for what its predecessors left open.

    A provider maps rows to (key, output); its calls should retry and catch inside (called()).  What it gives is stored before
    the next one is asked, so each text is sent to a provider once, whatever reads the result and however often.
    """
    open_, done = running.stored(rows, "passes-rows") if providers else rows, None
    rows = open_
    for name, ask in providers:
        got = ask(open_).select(key, blank_to_null(F.col("output")).alias("translated")).filter("translated is not null").withColumn("provider", F.lit(name))
        got = running.stored(got, "passes-got")
        done = got if done is None else done.unionByName(got)
        open_ = open_.join(got, key, "left_anti")
    out = rows.join(done, key, "left") if done is not None else rows.withColumns({"translated": F.lit(None).cast("string"), "provider": F.lit(None).cast("string")})
    return out.withColumn("failed", F.col("provider").isNull()).withColumn("translated", F.coalesce("translated", text))


class ConfigurationError(Exception):
    """Ends the whole run instead of falling back."""


def called(provider: Callable[[list[str]], list[str]], texts: list[str], attempts: int = 3) -> tuple[list[str | None], str | None]:
    """(outputs, error) of one chunk: at most three attempts; a result of another length is an error of the whole chunk."""
    error = None
    for _ in range(max(1, min(3, attempts))):
        try:
            out = list(provider(texts))
        except ConfigurationError:
            raise
        except Exception as e:  # whatever a provider throws leaves its chunk open
            error = f"{type(e).__name__}: {e}"
            continue
        if len(out) == len(texts):
            return out, None
        error = f"{len(out)} results for {len(texts)} texts"
    return [None] * len(texts), error


def provider_step(provider: Callable[[list[str]], list[str]], size: int = 25, attempts: int = 3, key: str = "seq"):
    """A provider of passes() from a function over lists of texts, asked `size` at a time."""

    def step(batches):
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for k in range(0, len(texts), size):
                out += called(provider, texts[k : k + size], attempts)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(out, pa.string())], names=[key, "output"])

    def ask(rows: DataFrame) -> DataFrame:
        schema = T.StructType([rows.schema[key], T.StructField("output", T.StringType())])
        return rows.select(key, "text").mapInArrow(step, schema)

    return ask


def with_text(segments: DataFrame, seq: str = "seq") -> DataFrame:
    """Only segments with text, at their places in the whole."""
    return segments.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("original_index", F.col(seq))


def batch_ids(rows: DataFrame, size: int, order: list[str], key: str | list[str]) -> DataFrame:
    """rows with batch: fixed chunks of `size` ordered rows of each key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def quota_window(provider="provider", ts="ts"):
    """The calendar window that a provider's quota counts in; null for unmetered ones."""
    p = F.col(provider)
    month = [k for k, v in LIMITS.items() if v[0] == "month"]
    day = [k for k, v in LIMITS.items() if v[0] == "day"]
    return F.when(p.isin(month), F.date_format(ts, "yyyy-MM")).when(p.isin(day), F.date_format(ts, "yyyy-MM-dd"))


def quota_usage(requests: DataFrame, amount: str = "amount") -> DataFrame:
    """provider, window, used."""
    return requests.withColumn("window", quota_window()).groupBy("provider", "window").agg(F.sum(amount).alias("used"))


def reserved(requests: DataFrame) -> DataFrame:
    """provider, window, req_id, amount, limit, accepted, used: each request in order takes its amount, or nothing.

    requests: provider, window, req_id, amount (0 or more), limit (null: unmetered).  A request above what is left is refused
    and takes nothing, so this is no running sum; but it is one of few.  While half of what is left, or more, is still
    left, requests of at most that half are all accepted; so a round takes the running sums of these alone, up to the
    first place where they exceed the half, or where a larger request fits what is left then: that one is accepted too,
    and either way at most half of the rest is left.  What no longer fits the rest is never looked at again.  A limit of L
    takes log2(L) rounds at most, and as many jobs twice, however many requests and windows there are; all windows go side
    by side, and one window is spread over blocks of requests, each the work of one task.

    The state of a window is a row for each round: up to where it decides, and which amounts it accepts.  Only these rows
    meet the requests.  Nothing is decided in Python.  Unmetered requests are accepted as they are, without a shuffle.
    Ties of req_id go by amount.  A null amount is 0.  A request without a window of its own, but with a limit, counts in
    the null window.
    """
    rows = requests.select("provider", "window", "req_id", F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), F.col("limit").cast("long").alias("limit"))
    free = rows.filter("limit is null").select("*", F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("used"))
    # (p, w) names a window; a window's limit is the least that its requests state
    keys, order = ["p", "w"], ["req_id", "amount", "_tie"]
    metered = rows.filter("limit is not null").withColumns({"p": F.coalesce("provider", F.lit("")), "w": F.coalesce("window", F.lit("")), "_tie": F.monotonically_increasing_id()})
    base = running.blocks(metered, keys, order, "quota-requests")
    place = F.struct("block", *order)
    start = F.struct(F.lit(-1).alias("block"), *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in order])
    state = base.groupBy(*keys).agg(F.min("limit").alias("rest")).withColumn("at", start)
    state = running.stored(state, "quota-state")
    rounds, last, n = None, 0, state.count()
    most_blocks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n:
        open_rows = running.met(base, state, keys, n).filter((place > F.col("at")) & (F.col("amount") <= F.col("rest")))
        half = F.expr("rest div 2")
        small = F.when(F.col("amount") <= half, F.col("amount")).otherwise(0)
        offsets = running.stored(running.before_blocks(open_rows, keys, small, "_before"), "quota-offsets")
        upto = running.in_block(keys, order, small) + F.col("_before")
        summed = running.met(open_rows, offsets, [*keys, "block"], n * most_blocks).withColumn("_upto", upto)
        large = F.col("amount") > half
        turn = F.when(large, F.col("_upto") + F.col("amount") <= F.col("rest")).otherwise(F.col("_upto") > half)
        event = F.when(turn, place)
        took = F.col("_upto") + F.when(large, F.col("amount")).otherwise(0)
        found = summed.groupBy(*keys, "rest", "at").agg(
            F.min(event).alias("to"),
            F.min_by(took, event).alias("took"),
            F.min_by(large, event).alias("by_large"),
        )
        found = found.select(*keys, F.struct("at", "to", half.alias("half"), F.coalesce("by_large", F.lit(False)).alias("by_large"), F.lit(last).alias("nth")).alias("round"), (F.col("rest") - F.col("took")).alias("rest"), F.col("to").alias("_next"))
        found = running.stored(found, "quota-round")
        one = found.select(*keys, "round")
        rounds = one if rounds is None else rounds.unionByName(one)
        # a window without an event has all its small requests accepted and is done
        state = found.filter("_next is not null").select(*keys, "rest", F.col("_next").alias("at"))
        n, last = state.count(), last + 1
    if rounds is None:
        return free.unionByName(rows.filter("false").select("*", F.lit(True).alias("accepted"), F.lit(0).cast("long").alias("used")))
    decided = running.stored(rounds.groupBy(*keys).agg(F.collect_list("round").alias("rounds")), "quota-rounds")  # a window has few
    out = running.met(base, decided, keys, decided.count(), 2048)
    # the round that decides a request is the one whose stretch it is in; what a round passed over exceeds its half
    mine = F.get(F.filter("rounds", lambda r: (place > r["at"]) & (r["to"].isNull() | (place <= r["to"]))), F.lit(0))
    accepted = F.coalesce((F.col("amount") <= mine["half"]) | ((place == mine["to"]) & mine["by_large"]), F.lit(False))
    out = out.withColumn("accepted", accepted).drop("rounds")
    gone = F.when(F.col("accepted"), F.col("amount")).otherwise(0)
    offsets = running.before_blocks(out, keys, gone, "_before")
    used = running.in_block(keys, order, gone) + F.col("_before")
    offsets = running.stored(offsets, "quota-used")
    done = running.met(out, offsets, [*keys, "block"], offsets.count()).withColumn("used", used)
    return done.select(*rows.columns, "accepted", "used").unionByName(free)


def exhausted(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """requests with refused: a provider that reported its quota spent takes no more in that window.  failures: provider, window, req_id."""
    first = failures.groupBy("provider", "window").agg(F.min("req_id").alias("_spent"))
    return requests.join(first, ["provider", "window"], "left").withColumn("refused", F.coalesce(F.col("req_id") > F.col("_spent"), F.lit(False))).drop("_spent")


