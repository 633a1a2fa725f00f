"""Cohort retention matrix: monoids over RDDs of column blocks."""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import partitions, store, table

DAY = 86_400_000_000
SALTS = 64  # parts of a client's rows, in as many buckets next to each other
BLOCK_ROWS = 1 << 18
LEAST = 1 << 12  # rows that a monoid gathers before it combines them
CUT = datetime.datetime(2024, 3, 1)
COHORT_DAYS = PERIOD_DAYS = 3
BUYS = "purchase"
RESULT = "state int, segment string, cohort long, period long, users long, users_crc32 long, moved long, cents long"


def _bytes(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _read(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all()


class Sums:
    """A monoid: rows added up by keys.  What was added is combined once it is as long as what had been combined, so n rows
    take n log n steps however they come together.  Travels in its combined form."""

    def __init__(self, keys: list[str], how: dict[str, str], parts: tuple = ()):
        self.keys, self.how, self.parts = keys, how, list(parts)

    def add(self, t: pa.Table) -> Sums:
        self.parts.append(t)
        if sum(p.num_rows for p in self.parts[1:]) > max(LEAST, self.parts[0].num_rows):
            self.parts = [self.whole()]
        return self

    def merge(self, other: Sums) -> Sums:
        for t in other.parts:
            self.add(t)
        return self

    def whole(self) -> pa.Table:
        got = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate(list(self.how.items()))
        return got.select([*self.keys, *(f"{k}_{v}" for k, v in self.how.items())]).rename_columns([*self.keys, *self.how])

    def __reduce__(self):
        return _sums, (self.keys, self.how, _bytes(self.whole()))


def _sums(keys, how, raw) -> Sums:
    return Sums(keys, how, [_read(raw)])


def _merge(a: Sums, b: Sums) -> Sums:
    return a.merge(b)


def _own(bucket: int) -> int:
    return bucket


PAIRS = ["client", "at"], {"s0": "min", "s1": "min", "city": "min"}
FACTS = ["state", "client", "period", "cohort", "moved", "city"], {"cents": "sum"}
CELLS = ["state", "city", "cohort", "period"], {"users": "sum", "crc": "sum", "moved": "sum", "cents": "sum"}


def _home(client: np.ndarray, n: int) -> np.ndarray:
    return (ta.mix(client.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _by(t: pa.Table, bucket: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each bucket."""
    if not t.num_rows:
        return
    order = np.argsort(bucket, kind="stable")
    t, bucket = t.take(pa.array(order)), bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for i, j in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[i]), t.slice(i, j - i)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def blocks(rows: DataFrame, n: int) -> RDD:
    """(bucket, block of rows) of rows (client, us, early, buys, cents, salt): a client's rows are in SALTS buckets at most."""

    def pack(batches):
        def cut(held):
            t = pa.Table.from_batches(held)
            bucket = (_home(_numbers(t, "client"), n) + _numbers(t, "salt")) % n
            found = [(b, _bytes(x)) for b, x in _by(t.drop_columns("salt"), bucket)]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "block"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield cut(held)
                held, size = [], 0
        if size:
            yield cut(held)

    return rows.mapInArrow(pack, "bucket int, block binary").rdd.map(lambda r: (r[0], r[1]))


def _fold(pairs: Sums | None, found: tuple[int, bytes]) -> Sums:
    """Start pairs with the rows of one more block: each client's earliest purchase among early rows, and among all."""
    bucket, raw = found
    t = _read(raw)
    buys, us = t.column("buys"), t.column("us")
    none = pa.nulls(t.num_rows, pa.int64())
    own = pa.table(
        {
            "client": t.column("client"),
            "at": pa.array(np.full(t.num_rows, bucket), pa.int64()),
            "s0": pc.if_else(pc.and_(buys, t.column("early")), us, none),
            "s1": pc.if_else(buys, us, none),
            "city": pa.nulls(t.num_rows, pa.string()),
        }
    )
    return (pairs or Sums(*PAIRS)).add(own)


def _starts(found: tuple[int, Sums]) -> Iterator[tuple[int, tuple[str, bytes]]]:
    """The start pairs and city of each client of a home bucket that has a start, for each bucket that holds rows of it."""
    t = found[1].whole()
    by_client = t.group_by("client", use_threads=False).aggregate([("s0", "min"), ("s1", "min"), ("city", "min")])
    by_client = by_client.filter(pc.is_valid(by_client.column("s1_min"))).sort_by("client")
    known = _numbers(by_client, "client")
    at = t.filter(pc.greater_equal(t.column("at"), 0))
    client = _numbers(at, "client")
    i = np.minimum(np.searchsorted(known, client), max(len(known) - 1, 0))
    here = known[i] == client if len(known) else np.zeros(len(client), bool)
    met = by_client.take(pa.array(i[here])).select(["client", "s0_min", "s1_min", "city_min"]).rename_columns(["client", "s0", "s1", "city"])
    for bucket, x in _by(met, _numbers(at, "at")[here]):
        yield bucket, ("starts", _bytes(x))


def _applied(cohort_us: int, period_us: int, n: int):
    """For a partition that holds the starts of its buckets and then their rows: (home, user-period facts)."""

    def facts(found):
        starts: list[pa.Table] = []
        known = None
        out = Sums(["state", "client", "period"], {"cents": "sum"})
        for _, (kind, raw) in found:
            if kind == "starts":
                if known is not None:
                    raise RuntimeError("the starts of a partition are to come before its rows")
                starts.append(_read(raw))
                continue
            if known is None:
                known = _sorted_starts(starts, cohort_us)
            t = _read(raw)
            client, us, cents, early = (_numbers(t, c) for c in ("client", "us", "cents", "early"))
            i, here = _places(known, client)
            for state in (0, 1):
                start, has = known["start"][state][i], known["has"][state][i]
                keep = here & has & (us >= start) & (early if state == 0 else True)
                if keep.any():
                    period = (us[keep] - start[keep]) // period_us
                    out.add(pa.table({"state": pa.array(np.full(len(period), state, np.int32)), "client": client[keep], "period": period, "cents": cents[keep]}))
        if not out.parts:
            return
        t = out.whole()
        client, state = _numbers(t, "client"), _numbers(t, "state")
        i, _ = _places(known, client)
        t = t.append_column("cohort", pa.array(np.where(state == 0, known["cohort"][0][i], known["cohort"][1][i])))
        t = t.append_column("moved", pa.array(known["moved"][i].astype(np.int64))).append_column("city", known["city"].take(pa.array(i)))
        for home, x in _by(t, _home(client, n)):
            yield home, Sums(*FACTS, [x])

    return facts


def _sorted_starts(starts: list[pa.Table], cohort_us: int) -> dict:
    empty = pa.table({"client": pa.array([], pa.int64()), "s0": pa.array([], pa.int64()), "s1": pa.array([], pa.int64()), "city": pa.array([], pa.string())})
    t = pa.concat_tables([empty, *starts]).sort_by("client")
    start = [t.column(c).fill_null(0).to_numpy() for c in ("s0", "s1")]
    has = [pc.is_valid(t.column(c)).to_numpy() for c in ("s0", "s1")]
    cohort = [s // DAY // (cohort_us // DAY) for s in start]
    moved = has[0] & has[1] & (cohort[0] != cohort[1])
    city = t.column("city").fill_null("").combine_chunks()
    # a last row that no client has stands for all who have no start
    pad = lambda a, v: np.append(a, v)
    return {
        "client": _numbers(t, "client"),
        "start": [pad(s, 0) for s in start],
        "has": [pad(h, False) for h in has],
        "cohort": [pad(c, 0) for c in cohort],
        "moved": pad(moved, False),
        "city": pa.concat_arrays([city.chunk(0) if isinstance(city, pa.ChunkedArray) and city.num_chunks else pa.array(city.to_pylist(), pa.string()), pa.array([""])]),
    }


def _places(known: dict, client: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each client's start is, and whether there is one."""
    i = np.searchsorted(known["client"], client)
    here = np.append(known["client"], 0)[i] == client
    here &= i < len(known["client"])
    return np.where(here, i, len(known["client"])), here


def _cells(n: int):
    def cells(found: tuple[int, Sums]) -> Iterator[tuple[int, Sums]]:
        """The cells of the user-period facts of a home bucket; each fact is one user of its cell."""
        t = found[1].whole()
        names, place = np.unique(_numbers(t, "client"), return_inverse=True)
        crc = np.array([zlib.crc32(str(c).encode()) for c in names.tolist()], np.int64)[place]
        one = pa.array(np.ones(t.num_rows, np.int64))
        t = pa.table({**{k: t.column(k) for k in CELLS[0]}, "users": one, "crc": crc, "moved": t.column("moved"), "cents": t.column("cents")})
        t = Sums(*CELLS, [t]).whole()
        city = t.column("city").combine_chunks().dictionary_encode()
        city = city.combine_chunks() if isinstance(city, pa.ChunkedArray) else city
        of_city = np.array([zlib.crc32(c.encode()) for c in city.dictionary.to_pylist()], np.uint64)[city.indices.to_numpy()]
        mixed = ta.mix(of_city * np.uint64(1 << 20) + _numbers(t, "cohort").view(np.uint64) * np.uint64(1 << 10) + _numbers(t, "period").view(np.uint64))
        for bucket, x in _by(t, (mixed % np.uint64(n)).astype(np.int64)):
            yield bucket, Sums(*CELLS, [x])

    return cells


def _tuples(found: tuple[int, Sums]) -> Iterator[tuple]:
    cols = found[1].whole().to_pydict()
    yield from zip(*(cols[c] for c in ("state", "city", "cohort", "period", "users", "crc", "moved", "cents")), strict=True)


def retention(
    clicks: DataFrame,
    clients: DataFrame,
    cut: datetime.datetime = CUT,
    buys: str = BUYS,
    cohort_days: int = COHORT_DAYS,
    period_days: int = PERIOD_DAYS,
    salts: int = SALTS,
) -> DataFrame:
    """The retention matrix of clicks (client_id, ts, arrived_at, kind, value; others count only for equality) in two states of
    knowledge: what arrived before `cut`, and all.  A row for each state, segment, cohort and period that has a click.

    Rows are packed into column blocks by (client, salt), so a client with a third of all rows fills SALTS buckets evenly.
    aggregateByKey folds the blocks of a bucket into start pairs - a client's first purchase in either state, with the bucket
    that asks for it; reduceByKey merges these by client, with the client's city; each pair returns to the buckets that hold
    rows of the client.  Starts and rows are dealt out by one partitioner, so their union joins them partition by partition
    without another shuffle (the zip of co-partitioned RDDs), starts first.  reduceByKey then adds up facts of (state,
    client, period), whose number for one client is that of its periods, and after that cells.  All of them are monoids
    of column blocks: nothing comes to the driver, nothing is broadcast, and a value holds one bucket of `partitions`.

    Equal rows count once; rows with null ts or client_id go.  A null arrived_at is unknown in state 0; a null kind is no
    purchase; a null or non-finite value is 0 cents; a client that is missing, or has a null city, is of segment '';
    of several cities of one client the least counts.  Ties of the first purchase are one start.  Other columns, those with
    clashing names too, count only for the equality of rows.  Empty tables give no rows.
    """
    spark = clicks.sparkSession
    n = partitions(spark)
    cohort_us, period_us = cohort_days * DAY, period_days * DAY
    once = clicks.filter("ts is not null and client_id is not null").distinct()
    value = F.col("value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e16)
    rows = once.select(
        F.col("client_id").cast("long").alias("client"),
        F.col("ts").cast("timestamp_ntz").alias("us"),
        F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(cut).cast("timestamp_ntz"), F.lit(False)).alias("early"),
        F.coalesce(F.col("kind") == buys, F.lit(False)).alias("buys"),
        F.when(finite, F.floor(100 * value + 0.5)).otherwise(F.lit(0)).cast("long").alias("cents"),
        F.pmod(F.xxhash64("ts", "arrived_at", "value"), F.lit(salts)).cast("int").alias("salt"),
    )
    rows = store(rows, "cohort-rows")

    def micros(batches):
        for b in batches:
            yield b.set_column(1, "us", b.column(1).cast(pa.timestamp("us")).cast(pa.int64()))

    rows = rows.mapInArrow(micros, "client long, us long, early boolean, buys boolean, cents long, salt int")
    packed = blocks(rows, n)

    def cities(batches):
        for b in batches:
            none = pa.nulls(b.num_rows, pa.int64())
            t = pa.table({"client": b.column(0), "at": pa.array(np.full(b.num_rows, -1), pa.int64()), "s0": none, "s1": none, "city": b.column(1).cast(pa.string())})
            found = [(home, _bytes(x)) for home, x in _by(t, _home(_numbers(t, "client"), n))]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["home", "block"])

    city = clients.filter("client_id is not null and city is not null").select(F.col("client_id").cast("long"), F.col("city").cast("string"))
    city = city.mapInArrow(cities, "home int, block binary").rdd.map(lambda r: (r[0], Sums(*PAIRS, [_read(r[1])])))

    pairs = packed.map(lambda r: (r[0], r)).aggregateByKey(None, _fold, _merge, n, _own)
    by_client = pairs.flatMap(lambda r: [(home, Sums(*PAIRS, [x])) for t in [r[1].whole()] for home, x in _by(t, _home(_numbers(t, "client"), n))])
    starts = by_client.union(city).reduceByKey(_merge, n, _own).flatMap(_starts).partitionBy(n, _own)
    dealt = packed.map(lambda r: (r[0], ("rows", r[1]))).partitionBy(n, _own)
    zipped = starts.union(dealt)
    if zipped.getNumPartitions() != starts.getNumPartitions():
        raise RuntimeError("starts and rows are to be dealt out alike")
    facts = zipped.mapPartitions(_applied(cohort_us, period_us, n)).reduceByKey(_merge, n, _own)
    cells = facts.flatMap(_cells(n)).reduceByKey(_merge, n, _own)
    return spark.createDataFrame(cells.flatMap(_tuples), RESULT, verifySchema=False)


def delayed(clicks: DataFrame) -> DataFrame:
    """clicks of which those whose crc32(click_id) is divisible by 3 arrive that number mod 100 days later.  A null click_id has no delay."""
    h = F.crc32(F.col("click_id").cast("string"))
    days = F.when(h % 3 == 0, h % 100).otherwise(0).cast("int")
    return clicks.withColumn("_days", days).withColumn("arrived_at", F.expr("timestampadd(DAY, _days, arrived_at)")).drop("_days")


def op13_cohort_retention(spark, sf_dir) -> DataFrame:
    return retention(delayed(table(spark, sf_dir, "clicks")), table(spark, sf_dir, "clients"))


_NIBBLES = ", ".join(str(x) for x in ((lambda f: [f(f(f(f(k)))) for k in range(16)])(lambda x: (x >> 1) ^ (0xEDB88320 * (x & 1)))))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, nibble by nibble."""
    nibbles = f"flatten(list_transform(string_split({text}, ''), lambda c: [(ascii(c) & 15)::BIGINT, (ascii(c) >> 4)::BIGINT]))"
    return f"xor(list_reduce({nibbles}, lambda a, x: xor((a >> 4), [{_NIBBLES}][(xor(a, x) & 15) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"


OP13_SQL = f"""
WITH once AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
hashed AS (SELECT *, {crc32_sql("click_id::VARCHAR")} AS h FROM once),
rows AS (
  SELECT client_id, ts, kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents,
    coalesce(arrived_at + to_days((CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END)::INTEGER) < TIMESTAMP '2024-03-01', false) AS early
  FROM hashed),
known AS (SELECT 0 AS state, * FROM rows WHERE early UNION ALL SELECT 1 AS state, * FROM rows),
starts AS (SELECT state, client_id, min(ts) AS start FROM known WHERE kind = 'purchase' GROUP BY ALL),
cohorts AS (SELECT *, floor(floor(epoch_us(start) / 86400000000.0) / 3)::BIGINT AS cohort FROM starts),
moves AS (SELECT client_id, (count(*) = 2 AND min(cohort) <> max(cohort))::INTEGER AS moved FROM cohorts GROUP BY client_id),
cities AS (SELECT client_id, min(city) AS city FROM clients GROUP BY client_id),
facts AS (
  SELECT k.state, k.client_id, cohort, (epoch_us(ts) - epoch_us(start)) // (3 * 86400000000) AS period, sum(cents)::BIGINT AS cents
  FROM known k JOIN cohorts c ON k.state = c.state AND k.client_id = c.client_id WHERE ts >= start GROUP BY ALL)
SELECT state, coalesce(city, '') AS segment, cohort, period, count(*) AS users, sum({crc32_sql("f.client_id::VARCHAR")})::BIGINT AS users_crc32,
  sum(moved)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM facts f JOIN moves m ON f.client_id = m.client_id LEFT JOIN cities ON f.client_id = cities.client_id GROUP BY ALL
"""
