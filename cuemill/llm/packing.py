"""Tokenising documents, and best-fit packing of the pieces into sequences."""

from __future__ import annotations

import json
import os
import re
import time
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, memories, running_total, store, table

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
KNOWN_CHUNKS, LONGEST_KNOWN = 600_000, 48
MARKS = b".,!?;:$%&*#"
WORDS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # a fixed value: the split that Chunks relies on


_LETTER = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])\Z")  # at the end: ASCII, or a letter below U+0240 but U+0130, whose small form ends in a mark


def splits_at_space(plan: dict) -> bool:
    """Whether a tokenizer's file says what Chunks relies on: lower case, white space dropped, words and runs of marks apart,
    no marks of its own around a text, and special tokens that keep to themselves."""
    normal = [n.get("type") for n in (plan.get("normalizer") or {}).get("normalizers", [])]
    split = (plan.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    own = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and re.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in plan.get("added_tokens", []))
    words = (split.get("pattern") or {}).get("Regex") == WORDS_AND_MARKS and split.get("behavior") == "Removed" and split.get("invert")
    return normal == ["NFC", "Replace", "Lowercase"] and bool(words) and own and plan.get("post_processor") is None and plan["model"]["type"] == "BPE"


class Chunks(dict):
    """Token ids (little-endian 32 bits) of chunks between ASCII white space, where the tokenizer never joins them; another
    tokenizer (splits_at_space) is run on whole texts.

    A chunk not met before is made of its stem - the chunk without the marks at its end, A-Z lower-cased, as the tokenizer
    splits and normalises it - and of these marks; the tokenizer runs only on new stems.  The last `most` to twice as many
    chunks stay in memory.
    """

    def __init__(self, path: str, most: int = KNOWN_CHUNKS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.apart = splits_at_space(plan)

    def __missing__(self, c: bytes) -> bytes:
        got = self.old.get(c)
        if got is None:
            body = c.rstrip(MARKS)
            stem = body.lower()
            if stem == c or b"<|" in c or not _LETTER.search(body):
                # a stem; or special tokens, which are found before anything is normalised; or marks that would join marks
                got = array("I", self.tokenizer.encode(c.decode(), add_special_tokens=False).ids).tobytes()
            else:
                got = self[stem]
                if len(body) < len(c):
                    got += self[c[len(body) :]]
        if len(c) <= LONGEST_KNOWN:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[c] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.apart:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.encode().split()))


_tokenizers: dict[str, Chunks] = {}


def chunks_of(path: str, most: int = KNOWN_CHUNKS) -> Chunks:
    if path not in _tokenizers:
        _tokenizers[path] = Chunks(path)
    _tokenizers[path].most = most
    memories["chunks"] = time.monotonic(), _tokenizers.clear
    return _tokenizers[path]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, known_chunks: int = KNOWN_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (32-bit little-endian) of the pieces of documents.

    A document is the ids of its whole text and END_ID; one longer than capacity is cut into pieces of that length and
    a rest.  vocabulary: the tokenizer's file, as the executors see it.  known_chunks: how many chunks a worker remembers.  A null text is empty: END_ID alone.
    """

    @lean
    def cut(batches):
        if vocabulary is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        else:
            path = vocabulary
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            known, out = chunks_of(path, known_chunks), []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = known.ids(text or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    out.append((d, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=schema.names)

    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, number, first sequence, offset) of runs of placed pieces, and the number of sequences.

    Pieces of one length are alike, and so are sequences with one gap, so both range-sorted lists are held as runs: at
    most `capacity` lengths and `capacity` gaps, however many pieces there are.  Longest first, the pieces of a length
    sweep the gaps: each sweep gives them the tightest gaps they fit (their successors among the gaps), one piece a gap,
    by rank; the gaps shrink, and pieces that found none sweep again, or open sequences - as few as can hold them.
    """
    gaps: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    out, opened = [], 0

    def put(gap, first, n):
        if gap:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[k]
            want = -(-left // (gap // length))  # as many gaps as the pieces need if each is filled with them
            runs = bins[gap]
            while want and runs:
                first, n = runs.pop()
                if n > want:
                    runs.append((first + want, n - want))
                    n = want
                out.append((length, rank, n, first, capacity - gap))
                put(gap - length, first, n)
                rank, left, want = rank + n, left - n, want - n
            if not runs:
                del bins[gap]
                gaps.remove(gap)
    return out, opened


def packed(parts: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """parts (with length, 1 to capacity) with sequence_id and offset: its place in one of as few sequences as best fit finds.

    On the driver, best_fit matches at most `capacity` lengths with gaps; a piece's place follows from its rank among the pieces
    of its length, which running totals over range-sorted partitions give.  A length that a third of all pieces share
    spreads over tasks like any other.  The plan grows with the capacity, not with the data.  parts is read twice.
    """
    spark = parts.sparkSession
    ranked = running_total(parts.withColumn("_one", F.lit(1).cast("long")), "length", list(order), "_one", "_rank", "pack-ranks").drop("_one")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # a row for each length
    plan, _ = best_fit(counts, capacity)
    plan.sort()
    held = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5))

    def place(batches):
        rows = held.value
        starts = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = starts[n], starts[n + 1]
                at[own] = lo + np.searchsorted(rows[lo:hi, 1], rank[own], side="right") - 1
            keep = [n for n in b.schema.names if n != "_rank"]
            got = [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), *got], names=[*keep, "sequence_id", "offset"])

    schema = T.StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, known_chunks: int = KNOWN_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset of all pieces of documents.

    Nulls: a null doc_id is a document; an empty or null text is END_ID alone; repeated rows are documents of their own, and
    pieces alike in doc_id, piece and length take their places in the order of the files.  A text of any length is tokenised
    whole.  No documents, no rows.  Other columns are not read.
    """
    return packed(store(pieces(docs, vocabulary, capacity, with_ids, known_chunks), "pack-pieces"), capacity)


def op8_packing(spark, sf_dir) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), with_ids=False)
