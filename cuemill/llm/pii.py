"""Personal data: patterns, and terms that disclose it by what the corpus shows of their company."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small, store, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")  # letters and digits; scripts without spaces give whole runs
DIGITS = re.compile(r"[0-9]")

MIN_CONTEXTS = 3  # documents, no two of them near copies, in which a term must stand with an entity
NEAR, OF = 2, 5  # near copies share 2/5 of the terms that either has
SPLIT = 512  # documents of an entity that one task compares
GENERALISE, REMOVE = 0.93, 0.97  # thresholds of disclosure
KIND_GENERALISE = 0.85  # the same for kinds of data, which are less than one person's
EVIDENCE = 20.7  # ln(10^6 terms / 10^-3): how unlikely by chance the company of a term and a kind must be
ANY = "any"
EXACT_TERMS = 200_000
BITS = 24
_LOWEST = -(2**63)


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ in turn: the run of local characters before it (from the end of the last match on) and a domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind that pass its test."""
    out = [("email", s, e) for s, e in emails(text)]
    if DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := DIGITS.findall(m[0])) <= 19 and luhn("".join(d)):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind in ("email", "ip") else "".join(DIGITS.findall(value))
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _kind(kind: str) -> int:
    return xxhash.xxh64_intdigest(f"kind:{kind}") - (1 << 63)


KIND_IDS = tuple(_kind(k) for k in (*KINDS, ANY))


def _free(spans):
    """A test whether no span covers any of [s, e)."""
    covered = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in covered], list(accumulate((e for _, e in covered), max))
    return lambda s, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= s


def _fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), "text")


def find_base(docs: DataFrame) -> DataFrame:
    """id, print (of the text), n_email ... n_phone, base (spans), base_sha256, entities (the values of base spans, their kinds,
    and that there is any), words (the terms of a text with entities)."""

    @lean
    def find(batches):
        for b in batches:
            out = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                spans = base_spans(text)
                base = _joined(spans)
                n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                held = {_entity(k, text[s:e]) for k, s, e in spans}
                held |= {_kind(k) for k, _, _ in spans} | ({_kind(ANY)} if spans else set())
                out.append([d, _fingerprint(text), *n, base, hashlib.sha256(base.encode()).hexdigest(), sorted(held), sorted(_terms(text, spans)) if spans else []])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    kinds = [pa.int64()] * 6 + [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    names = ["id", "print", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "entities", "words"]
    schema = "id long, print long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, entities array<long>, words array<string>"
    return _rows(docs).mapInArrow(find, schema)


def _sieve(terms: DataFrame, n: int):
    """A test on sets of terms that lets every one of `terms` pass: the terms while there are at most EXACT_TERMS, else a bit for each of 2**BITS hashes."""
    spark = terms.sparkSession
    if n <= EXACT_TERMS:
        held = spark.sparkContext.broadcast(frozenset(r[0] for r in terms.select("term").collect()))
        return lambda found: found & held.value

    def mark(batches):
        bits = np.zeros(1 << BITS >> 3, np.uint8)
        for b in batches:
            for t in b.column(0).to_pylist():
                h = xxhash.xxh64_intdigest(t) >> (64 - BITS)
                bits[h >> 3] |= 1 << (h & 7)
        yield pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array([x.tobytes() for x in np.split(bits, 256)])], names=["part", "bits"])

    def join(key, rows):
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"].to_pylist()])
        return pa.table({"part": [key[0].as_py()], "bits": [whole.tobytes()]})

    parts = terms.select("term").mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(join, "part long, bits binary")
    held = spark.sparkContext.broadcast(b"".join(r["bits"] for r in sorted(parts.collect(), key=lambda r: r["part"])))  # 2 MB at any size

    def passing(found):
        bits = held.value
        return {t for t in found if bits[(h := xxhash.xxh64_intdigest(t) >> (64 - BITS)) >> 3] >> (h & 7) & 1}

    return passing


def _terms(text: str, spans=()) -> set[str]:
    """The terms of a text outside spans."""
    if not spans:
        return set(map(str.lower, set(TERM.findall(text))))
    free = _free(spans)
    return {m[0].lower() for m in TERM.finditer(text) if free(m.start(), m.end())}


@lean
def _leaders(batches):
    """(entity, term, print, words) of up to MIN_CONTEXTS documents for each entity, split and term, no two of them near copies.

    Rows come by entity, split and print; a document leads for each of its terms unless it is a near copy of one that
    leads already.  The term itself does not count as shared.  Where an entity has one split, words are left out.
    """
    last, lead = None, {}

    def led():
        rows = [(last[0], t, mark, sorted(w) if last[2] > 1 else None) for t, held in lead.items() for mark, w in held]
        for k in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000], strict=True), kinds, strict=True)], names=["entity", "term", "print", "words"])

    kinds = pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())
    for b in batches:
        for entity, split, splits, mark, words, terms in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last != (entity, split, splits):
                yield from led()
                last, lead = (entity, split, splits), {}
            own, shared = frozenset(words), {}
            for t in terms:
                held = lead.setdefault(t, [])
                if len(held) < MIN_CONTEXTS:
                    for other, w in held:
                        if other not in shared:
                            shared[other] = len(own & w)
                        both = shared[other]
                        if OF * (both - 1) >= NEAR * (len(own) + len(w) - both - 1):
                            break
                    else:
                        held.append((mark, own))
    yield from led()


def supported(pairs: DataFrame, near: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (entity, term) that stand together in MIN_CONTEXTS documents of which no two are near copies.

    near: entity, term, print.  holders: print, words, a row for each text.  An entity with many documents is split over
    tasks, whose leaders then meet by term.
    """
    shape = "entity long, term string, print long, words array<string>"
    keys = pairs.select("entity", "term")
    found = near.select("entity", "term", "print").join(small(keys, keys.count(), 64), ["entity", "term"]).groupBy("entity", "print").agg(F.collect_set("term").alias("terms"))
    found = store(found, "pii-found")
    many = found.groupBy("entity").agg(F.ceil(F.count("*") / SPLIT).alias("splits"))
    words = holders.select("print", "words")
    rows = found.join(many.hint("merge"), "entity").join(words.hint("merge"), "print").withColumn("split", F.pmod(F.xxhash64("print"), F.col("splits")))
    dealt = rows.select("entity", "split", "splits", "print", "words", "terms").repartition("entity", "split").sortWithinPartitions("entity", "split", "print")
    led = store(dealt.mapInArrow(_leaders, shape), "pii-leaders")
    again = led.filter("words is not null").select("entity", F.xxhash64("term").alias("split"), F.lit(1).alias("splits"), "print", "words", F.array("term").alias("terms"))
    again = again.repartition("entity", "split").sortWithinPartitions("entity", "split", "print").mapInArrow(_leaders, shape)
    whole = led.filter("words is null").union(again)
    return whole.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS).select("entity", "term")


def _evidence(texts: Column, share: Column, base_rate: Column) -> Column:
    """How far from chance it is that of texts / share documents `share` are of an entity that `base_rate` of all are of:
    the exponent of the Chernoff bound, n times the divergence of the two rates."""
    away = F.greatest(F.lit(1e-12), 1 - share)
    divergence = share * F.log(share / base_rate) + F.when(share < 1, away * F.log(away / F.greatest(F.lit(1e-12), 1 - base_rate))).otherwise(0.0)
    return F.when(share > base_rate, texts / share * divergence).otherwise(0.0)


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """term, disclosure, for terms at or above their threshold.

    Entities are the values of base spans, each of the four kinds, and personal data of any kind.  The disclosure of entity
    e by term t is PMI(e, t) / -log p(e), with probabilities over all documents: 1 if t never occurs without e, 0 if they are
    independent.  A term gets its highest.  All counts are of rows that hold e or t anywhere, t outside the spans; repeated
    rows change no share.  A value is disclosed at GENERALISE; a kind at KIND_GENERALISE, if chance can't explain the
    company: among a million terms, none would meet a kind so often in so many different texts.  For either, near copies of
    a document count once as support.
    """
    spark = docs.sparkSession
    kind = F.col("entity").isin(*KIND_IDS)
    holders = base.filter(F.size("entities") > 0).groupBy("print").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    holders = store(holders, "pii-holders")
    held = holders.select("print", "rows", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("rows").alias("with_entity")).filter(F.col("texts") >= MIN_CONTEXTS)
    entities = store(entities.select("entity", "with_entity"), "pii-entities")
    near = holders.select("print", "rows", F.explode("entities").alias("entity"), "words").join(small(entities.select("entity"), entities.count(), 16), "entity")
    near = near.select("print", "rows", "entity", F.explode("words").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.sum("rows").alias("both"), F.count("*").alias("texts")).filter(F.col("texts") >= MIN_CONTEXTS)
    pairs = store(pairs, "pii-pairs")
    candidates = pairs.select("term").distinct()
    passing = _sieve(candidates, candidates.count())

    @lean
    def count(batches):
        held: dict[str, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                text = text or ""
                for t in passing(_terms(text, base_spans(text))):
                    held[t] = held.get(t, 0) + 1
            if len(held) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

    seen = docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    total = base.count()
    p = pairs.join(seen, "term").join(entities, "entity")
    rate = F.col("with_entity") / F.lit(float(max(total, 1)))
    share = F.least(F.lit(1.0), F.col("both") / F.col("with_term"))
    p = p.withColumn("disclosure", F.when(rate < 1, 1 - F.log(share) / F.log(rate)).otherwise(0.0))
    reached = F.when(kind, (F.col("disclosure") >= KIND_GENERALISE) & (_evidence(F.col("texts"), share, rate) >= EVIDENCE)).otherwise(F.col("disclosure") >= GENERALISE)
    p = store(p.filter(reached).select("entity", "term", "disclosure"), "pii-disclosing")
    p = p.join(supported(p, near, holders), ["entity", "term"])
    return p.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def find_spans(docs: DataFrame) -> DataFrame:
    """id, print, n_email ... n_phone, base, base_sha256, terms (spans of disclosing terms with their disclosure,
    outside the base spans), spans.

    Nulls: a null text is empty; a null doc_id stands as the lowest long.  Repeated rows have a row each.  Texts are
    searched whole, in time linear in their length.  Only doc_id and text are read.
    """
    base = store(find_base(docs), "pii-base")
    kept = base.drop("entities", "words")
    shape = "array<struct<start: long, end: long, disclosure: double>>"
    terms = store(disclosing_terms(docs, base), "pii-terms")
    passing = _sieve(terms, terms.count())

    @lean
    def occurrences(batches):
        for b in batches:
            out = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if found := passing(_terms(text)):
                    own, free = _fingerprint(text), _free(base_spans(text))
                    out += [(d, own, t, m.start(), m.end()) for m in TERM.finditer(text) if (t := m[0].lower()) in found and free(m.start(), m.end())]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["id", "print", "term", "start", "end"])

    hits = _rows(docs).mapInArrow(occurrences, "id long, print long, term string, start long, end long").join(terms.hint("merge"), "term")
    hits = hits.groupBy("id", "print").agg(F.sort_array(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    whole = kept.join(hits, ["id", "print"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(shape)))
    named = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")))
    return whole.withColumn("spans", F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), named), ","))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with text in which base spans read [EMAIL], [IP], [CARD] or [PHONE], disclosing terms at REMOVE or above are
    left out and those below it read [TERM].  Where spans overlap, the first in the order of start, then length, stands."""
    spans = find_spans(docs).select("id", "print", "base", "terms").distinct()

    @lean
    def rewrite(batches):
        for b in batches:
            at = b.schema.get_field_index
            out = []
            for text, base, terms in zip(*(b.column(at(c)).to_pylist() for c in ("text", "base", "terms")), strict=True):
                marks = [(int(s), int(e), f"[{k.upper()}]") for k, s, e in (x.split(":") for x in base.split(",") if x)]
                marks += [(t["start"], t["end"], "" if t["disclosure"] >= REMOVE else "[TERM]") for t in terms]
                parts, end = [], 0
                for s, e, word in sorted(marks, key=lambda m: (m[0], -m[1])):
                    if s >= end:
                        parts += [text[end:s], word]
                        end = e
                out.append(None if text is None else "".join([*parts, text[end:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(at(n)) for n in names], names=names)

    @lean
    def keyed(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_fingerprint(x or "") for x in texts], pa.int64())], names=[*b.schema.names, "_print"])

    names = docs.columns
    prints = docs.mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField("_print", T.LongType())]))
    whole = prints.join(spans, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)) == F.col("id")) & (F.col("_print") == F.col("print")))
    return whole.select(*(prints[n] for n in names), "base", "terms").mapInArrow(rewrite, docs.schema)


def op10_pii(spark, sf_dir) -> DataFrame:
    out = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.nullif("id", F.lit(_LOWEST)).alias("doc_id"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
