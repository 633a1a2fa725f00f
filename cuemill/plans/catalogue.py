"""Every operator as a query over the driver's tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, names, quality, resources, text, times, uris
from ..operators import candidates, cues, dedup, fallback, intervals, listings, similarity, state, timeline
from ..operators.lineage import shared_dir
from . import tables as t

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 9):
    return F.round(c, digits)


# duplicates of outputs


@query(f"""WITH {t.FOLDERS}, tops AS (SELECT signature, count(*) AS n_folders, max(score) AS score FROM rated GROUP BY signature HAVING count(*) > 1),
ranks AS (SELECT r.*, row_number() OVER (PARTITION BY r.signature ORDER BY r.score DESC, low, name) AS k FROM rated r JOIN tops USING (signature))
SELECT a.signature, a.name AS canonical, n_folders, a.score, b.score AS runner_up, CASE WHEN a.score > b.score THEN 'delete_duplicates' ELSE 'keep' END AS decision
FROM tops JOIN ranks a ON a.signature = tops.signature AND a.k = 1 JOIN ranks b ON b.signature = tops.signature AND b.k = 2""")
def content_signature_dedup(spark, sf_dir) -> DataFrame:
    return dedup.decisions(t.folders(spark, sf_dir))


@query(f"""WITH {t.FOLDERS} SELECT signature, name, score, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM rated WINDOW w AS (PARTITION BY signature ORDER BY score DESC, low, name)""")
def ranked_folders(spark, sf_dir) -> DataFrame:
    return dedup.ranked(t.folders(spark, sf_dir))


@query(f"""WITH {t.FOLDERS}, ranks AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM rated WINDOW w AS (PARTITION BY signature ORDER BY score DESC, low, name)),
tops AS (SELECT signature, name AS canonical FROM ranks WHERE k = 1 AND score > nxt),
plan AS (SELECT signature, canonical, name AS duplicate FROM rated JOIN tops USING (signature) WHERE name <> canonical),
fresh AS (SELECT name, CASE WHEN right(name, 1) = '3' THEN 'changed' ELSE signature END AS signature FROM folders WHERE right(name, 1) <> '7')
SELECT p.*, CASE WHEN c.name IS NULL THEN 'canonical is gone' WHEN d.name IS NULL THEN 'duplicate is gone' WHEN c.signature <> p.signature THEN 'canonical changed' WHEN d.signature <> p.signature THEN 'duplicate changed' END AS refusal
FROM plan p LEFT JOIN fresh c ON c.name = canonical LEFT JOIN fresh d ON d.name = duplicate""")
def checked_deletions(spark, sf_dir) -> DataFrame:
    f = t.folders(spark, sf_dir)
    last = F.substring("name", -1, 1)
    now = f.filter(last != "7").withColumn("signature", F.when(last == "3", "changed").otherwise(F.col("signature")))
    return dedup.checked(dedup.plan(f, dedup.decisions(f)), now)


@query("""SELECT conv_id AS folder, string_agg(sha256(text), ',' ORDER BY sha256(text)) AS signature FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def folder_signatures(spark, sf_dir) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations")
    path = F.concat(F.when(F.col("role") == "system", "_manifests/").otherwise(""), F.col("turn").cast("string"))
    out = dedup.signatures(c.select(F.col("conv_id").alias("folder"), path.alias("rel_path"), F.col("text").alias("content")))
    return out.withColumn("signature", F.array_join("signature", ","))


@query("""SELECT o_orderkey AS id, 'kept' AS part FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'removed' FROM orders WHERE o_orderstatus = 'F'""")
def registry_removal(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("output_folder"))
    kept, gone = dedup.removed(o, spark.createDataFrame([("F",)], "name string"))
    return kept.select(F.col("o_orderkey").alias("id"), F.lit("kept").alias("part")).union(gone.select("o_orderkey", F.lit("removed")))


# segment quality


@query(f"""WITH {t.MEASURED} SELECT doc_id, word_count, round(unique_ratio, 9) AS unique_ratio, round(dominant_ratio, 9) AS dominant_ratio, round(bigram_ratio, 9) AS bigram_ratio,
  round(trigram_ratio, 9) AS trigram_ratio, round(repetition, 9) AS repetition FROM scored""")
def word_repetition(spark, sf_dir) -> DataFrame:
    out = t.texts(spark, sf_dir).select("doc_id", quality.metrics(F.col("text")).alias("m")).select("doc_id", "m.*")
    return out.select("doc_id", "word_count", *[_r(k).alias(k) for k in (*quality.METRICS[1:], "repetition")])


@query(f"WITH {t.MEASURED} SELECT doc_id, reasons FROM reasoned")
def suspicion_reasons(spark, sf_dir) -> DataFrame:
    return candidates.with_quality(t.measured(spark, sf_dir)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {t.MEASURED} SELECT source, doc_id, reasons FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_reasons > 0, n_reasons, repetition,
  greatest(0.0::DOUBLE, coalesce(compression_ratio, 0.0) - 2.4::DOUBLE), greatest(0.0::DOUBLE, -1.0::DOUBLE - coalesce(avg_logprob, -1.0::DOUBLE)), greatest(0.0::DOUBLE, coalesce(no_speech_prob, 0.0) - 0.6::DOUBLE), -unique_ratio, doc_id) AS k FROM reasoned) WHERE k = 1""")
def best_candidate_per_source(spark, sf_dir) -> DataFrame:
    rows = candidates.with_quality(t.measured(spark, sf_dir)).drop("text")
    return candidates.best(rows, "source", seq="doc_id").select("source", "doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {t.MEASURED}, c AS (SELECT *, doc_id // 7 AS segment_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE (doc_id % 7 + 1) // 2 END AS round, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 2 END AS pass, n_reasons = 0 AS ok FROM reasoned),
stops AS (SELECT segment_id, min(round * 10 + pass) FILTER (ok) AS stop, bool_or(round = 0 AND ok) AS first FROM c GROUP BY segment_id),
live AS (SELECT c.* FROM c JOIN stops USING (segment_id) WHERE (stop IS NULL OR round * 10 + pass <= stop) AND ((first AND round = 0) OR (NOT first AND round > 0)))
SELECT segment_id, doc_id, ok AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n_reasons > 0, n_reasons, repetition, greatest(0.0::DOUBLE, coalesce(compression_ratio, 0.0) - 2.4::DOUBLE),
  greatest(0.0::DOUBLE, -1.0::DOUBLE - coalesce(avg_logprob, -1.0::DOUBLE)), greatest(0.0::DOUBLE, coalesce(no_speech_prob, 0.0) - 0.6::DOUBLE), -unique_ratio, round, pass, doc_id) AS k FROM live) WHERE k = 1""")
def selective_recovery(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 7
    m = t.measured(spark, sf_dir).withColumns({
        "segment_id": F.floor(F.col("doc_id") / 7).cast("long"),
        "round": F.when(k == 0, 0).otherwise(F.floor((k + 1) / 2)).cast("int"),
        "pass": F.when(k == 0, 0).otherwise(F.col("doc_id") % 2).cast("int"),
        "pos": F.col("doc_id"),
    })
    return candidates.recovered(candidates.with_quality(m).drop("text")).select("segment_id", "doc_id", "accepted")


# timed segments


@query(f"""WITH {t.SEGMENTS} SELECT seq, isfinite(start) AND isfinite("end") AND start >= 0 AND "end" > start AS valid FROM segments""")
def interval_rules_strict(spark, sf_dir) -> DataFrame:
    return intervals.strict(t.segments(spark, sf_dir)).select("seq", "valid")


@query(f"""WITH {t.SEGMENTS}, f AS (SELECT *, CASE WHEN start < 0 THEN 'negative start' WHEN "end" < start THEN 'end before start' END AS fault FROM segments)
SELECT media_id, arg_min(fault, seq) FILTER (fault IS NOT NULL) AS fault, count(*) FILTER (text = '') AS n_empty, count(*) AS n_cues FROM f GROUP BY media_id""")
def interval_rules_lenient(spark, sf_dir) -> DataFrame:
    return intervals.lenient(t.segments(spark, sf_dir))


@query(f"""WITH {t.SEGMENTS}, l AS (SELECT *, lag(start) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM segments)
SELECT seq, concat_ws(',', CASE WHEN start < 0 THEN 'negative start' END, CASE WHEN "end" < start THEN 'end before start' END, CASE WHEN start + 0.001::DOUBLE < coalesce(before, -1.0) THEN 'unordered' END) AS faults FROM l""")
def interval_rules_repair(spark, sf_dir) -> DataFrame:
    return intervals.all_faults(t.segments(spark, sf_dir)).select("seq", F.array_join("faults", ",").alias("faults"))


@query(f"""WITH {t.SEGMENTS}, l AS (SELECT *, lag("end") OVER (PARTITION BY media_id ORDER BY seq) AS before FROM segments),
f AS (SELECT *, CASE WHEN start < 0 OR "end" <= start THEN 'invalid time' WHEN start < before THEN 'overlap' END AS fault FROM l)
SELECT media_id, arg_min(fault, seq) FILTER (fault IS NOT NULL) AS fault, count(*) AS n_cues FROM f GROUP BY media_id""")
def interval_rules_tts(spark, sf_dir) -> DataFrame:
    return intervals.speech(t.segments(spark, sf_dir))


@query(f"""WITH {t.SEGMENTS}, s AS (SELECT media_id, seq, text, CASE WHEN seq % 67 = 9 THEN NULL ELSE start END AS start, "end" FROM segments),
l AS (SELECT *, coalesce(lag(start) OVER w, -1.0) AS ps, coalesce(lag("end") OVER w, -1.0) AS pe, CASE WHEN start < 0 THEN 'negative start' WHEN "end" < start THEN 'end before start' END AS f FROM s WHERE start IS NOT NULL WINDOW w AS (PARTITION BY media_id ORDER BY seq)),
o AS (SELECT media_id, count(*) FILTER (start + 0.001::DOUBLE < ps) AS n_unordered, count(*) FILTER (start + 0.001::DOUBLE < pe AND pe - start > 10) AS n_overlap, arg_min(f, seq) FILTER (f IS NOT NULL) AS fault FROM l GROUP BY media_id),
b AS (SELECT media_id, count(*) AS n_cues, count(*) FILTER (start IS NULL) AS n_unreadable FROM s GROUP BY media_id)
SELECT b.media_id, n_cues, n_unreadable, coalesce(n_unordered, 0) AS n_unordered, coalesce(n_overlap, 0) AS n_overlap, fault, media_id % 5 > 0 AND n_cues > (media_id % 5) * 10 + 100 AS too_many,
  fault IS NULL AND n_unreadable = 0 AND coalesce(n_unordered, 0) = 0 AND coalesce(n_overlap, 0) = 0 AND NOT (media_id % 5 > 0 AND n_cues > (media_id % 5) * 10 + 100) AS valid
FROM b LEFT JOIN o USING (media_id)""")
def interval_rules_reprocess(spark, sf_dir) -> DataFrame:
    s = t.segments(spark, sf_dir).withColumn("start", F.when(F.col("seq") % 67 != 9, F.col("start")))
    previous = s.select("media_id").distinct().withColumn("n_previous", F.col("media_id") % 5)
    return intervals.regenerated(s, previous)


_GAPS = f"""WITH {t.SEGMENTS}, g AS (SELECT * FROM segments WHERE isfinite(start) AND isfinite("end") AND start >= 0 AND "end" > start),
n AS (SELECT *, coalesce((start - lag("end") OVER (PARTITION BY media_id ORDER BY seq) > @GAP)::INT, 0) AS new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM n)
SELECT media_id, segment, round(arg_min(start, seq), 6) AS start, round(arg_max("end", seq), 6) AS "end", count(*) AS n_words, trim(string_agg(text, '@JOIN' ORDER BY seq), ' ') AS text
FROM c GROUP BY media_id, segment HAVING trim(string_agg(text, '@JOIN' ORDER BY seq), ' ') <> ''"""


@query(_GAPS.replace("@GAP", "3600.0::DOUBLE").replace("@JOIN", ""))
def gap_segments(spark, sf_dir) -> DataFrame:
    out = intervals.gap_segments(t.segments(spark, sf_dir), threshold=3600.0)
    return out.withColumn("start", _r("start", 6)).withColumn("end", _r("end", 6))


@query(_GAPS.replace("@GAP", "3600.0::DOUBLE").replace("@JOIN", ""))
def gap_session_stream(spark, sf_dir) -> DataFrame:
    """gap_segments from a stream of words in the order of their time, file by file; a word far ahead seals what is open."""
    from ..streaming import sessions

    words = t.segments(spark, sf_dir)
    clock = spark.range(1).select(F.lit(-1).cast(words.schema["media_id"].dataType).alias("media_id"), F.lit(-1).cast("long").alias("seq"), F.lit(4e9).alias("start"), F.lit(4e9 + 1).alias("end"), F.lit("tick").alias("text"))
    root = f"{shared_dir(spark)}/cuemill/sessions-{uuid.uuid4().hex}"
    words.repartitionByRange(4, "start").write.mode("append").parquet(f"{root}/in")
    clock.coalesce(1).write.mode("append").parquet(f"{root}/in")
    live = spark.newSession()
    live.conf.set(sessions.STORE, sessions.ROCKS)
    got = sessions.gap_sessions(live.readStream.schema(words.schema).parquet(f"{root}/in"), threshold=3600.0, delay="1 hour")
    shape = got.schema
    run = got.writeStream.format("parquet").option("checkpointLocation", f"{root}/check").option("path", f"{root}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(shape).parquet(f"{root}/out").filter("media_id <> -1")
    return out.withColumn("start", _r("start", 6)).withColumn("end", _r("end", 6))


@query(_GAPS.replace("@GAP", "0.1::DOUBLE").replace("@JOIN", " "))
def gap_segments_spaced(spark, sf_dir) -> DataFrame:
    out = intervals.gap_segments(t.segments(spark, sf_dir), threshold=0.0, joiner=" ")
    return out.withColumn("start", _r("start", 6)).withColumn("end", _r("end", 6))


@query(f"""WITH {t.SEGMENTS}, g AS (SELECT *, start - lag("end") OVER (PARTITION BY media_id ORDER BY seq) AS gap FROM segments WHERE isfinite("end"))
SELECT media_id, count(*) AS n_cues, round(arg_min(start, seq), 6) AS first_start, round(arg_max("end", seq), 6) AS last_end, count(*) FILTER (gap > 0.001::DOUBLE) AS n_gaps,
  round(coalesce(max(gap) FILTER (gap > 0.001::DOUBLE), 0.0), 6) AS max_gap, count(*) FILTER (gap < -0.001::DOUBLE) AS n_overlaps, round(coalesce(max(-gap) FILTER (gap < -0.001::DOUBLE), 0.0), 6) AS max_overlap FROM g GROUP BY media_id""")
def gap_overlap_diagnostics(spark, sf_dir) -> DataFrame:
    out = intervals.diagnostics(t.segments(spark, sf_dir).filter(F.col("end") < float("inf")))
    return out.select("media_id", "n_cues", *[_r(c, 6).alias(c) if c not in ("n_gaps", "n_overlaps") else c for c in ("first_start", "last_end", "n_gaps", "max_gap", "n_overlaps", "max_overlap")])


@query(f"""WITH {t.SEGMENTS} SELECT media_id, seq, row_number() OVER (PARTITION BY media_id ORDER BY start, "end", seq) AS place FROM segments""")
def sorted_segments(spark, sf_dir) -> DataFrame:
    return intervals.in_order(t.segments(spark, sf_dir)).select("media_id", "seq", "place")


# cue lists


@query(f"""WITH {t.CUES}, {t.PERTURBED} SELECT coalesce(a.media_id, b.media_id) AS media_id, coalesce(a.index, b.index) AS index,
  CASE WHEN a.media_id IS NULL THEN 'extra' WHEN b.media_id IS NULL THEN 'missing' ELSE 'changed time' END AS kind
FROM cues a FULL JOIN perturbed b ON a.media_id = b.media_id AND a.index = b.index WHERE a.media_id IS NULL OR b.media_id IS NULL OR a.start <> b.start OR a."end" <> b."end" """)
def cue_alignment(spark, sf_dir) -> DataFrame:
    c = t.cues(spark, sf_dir)
    return cues.misaligned(c, t.perturbed(c))


@query(f"""WITH {t.CUES}, {t.PERTURBED} SELECT a.media_id, a.index, coalesce(b.text, '') AS source_text FROM cues a LEFT JOIN perturbed b ON a.media_id = b.media_id AND a.index = b.index""")
def source_texts(spark, sf_dir) -> DataFrame:
    c = t.cues(spark, sf_dir)
    return cues.with_source(c, t.perturbed(c)).select("media_id", "index", "source_text")


@query(f"""WITH {t.CUES} SELECT media_id, index, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after FROM cues WINDOW w AS (PARTITION BY media_id ORDER BY index)""")
def neighbour_context(spark, sf_dir) -> DataFrame:
    return cues.with_neighbours(t.cues(spark, sf_dir)).select("media_id", "index", "before", "after")


@query(f"""WITH {t.CUES} SELECT media_id, index, 'opening' AS engine, text AS before, '<' || substring(text, 2) AS after, 1.0::DOUBLE AS confidence FROM cues WHERE length(text) >= 1 AND index % 3 = 0 AND text <> '<' || substring(text, 2)
UNION ALL SELECT media_id, index, 'closing', CASE WHEN index % 3 = 0 THEN '<' || substring(text, 2) ELSE text END, left(CASE WHEN index % 3 = 0 THEN '<' || substring(text, 2) ELSE text END, length(text) - 1) || '>', 0.5::DOUBLE FROM cues WHERE length(text) >= 2 AND index % 2 = 0 AND right(text, 1) <> '>'""")
def review_issues(spark, sf_dir) -> DataFrame:
    edit = "array<struct<offset: int, length: int, value: string>>"

    def opening(c):
        out_of_range = F.struct(F.lit(100000).alias("offset"), F.lit(1).alias("length"), F.lit("!").alias("value"))
        first = F.struct(F.lit(0).alias("offset"), F.lit(1).alias("length"), F.lit("<").alias("value"))
        empty = F.struct(F.lit(0).alias("offset"), F.lit(0).alias("length"), F.lit("").alias("value"))
        return c.filter("index % 3 = 0").select("media_id", "index", F.array(out_of_range, empty, first).cast(edit).alias("edits"), F.lit(7.0).alias("confidence"))

    def closing(c):
        last = F.struct((F.length("text") - 1).alias("offset"), F.lit(1).alias("length"), F.lit(">").alias("value"))
        return c.filter("index % 2 = 0 and length(text) >= 2").select("media_id", "index", F.array(last).cast(edit).alias("edits"), F.lit(0.5).alias("confidence"))

    return cues.reviewed(t.cues(spark, sf_dir).select("media_id", "index", "text"), [("opening", opening), ("closing", closing)])[1]


# incremental state


def _manifest(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("success", "error", "already_current", "partial_translation", "renamed_existing")]), (k % 5 + 1).cast("int"))
    rows = o.filter(k % 4 != 1).select((k % 9000).alias("source"), k.alias("pos"), status.alias("status"), F.concat(F.lit("out_"), (k % 700).cast("string")).alias("output_folder"))
    return rows.withColumn("required", F.array(F.lit("video"), F.lit("vtt")))


_MANIFEST = """manifest AS (SELECT o_orderkey % 9000 AS source, o_orderkey AS pos, ['success', 'error', 'already_current', 'partial_translation', 'renamed_existing'][o_orderkey % 5 + 1] AS status, 'out_' || (o_orderkey % 700) AS output_folder FROM orders WHERE o_orderkey % 4 <> 1),
artefacts AS (SELECT DISTINCT output_folder AS folder, n AS name FROM manifest, (VALUES ('video'), ('vtt')) v(n) WHERE NOT (n = 'vtt' AND output_folder LIKE '%3'))"""


@query(f"""WITH {_MANIFEST}, e AS (SELECT source, arg_max(output_folder, pos) AS output_folder FROM manifest WHERE status IN ('success', 'already_current', 'renamed_existing') GROUP BY source),
ok AS (SELECT * FROM e WHERE (SELECT count(*) FROM artefacts a WHERE a.folder = e.output_folder) = 2),
s AS (SELECT DISTINCT o_orderkey % 9000 AS source FROM orders)
SELECT s.source, ok.output_folder, ok.source IS NOT NULL AS resumed FROM s LEFT JOIN ok ON s.source = ok.source""")
def resume_split(spark, sf_dir) -> DataFrame:
    m = _manifest(spark, sf_dir)
    have = m.select(F.col("output_folder").alias("folder"), F.explode("required").alias("name")).distinct().filter("not (name = 'vtt' and folder like '%3')")
    sources = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9000).alias("source")).distinct()
    return state.resume_split(sources, m, have).select("source", "output_folder", "resumed")


@query(f"""WITH {_MANIFEST}, s AS (SELECT DISTINCT o_orderkey % 9500 AS source FROM orders), h AS (SELECT source, count(DISTINCT output_folder) AS n, min(output_folder) AS f FROM manifest GROUP BY source)
SELECT s.source, CASE WHEN coalesce(n, 0) = 0 THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS match, CASE WHEN n = 1 THEN f END AS output_folder FROM s LEFT JOIN h ON s.source = h.source""")
def folder_of_source(spark, sf_dir) -> DataFrame:
    wanted = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9500).alias("source")).distinct()
    return state.matched_folders(wanted, _manifest(spark, sf_dir))


@query("""WITH r AS (SELECT sha256(text) AS h, doc_id AS pos, CASE WHEN doc_id % 3 > 0 THEN 'f' || doc_id ELSE '' END AS f FROM documents WHERE doc_id % 2 = 0),
m AS (SELECT h, min(pos) AS pos, arg_min(f, pos) AS f FROM r WHERE f <> '' GROUP BY h)
SELECT doc_id, m.pos AS duplicate_pos, m.f AS duplicate_folder FROM documents LEFT JOIN m ON sha256(text) = m.h""")
def registry_lookup(spark, sf_dir) -> DataFrame:
    d = t.texts(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    folder = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).otherwise("")
    registry = d.filter("doc_id % 2 = 0").select("sha256", F.col("doc_id").alias("pos"), folder.alias("output_folder"), F.lit("s").alias("source"))
    out = state.first_duplicates(d, registry)
    return out.select("doc_id", F.col("duplicate.pos").alias("duplicate_pos"), F.col("duplicate.output_folder").alias("duplicate_folder"))


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 3 = 0 AND r.source = d.source AND sha256(r.text) = sha256(d.text))""")
def unprocessed_sources(spark, sf_dir) -> DataFrame:
    d = t.texts(spark, sf_dir).select("doc_id", F.col("source").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    registry = d.withColumn("status", F.when(F.col("doc_id") % 3 == 0, "success").otherwise("error")).drop("doc_id")
    return state.unprocessed(d, registry).select("doc_id")


@query("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'final' ELSE o_orderstatus END AS output_folder FROM orders""")
def registry_moves(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("output_folder"))
    return state.moved(o, spark.createDataFrame([("F", "final")], "old string, new string")).select("id", "output_folder")


def _runs(spark, sf_dir):
    """Orders as the outcomes of a customer's run; enough of each mix of outcomes."""
    o = t.table(spark, sf_dir, "orders")
    c = F.col("o_custkey") % 6
    status = (
        F.when(c == 0, F.when(F.col("o_orderstatus") == "F", "error").otherwise("success"))
        .when(c == 1, "success")
        .when(c == 2, "error")
        .when(c == 3, F.when(F.col("o_orderstatus") == "O", "partial").otherwise("success"))
        .when(c == 4, F.when(F.col("o_orderstatus") == "O", "partial_translation").otherwise("success"))
        .otherwise(F.when(F.col("o_orderstatus") == "P", "error").otherwise("skipped"))
    )
    return o.select("o_custkey", status.alias("status"))


_RUNS = """runs AS (SELECT o_custkey, CASE o_custkey % 6 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END WHEN 1 THEN 'success' WHEN 2 THEN 'error'
  WHEN 3 THEN CASE WHEN o_orderstatus = 'O' THEN 'partial' ELSE 'success' END WHEN 4 THEN CASE WHEN o_orderstatus = 'O' THEN 'partial_translation' ELSE 'success' END
  ELSE CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'skipped' END END AS status FROM orders),
n AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'partial_translation') AS pt, count(*) FILTER (status = 'skipped') AS k FROM runs GROUP BY o_custkey)"""


@query(f"""WITH {_RUNS} SELECT o_custkey, s AS n_success, e AS n_error, p AS n_partial, k AS n_skipped, CASE WHEN e > 0 AND s = 0 THEN 'error' WHEN e > 0 OR p > 0 THEN 'partial' ELSE 'success' END AS batch,
  CASE WHEN e > 0 OR pt > 0 THEN 'partial' ELSE 'success' END AS archive, CASE WHEN e > 0 AND e = total THEN 'error' ELSE 'success' END AS raw,
  CASE WHEN e > 0 THEN CASE WHEN s + pt > 0 THEN 'partial_failure' ELSE 'error' END WHEN pt > 0 THEN 'partial_translation' ELSE 'success' END AS reprocess FROM n""")
def status_rollups(spark, sf_dir) -> DataFrame:
    s = F.col("status")
    return _runs(spark, sf_dir).groupBy("o_custkey").agg(
        *state.counts(s, ["success", "error", "partial", "skipped"]),
        state.batch_status(s).alias("batch"),
        state.archive_status(s).alias("archive"),
        state.raw_status(s).alias("raw"),
        state.reprocess_status(s).alias("reprocess"),
    )


@query(f"""WITH {_MANIFEST} SELECT source, string_agg(DISTINCT output_folder, ',' ORDER BY output_folder) AS folders FROM manifest GROUP BY source""")
def distinct_folders(spark, sf_dir) -> DataFrame:
    return _manifest(spark, sf_dir).groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("output_folder")), ",").alias("folders"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS stem, left(sha256(p_type), 8) AS d, p_brand LIKE '%1' AS taken FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS k, row_number() OVER (PARTITION BY stem, d ORDER BY p_partkey) AS q FROM p),
f AS (SELECT *, first_value(d) OVER (PARTITION BY stem ORDER BY p_partkey) AS first_d FROM r)
SELECT p_partkey, CASE WHEN k = 1 AND NOT taken THEN stem WHEN n = 1 THEN stem || '___' || d ELSE stem || '___' || d || printf('_%02d', n) END AS output_stem
FROM (SELECT *, q - (CASE WHEN d = first_d AND NOT taken THEN 1 ELSE 0 END) AS n FROM f)""")
def unique_stems(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("stem"), F.sha2("p_type", 256).alias("sha256"))
    return state.unique_stems(p, p.filter("stem like '%1'").select("stem"), order="p_partkey").select("p_partkey", "output_stem")


@query("""WITH r AS (SELECT o_custkey AS archive, o_orderkey AS pos, count(*) OVER w AS files, sum(o_orderkey % 1000) OVER w AS bytes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT archive, pos, files, bytes::BIGINT AS bytes, CASE WHEN files > 8 THEN 'files' WHEN bytes > 4000 THEN 'bytes' END AS fault FROM r""")
def running_limits(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.lit(0).alias("depth"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 1000).alias("size"))
    return state.within_limits(o, 8, 4000).select("archive", "pos", "files", "bytes", "fault")


@query("""SELECT o_custkey AS archive, count(*) AS files, sum(o_orderkey % 1000)::BIGINT AS bytes, max(o_orderkey % 4)::BIGINT AS depth FROM orders GROUP BY o_custkey""")
def extraction_totals(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), (F.col("o_orderkey") % 4).alias("depth"), (F.col("o_orderkey") % 1000).alias("size"))
    return state.totals(o)


@query("""WITH m AS (SELECT p_size AS archive, p_partkey AS pos, lower(nfc_normalize(CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) || '/e' || chr(769) ELSE lower(p_brand) || '/' || chr(233) END)) AS path FROM part)
SELECT archive, pos, row_number() OVER (PARTITION BY archive, path ORDER BY pos) > 1 AS collides FROM m""")
def path_collisions(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_brand"), F.lit("/e\u0301"))).otherwise(F.concat(F.lower("p_brand"), F.lit("/\u00e9")))
    m = p.select(F.col("p_size").alias("archive"), F.lit(0).alias("depth"), F.col("p_partkey").alias("pos"), name.alias("name"))
    return state.collisions(m, text.casefold_any(text.nfc("name"))).select("archive", "pos", "collides")


@query("""WITH RECURSIVE items(id, parent) AS (SELECT 'r' || r_regionkey, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
tree(id, depth, path) AS (SELECT id, 0, id FROM items WHERE parent IS NULL UNION ALL SELECT i.id, depth + 1, path || '/' || i.id FROM items i JOIN tree ON i.parent = tree.id WHERE depth < 5)
SELECT id, depth, path FROM tree""")
def container_tree(spark, sf_dir) -> DataFrame:
    from ..operators.archives import tree

    s = lambda c: F.col(c).cast("string")
    r = t.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), s("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"))
    n = t.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), s("n_nationkey")), F.concat(F.lit("r"), s("n_regionkey")))
    c = t.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), s("c_custkey")), F.concat(F.lit("n"), s("c_nationkey")))
    return tree(r.union(n).union(c), 5)


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS o, o_orderkey % 3 > 0 AS t, o_orderkey % 7 > 0 AS v, ['stt_only', 'translate_only', 'full', 'other'][o_orderkey % 4 + 1] AS m FROM orders)
SELECT o_orderkey, CASE WHEN NOT v THEN 'skipped' WHEN NOT o THEN 'transcribe_and_translate' WHEN NOT t THEN 'translate' ELSE 'valid' END AS repair,
  CASE WHEN m IN ('stt_only', 'full') AND NOT v THEN 'error' WHEN m = 'translate_only' AND NOT o THEN 'error' WHEN m <> 'other' THEN m END AS reprocess,
  CASE WHEN NOT v THEN 'no_video' WHEN NOT t THEN 'no_subtitles' WHEN o_orderkey % 5 = 0 THEN 'exists' WHEN NOT o THEN 'not_repaired' ELSE 'synthesize' END AS synthesis FROM f""")
def output_decisions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    o, tr, v = k % 2 == 0, k % 3 > 0, k % 7 > 0
    mode = F.element_at(F.array(*[F.lit(m) for m in ("stt_only", "translate_only", "full", "other")]), (k % 4 + 1).cast("int"))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", state.repair_action(o, tr, v).alias("repair"), state.reprocess_action(mode, o, v).alias("reprocess"), state.synthesis_action(v, o, tr, k % 5 == 0).alias("synthesis"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey % 10 END AS folder, 'a' || o_orderkey % 7 AS desired FROM orders)
SELECT k, CASE WHEN k % 4 = 0 THEN CASE WHEN coalesce(folder <> desired, false) THEN 'renamed_existing' ELSE 'already_current' END WHEN k % 5 = 0 THEN CASE WHEN folder IS NOT NULL THEN 'renamed_existing' ELSE 'skipped_duplicate' END WHEN k % 11 = 0 THEN 'error' ELSE 'success' END AS status FROM f""")
def source_statuses(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    a = lambda n: F.concat(F.lit("a"), (k % n).cast("string"))
    rows = t.table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 3 == 0, a(10)).alias("folder"), a(7).alias("desired"), (k % 4 == 0).alias("resumed"), (k % 5 == 0).alias("duplicate"), (k % 11 == 0).alias("failed"))
    return state.source_status(rows).select("k", "status")


_RENAMES = f"""{_MANIFEST}, s AS (SELECT DISTINCT o_orderkey % 9500 AS source, 'out_' || o_orderkey % 9500 % 1400 AS desired FROM orders), folders AS (SELECT DISTINCT output_folder AS folder FROM manifest WHERE output_folder NOT LIKE '%7')"""


def _renamed(spark, sf_dir):
    k = F.col("o_orderkey") % 9500
    sources = t.table(spark, sf_dir, "orders").select(k.alias("source"), F.concat(F.lit("out_"), (k % 1400).cast("string")).alias("desired")).distinct()
    m = _manifest(spark, sf_dir)
    return sources, m, m.select(F.col("output_folder").alias("folder")).distinct().filter("folder not like '%7'")


@query(f"""WITH {_RENAMES}, e AS (SELECT source, arg_max(output_folder, pos) AS old_folder FROM manifest WHERE status IN ('success', 'renamed_existing') GROUP BY source),
r AS (SELECT s.source, desired, old_folder, CASE WHEN old_folder IS NULL THEN 'not_found_in_previous_manifest' WHEN f.folder IS NULL THEN NULL WHEN old_folder = desired THEN 'already_current' ELSE 'renamed_existing' END AS status,
  desired IN (SELECT folder FROM folders) AS taken FROM s LEFT JOIN e USING (source) LEFT JOIN folders f ON f.folder = e.old_folder),
m AS (SELECT *, row_number() OVER (PARTITION BY desired ORDER BY source) AS k, row_number() OVER (PARTITION BY desired, left(old_folder, 8) ORDER BY source) AS q, first_value(left(old_folder, 8)) OVER (PARTITION BY desired ORDER BY source) AS fd FROM r WHERE status = 'renamed_existing'),
n AS (SELECT *, q - (CASE WHEN left(old_folder, 8) = fd AND NOT taken THEN 1 ELSE 0 END) AS n FROM m)
SELECT source, status, old_folder, CASE WHEN k = 1 AND NOT taken THEN desired ELSE desired || '_' || left(old_folder, 8) || CASE WHEN n > 1 THEN printf('_%02d', n) ELSE '' END END AS output_folder FROM n
UNION ALL SELECT source, status, old_folder, CASE WHEN status = 'already_current' THEN old_folder END FROM r WHERE status IS NULL OR status <> 'renamed_existing'""")
def rename_plan(spark, sf_dir) -> DataFrame:
    return state.renames(*_renamed(spark, sf_dir))


@query(f"""WITH {_RENAMES}, e AS (SELECT source, arg_max(output_folder, pos) AS own FROM manifest WHERE status IN ('success', 'already_current', 'renamed_existing') GROUP BY source),
g AS (SELECT sha256((source % 1000)::VARCHAR) AS h, arg_min(output_folder, pos) AS dup FROM manifest WHERE pos % 3 = 0 GROUP BY h),
r AS (SELECT s.source, desired, sha256((s.source % 1000)::VARCHAR) AS h, own, dup, f.folder AS there FROM s LEFT JOIN e USING (source) LEFT JOIN g ON g.h = sha256((s.source % 1000)::VARCHAR) LEFT JOIN folders f ON f.folder = dup),
p AS (SELECT *, desired IN (SELECT folder FROM folders) AS taken, row_number() OVER (PARTITION BY desired ORDER BY source) AS k, row_number() OVER (PARTITION BY desired, h ORDER BY source) AS q, first_value(h) OVER (PARTITION BY desired ORDER BY source) AS fh FROM r WHERE own IS NULL AND dup IS NULL),
n AS (SELECT *, q - (CASE WHEN h = fh AND NOT taken THEN 1 ELSE 0 END) AS n FROM p)
SELECT source, 'pending' AS status, CASE WHEN k = 1 AND NOT taken THEN desired ELSE desired || '___' || left(h, 8) || CASE WHEN n > 1 THEN printf('_%02d', n) ELSE '' END END AS output_folder FROM n
UNION ALL SELECT source, CASE WHEN own IS NOT NULL THEN CASE WHEN own = desired THEN 'already_current' ELSE 'renamed_existing' END WHEN there IS NOT NULL THEN 'renamed_existing' ELSE 'skipped_duplicate' END, coalesce(own, there) FROM r WHERE own IS NOT NULL OR dup IS NOT NULL""")
def run_plan(spark, sf_dir) -> DataFrame:
    sources, m, folders = _renamed(spark, sf_dir)
    digest = F.sha2((F.col("source") % 1000).cast("string"), 256)
    registry = m.filter("pos % 3 = 0").select(digest.alias("sha256"), "output_folder", "source", "pos")
    return state.planned(sources.withColumn("sha256", digest), m, registry, folders)


# fallback and quotas


@query("""WITH o AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN 'A' || doc_id END AS a, CASE WHEN doc_id % 5 > 0 THEN ' B' || doc_id END AS b, CASE WHEN doc_id % 15 <> 5 THEN '' ELSE 'C' END AS c FROM documents)
SELECT doc_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), text) AS translated, CASE WHEN nullif(trim(a), '') IS NOT NULL THEN 'a' WHEN nullif(trim(b), '') IS NOT NULL THEN 'b' WHEN nullif(trim(c), '') IS NOT NULL THEN 'c' END AS provider,
  nullif(trim(a), '') IS NULL AND nullif(trim(b), '') IS NULL AND nullif(trim(c), '') IS NULL AS failed, concat_ws(',', CASE WHEN nullif(trim(a), '') IS NULL THEN 'a: blank' END, CASE WHEN nullif(trim(a), '') IS NULL AND nullif(trim(b), '') IS NULL THEN 'b: none' END) AS errors FROM o""")
def fallback_cascade(spark, sf_dir) -> DataFrame:
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    rows = t.texts(spark, sf_dir).select("doc_id", "text", F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit("A"), s)).alias("a"), F.lit("blank").alias("ea"), F.when(k % 5 > 0, F.concat(F.lit(" B"), s)).alias("b"), F.lit("none").alias("eb"), F.when(k % 15 != 5, "").otherwise("C").alias("c"))
    out = fallback.cascade(rows, [("a", "a", "ea"), ("b", "b", "eb"), ("c", "c", None)])
    return out.select("doc_id", "translated", "provider", "failed", F.array_join("errors", ",").alias("errors"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'one' WHEN doc_id % 2 = 0 THEN 'two' END AS provider, CASE WHEN doc_id % 3 = 1 THEN 'A' || n_chars WHEN doc_id % 2 = 0 THEN 'B' || n_chars ELSE text END AS translated, doc_id % 3 <> 1 AND doc_id % 2 <> 0 AS failed FROM documents""")
def fallback_passes(spark, sf_dir) -> DataFrame:
    rows = t.texts(spark, sf_dir).select(F.col("doc_id").alias("seq"), "text", "n_chars")
    k = F.col("seq")
    one = lambda r: r.select("seq", F.when(k % 3 == 1, F.concat(F.lit("A"), F.col("n_chars").cast("string"))).otherwise(" ").alias("output"))
    two = lambda r: r.select("seq", F.when(k % 2 == 0, F.concat(F.lit("B"), F.col("n_chars").cast("string"))).alias("output"))
    return fallback.passes(rows, [("one", one), ("two", two)]).select(k.alias("doc_id"), "provider", "translated", "failed")


@query("""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations WHERE trim(text) <> ''""")
def batch_ids(spark, sf_dir) -> DataFrame:
    rows = fallback.with_text(t.table(spark, sf_dir, "conversations"), "turn")
    return fallback.batch_ids(rows, 2, ["turn"], "conv_id").select("conv_id", "turn", "batch")


def _requests(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    provider = F.when(F.col("event_type").isin("click", "view"), "mymemory").when(F.col("event_type") == "purchase", "deepl").otherwise(F.col("event_type"))
    return e.select(provider.alias("provider"), "ts", F.col("event_id").alias("req_id"), (F.col("event_id") % 1000 * 30 + 1).alias("chars")).withColumn("window", fallback.quota_window())


_REQUESTS = """req AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'mymemory' WHEN event_type = 'purchase' THEN 'deepl' ELSE event_type END AS provider, ts, event_id AS req_id, event_id % 1000 * 30 + 1 AS chars FROM events),
w AS (SELECT *, CASE provider WHEN 'deepl' THEN strftime(ts, '%Y-%m') WHEN 'mymemory' THEN strftime(ts, '%Y-%m-%d') END AS "window", CASE provider WHEN 'deepl' THEN chars WHEN 'mymemory' THEN 1 ELSE chars END AS amount, CASE provider WHEN 'deepl' THEN 500000 WHEN 'mymemory' THEN 100 END AS lim FROM req)"""


@query(f"""WITH {_REQUESTS} SELECT provider, "window", sum(amount)::BIGINT AS used FROM w GROUP BY provider, "window" """)
def quota_usage(spark, sf_dir) -> DataFrame:
    r = _requests(spark, sf_dir)
    return fallback.quota_usage(r.withColumn("amount", F.when(F.col("provider") == "mymemory", 1).otherwise(F.col("chars"))))


@query(f"""WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY provider, "window" ORDER BY req_id) AS k FROM w WHERE lim IS NOT NULL),
s(provider, win, k, req_id, accepted, used) AS (SELECT provider, "window", k, req_id, amount <= lim, CASE WHEN amount <= lim THEN amount ELSE 0 END FROM n WHERE k = 1
  UNION ALL SELECT n.provider, n."window", n.k, n.req_id, s.used + n.amount <= n.lim, CASE WHEN s.used + n.amount <= n.lim THEN s.used + n.amount ELSE s.used END FROM s JOIN n ON n.provider = s.provider AND n."window" = s.win AND n.k = s.k + 1)
SELECT req_id, accepted, used::BIGINT AS used FROM s UNION ALL SELECT req_id, true, NULL FROM w WHERE lim IS NULL""")
def quota_reserve(spark, sf_dir) -> DataFrame:
    r = _requests(spark, sf_dir)
    p = F.col("provider")
    r = r.withColumn("amount", F.when(p == "mymemory", 1).otherwise(F.col("chars"))).withColumn("limit", F.when(p == "deepl", 500000).when(p == "mymemory", 100))
    return fallback.reserved(r).select("req_id", "accepted", "used")


@query(f"""WITH {_REQUESTS}, s AS (SELECT provider, "window", min(req_id) AS spent FROM w WHERE req_id % 401 = 3 AND "window" IS NOT NULL GROUP BY provider, "window")
SELECT req_id, coalesce(req_id > spent, false) AS refused FROM w LEFT JOIN s ON w.provider = s.provider AND w."window" = s."window" """)
def quota_exhausted(spark, sf_dir) -> DataFrame:
    r = _requests(spark, sf_dir)
    return fallback.exhausted(r, r.filter("req_id % 401 = 3 and window is not null")).select("req_id", "refused")


@query("""SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN ['deepl', 'my_memory'] WHEN 1 THEN ['b', 'a'] ELSE [] END, ',') AS providers, CASE doc_id % 2 WHEN 0 THEN 'y,z' ELSE '' END AS unknown FROM documents""")
def option_lists(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    given = F.when(k % 3 == 0, arr(" DeepL", "my-memory", "deepl ", "")).when(k % 3 == 1, arr("b", "a", "B")).otherwise(arr(" "))
    options = F.when(k % 2 == 0, arr("z", "a", "y", "z")).otherwise(arr("a", "b"))
    return t.texts(spark, sf_dir).select("doc_id", F.array_join(text.first_distinct(given), ",").alias("providers"), F.array_join(text.unknown_options(options, arr("a", "b", "c")), ",").alias("unknown"))


# names and addresses


@query("""WITH n AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'a/b.zip' WHEN 2 THEN '__MACOSX/x.mp4' WHEN 3 THEN 'dir.v2/none' WHEN 4 THEN 's.mp3' WHEN 5 THEN 's.Mov' WHEN 6 THEN 's.mkv' WHEN 7 THEN 's.avi' WHEN 8 THEN 's.wmv' WHEN 9 THEN 's.webm' WHEN 10 THEN 's.m4v' ELSE url END AS name FROM pages),
e AS (SELECT *, lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1)) AS ext FROM n)
SELECT page_id, CASE WHEN ext IN ('.mp4', '.mp3', '.wmv', '.mov', '.mkv', '.avi') THEN 'media' WHEN ext = '.zip' THEN 'nested_zip' ELSE 'ignored' END AS kind,
  ext IN ('.mp4', '.mov', '.mkv', '.avi', '.webm', '.m4v', '.wmv') AS raw, starts_with(name, '__MACOSX/') OR contains(name, '/__MACOSX/') OR ends_with(name, '.DS_Store') AS junk FROM e""")
def extension_classes(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "pages")
    given = ["clip.MP4", "a/b.zip", "__MACOSX/x.mp4", "dir.v2/none", "s.mp3", "s.Mov", "s.mkv", "s.avi", "s.wmv", "s.webm", "s.m4v"]
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, given)), (F.col("page_id") % 12 + 1).cast("int")), F.col("url"))
    return p.select("page_id", uris.media_class(name).alias("kind"), (uris.media_class(name, uris.RAW_MEDIA) == "media").alias("raw"), uris.is_junk(name).alias("junk"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'https', 'local') WHEN 1 THEN 'gdrive://a%20b+' || page_id WHEN 2 THEN 'rclone://remote:%zzx' ELSE url END AS u FROM pages)
SELECT page_id, CASE WHEN regexp_matches(u, '^(local|gdrive|rclone)://') THEN regexp_extract(u, '^([a-z]+)://', 1) END AS scheme,
  CASE page_id % 4 WHEN 1 THEN 'a b+' || page_id WHEN 2 THEN 'remote:%zzx' ELSE CASE WHEN regexp_matches(u, '^(local|gdrive|rclone)://') THEN regexp_extract(u, '^[a-z]+://(.*)$', 1) END END AS value,
  CASE WHEN regexp_matches(u, '^local://') THEN 'local' WHEN regexp_matches(u, '^gdrive://') THEN 'google_drive' WHEN regexp_matches(u, '^rclone://') THEN 'rclone' END AS provider FROM u""")
def uri_parse(spark, sf_dir) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.replace("url", F.lit("https"), F.lit("local"))).when(k == 1, F.concat(F.lit("gdrive://a%20b+"), F.col("page_id").cast("string"))).when(k == 2, "rclone://remote:%zzx").otherwise(F.col("url"))
    return t.table(spark, sf_dir, "pages").select("page_id", uris.parse_uri(u).alias("u")).select("page_id", "u.scheme", "u.value", "u.provider")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(url || ' Ünïcode-ß & 3$')), 'ß', 'ss'), '[\p{P}\p{Z}\s]', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g'), '_+', '_', 'g'), '_') AS name FROM pages""")
def name_clean(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", names.clean_name(F.concat("url", F.lit(" Ünïcode-ß & 3$"))).alias("name"))


@query(f"""WITH {t.FOLDERS} SELECT name, max(score) AS score FROM rated GROUP BY name""")
def name_stability(spark, sf_dir) -> DataFrame:
    f = t.folders(spark, sf_dir).select("name").distinct()
    return f.select("name", names.stability(F.col("name"))["score"].alias("score"))


_RESERVED = """n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CON' WHEN 1 THEN 'lpt1.txt' WHEN 2 THEN 'com0' WHEN 3 THEN 'nul. ' WHEN 4 THEN 'console' ELSE p_name END AS name FROM part)"""


@query(f"""WITH {_RESERVED} SELECT p_partkey, regexp_matches(lower(regexp_replace(name, '[ .]+$', '')), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$') AS reserved FROM n""")
def reserved_names(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "CON").when(k == 1, "lpt1.txt").when(k == 2, "com0").when(k == 3, "nul. ").when(k == 4, "console").otherwise(F.col("p_name"))
    return t.table(spark, sf_dir, "part").select("p_partkey", names.is_reserved(name).alias("reserved"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'absolute' WHEN 1 THEN 'absolute' WHEN 2 THEN 'parent' WHEN 3 THEN 'reserved' WHEN 4 THEN 'empty' WHEN 5 THEN 'symlink' WHEN 6 THEN 'absolute' END AS fault FROM part""")
def member_faults(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 8
    name = F.when(k == 0, "/etc/x").when(k == 1, "C:\\x").when(k == 2, "a/../b").when(k == 3, "a/aux.txt").when(k == 4, "").when(k == 6, "\\\\host\\share").otherwise(F.concat(F.lit("dir/"), F.col("p_name")))
    return t.table(spark, sf_dir, "part").select("p_partkey", uris.member_fault(name, k == 5).alias("fault"))


@query(r"""SELECT p_partkey, regexp_extract(p_name || '.WeBm', '^(.*?)(\.[A-Za-z0-9]{2,8})$', 1) AS stem, '.webm' AS extension, CASE WHEN strlen(p_name || '-é') <= 9 THEN p_name || '-é' ELSE left(p_name || '-', 9) END AS short FROM part""")
def name_parts(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "part")
    s = names.split_extension(F.concat("p_name", F.lit(".WeBm")))
    return p.select("p_partkey", s["stem"].alias("stem"), s["extension"].alias("extension"), names.truncate_bytes(F.concat("p_name", F.lit("-é")), 9).alias("short"))


@query("""SELECT p_partkey, 'talk ' || p_partkey || ' _ end' AS cleaned FROM part""")
def date_artefacts(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    stamp = F.element_at(F.array(*[F.lit(x) for x in ("2024-01-05", "05.01.2024", "20240105T101010Z", "2024/1/5 23:59", "1999_12_31")]), (k % 5 + 1).cast("int"))
    return t.table(spark, sf_dir, "part").select("p_partkey", names.strip_dates(F.concat(F.lit("talk "), s, F.lit(" "), stamp, F.lit(" end"))).alias("cleaned"))


@query(r"""WITH k AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'video ' || p_name WHEN 5 THEN 'part 3 ' || p_name ELSE p_name END AS t FROM part)
SELECT p_partkey, array_to_string([w FOR w IN regexp_split_to_array(lower(t), '[^a-z0-9]+') IF w <> '' AND w <> 'video'], ' ') AS key FROM k""")
def comparison_keys(spark, sf_dir) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    title = (
        F.when(k == 0, F.concat(F.lit("wetransfer_"), name, F.lit(" 2024-01-05 (copy).mp4")))
        .when(k == 1, F.concat(F.lit("in/zip - "), name, F.lit("-copy.tar.gz")))
        .when(k == 2, F.concat(F.lit("Video "), name, F.lit(" (2).wmv")))
        .when(k == 3, F.concat(F.lit("unzipped_"), name, F.lit(" 20240105T101500Z.mp4")))
        .when(k == 4, F.concat(F.lit("Files from "), name))
        .otherwise(F.concat(F.lit("Part 3 "), name, F.lit(".mkv")))
    )
    return t.table(spark, sf_dir, "part").select("p_partkey", names.comparison_key(title).alias("key"))


_SLUG = "regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g')"


@query(f"""WITH s AS (SELECT p_partkey, {_SLUG.format("p_type")} AS kind, {_SLUG.format("p_name")} AS name FROM part), l AS (SELECT *,
  CASE p_partkey % 3 WHEN 0 THEN 12 END AS course, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE kind END AS course_name,
  CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 5 END AS lesson, name AS lesson_name FROM s)
SELECT p_partkey, course, lesson, course_name, lesson_name, lesson_name AS description,
  concat_ws('x', nullif(concat_ws('_', course, course_name), ''), concat_ws('_', printf('%02d', lesson), lesson_name)) AS output_stem,
  CASE WHEN course IS NOT NULL AND lesson IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, course IS NULL OR lesson IS NULL AS review_required,
  concat_ws('; ', CASE WHEN course IS NULL THEN 'course number not found; textual course description used when available' END, CASE WHEN lesson IS NULL THEN 'lesson number not found; textual lesson description used when available' END) AS review_reason FROM l""")
def course_lessons(spark, sf_dir) -> DataFrame:
    p, k, name = t.dealt(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    box = F.when(k % 3 == 0, F.concat(F.lit("download_2026-08-26_Curso 12 "), "p_type")).when(k % 3 == 1, "backup").otherwise(F.concat(F.lit("Course "), "p_type"))
    leaf = F.when(k % 4 == 0, F.concat(F.lit("03. "), name, F.lit(".mp4"))).when(k % 4 == 1, F.concat(F.lit("Lección 7 - "), name)).when(k % 4 == 2, F.concat(F.lit("clase 5 "), name, F.lit("_20260831_10_24.wmv"))).otherwise(name)
    return p.select("p_partkey", names.course_lesson(F.concat_ws("/", box, leaf)).alias("c")).select("p_partkey", "c.*")


@query(f"""WITH s AS (SELECT p_partkey, {_SLUG.format("p_name")} AS name, upper({_SLUG.format("p_brand")}) AS brand, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '_1_' || name WHEN 3 THEN p_size || '_' || name ELSE name END
  || 'x' || CASE p_partkey % 3 WHEN 0 THEN p_size || '_' || lower(brand) WHEN 1 THEN lower(brand) || '_an' ELSE p_size || '_' || lower(brand) || '_2_parte' END AS stem FROM s""")
def archive_stems(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    slug, brand = F.regexp_replace("p_name", "[^A-Za-z0-9]+", "-"), F.upper("p_brand")
    label = F.when(k % 5 == 0, F.concat(F.lit("curso"), size, F.lit("-basic"))).when(k % 5 == 1, F.concat(F.lit("Curso"), size)).when(k % 5 == 2, F.concat(F.lit("curso"), size, F.lit("_1o-"), slug, F.lit("-mp4"))).when(k % 5 == 3, F.concat(size, F.lit("o-"), slug, F.lit("-wmv"))).otherwise(slug)
    leaf = F.when(k % 3 == 0, F.concat(size, F.lit(".- "), brand, F.lit(".mp4"))).when(k % 3 == 1, F.concat(brand, F.lit(" (An).mov"))).otherwise(F.concat(size, F.lit("º"), brand, F.lit(" 2º parte.mp4")))
    path = F.concat_ws("/", F.concat(F.lit("wetransfer_"), label, F.lit("_2026-07-19_0916__d140128160f88ce8")), leaf)
    return t.dealt(spark, sf_dir, "part").select("p_partkey", names.course_lesson(path)["output_stem"].alias("stem"))


@query(r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '-') || ['_es.vtt', '.EN.vtt', '-es-es.mp4', '_en-us.VTT', '_tv.vtt', '.mp4', '_es'][p_partkey % 7 + 1] AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 < 4 THEN regexp_replace(name, '(?i)[-_.](es-es|en-us|es|en)\.[^.]+$', '') ELSE regexp_replace(name, '\.[^.]+$', '') END AS stem,
  ['es', 'en', 'es-es', 'en-us', NULL, NULL, NULL][p_partkey % 7 + 1] AS language, ['.vtt', '.vtt', '.mp4', '.vtt', '.vtt', '.mp4', ''][p_partkey % 7 + 1] AS extension FROM n""")
def language_suffixes(spark, sf_dir) -> DataFrame:
    ends = ["_es.vtt", ".EN.vtt", "-es-es.mp4", "_en-us.VTT", "_tv.vtt", ".mp4", "_es"]
    name = F.concat(F.regexp_replace("p_name", " ", "-"), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return t.table(spark, sf_dir, "part").select("p_partkey", names.language_suffix(name).alias("n")).select("p_partkey", "n.stem", "n.language", "n.extension")


@query()
def name_similarity_pairs(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "part").groupBy(names.comparison_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key")).agg(F.min("p_partkey").alias("id"))
    return similarity.name_pairs(p, p).filter("left_id < right_id").withColumn("similarity", _r("similarity"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN lang WHEN 2 THEN 'es' ELSE 'pt' END AS code, CASE doc_id % 4 WHEN 0 THEN 'en-gb' WHEN 1 THEN CASE lang WHEN 'en' THEN 'en-us' WHEN 'fr' THEN 'fr-fr' ELSE lang END WHEN 2 THEN 'spanish' ELSE 'pt-br' END AS voice FROM documents""")
def language_codes(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 0, " EN-GB").when(k == 1, F.col("lang")).when(k == 2, "Spanish").otherwise("pt-BR")
    return t.texts(spark, sf_dir).select("doc_id", resources.language_code(name).alias("code"), resources.voice_code(name).alias("voice"))


@query("""SELECT p_partkey, '12,' || p_size || CASE WHEN p_size % 2 = 0 THEN ',0' ELSE '' END AS version, p_size > 10 AS newer FROM part""")
def version_tuples(spark, sf_dir) -> DataFrame:
    s = F.col("p_size").cast("string")
    v = resources.version_tuple(F.concat(F.lit("v12."), s, F.when(F.col("p_size") % 2 == 0, "-rc0").otherwise(".beta.3")))
    older = F.array(F.lit(12).cast("long"), F.lit(10).cast("long"), F.lit(9).cast("long"))
    return t.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("version"), (v > older).alias("newer"))


# times


@query("""WITH m AS (SELECT event_id, round_even(value * 37.1234567::DOUBLE * 1000, 0)::BIGINT AS ms FROM events) SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, round(ms / 1000.0::DOUBLE, 3) AS seconds FROM m""")
def time_format(spark, sf_dir) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select("event_id", times.format_time(F.col("value") * 37.1234567).alias("stamp"))
    return e.withColumn("seconds", _r(times.parse_time(F.col("stamp")), 3))


@query("""WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS d FROM documents), m AS (SELECT *, least(2.0::DOUBLE, d * 0.05::DOUBLE) AS m FROM d)
SELECT doc_id, CASE WHEN d <= 0 THEN '0.000' WHEN d <= m * 2 THEN printf('%.3f', d / 2) ELSE concat_ws(',', printf('%.3f', m + (d - 2 * m) * 0.1::DOUBLE), printf('%.3f', m + (d - 2 * m) * 0.3::DOUBLE), printf('%.3f', m + (d - 2 * m) * 0.5::DOUBLE), printf('%.3f', m + (d - 2 * m) * 0.7::DOUBLE), printf('%.3f', m + (d - 2 * m) * 0.9::DOUBLE)) END AS positions FROM m""")
def sample_positions(spark, sf_dir) -> DataFrame:
    p = times.sample_positions(F.col("n_chars") / 100.0)
    return t.texts(spark, sf_dir).select("doc_id", F.array_join(F.transform(p, lambda x: F.format_string("%.3f", x)), ",").alias("positions"))


@query("""SELECT p_partkey, least(30.0::DOUBLE, 0.5::DOUBLE * pow(2.0::DOUBLE, p_size % 9)) AS delay FROM part""")
def retry_delays(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", times.backoff(F.col("p_size") % 9 + 1, base=0.5).alias("delay"))


# fingerprints


def _vectors(spark, sf_dir):
    return t.table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))


_HASH = """v AS (SELECT vec_id, label, [a::DOUBLE FOR a IN embedding] AS x FROM embeddings), m AS (SELECT *, list_reduce(x, lambda a, b: a + b) / len(x) AS m FROM v),
h AS (SELECT vec_id, label, round_even(m / 255, 6) AS mean, array_to_string([CASE WHEN a >= m THEN '1' ELSE '0' END FOR a IN x], '') AS bits FROM m)"""


@query(f"WITH {_HASH} SELECT vec_id, mean + 0.0::DOUBLE AS mean, bits FROM h")
def average_hash(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", media.average_hash(F.col("x")).alias("h")).select("vec_id", (F.col("h.mean") + 0.0).alias("mean"), "h.bits")


@query(f"""WITH {_HASH} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(0.8::DOUBLE * (length(a.bits) - hamming(a.bits, b.bits)) / length(a.bits) + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(a.mean - b.mean) / 0.25::DOUBLE), 9) AS similarity
FROM h a JOIN h b ON b.label = a.label AND b.vec_id > a.vec_id AND b.vec_id // 10 = a.vec_id // 10""")
def hash_similarity(spark, sf_dir) -> DataFrame:
    h = _vectors(spark, sf_dir).select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("_g"), media.average_hash(F.col("x")).alias("h"))
    out = h.toDF("left_id", "label", "_g", "h").join(h.toDF("right_id", "label", "_g", "g"), ["label", "_g"]).filter("left_id < right_id")
    return out.select("left_id", "right_id", _r(media.visual_similarity(F.array("h"), F.array("g"))).alias("similarity"))


_AUDIO = """u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT *, (x < 0) <> (lag(x) OVER (PARTITION BY vec_id ORDER BY i) < 0) AS turn FROM u),
f AS (SELECT vec_id, label, sum(abs(x)) / count(*) AS mean_abs, sqrt(sum(x * x) / count(*)) AS rms, count(*) FILTER (turn) / count(*)::DOUBLE AS crossings FROM c GROUP BY vec_id, label)"""


@query(f"WITH {_AUDIO} SELECT vec_id, round(mean_abs, 9) AS mean_abs, round(rms, 9) AS rms, round(crossings, 9) AS crossings FROM f")
def audio_features(spark, sf_dir) -> DataFrame:
    f = _vectors(spark, sf_dir).select("vec_id", media.audio_features(F.col("x")).alias("f"))
    return f.select("vec_id", *[_r(f"f.{k}").alias(k) for k in ("mean_abs", "rms", "crossings")])


@query(f"""WITH {_AUDIO}, p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, greatest(0.0, 1 - abs(a.mean_abs - b.mean_abs) / greatest(a.mean_abs, b.mean_abs, 1e-6::DOUBLE)) AS x, greatest(0.0, 1 - abs(a.rms - b.rms) / greatest(a.rms, b.rms, 1e-6::DOUBLE)) AS y,
  greatest(0.0, 1 - abs(a.crossings - b.crossings) / greatest(a.crossings, b.crossings, 1e-6::DOUBLE)) AS z FROM f a JOIN f b ON b.label = a.label AND b.vec_id > a.vec_id AND b.vec_id // 10 = a.vec_id // 10) SELECT left_id, right_id, round((x + y + z) / 3, 8) AS similarity FROM p""")
def audio_similarity(spark, sf_dir) -> DataFrame:
    f = _vectors(spark, sf_dir).select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("_g"), media.audio_features(F.col("x")).alias("f"))
    out = f.toDF("left_id", "label", "_g", "f").join(f.toDF("right_id", "label", "_g", "g"), ["label", "_g"]).filter("left_id < right_id")
    return out.select("left_id", "right_id", _r(media.audio_similarity(F.array("f"), F.array("g")), 8).alias("similarity"))


@query("""WITH v AS (SELECT vec_id, [a::DOUBLE * 8 FOR a IN embedding] AS x FROM embeddings), p AS (SELECT vec_id, x, list_max([abs(a) FOR a IN x]) AS p FROM v)
SELECT vec_id, array_to_string([round_even(greatest(-1.0, least(1.0, CASE WHEN p > 1 THEN a / p ELSE a END)) * 32767, 0)::INT FOR a IN x], ',') AS pcm FROM p""")
def pcm_samples(spark, sf_dir) -> DataFrame:
    x = F.transform("x", lambda v: v * 8)
    return _vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform(media.pcm16(media.peak_normalised(x)), lambda v: v.cast("string")), ",").alias("pcm"))


def _identities(spark, sf_dir):
    """embeddings as media: hashes and features of their vectors; every tenth shares its neighbour's duration."""
    v = _vectors(spark, sf_dir)
    k = F.col("vec_id")
    identity = F.struct(
        F.when(k % 23 != 4, F.floor(k / 10) * 7.0 + (k % 10) * 0.4).alias("duration_seconds"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
        F.when(k % 6 == 5, "audio").otherwise("video").alias("media_type"),
        F.array(media.average_hash(F.transform("x", lambda a: F.floor(a * 4)))).alias("video_samples"),
        F.when(k % 5 == 1, F.array().cast("array<struct<mean_abs: double, rms: double, crossings: double>>")).otherwise(F.array(media.audio_features(F.col("x")))).alias("audio_samples"),
        F.lit(2).alias("audio_channels"),
        F.when(k % 4 == 0, 44100).otherwise(48000).alias("audio_sample_rate"),
    )
    return v.select("vec_id", identity.alias("identity"))


_IDENTITY = f"""hv AS (SELECT vec_id, label, [floor(a::DOUBLE * 4) FOR a IN embedding] AS x FROM embeddings), hm AS (SELECT *, list_reduce(x, lambda a, b: a + b) / len(x) AS m FROM hv),
hh AS (SELECT vec_id, round_even(m / 255, 6) AS mean, array_to_string([CASE WHEN a >= m THEN '1' ELSE '0' END FOR a IN x], '') AS bits FROM hm), {_AUDIO},
i AS (SELECT hh.vec_id, hh.vec_id // 10 AS g, CASE WHEN hh.vec_id % 23 <> 4 THEN (hh.vec_id // 10) * 7.0::DOUBLE + (hh.vec_id % 10) * 0.4::DOUBLE END AS duration, hh.vec_id % 6 <> 5 AS video, hh.vec_id % 5 <> 1 AS sound,
  CASE WHEN hh.vec_id % 4 = 0 THEN 44100 ELSE 48000 END AS rate, mean, bits, mean_abs, rms, crossings FROM hh JOIN f ON f.vec_id = hh.vec_id),
s AS (SELECT a.vec_id AS id, b.vec_id AS pos, a.video, a.rate = b.rate AS same_rate, a.sound AND b.sound AS heard, coalesce(abs(a.duration - b.duration) <= greatest(1.5::DOUBLE, a.duration * 0.005::DOUBLE), false) AS near,
  0.8::DOUBLE * (length(a.bits) - hamming(a.bits, b.bits)) / length(a.bits) + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(a.mean - b.mean) / 0.25::DOUBLE) AS v,
  (greatest(0.0, 1 - abs(a.mean_abs - b.mean_abs) / greatest(a.mean_abs, b.mean_abs, 1e-6::DOUBLE)) + greatest(0.0, 1 - abs(a.rms - b.rms) / greatest(a.rms, b.rms, 1e-6::DOUBLE)) + greatest(0.0, 1 - abs(a.crossings - b.crossings) / greatest(a.crossings, b.crossings, 1e-6::DOUBLE))) / 3 AS u
  FROM i a JOIN i b ON a.g = b.g),
scores AS (SELECT id, pos, CASE WHEN NOT near OR (video AND v < 0.91::DOUBLE) OR (heard AND u < 0.82::DOUBLE) THEN 0.0::DOUBLE
  ELSE least(1.0::DOUBLE, 0.25::DOUBLE + 0.15::DOUBLE + CASE WHEN video THEN 0.40::DOUBLE * v ELSE 0 END + CASE WHEN heard THEN 0.20::DOUBLE * u ELSE 0.10::DOUBLE END + 0.05::DOUBLE + CASE WHEN same_rate THEN 0.05::DOUBLE ELSE 0 END) END AS score FROM s)"""


@query(f"WITH {_IDENTITY} SELECT id, pos, round(score, 6) AS score FROM scores")
def identity_scores(spark, sf_dir) -> DataFrame:
    m = _identities(spark, sf_dir)
    pairs = m.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).alias("_g"), F.col("identity").alias("current")).join(m.select(F.col("vec_id").alias("pos"), F.floor(F.col("vec_id") / 10).alias("_g"), F.col("identity").alias("candidate")), "_g")
    return pairs.select("id", "pos", _r(media.identity_score("current", "candidate"), 6).alias("score"))


# names of one group are equal and of different groups less alike than the threshold, so candidates are the group's registry rows
@query(f"""WITH {_IDENTITY}, exact AS (SELECT a.vec_id AS id, min(b.vec_id) AS pos FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = b.vec_id % 100 AND b.vec_id % 3 = 0 WHERE a.vec_id % 3 <> 0 GROUP BY a.vec_id),
near AS (SELECT id, pos, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS k FROM scores WHERE id % 3 <> 0 AND pos % 3 = 0 AND score >= 0.90::DOUBLE AND id NOT IN (SELECT id FROM exact))
SELECT id, pos, 'duplicate_exact' AS status, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT id, pos, 'duplicate_probable', round(score, 6) FROM near WHERE k = 1""")
def duplicate_cascade(spark, sf_dir) -> DataFrame:
    m = _identities(spark, sf_dir)
    k = F.floor(F.col("vec_id") / 10)
    key = F.concat_ws(" ", F.sha2(k.cast("string"), 256), F.md5(k.cast("string").cast("binary")))
    rows = m.select("vec_id", F.sha2((F.col("vec_id") % 100).cast("string"), 256).alias("sha256"), key.alias("key"), "identity")
    registry = rows.filter("vec_id % 3 = 0").withColumn("output_folder", F.lit("f")).withColumnRenamed("vec_id", "pos")
    out = similarity.cascade(rows.filter("vec_id % 3 <> 0").withColumnRenamed("vec_id", "id"), registry)
    return out.withColumn("score", _r("score", 6))


# resources, timeline


@query("""WITH h AS (SELECT p_partkey, p_size % 32 + 1 AS cpus, p_retailprice / 50.0::DOUBLE AS mem, p_partkey % 3 = 0 AS usable, (p_partkey % 9)::DOUBLE AS free, p_partkey % 7 = 0 AS shared, ['auto', 'cpu', 'cuda'][p_partkey % 3 + 1] AS ask, ['small', 'large-v3', 'other'][p_partkey % 3 + 1] AS model, (p_partkey % 5)::BIGINT AS thr, (p_partkey % 4)::BIGINT AS req FROM part),
g AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN shared THEN mem - 2 ELSE free END) AS gpu FROM h), d AS (SELECT *, CASE ask WHEN 'cuda' THEN CASE WHEN usable AND gpu >= 3 THEN 'cuda' END WHEN 'cpu' THEN 'cpu' ELSE CASE WHEN usable AND gpu >= 3 THEN 'cuda' ELSE 'cpu' END END AS device FROM g),
b AS (SELECT *, CASE WHEN thr > 0 THEN thr ELSE greatest(2, least(8, cpus // 2)) END AS t, CASE model WHEN 'small' THEN 1.6::DOUBLE WHEN 'large-v3' THEN 5.5::DOUBLE ELSE 3.0::DOUBLE END AS ram FROM d),
c AS (SELECT *, greatest(1, greatest(1, cpus - 2) // t) AS by_cpu, greatest(1, floor(greatest(1.0::DOUBLE, mem - 2) / greatest(0.5::DOUBLE, CASE WHEN device = 'cuda' THEN 1.5::DOUBLE ELSE ram END))) AS by_ram, CASE WHEN device = 'cuda' THEN greatest(1, floor(gpu / greatest(2.0::DOUBLE, ram * 0.85::DOUBLE))) ELSE 2147483647 END AS by_gpu FROM b)
SELECT p_partkey, device, CASE WHEN device = 'cuda' THEN 'float16' ELSE 'int8' END AS compute, CASE WHEN req <= 0 THEN least(by_cpu, by_ram, by_gpu) ELSE least(req, by_cpu, by_ram, by_gpu) END::BIGINT AS workers,
  CASE WHEN mem >= 24 AND cpus >= 12 THEN 'high' WHEN mem >= 14 AND cpus >= 6 THEN 'balanced' ELSE 'low' END AS profile, CASE WHEN (device = 'cuda' AND gpu >= 8) OR (mem >= 16 AND cpus >= 6) THEN 'medium' ELSE 'small' END AS auto_model FROM c""")
def parallelism(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % 3 + 1).cast("int"))
    h = t.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 32 + 1).alias("cpus"), (F.col("p_retailprice") / 50.0).alias("mem"), (k % 3 == 0).alias("usable"), (k % 9).cast("double").alias("free"), (k % 7 == 0).alias("shared"), pick("auto", "cpu", "cuda").alias("ask"), pick("small", "large-v3", "other").alias("model"), (k % 5).alias("thr"), (k % 4).alias("req"))
    h = h.withColumn("gpu", resources.gpu_memory(F.col("shared"), F.col("free"), F.col("mem")))
    h = h.withColumn("device", resources.whisper_device(F.col("ask"), F.col("usable"), F.col("gpu")))
    return h.select(
        "p_partkey",
        "device",
        resources.whisper_compute(F.lit("auto"), F.coalesce("device", F.lit("cpu"))).alias("compute"),
        resources.safe_parallelism(F.col("cpus"), F.col("mem"), F.col("gpu"), F.coalesce("device", F.lit("cpu")), F.col("model"), F.col("thr"), F.col("req")).alias("workers"),
        resources.profile(F.col("mem"), F.col("cpus"))["name"].alias("profile"),
        resources.default_model(F.lit("auto"), F.coalesce("device", F.lit("cpu")), F.col("gpu"), F.col("mem"), F.col("cpus")).alias("auto_model"),
    )


_SPOKEN = f"""{t.CUES}, s AS (SELECT *, greatest(1, round_even(1.5::DOUBLE * 24000, 0))::BIGINT AS target, (length(text) * 450)::BIGINT AS n FROM cues),
d AS (SELECT *, CASE WHEN trim(text) = '' THEN 'silence' WHEN n <= target * 1.05::DOUBLE THEN 'fits' WHEN n / target <= 1.35::DOUBLE THEN 'faster' ELSE 'stretch' END AS action FROM s)"""


@query(f"""WITH {_SPOKEN} SELECT media_id, index, round_even(start * 24000, 0)::BIGINT AS start_sample, action, round(CASE WHEN action = 'faster' THEN least(1.35::DOUBLE, n / target * 1.01::DOUBLE) ELSE 1.0 END, 9) AS speed FROM d""")
def speech_fit(spark, sf_dir) -> DataFrame:
    c = t.cues(spark, sf_dir).withColumn("n_samples", (F.length("text") * 450).cast("long"))
    return timeline.decided(c).select("media_id", "index", "start_sample", "action", _r("speed").alias("speed"))


@query(f"""WITH {_SPOKEN} SELECT media_id, greatest(2, coalesce(max(round_even(start * 24000, 0)::BIGINT + least(n, target)) FILTER (action <> 'silence'), 0))::BIGINT AS n_samples FROM d GROUP BY media_id""")
def timeline_length(spark, sf_dir) -> DataFrame:
    c = t.cues(spark, sf_dir).withColumn("n_samples", (F.length("text") * 450).cast("long"))
    return timeline.length(timeline.decided(c))


@query(f"""WITH {t.CUES} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY index) AS index, start, "end", trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM cues WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def vtt_round_trip(spark, sf_dir) -> DataFrame:
    from ..sources import vtt

    c = t.cues(spark, sf_dir).withColumn("text", text.collapse(F.col("text"))).filter("text <> ''").withColumnRenamed("index", "seq")
    return vtt.parsed(vtt.documents(c), "media_id").select("media_id", "index", "start", "end", "text")


@query(f"""WITH {t.CUES} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY index) AS index, start, "end", trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM cues WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def published_subtitles(spark, sf_dir) -> DataFrame:
    """All subtitles as one version of a folder, read again through its pointer."""
    from ..sources import publish, vtt

    c = t.cues(spark, sf_dir).withColumn("text", text.collapse(F.col("text"))).filter("text <> ''").withColumnRenamed("index", "seq")
    root = f"{shared_dir(spark)}/cuemill/published-{uuid.uuid4().hex}"
    publish.publish(vtt.documents(c).select(F.concat(F.lit("subtitles/"), "media_id", F.lit(".vtt")).alias("name"), "document"), root)
    files = publish.published(spark, root).select(F.regexp_extract("name", "([^/]+)[.]vtt$", 1).cast(c.schema["media_id"].dataType).alias("media_id"), "document")
    return vtt.parsed(files, "media_id").select("media_id", "index", "start", "end", "text")


@query(f"""WITH {t.CUES}, a AS (SELECT media_id, index, start, least(length(text), 75) AS n, (ascii(text) % 100) / 128.0::DOUBLE AS v, (index * 100) AS s FROM cues WHERE length(text) > 0),
p AS (SELECT *, unnest(generate_series(s // 64, (s + n - 1) // 64)) AS tile FROM a),
l AS (SELECT media_id, greatest(2, coalesce(max(CASE WHEN length(text) > 0 THEN index * 100 + least(length(text), 75) ELSE index * 100 END), 0)) AS length FROM cues GROUP BY media_id),
k AS (SELECT media_id, length, unnest(generate_series(0, (length - 1) // 64)) AS tile FROM l),
v AS (SELECT media_id, tile, sum(v * (least(s + n, (tile + 1) * 64) - greatest(s, tile * 64))) AS total FROM p GROUP BY ALL)
SELECT media_id, tile::BIGINT AS tile, least(64, length - tile * 64)::BIGINT AS n_samples, round(coalesce(total, 0.0), 6)::DOUBLE AS total FROM k LEFT JOIN v USING (media_id, tile)""")
def timeline_tiles(spark, sf_dir) -> DataFrame:
    """Cues as sound of one level each, a hundred samples for two seconds, overlaid in tiles of 64 samples."""
    body = F.coalesce("text", F.lit(""))
    c = t.cues(spark, sf_dir).select("media_id", F.col("index").alias("seq"), (F.col("index") * 100).cast("long").alias("start_sample"), F.lit(75).cast("long").alias("target_samples"), F.array_repeat((F.ascii(body) % 100) / F.lit(128.0), F.length(body)).alias("audio"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return timeline.tiled(c, tile_samples=64).select("media_id", "tile", F.size("samples").cast("long").alias("n_samples"), _r(total, 6).alias("total"))


@query("""SELECT o_orderkey AS pos, o_orderkey % 12 AS manifest, 'out_' || o_orderkey % 700 AS output_folder, CASE WHEN o_orderkey % 700 % 12 = 5 THEN 'voiced' ELSE o_orderstatus END AS state FROM orders""")
def manifests_rewritten(spark, sf_dir) -> DataFrame:
    """Manifests by partition, of which those with new states are written again, read from their folder."""
    from ..sources.documents import rewritten

    root = f"{shared_dir(spark)}/cuemill/manifests-{uuid.uuid4().hex}"
    o = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("pos"), F.concat(F.lit("out_"), (F.col("o_orderkey") % 700).cast("string")).alias("output_folder"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 12).cast("long").alias("manifest"))
    o.repartition("manifest").write.partitionBy("manifest").parquet(root)
    new = spark.range(700).filter("id % 12 = 5").select(F.concat(F.lit("out_"), F.col("id").cast("string")).alias("output_folder"), F.lit("voiced").alias("state"))
    read = lambda: spark.read.schema(o.schema).parquet(root)
    rewritten(listings.patched(read(), new), root)
    return read().select("pos", "manifest", "output_folder", "state")


# listings of output folders


def _files(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in ("_original.vtt", "_es.vtt", ".backup.vtt", "_es.bak.02.vtt", ".mp4", ".MKV", "_TTS.mp4", ".txt", "_original.bak.vtt")]), (k % 9 + 1).cast("int"))
    folder = F.when(k % 500 == 0, "_manifests").otherwise(F.concat(F.lit("f"), (k % 500).cast("string")))
    inner = F.when(k % 4 == 1, "original_transcriptions").when(k % 4 == 3, "other")
    return t.table(spark, sf_dir, "part").select(folder.alias("folder"), inner.alias("subfolder"), F.concat(F.regexp_replace("p_name", " ", "_"), k.cast("string"), name).alias("name"))


_FILES = """files AS (SELECT CASE WHEN p_partkey % 500 = 0 THEN '_manifests' ELSE 'f' || p_partkey % 500 END AS folder, CASE p_partkey % 4 WHEN 1 THEN 'original_transcriptions' WHEN 3 THEN 'other' END AS subfolder, replace(p_name, ' ', '_') || p_partkey || ['_original.vtt', '_es.vtt', '.backup.vtt', '_es.bak.02.vtt', '.mp4', '.MKV', '_TTS.mp4', '.txt', '_original.bak.vtt'][p_partkey % 9 + 1] AS name FROM part)"""


@query(f"""WITH {_FILES}, v AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY lower(name) NOT LIKE '%.mp4', lower(name), name) AS k FROM files WHERE (lower(name) LIKE '%.mp4' OR lower(name) LIKE '%.mkv') AND NOT contains(lower(name), '_tts')),
s AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY NOT contains(name, '_original'), lower(name)) AS k FROM files WHERE name LIKE '%.vtt' AND NOT contains(name, '.bak.'))
SELECT coalesce(v.folder, s.folder) AS folder, v.name AS video, s.name AS subtitles FROM (SELECT * FROM v WHERE k = 1) v FULL JOIN (SELECT * FROM s WHERE k = 1) s ON v.folder = s.folder""")
def folder_choices(spark, sf_dir) -> DataFrame:
    f = _files(spark, sf_dir)
    return listings.video_choice(f).withColumnRenamed("name", "video").join(listings.subtitle_choice(f, True).withColumnRenamed("name", "subtitles"), "folder", "full_outer")


@query(f"""WITH {_FILES}, v AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY lower(name) NOT LIKE '%.mp4', lower(name)) AS k FROM files WHERE lower(name) LIKE '%.mp4' OR lower(name) LIKE '%.mkv') SELECT folder, name FROM v WHERE k = 1""")
def reprocess_videos(spark, sf_dir) -> DataFrame:
    return listings.reprocess_video(_files(spark, sf_dir))


_FLAGS = """flags AS (SELECT folder, bool_or(subfolder IS NULL AND (lower(name) LIKE '%.mp4' OR lower(name) LIKE '%.mkv')) AS has_video,
  bool_or(coalesce(subfolder = 'original_transcriptions', false) AND name LIKE '%.vtt' AND NOT contains(name, '.bak')) AS has_subtitles, bool_or(subfolder IS NULL AND contains(lower(name), '_tts') AND lower(name) LIKE '%.mp4') AS has_output FROM files GROUP BY folder)"""


@query(f"""WITH {_FILES}, {_FLAGS} SELECT * FROM flags""")
def folder_flags(spark, sf_dir) -> DataFrame:
    return listings.folder_flags(_files(spark, sf_dir))


@query(f"""WITH {_FILES}, {_FLAGS} SELECT folder FROM flags WHERE folder <> '_manifests' AND (has_video OR has_subtitles)""")
def eligible_folders(spark, sf_dir) -> DataFrame:
    return listings.eligible_folders(_files(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, ' ', '_') END AS name FROM part), m AS (SELECT name, replace(lower(name), ' ', '_') AS new_name FROM n),
w AS (SELECT *, bool_or(name = new_name) OVER (PARTITION BY new_name) AS taken, row_number() OVER (PARTITION BY new_name ORDER BY name) AS k FROM m)
SELECT name, new_name, CASE WHEN name = new_name THEN 'unchanged' WHEN taken OR k > 1 THEN 'skip' ELSE 'rename' END AS action FROM w""")
def normalised_tree(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).otherwise(F.regexp_replace("p_name", " ", "_"))
    return listings.normalised_tree(t.table(spark, sf_dir, "part").select(name.alias("name")).distinct())


@query("""SELECT o_orderkey AS pos, 'out_' || o_orderkey % 700 AS output_folder, CASE WHEN o_orderkey % 700 % 3 = 0 THEN 'voiced' ELSE o_orderstatus END AS state, o_orderkey % 700 % 3 = 0 AND o_orderstatus <> 'voiced' AS changed FROM orders""")
def manifest_patch(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("out_"), (F.col("o_orderkey") % 700).cast("string")).alias("output_folder"), F.col("o_orderstatus").alias("state"))
    new = spark.range(700).filter("id % 3 = 0").select(F.concat(F.lit("out_"), F.col("id").cast("string")).alias("output_folder"), F.lit("voiced").alias("state"))
    return listings.patched(o, new)
