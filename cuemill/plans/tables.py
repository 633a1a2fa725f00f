"""The driver's tables as inputs of the operators: each derivation once as DataFrame code, and once as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work on each row alone; where it is one file that fewer tasks would read than there are cores, dealt over all of them."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) == 1 and rows.rdd.getNumPartitions() < cores else rows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents")


def segments(spark, sf_dir) -> DataFrame:
    """events as timed words of each user: media_id, seq, start, end, text; some rows are made invalid by event_id."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))") / 1e6
    k = F.col("event_id")
    start = F.when(k % 97 == 5, -1.0).otherwise(t)
    end = F.when(k % 89 == 7, t - 1).when(k % 83 == 11, t).when(k % 79 == 3, F.lit(float("inf"))).otherwise(t + F.col("value"))
    return e.select(F.col("user_id").alias("media_id"), k.alias("seq"), start.alias("start"), end.alias("end"), F.when(k % 61 == 2, "").otherwise(F.col("event_type")).alias("text"))


SEGMENTS = """segments AS (
  SELECT user_id AS media_id, event_id AS seq,
    CASE WHEN event_id % 97 = 5 THEN -1.0::DOUBLE ELSE epoch_us(ts) / 1e6 END AS start,
    CASE WHEN event_id % 89 = 7 THEN epoch_us(ts) / 1e6 - 1 WHEN event_id % 83 = 11 THEN epoch_us(ts) / 1e6
         WHEN event_id % 79 = 3 THEN 'infinity'::DOUBLE ELSE epoch_us(ts) / 1e6 + value END AS "end",
    CASE WHEN event_id % 61 = 2 THEN '' ELSE event_type END AS text
  FROM events)"""


def cues(spark, sf_dir) -> DataFrame:
    """conversations as cue lists: media_id, index, start, end, text, two seconds a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("index"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"), "role", "text")


CUES = """cues AS (SELECT conv_id AS media_id, turn AS index, turn * 2.0::DOUBLE AS start, turn * 2.0::DOUBLE + 1.5 AS "end", role, text FROM conversations)"""


def perturbed(c: DataFrame) -> DataFrame:
    """The same cues with some missing, some extra and some at other times."""
    key = F.col("media_id") * 31 + F.col("index")
    kept = c.filter(key % 13 != 4).withColumn("start", F.when(key % 11 == 3, F.col("start") + 0.25).otherwise(F.col("start")))
    extra = c.filter(key % 17 == 6).withColumn("index", F.col("index") + 1000)
    return kept.unionByName(extra)


PERTURBED = """perturbed AS (
  SELECT media_id, index, CASE WHEN (media_id * 31 + index) % 11 = 3 THEN start + 0.25 ELSE start END AS start, "end", text FROM cues WHERE (media_id * 31 + index) % 13 <> 4
  UNION ALL SELECT media_id, index + 1000, start, "end", text FROM cues WHERE (media_id * 31 + index) % 17 = 6)"""


def measured(spark, sf_dir) -> DataFrame:
    """documents as transcribed segments, with nullable measures taken from labels."""
    d, label = texts(spark, sf_dir).select("doc_id", "source", "text", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(label, "doc_id", "left").select(
        "doc_id",
        "source",
        "text",
        (F.col("n_chars") / 1000.0).alias("compression_ratio"),
        F.when(F.col("quality") == 1, -0.5).when(F.col("quality") == 0, -1.5).alias("avg_logprob"),
        F.when(F.col("toxic") == 1, 0.75).when(F.col("toxic") == 0, 0.25).alias("no_speech_prob"),
    )


WORD_SQL = r"[\p{L}\p{N}_]+(?:[’''-]+[\p{L}\p{N}_]+)*"
MEASURED = f"""measured AS (
  SELECT d.doc_id, source, text, n_chars / 1000.0::DOUBLE AS compression_ratio,
    CASE quality WHEN 1 THEN -0.5::DOUBLE WHEN 0 THEN -1.5::DOUBLE END AS avg_logprob, CASE toxic WHEN 1 THEN 0.75::DOUBLE WHEN 0 THEN 0.25::DOUBLE END AS no_speech_prob
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, [replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(text, '{WORD_SQL}')] AS w FROM documents)),
grams AS (SELECT doc_id, i, w, CASE WHEN lead(w, 1) OVER p IS NOT NULL THEN w || ' ' || lead(w, 1) OVER p END AS b,
    CASE WHEN lead(w, 2) OVER p IS NOT NULL THEN w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p END AS t FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w) GROUP BY doc_id),
metrics AS (
  SELECT m.*, coalesce(n, 0) AS word_count, coalesce(u / n, 0.0)::DOUBLE AS unique_ratio, coalesce(top / n, 0.0)::DOUBLE AS dominant_ratio,
    coalesce(CASE WHEN n < 2 THEN 0.0 ELSE (n - 1 - bu) / (n - 1) END, 0.0)::DOUBLE AS bigram_ratio, coalesce(CASE WHEN n < 3 THEN 0.0 ELSE (n - 2 - tu) / (n - 2) END, 0.0)::DOUBLE AS trigram_ratio
  FROM measured m LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT w)::DOUBLE AS u, count(DISTINCT b)::DOUBLE AS bu, count(DISTINCT t)::DOUBLE AS tu FROM grams GROUP BY doc_id) g ON m.doc_id = g.doc_id
  LEFT JOIN tops ON m.doc_id = tops.doc_id),
scored AS (SELECT *, greatest(dominant_ratio, bigram_ratio, trigram_ratio) AS repetition FROM metrics),
flagged AS (SELECT *, word_count >= 8 AND repetition >= 0.60::DOUBLE AS f_rep, coalesce(compression_ratio > 2.4::DOUBLE, false) AS f_com, coalesce(avg_logprob < -1.0::DOUBLE, false) AS f_log, coalesce(no_speech_prob > 0.6::DOUBLE, false) AS f_sil FROM scored),
reasoned AS (SELECT *, concat_ws(',', CASE WHEN word_count = 0 THEN 'empty' END, CASE WHEN f_rep THEN 'repetition' END, CASE WHEN f_com THEN 'compression' END,
    CASE WHEN f_log THEN 'low_logprob' END, CASE WHEN f_sil AND (f_rep OR f_com OR f_log) THEN 'no_speech' END) AS reasons,
  (word_count = 0)::INT + f_rep::INT + f_com::INT + f_log::INT + (f_sil AND (f_rep OR f_com OR f_log))::INT AS n_reasons FROM flagged)"""


def folders(spark, sf_dir) -> DataFrame:
    """documents as output folders: name from doc_id by a fixed rule that meets every rung of the ladder, signature of the text."""
    d = table(spark, sf_dir, "documents")
    k, i = F.col("doc_id") % 11, F.col("doc_id").cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("12x03_topic_"), i))
        .when(k == 1, F.concat(F.lit("7x"), F.lit("_part_"), i))
        .when(k == 2, F.concat(F.lit("12X03_Topic_"), i))
        .when(k == 3, F.concat(F.lit("wetransfer_"), i, F.lit("_talk")))
        .when(k == 4, F.concat(F.lit("talk_copy_"), i, F.lit("x")))
        .when(k == 5, F.concat(F.lit("12x04_deadbeef01_"), i, F.lit("n")))
        .when(k == 6, F.concat(F.lit("sin_curso_"), i))
        .when(k == 7, F.concat(F.lit("20240105t101010z_"), i, F.lit("q")))
        .when(k == 8, F.concat(F.repeat(F.lit("long_"), F.lit(30)), i))
        .otherwise(F.concat(F.lit("12x05_other_"), i, F.lit("k")))
    )
    return d.select(name.alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("signature"))


FOLDERS = """folders AS (
  SELECT sha256(text) AS signature, CASE doc_id % 11 WHEN 0 THEN '12x03_topic_' || doc_id WHEN 1 THEN '7x_part_' || doc_id WHEN 2 THEN '12X03_Topic_' || doc_id
    WHEN 3 THEN 'wetransfer_' || doc_id || '_talk' WHEN 4 THEN 'talk_copy_' || doc_id || 'x' WHEN 5 THEN '12x04_deadbeef01_' || doc_id || 'n'
    WHEN 6 THEN 'sin_curso_' || doc_id WHEN 7 THEN '20240105t101010z_' || doc_id || 'q' WHEN 8 THEN repeat('long_', 30) || doc_id ELSE '12x05_other_' || doc_id || 'k' END AS name
  FROM documents),
rungs AS (SELECT *, lower(name) AS low, regexp_full_match(name, '[0-9]{1,4}x[0-9]{2}(_.+)?') AS whole,
    regexp_full_match(name, '([0-9]{1,4}x([0-9]{2})?|([0-9]{1,4})?x[0-9]{2})(_.+)?') AS part, regexp_full_match(lower(name), '[0-9]{1,4}x[0-9]{2}(_.+)?') AS loose FROM folders),
rated AS (SELECT signature, name, low,
    CASE WHEN whole THEN 100 WHEN part THEN 70 WHEN loose THEN 55 ELSE 0 END
    - CASE WHEN regexp_matches(low, '(^|[_-])(sin_curso|sin_leccion|sin_nombre)($|[_-])') THEN 45 ELSE 0 END
    - CASE WHEN regexp_matches(low, '(^|[_-])(wetransfer|drive-download|archive|compressed|backup|download|descarga)($|[_-])') THEN 35 ELSE 0 END
    - CASE WHEN regexp_matches(low, '20[0-9]{6}t[0-9]{4,6}z') THEN 25 ELSE 0 END
    - CASE WHEN regexp_matches(low, '(^|[_-])[0-9a-f]{8,}($|[_-])') THEN 20 ELSE 0 END
    - CASE WHEN regexp_matches(low, '(^|[_ -])(copy|copia|\\(?[0-9]+\\)?)($|[_ -])') THEN 15 ELSE 0 END
    + CASE WHEN length(name) <= 80 THEN 5 WHEN length(name) > 140 THEN -10 ELSE 0 END AS score FROM rungs)"""
