"""Speech on a timeline: what to do with each cue's audio, and the assembled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decided(cues: DataFrame, rate: int = 24000, tolerance: float = 0.05, speed: float = 1.0, max_speed: float = 1.35) -> DataFrame:
    """cues (start, end, text, n_samples) with target_samples, start_sample and action: silence, fits, faster (with its speed), stretch.

    Audio within the tolerance fits and is cut; longer audio is spoken faster if max_speed is enough, else stretched.
    """
    target = F.greatest(F.lit(1), F.bround(F.greatest(F.lit(0.0), F.col("end") - F.col("start")) * rate, 0).cast("long"))
    out = cues.withColumn("target_samples", target).withColumn("start_sample", F.bround(F.col("start") * rate, 0).cast("long"))
    needed = speed * F.col("n_samples") / F.col("target_samples")
    fits = F.col("n_samples") <= F.col("target_samples") * (1.0 + tolerance)
    action = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "silence").when(fits, "fits").when(needed <= max_speed, "faster").otherwise("stretch")
    return out.withColumn("action", action).withColumn("speed", F.when(F.col("action") == "faster", F.least(F.lit(max_speed), needed * 1.01)).otherwise(speed))


def length(cues: DataFrame, key: str = "media_id") -> DataFrame:
    """Samples of each medium's timeline: at least two."""
    end = F.col("start_sample") + F.least("n_samples", "target_samples")
    return cues.groupBy(key).agg(F.greatest(F.lit(2), F.coalesce(F.max(F.when(F.col("action") != "silence", end)), F.lit(0))).cast("long").alias("n_samples"))


def rendered(cues: DataFrame, key: str = "media_id") -> DataFrame:
    """media_id, samples: each cue's audio (array<double>) at its start, later cues over earlier ones; one medium is one array in memory."""

    def render(k, rows):
        rows = rows.sort_by("seq").to_pylist()
        out = np.zeros(max([2, *(r["start_sample"] + min(len(r["audio"] or ()), r["target_samples"]) for r in rows)]))
        for r in rows:
            a = np.asarray(r["audio"] or (), float)[: r["target_samples"]]
            out[r["start_sample"] : r["start_sample"] + len(a)] = a
        return pa.table({key: pa.array([k[0].as_py()], k[0].type), "samples": [np.clip(out, -1, 1)]})

    kind = cues.schema[key].dataType.simpleString()
    return cues.select(key, "seq", "start_sample", "target_samples", "audio").groupBy(key).applyInArrow(render, f"{key} {kind}, samples array<double>")


TILE = 24_000 * 60  # samples


def _overlaid(kind: pa.DataType, key: str, tile_samples: int):
    """Lays the pieces of one tile after the other over silence, in the order they come: memory is that of one tile."""

    def run(batches):
        at, out = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], kind), pa.array([at[1]], pa.int64()), pa.array([at[1] * tile_samples], pa.int64()), pa.array([np.clip(out, -1, 1)], pa.list_(pa.float64()))], names=[key, "tile", "start_sample", "samples"])
        for b in batches:
            keys, tiles, offsets, sizes = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            pieces = b.column(5)
            for k in range(b.num_rows):
                if (keys[k], tiles[k]) != at:
                    if at:
                        yield row()
                    at, out = (keys[k], tiles[k]), np.zeros(sizes[k])  # a tile's first row is its silence
                piece = pieces[k].values
                if piece is not None and len(piece):
                    out[offsets[k] : offsets[k] + len(piece)] = piece.to_numpy(zero_copy_only=False)
        if at:
            yield row()

    return run


def tiled(cues: DataFrame, key: str = "media_id", tile_samples: int = TILE) -> DataFrame:
    """key, tile, start_sample, samples: the timeline that rendered() gives, cut into tiles of tile_samples; the last is shorter.

    Each cue's audio is cut at the tiles' edges, and the pieces of a tile are laid over each other in the order of seq, later
    ones on top.  So a medium is spread over tasks, and a task holds one tile, however long the medium is and however many
    cues meet in it.  Media without any audio have a tile of two samples, as they have two samples there.
    """
    size = F.least(F.size(F.coalesce("audio", F.array().cast("array<double>"))), F.col("target_samples")).cast("long")
    cut = cues.select(key, F.col("seq").cast("long").alias("seq"), F.col("start_sample").cast("long").alias("s"), size.alias("n"), "audio")
    length = cut.groupBy(key).agg(F.greatest(F.lit(2), F.max(F.col("s") + F.col("n"))).cast("long").alias("length"))
    tiles = length.withColumn("tile", F.explode(F.expr(f"sequence(0L, (length - 1) div {tile_samples}L)")))
    silence = tiles.select(key, "tile", F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset"), F.least(F.lit(tile_samples), F.col("length") - F.col("tile") * tile_samples).cast("long").alias("size"), F.lit(None).cast("array<double>").alias("piece"))
    parts = cut.filter("n > 0").withColumn("tile", F.explode(F.expr(f"sequence(s div {tile_samples}L, (s + n - 1) div {tile_samples}L)")))
    begin = F.greatest(F.col("s"), F.col("tile") * tile_samples)
    end = F.least(F.col("s") + F.col("n"), (F.col("tile") + 1) * tile_samples)
    piece = F.slice("audio", (begin - F.col("s") + 1).cast("int"), (end - begin).cast("int"))
    pieces = parts.select(key, "tile", "seq", (begin - F.col("tile") * tile_samples).alias("offset"), F.lit(None).cast("long").alias("size"), piece.cast("array<double>").alias("piece"))
    dealt = silence.unionByName(pieces).repartition(key, "tile").sortWithinPartitions(F.col(key), F.col("tile"), F.col("seq").asc_nulls_first())
    kind = cues.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.mapInArrow(_overlaid(to_arrow_type(kind), key, tile_samples), T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("tile long, start_sample long, samples array<double>").fields]))


def synthesised(cues: DataFrame, speak, rate: int = 24000) -> DataFrame:
    """cues (text, language, voice, speed) with audio (array<double> at `rate`) and n_samples of what speak gives.

    speak(text, language, voice, speed) -> (samples, its rate) is the injected model; it runs on the executors, cue by cue,
    and not at all for blank texts, which are silence.  Another rate than asked for is resampled linearly; samples beyond
    -1 and 1 are scaled to them.
    """
    schema = T.StructType([*(f for f in cues.schema.fields if f.name not in ("audio", "n_samples")), T.StructField("audio", T.ArrayType(T.DoubleType())), T.StructField("n_samples", T.LongType())])
    names = [f.name for f in schema.fields[:-2]]

    def one(text, language, voice, speed):
        if not (text or "").strip():
            return np.zeros(0)
        samples, own = speak(text, language, voice, speed)
        x = np.asarray(samples, float)
        if own != rate and len(x):
            n = max(1, round(len(x) * rate / own))
            x = np.interp(np.arange(n) * (own / rate), np.arange(len(x)), x)
        peak = np.abs(x).max(initial=0.0)
        return x / peak if peak > 1 else x

    def step(batches):
        for b in batches:
            said = [one(*row) for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("text", "language", "voice", "speed")), strict=True)]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(said, pa.list_(pa.float64())), pa.array([len(x) for x in said], pa.int64())], names=schema.names)

    return cues.mapInArrow(step, schema)
