"""Progress by listener, timelines in tiles, manifests rewritten where they changed."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import listings, timeline
from cuemill.sources import documents
from cuemill.streaming import progress
from cuemill.streaming.stages import Stages


def test_batches_are_counted_by_listener(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "id % 2 as odd").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    stages = Stages(told.append)
    listener = progress.Progress(stages, "counted").start(spark)
    other = progress.Progress(Stages(), "another").start(spark)
    rows = spark.readStream.schema("id long, odd long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = progress.observed(rows, odd=F.sum("odd"), high=F.max("id"))
    q = rows.writeStream.queryName("counted").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    listener.stop(spark)
    other.stop(spark)
    batches = [t for t in told if t["stage"] == "batch"]
    assert [(t["rows"], t["odd"], t["input_rows"]) for t in batches] == [(10, 5, 10)] * 3
    assert [t["completed"] for t in batches] == [1, 2, 3] and sorted(t["high"] for t in batches) == [9, 19, 29]
    assert listener.totals["rows"] == 30 and other.totals == {}
    assert [told[0]["stage"], told[-1]["stage"]] == ["stream", "completed"]


def test_a_stream_that_fails_is_told(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    told = []
    listener = progress.Progress(Stages(told.append), "failing").start(spark)
    rows = progress.observed(spark.readStream.schema("id long").parquet(str(tmp_path / "in"))).select(F.raise_error(F.lit("no")).alias("x"), "id")
    q = rows.writeStream.queryName("failing").format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no"):
        q.awaitTermination(120)
    listener.stop(spark)
    assert told[-1]["stage"] == "failed" and "no" in told[-1]["message"]


@pytest.mark.parametrize("tile", [7, 64, 100_000])
def test_tiles_are_the_rendered_timeline(spark, tile):
    r = random.Random(tile)
    rows = []
    for m in range(4):
        for k in range(25):
            n = r.choice([0, 1, 5, 40, 200])
            rows.append((f"m{m}", k, r.randrange(0, 900), r.choice([1, 30, 150]), [r.uniform(-1.5, 1.5) for _ in range(n)] if n else r.choice([None, []])))
    rows.append(("silent", 0, 0, 10, None))
    df = spark.createDataFrame(rows, "media_id string, seq int, start_sample long, target_samples long, audio array<double>").repartition(3)
    want = {x.media_id: list(x.samples) for x in timeline.rendered(df).collect()}
    got = timeline.tiled(df, tile_samples=tile).collect()
    for m, samples in want.items():
        own = sorted((x.tile, x.start_sample, x.samples) for x in got if x.media_id == m)
        assert [t for t, _, _ in own] == list(range(len(own))) and all(s == t * tile for t, s, _ in own)
        assert all(len(x) == tile for _, _, x in own[:-1]) and 0 < len(own[-1][2]) <= tile
        assert [v for _, _, x in own for v in x] == pytest.approx(samples)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_untouched_manifests_keep_their_files(spark, tmp_path):
    rows = spark.range(60).selectExpr("id as pos", "concat('out_', id % 20) as output_folder", "'new' as state", "concat('run', id % 4) as manifest")
    path = tmp_path / "manifests"
    rows.repartition("manifest").write.partitionBy("manifest").parquet(str(path))
    before = files(path)
    states = spark.createDataFrame([("out_1", "voiced"), ("out_5", "new"), ("out_9", "voiced"), ("none", "x")], "output_folder string, state string")
    patched = listings.patched(spark.read.parquet(str(path)), states)
    assert documents.rewritten(patched, str(path)) == ["run1"]
    after = files(path)
    same = lambda f: {k: v for k, v in f.items() if "run1" not in k}
    assert same(after) == same(before) and set(after) - set(same(after)) != set(before) - set(same(before))
    got = spark.read.parquet(str(path))
    assert got.count() == 60 and {r.output_folder for r in got.filter("state = 'voiced'").collect()} == {"out_1", "out_9"}
    assert got.filter("state = 'voiced'").count() == 6
    assert documents.rewritten(listings.patched(spark.read.parquet(str(path)), states), str(path)) == []
