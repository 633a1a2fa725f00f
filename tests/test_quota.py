"""Quota reservation by rounds against one request after the other."""

import random
from collections import Counter, defaultdict

import pytest

from cuemill.operators import fallback

SCHEMA = "provider string, window string, req_id long, amount long, limit long"


def plain(rows):
    used, out = defaultdict(int), []
    for p, w, q, a, most in sorted(rows, key=lambda r: (r[2], r[3] or 0)):
        a = a or 0
        if most is None:
            out.append((p, w, q, a, most, True, None))
            continue
        fits = used[p, w] + a <= most
        used[p, w] += a * fits
        out.append((p, w, q, a, most, fits, used[p, w]))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("provider", "window", "req_id", "amount", "limit", "accepted", "used").collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_decide_as_one_by_one(spark, seed):
    r = random.Random(seed)
    limits = {"a": 1000, "b": 7, "c": 0, "d": 500_000, "e": None}
    rows = []
    for k in range(1500):
        p = r.choice(["a", "a", "a", "b", "c", "d", "e"])
        amount = {"a": r.choice([1, 5, 90, 400, 600, 999, 1000, 1001, 0]), "b": r.randint(0, 8), "c": r.choice([0, 0, 3]), "d": r.randint(1, 90_000)}.get(p, 4)
        rows.append((p, None if p == "e" else f"w{k % 2}", k, None if r.random() < 0.02 else amount, limits[p]))
    rows += [("a", None, 5000 + k, 300, 1000) for k in range(5)]
    assert got(fallback.reserved(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_refusals_that_alternate_take_few_rounds(spark, monkeypatch):
    """1, 100, 1, 99, 1, 98: accepted up to the first refusal, each round would decide two requests."""
    rows = [("a", "w", 2 * k, 1, 200) for k in range(150)] + [("a", "w", 2 * k + 1, 200 - k, 200) for k in range(150)]
    stored, names = fallback.running.stored, []
    monkeypatch.setattr(fallback.running, "stored", lambda df, name: names.append(name) or stored(df, name))
    assert got(fallback.reserved(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert names.count("quota-round") <= 9


def test_one_window_is_many_tasks_work_and_no_python(spark):
    rows = spark.range(8000).selectExpr("'deepl' as provider", "'2024-01' as window", "id as req_id", "id % 97 + 1 as amount", "cast(100000 as long) as limit")
    out = fallback.reserved(rows)
    blocks = fallback.running.blocks(rows, ["provider", "window"], ["req_id"], "test-blocks")
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 4000
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got(out) == plain([tuple(r) for r in rows.collect()])


def test_unmetered_requests_are_not_shuffled(spark):
    free = spark.range(100).selectExpr("'x' as provider", "cast(null as string) as window", "id as req_id", "id as amount", "cast(null as long) as limit")
    out = fallback.reserved(free)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("accepted and used is null").count() == 100


def test_no_requests(spark):
    assert fallback.reserved(spark.createDataFrame([], SCHEMA)).collect() == []
