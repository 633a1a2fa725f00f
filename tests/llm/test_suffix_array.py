"""The plain difference-cover suffix array against sorting, and its windows against a scan."""

import random

from cuemill.llm import suffixarray, suffixes

from . import helpers as h


def test_ranks(spark):
    r = random.Random(1)
    s = bytes(r.choice(b"ab") for _ in range(90)) + b"ab" * 11
    df = spark.createDataFrame([(i, c) for i, c in enumerate(s)], "pos long, v long").repartition(3)
    want = {p: k for k, p in enumerate(sorted(range(len(s)), key=lambda p: s[p:]))}
    for one_task in (1000, 80):
        assert {x["pos"]: x["rank"] for x in suffixarray.suffix_ranks(df, one_task).collect()} == want


def test_windows_agree_with_the_sampled_cover(spark):
    docs = h.frame(spark, [x for x in h.documents(n=8) if len(x[1] or "") < 900])
    got = {(x.doc_id, x["at"]) for x in suffixarray.repeated_windows(docs, 100).collect()}
    covered = {(d, p) for d, at in got for p in range(at, at + 100)}
    spans = {(x.doc_id, p) for x in suffixes.drop_repeated_substrings(docs).collect() for s in x.spans for p in range(s.start, s.end)}
    assert covered == spans and got
