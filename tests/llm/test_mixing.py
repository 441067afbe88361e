import math
import os

import pytest
from pyspark.sql import functions as F

from barloom.llm.mixing import VOCABULARY, MixParams, _encoder, _pieces, count_tokens, mix_sources, scan_quality

DOCS = "doc_id bigint, source string, text string, w double, copies int, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, doc_id string"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary isn't here")


def docs(spark, sizes, w=1.0):
    rows, k = [], 0
    for source, n in sizes.items():
        for j in range(n):
            rows.append((k, source, "word " * (20 + (j * 7) % 30), w, 0, ""))
            k += 1
    return spark.createDataFrame(rows, DOCS)


def brute(pages, goals, seed_keys, total):
    """Complete epochs, then pages in key order while they fit."""
    out = {}
    for source, (share, most) in goals.items():
        own = [p for p in pages if p[1] == source]
        size = sum(p[2] for p in own)
        if not size:
            continue
        budget = min(math.floor(total * share + 1e-6), most * size)
        epochs, rest = divmod(budget, size)
        used = 0
        for d, _, n in sorted(own, key=lambda p: (seed_keys[p[0]], p[0])):
            used += n
            c = epochs + (used <= rest)
            if c:
                out[d] = c
    return out


@pytest.mark.parametrize("bins,low", [(1, 0.5), (1024, 0.5), (1024, 0.05)])
def test_against_brute_force(spark, bins, low):
    goals = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 8)}
    df = docs(spark, {"a": 120, "b": 40, "c": 5, "other": 30})
    targets = spark.createDataFrame([(s, *g, "") for s, g in goals.items()], TARGETS)
    p = MixParams(bins=bins)
    mix, shares = mix_sources(df, targets, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(low), params=p)
    sized = [tuple(r) for r in count_tokens(df.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens").collect()]
    draw = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("source"), F.lit(p.seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keys = {r[0]: -math.log(r[1]) / (1.0 if r[0] % 2 == 0 else low) for r in df.select("doc_id", draw).collect()}
    size = lambda s: sum(n for _, x, n in sized if x == s)
    total = min(m * size(s) / g for s, (g, m) in goals.items())
    got = {r["doc_id"]: r["copies"] for r in mix.collect()}
    assert got == brute(sized, goals, keys, total)
    for r in shares.collect():
        assert r["actual_share"] == pytest.approx(goals[r["source"]][0], abs=0.03)


def test_total_and_caps(spark):
    df = docs(spark, {"a": 50, "b": 4})
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.4, 2, ""), ("none", 0.1, 5, "")], TARGETS)
    mix, shares = mix_sources(df, targets, params=MixParams(total_tokens=1_200))
    by = {r["source"]: r for r in shares.collect()}
    assert by["b"]["used"] == 2 * by["b"]["available"] and by["none"]["used"] == 0 and 500 < by["a"]["used"] <= 600
    assert mix.agg(F.max("copies")).first()[0] == 2


def test_weights_matter(spark):
    df = docs(spark, {"a": 2000})
    targets = spark.createDataFrame([("a", 1.0, 1, "")], TARGETS)
    mix, _ = mix_sources(df, targets, weight=F.when(F.col("doc_id") < 1000, 1.0).otherwise(0.2), params=MixParams(total_tokens=15_000))
    n = mix.agg(F.count_if(F.col("doc_id") < 1000), F.count("*")).first()
    assert n[0] / n[1] > 0.7


def test_defined_results(spark):
    odd = spark.createDataFrame([(1, None, "a b", 1.0, 0, ""), (2, "a", None, 1.0, 0, ""), (3, "a", "", 1.0, 0, ""), (4, "a", "x y", float("nan"), 0, ""), (4, "a", "x y", None, 0, ""), (None, "a", "z z", -1.0, 0, "")], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("a", 0.5, 2, ""), (None, 1.0, 1, ""), ("b", None, None, "")], TARGETS)
    mix, shares = mix_sources(odd, targets, weight=F.col("w"))
    assert sorted(str(r["doc_id"]) for r in mix.collect()) == ["4", "4", "None"] and {r["source"]: r["actual_share"] for r in shares.collect()} == {"a": 1.0, "b": 0.0}
    for d, t in ((odd.limit(0), targets), (odd, targets.limit(0))):
        m, s = mix_sources(d, t)
        assert m.count() == 0 and s.count() == (2 if t is targets else 0)


def test_pieces_count_like_whole_texts():
    enc = _encoder(VOCABULARY, None)
    text = "\n".join(f"line {k} with some  words, it's {k * k}" for k in range(3000))
    parts = list(_pieces(text, 1_000))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(len(enc.encode_ordinary(x)) for x in parts) == len(enc.encode_ordinary(text))


def test_scan_quality(spark):
    df = spark.createDataFrame([([(1, 0.5), (2, 0.7)],), ([],), (None,), ([(1, None)],)], "b array<struct<x0:int,conf:float>>")
    assert [round(r[0], 3) if r[0] is not None else None for r in df.select(scan_quality(F.col("b"))).collect()] == [0.6, None, None, None]


def test_vocabulary_of_the_session(spark):
    df = docs(spark, {"a": 3}).select("doc_id", "text")
    spark.conf.set("spark.barloom.vocabulary", "/nowhere/ranks")
    try:
        with pytest.raises(Exception, match="nowhere"):
            count_tokens(df).collect()
        assert count_tokens(df, MixParams(vocabulary=VOCABULARY)).count() == 3
    finally:
        spark.conf.unset("spark.barloom.vocabulary")
