import random

import pytest

from barloom.operators.tablediff import DiffParams, diff_tables, unmatched_rows

SCHEMA = "k bigint, v int, x double, s string, _key string"


def diff(spark, a, b, key="k", schema=SCHEMA, **params):
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    out = diff_tables(left, right, key=key, fields=["x", "s"], version="v", names=("a", "b"), params=DiffParams(**params))
    return sorted((r[key], r["field"]) for r in out.collect())


def test_rules(spark):
    nan = float("nan")
    a = [(1, 0, 1.0, "t", ""), (2, 0, 1.0, "t", ""), (3, 0, nan, None, ""), (4, 0, 1.0, "t ", ""), (5, 0, 1.0, "t", ""), (7, 0, 2.0, "t", ""), (8, 0, 0.0, "t", ""), (None, 0, 1.0, "t", ""), (9, 1, 5.0, "t", ""), (9, 2, 6.0, "t", "")]
    b = [(1, 5, 1.0 + 5e-10, "t", ""), (2, 0, 1.0 + 5e-9, "t", ""), (3, 0, None, None, ""), (4, 0, 1.0, "T ", ""), (6, 0, 1.0, "t", ""), (7, 0, None, None, ""), (8, 0, -0.0, "t", ""), (9, 3, 6.0, "t", "")]
    assert diff(spark, a + a[:4], b + b) == [(2, "x"), (4, "s"), (5, "only_a"), (6, "only_b"), (7, "s"), (7, "x")]


@pytest.mark.parametrize("width,chunk,apart", [(64, 4, 1), (65_536, 16, 1), (100, 1, 10**14)])
def test_random_against_brute_force(spark, width, chunk, apart):
    rng = random.Random(width)
    a = [((k - 500) * apart, 0, rng.random(), rng.choice("abc"), "") for k in range(1000) if rng.random() > 0.02]
    b = [(k, 0, x + (rng.random() < 0.03), s if rng.random() > 0.03 else "z", "") for k, _, x, s, _ in a if rng.random() > 0.02] + [(10_000 + k, 0, 1.0, "n", "") for k in range(5)]
    A, B = {r[0]: r for r in a}, {r[0]: r for r in b}
    expect = [(k, "only_a") for k in A.keys() - B.keys()] + [(k, "only_b") for k in B.keys() - A.keys()]
    for k in A.keys() & B.keys():
        expect += [(k, f) for f, i in (("x", 2), ("s", 3)) if A[k][i] != B[k][i]]
    rng.shuffle(b)
    assert diff(spark, a, b, bucket_rows=width, mean_chunk=chunk) == sorted(expect)


def test_equal_parts_are_not_read_again(spark):
    a = [(k, 0, float(k), "s", "") for k in range(5000)]
    b = [r for r in a if r[0] != 2500]
    left, right = unmatched_rows(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "k", ["x", "s"], "v")
    assert 0 < left.count() < 250 and left.count() - right.count() == 1


def test_text_keys_and_empty(spark):
    schema = "k string, v int, x double, s string, _key string"
    assert diff(spark, [("a", 0, 1.0, "q", ""), ("b", 0, 1.0, "q", "")], [("b", 0, 2.0, "q", "")], schema=schema) == [("a", "only_a"), ("b", "x")]
    assert diff(spark, [], [(1, 0, 1.0, "q", "")]) == [(1, "only_b")]
    assert diff(spark, [], []) == []
