import random

import pytest

from barloom.llm.queries import QUERIES
from barloom.llm.reading import ReadingParams, band_of, fit_levels, fit_on, predict_levels

WORDS = {b: [f"{p}{q}" for p in (x, x + "a", x + "e") for q in ("tor", "lin", "mar", "pel", "sun", "dor")] for b, x in zip((1, 2, 3, 4), ("b", "kr", "stram", "prenthol"))}


def page(band, rng, n=120):
    """Words of the band and, less often, of easier ones; some misread, one broken at a line end."""
    words = [rng.choice(WORDS[band if rng.random() < 0.6 else rng.randint(1, band)]) for _ in range(n)]
    words = [w if rng.random() > 0.05 else w[:1] + "x" + w[2:] for w in words]
    return " ".join(words[: n // 2]) + " " + words[0][:2] + "-\n" + words[0][2:] + " " + " ".join(words[n // 2 :])


def test_held_out_accuracy():
    rng = random.Random(2)
    train = [(page(b, rng), min(4, max(1, b + rng.choice([0, 0, 0, 0, 1, -1]) * 0.5))) for b in (1, 2, 3, 4) for _ in range(40)]
    model = fit_on(train)
    test = [(page(b, rng), b) for b in (1, 2, 3, 4) for _ in range(40)]
    assert sum(band_of(t, model)[0] == b for t, b in test) / len(test) >= 0.95


def test_word_grades_follow_use():
    model = fit_on([("ab ab ab cd", 1.0)] * 5 + [("cd cd ef ef", 4.0)] * 5, ReadingParams(min_pages=2))
    assert model.grade["ab"] < model.grade["cd"] < model.grade["ef"]


def test_spark_and_defined_results(spark):
    rng = random.Random(4)
    docs = [(k, page(k % 4 + 1, rng), "clash") for k in range(80)] + [(100, None, ""), (101, "", ""), (102, "zz qq", ""), (1, page(2, rng), "")]
    labels = [(k, k, "r", k % 4 + 1) for k in range(60)] + [(0, 0, "r", 1)] * 5 + [(900, 61, "r", None), (901, None, "r", 2), (902, 5_000, "r", 3)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, band string")
    lab = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, rater string, grade int")
    model = fit_levels(d, lab)
    out = [(r["doc_id"], r["band"]) for r in predict_levels(d, model).collect()]
    assert len(out) == len(docs) and sum(b == k % 4 + 1 for k, b in out if k < 80) >= 76
    assert {b for k, b in out if k in (100, 101, 102)} == {model.fallback}
    assert {r["doc_id"] for r in predict_levels(d, model).where("known_words = 0").collect()} == {100, 101, 102}
    none = fit_levels(d, lab.limit(0))
    assert {r["band"] for r in predict_levels(d, none).collect()} == {None}
    assert predict_levels(d.limit(0), model).count() == 0
    assert len(fit_levels(d, lab, ReadingParams(max_pages=8)).bands) <= 4


def test_queries_run(spark, data):
    for name, f in QUERIES.items():
        assert f(spark, data).count() > 0, name
    pages = QUERIES["p8_found"](spark, data)
    assert pages.columns == ["doc_id", "band"] and QUERIES["p6_found"](spark, data).columns == ["doc_id", "item_id"]
    assert pytest.approx(1.0) == sum(r["actual_share"] for r in QUERIES["p7_shares"](spark, data).collect())
