import random

import numpy as np
import pytest

from barloom.llm.leaks import LeakParams, leaked_passages
from barloom.llm.wumanber import Letters, WuManber, packed

DOCS = "doc_id bigint, text string, item_id string, words string"
ITEMS = "item_id bigint, text string, doc_id string"


def vocabulary(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(n)]


WORDS = vocabulary()


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def lines(words, width=34, rng=None):
    """Lines of a page; with ``rng`` some words break at line ends."""
    out, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > width and line:
            room = width - len(line) - 2
            if rng and 2 < room < len(w) - 2 and rng.random() < 0.7:
                out.append(f"{line} {w[:room]}-")
                line = w[room:]
                continue
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def misread(text, rng, rate):
    return "".join(rng.choice("abcdefghilmnorstu") if c.isalpha() and rng.random() < rate else c for c in text)


def test_search_finds_what_comparison_finds():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 4, 30_000).astype(np.uint8)
    starts = rng.integers(0, len(code) - 12, 200)
    extra = packed(rng.integers(0, 4, 600).astype(np.uint8), np.arange(0, 588, 12), 12)
    patterns = np.unique(np.r_[packed(code, starts, 12), extra])
    for block, bits in ((6, 18), (3, 10), (1, 6)):
        at, value = WuManber(patterns, 12, block, bits).search(code, lane=37)
        every = packed(code, np.arange(len(code) - 11), 12)
        want = np.flatnonzero(np.isin(every, patterns))
        assert at.tolist() == want.tolist() and (value == every[want]).all()


def test_letters_join_breaks_and_fold():
    L = Letters(["Élan ab-\r\ncd", None, "", "x1y"])
    assert "".join(chr(97 + c) for c in L.code) == "elanabcdxly" and L.start.tolist() == [0, 8, 8, 8, 11]
    assert L.line[6] == L.line[5] + 1


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    items = [(k, " ".join(prose(rng, rng.randint(30, 80)))) for k in range(20)]
    docs, want = [], set()
    for d in range(120):
        body = lines(prose(rng, 200), rng=rng)
        k = d % 20
        words = items[k][1].split()
        kind = d % 6
        if kind < 3:
            a = rng.randrange(0, len(words) - 26)
            part = words[a : a + rng.randint(26, 40)]
            for x in rng.sample(range(1, len(part) - 1), len(part) // 8):
                part[x] = rng.choice(WORDS)
            shown = lines(part, rng=rng)
            if kind == 1:  # columns read across each other
                other = lines(prose(rng, 60))
                shown = [x for pair in zip(shown, other) for x in pair] + shown[len(other) :]
            if kind == 2:  # an advert in between
                shown[2:2] = ["FOR SALE CHEAP", "9 boats and one farm.", "Inquire of the owner."]
            want.add((d, k))
        elif kind == 3:  # a short shared phrase
            shown = lines(words[:9])
        elif kind == 4:  # the item's words in another order
            shown = lines(rng.sample(words, len(words)))
        else:
            shown = []
        at = rng.randrange(len(body))
        text = misread("\n".join(body[:at] + shown + body[at:]), rng, 0.01 if d % 2 else 0.025)
        docs.append((d, text.upper() if d % 7 == 0 else text, "x", "y"))
    return docs, items, want


def test_planted_passages(spark, case):
    docs, items, want = case
    got = {(r["doc_id"], r["item_id"]) for r in leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, t, "z") for k, t in items], ITEMS)).collect()}
    assert len(got & want) / len(want) >= 0.97 and not got - want


def test_passes_and_stretches_change_nothing(spark, case):
    docs, items, _ = case
    whole = "\n".join(t for _, t, *_ in docs[:40])
    d, i = spark.createDataFrame([(1, whole, "", "")], DOCS), spark.createDataFrame([(k, t, "z") for k, t in items], ITEMS)
    one = {tuple(r)[:2] for r in leaked_passages(d, i).collect()}
    cut = {tuple(r)[:2] for r in leaked_passages(d, i, LeakParams(stretch=20_000, overlap=6_000, max_item_letters=2_000)).collect()}
    assert one == cut and len(one) > 10


def test_nulls_and_empty(spark, case):
    items = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "too short", ""), (None, case[1][0][1], ""), (5, case[1][0][1], ""), (5, case[1][0][1], "")], ITEMS)
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (None, case[1][0][1], "", ""), (4, case[1][0][1], "", ""), (4, case[1][0][1], "", ""), (6, "é" * 50, "", "")], DOCS)
    assert [tuple(r)[:2] for r in leaked_passages(docs, items).collect()] == [(4, 5)]
    assert leaked_passages(docs.limit(0), items).count() == 0 and leaked_passages(docs, items.limit(0)).count() == 0
