"""Passages of exactly the least length that counts, and shared phrases of one word less than twelve."""

import random

from barloom.llm.leaks import Items, LeakParams, _candidates, find_in_texts
from barloom.llm.wumanber import Letters
from tests_leaks_help import lines, page, prose, prose_items


def found(texts, items):
    return {r[:2] for r in find_in_texts(texts, Items(items, LeakParams()))}


def planted(items, n, words, changed, mixed, rate, seed):
    rng = random.Random(seed)
    texts, want = [], set()
    for q in range(n):
        k = q % len(items)
        texts.append(page(rng, items[k].split(), words, changed, mixed, rate))
        want.add((q, k))
    return texts, want


def test_twenty_words_with_three_changed():
    items = prose_items(40)
    texts, want = planted(items, 80, 20, 3, False, 0.01, 7)
    got = found(texts, items)
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_short_phrases_are_no_case():
    items = prose_items(40)
    texts, _ = planted(items, 80, 11, 0, False, 0.0, 8)
    assert not found(texts, items)
    texts, _ = planted(items, 80, 24, 8, False, 0.0, 9)
    assert not found(texts, items)


def test_one_item_is_found_as_among_many():
    items = prose_items(1)
    texts, want = planted(items, 80, 20, 3, False, 0.01, 5)
    got = found(texts, items)
    assert len(got & want) >= 0.85 * len(want)
    short = " ".join(sorted({w for w in items[0].split() if len(w) > 3})[:20])
    assert found([short], [short]) == {(0, 0)}


def test_filter_keeps_passages_in_columns_read_across():
    texts_of = prose_items(400)
    texts, want = planted(texts_of, 200, 20, 3, True, 0.025, 12)
    items, L = Items(texts_of, LeakParams()), Letters(texts)
    rows = _candidates(L, *items.seeds(*items.finder.search(L.code)), items)
    kept = {tuple(r) for r in rows[:, :2].tolist()}
    assert len(kept & want) >= 0.9 * len(want)


def test_an_advert_of_any_length_hides_nothing():
    items = prose_items(40)
    rng = random.Random(3)
    for between in (3, 60, 200):
        texts, want = [], set()
        for q in range(20):
            words = items[q].split()[:26]
            advert = [x for _ in range(between) for x in lines(prose(rng, 6), 80)]
            texts.append("\n".join(lines(prose(rng, 60)) + lines(words[:13]) + advert + lines(words[13:]) + lines(prose(rng, 60))))
            want.add((q, q))
        assert found(texts, items) == want


def test_many_runs_on_one_place():
    """A phrase that an item repeats gives many runs at one place of the page; the passage around it is found still."""
    rng = random.Random(8)
    phrase = " ".join(prose(rng, 4))
    parts = [" ".join(prose(rng, 5)) for _ in range(40)]
    item = " ".join(f"{phrase} {x}" for x in parts)
    passage = " ".join(f"{phrase} {x}" for x in parts[20:24])
    text = "\n".join([*lines(prose(rng, 90)), *lines((passage + " ").split()), *lines(prose(rng, 90))])
    assert found([text], [item]) == {(0, 0)}
