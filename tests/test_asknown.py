import datetime as dt
import random

import pytest

from barloom.operators.asknown import AsKnownParams, attach_as_known

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id bigint, ent bigint, at timestamp, in_extra string, f0 string"
ATTRS = "ent bigint, rid bigint, src timestamp, known timestamp, tr double, id string"


def held(spark, events, attrs, **params):
    e, a = spark.createDataFrame(events, EVENTS), spark.createDataFrame(attrs, ATTRS)
    out = attach_as_known(e, a, event_entity="ent", event_time="at", entity="ent", known_at="known", rank=["src", "known"], keep=["tr"], row_id="rid", params=AsKnownParams(**params))
    return {(r["id"], r["in_extra"]): (r["in_force"]["rid"] if r["in_force"] else None) for r in out.collect()}, out


@pytest.mark.parametrize("inline", [0, 2, 256])
def test_against_brute_force(spark, inline):
    rng = random.Random(7)
    h = lambda n: T0 + dt.timedelta(minutes=rng.randrange(n))
    attrs = [(rng.randrange(3), k, h(4000) if rng.random() > 0.05 else None, h(6000) if rng.random() > 0.05 else None, float(k), "x") for k in range(120)]
    attrs += attrs[:10]
    events = [(k, rng.choice([0, 1, 2, 9, None]), h(7000) if rng.random() > 0.05 else None, "e", "f") for k in range(150)]
    got, _ = held(spark, events, attrs, period_seconds=3600 * 8, max_inline=inline)
    for i, ent, at, *_ in events:
        known = [(a[2], a[3], a[1]) for a in attrs if a[0] == ent and ent is not None and at and a[2] and a[3] and a[3] <= at]
        assert got[(i, "e")] == (max(known)[2] if known else None)


def test_empty_and_ties(spark):
    events = [(1, 1, T0, "a", "")]
    assert held(spark, events, [])[0] == {(1, "a"): None}
    assert held(spark, [], [(1, 1, T0, T0, 1.0, "")])[0] == {}
    assert held(spark, events * 2, [(1, 4, T0, T0, 1.0, ""), (1, 5, T0, T0, 2.0, "")])[0] == {(1, "a"): 5}


def test_event_columns_stay(spark):
    _, out = held(spark, [(1, 1, T0, "a", "b")], [(1, 4, T0, T0, 1.0, "")])
    assert out.columns == ["id", "ent", "at", "in_extra", "f0", "in_force"] and out.first()["f0"] == "b"
