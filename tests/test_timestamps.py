import datetime as dt

import pytest

from barloom.operators.timestamps import date_order_posteriors, normalise_timestamps, source_hints, utc_text

MANIFESTS = "manifest_id bigint, timezone_interpretation string, notes array<string>, timestamp string"
ROWS = "id bigint, manifest_id bigint, seq bigint, timestamp string, _zone string"


UTC = "naive, meant as UTC"
SAME = "2020-03-04T05:06:07.000000Z"
GRAMMAR = ["2020-03-04T05:06:07Z", "2020-03-04 05:06:07", " 2020-03-04t05:06:07z", "20200304 050607", "20200304T050607Z", "Mar 4, 2020 05:06:07", "04-Mar-2020 05:06:07 UTC", "Wed, 04 Mar 2020 05:06:07 +0000",
           "2020-03-04T07:06:07+02:00", "2020-03-04 00:06:07 -0500", "2020-03-04T06:06:07+01:00[Europe/Berlin]", "04-Mar-2020 00:06:07 EST", "1583298367", "1583298367000", "1583298367000000", "1583298367000000000", "2020-03-04T05:06:07,000"]
BAD = [None, "", "  ", "null", "24:61", "2021-02-30 10:15:00", "0000-00-00 00:00:00", "2022-13-04T08:00:00Z", "2020-06-31T12:00:00+00:00", "2020-01-01 25:00:00", "x" * 10_000, "12345", "1/2"]
WALL = ["2020-11-01 00:59:00", "2020-11-01 01:00:00", "2020-11-01 01:59:00", "2020-11-01 01:00:00", "2020-11-01 01:59:00", "2020-11-01 02:00:00"]
CHICAGO = "naive; America/Chicago"
#: name: (zone text, notes, values); all are read in one call, each as a file of its own.
CASES = {
    "grammar": (UTC, [], GRAMMAR),
    "precision": (UTC, [], ["2020-03-04T05:06:07.123456789Z", "1583298367123456789", "1583298367.1234567", "1583298367123"]),
    "bad": (UTC, [], BAD),
    "mdy": (UTC, ["month comes before day, twelve-hour clock"], ["03/04/2020 05:06:07 PM", "03/04/2020 12:06:07 AM"]),
    "dmy": (UTC, ["dates are written day/month/year"], ["03/04/2020 05:06", "04/25/2020 05:06"]),
    "evidence": (UTC, [], ["03/04/2020 05:06"] + [f"{d}/04/2020 05:06" for d in range(13, 30)]),
    "unsure": (UTC, [], ["03/04/2020 05:06", "03/03/2020 00:00"]),
    "york": ("wall clock of New York (US Eastern), daylight saving applied", [], ["2020-07-01 12:00:00"]),
    "india": ("no zone recorded; UTC+05:30 all year", [], ["2020-07-01 12:00:00"]),
    "none": (None, [], ["2020-07-01 12:00:00"]),
    "gap": (CHICAGO, [], ["2020-03-08 02:30:00"]),
    "fold": (CHICAGO, [], WALL),
    "second": (CHICAGO, [], WALL[3:]),
    "first": (CHICAGO, [], WALL[:2]),
    "anchored": (CHICAGO + "; some values carry their own zone", [], ["2020-11-01 01:10:00", "2020-11-01T06:20:00Z", "2020-11-01 01:30:00"]),
    "two_hours": ("naive; Antarctica/Troll", [], ["2020-10-25 00:59:00", "2020-10-25 01:30:00", "2020-10-25 02:30:00", "2020-10-25 01:30:00", "2020-10-25 02:30:00", "2020-10-25 03:00:00"]),
    "lone": (CHICAGO, [], ["2020-11-01 01:30:00"]),
    "between": (CHICAGO, [], ["2020-11-01 00:40:00", "2020-11-01 01:35:00", "2020-11-01 02:45:00"]),
    "shared": ("naive; Asia/Shanghai", [], ["04-Mar-2020 05:06:07 CST", "2020-03-04 05:06:07"]),
    "shared_us": (CHICAGO, [], ["04-Mar-2020 05:06:07 CST", "04-Mar-2020 05:06:07 IST"]),
    "half_hour": ("naive; Australia/Lord_Howe", [], ["2020-04-05 01:40:00", "2020-04-05 01:50:00", "2020-04-05 01:40:00", "2020-04-05 02:00:00"]),
}


@pytest.fixture(scope="module")
def read(spark):
    m = spark.createDataFrame([(k, zone, notes, "clash") for k, (zone, notes, _) in enumerate(CASES.values())], MANIFESTS)
    rows = [(1_000 * k + n, k, n, v, "clash") for k, (_, _, values) in enumerate(CASES.values()) for n, v in enumerate(values)]
    out = normalise_timestamps(spark.createDataFrame(rows, ROWS), m, "timestamp", order_by="seq", row_id="id")
    got = {r[0]: (r[1], r[2]) for r in out.select("id", utc_text(out["ts_utc"]), "status").collect()}
    assert set(got) == {r[0] for r in rows}
    return lambda name: [got[1_000 * list(CASES).index(name) + n] for n in range(len(CASES[name][2]))]


def clock(found):
    return [t[11:16] for t, _ in found]


def test_grammar_and_precision(read):
    assert [x[0] for x in read("grammar")] == [SAME] * len(GRAMMAR)
    assert [t[20:] for t, _ in read("precision")] == ["123456Z", "123456Z", "123456Z", "123000Z"]


def test_unreadable(read):
    found = read("bad")
    assert all(t is None for t, _ in found)
    assert [s for _, s in found] == ["missing"] * 3 + ["unreadable"] * (len(BAD) - 3)


def test_date_order_from_note_and_from_evidence(read):
    assert read("mdy") == [("2020-03-04T17:06:07.000000Z", "ok"), ("2020-03-04T00:06:07.000000Z", "ok")]
    assert read("dmy") == [("2020-04-03T05:06:00.000000Z", "ok"), (None, "off_format")]
    assert read("evidence")[0] == ("2020-04-03T05:06:00.000000Z", "ok")
    assert [s for _, s in read("unsure")] == ["ambiguous", "ok"]


def test_zones_gaps_and_folds(read):
    assert clock(read("york")) == ["16:00"] and clock(read("india")) == ["06:30"]
    assert read("none") == [(None, "no_zone")] and read("gap") == [(None, "skipped")]
    assert clock(read("fold")) == ["05:59", "06:00", "06:59", "07:00", "07:59", "08:00"]
    assert clock(read("second")) == ["07:00", "07:59", "08:00"] and clock(read("first")) == ["05:59", "06:00"]
    assert clock(read("anchored")) == ["06:10", "06:20", "06:30"]
    assert clock(read("two_hours")) == ["22:59", "23:30", "00:30", "01:30", "02:30", "03:00"]
    assert read("lone") == [(None, "ambiguous")] and [x for _, x in read("between")] == ["ok", "ambiguous", "ok"]
    assert clock(read("shared")) == ["21:06", "21:06"] and clock(read("shared_us")) == ["11:06", "23:36"]
    assert clock(read("half_hour")) == ["14:40", "14:50", "15:10", "15:30"]


def test_em_posterior_matches_fixed_point(spark):
    m = spark.createDataFrame([(1, None, [], "")], MANIFESTS)
    df = spark.createDataFrame([(k, 1, k, f"{d}/04/2020 05:06", "") for k, d in enumerate([20, 21, 22, 3])] + [(9, 1, 9, "04/23/2020 05:06", "")], ROWS)
    got = date_order_posteriors(df, source_hints(m), "timestamp", "manifest_id").first()["_pd"]
    w = 0.5
    for _ in range(200):
        w = (3 + w + 0.5) / (3 + 1 + 1 + 1)
    assert got == pytest.approx(w, abs=1e-4)


def test_empty_and_repeated(spark):
    m = spark.createDataFrame([], MANIFESTS)
    df = spark.createDataFrame([], ROWS)
    assert normalise_timestamps(df, m, "timestamp", order_by="seq", row_id="id").count() == 0
    twice = spark.createDataFrame([(1, 5, None, "2020-01-01 00:00:00Z", "")] * 2, ROWS)
    out = normalise_timestamps(twice, m, "timestamp", order_by="seq", row_id="id").collect()
    assert [r["ts_utc"] for r in out] == [dt.datetime(2020, 1, 1)] * 2
