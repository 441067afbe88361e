import numpy as np
import pandas as pd

from barloom.operators.spikes import SpikeParams, implausible_bars

BARS = "bar_id bigint, publisher_id int, instrument_id bigint, seq_no bigint, open double, high double, low double, close double, volume bigint, kind string, _scale string"
INSTRUMENTS = "instrument_id bigint, symbol string, kind string, tick_size double"


def series(n=400, seed=0, level=100.0):
    rng = np.random.default_rng(seed)
    close = level + np.cumsum(rng.normal(0, 0.25, n))
    open_ = np.r_[close[0], close[:-1]]
    return [[k, 1, 7, 1000 + k, float(open_[k]), float(max(open_[k], close[k]) + 0.3), float(min(open_[k], close[k]) - 0.3), float(close[k]), k + 1, "x", "y"] for k in range(n)]


def found(spark, rows, params=SpikeParams(), kind="outright"):
    bars = spark.createDataFrame([tuple(r) for r in rows], BARS)
    info = spark.createDataFrame([(7, "A", kind, 0.25)], INSTRUMENTS)
    out = {}
    for r in implausible_bars(bars, info, params).collect():
        out.setdefault(r["reason"], set()).add(r["bar_id"])
    return out


def move(row, by):
    for k in range(4, 8):
        row[k] += by


def test_kinds(spark):
    rows = series()
    for k in (50, 51, 52):
        move(rows[k], 40)
    rows[90][5] += 60
    for k in range(130, len(rows)):
        move(rows[k], 25)  # a lasting shift
    rows[200][6], rows[200][5] = rows[200][5], rows[200][6]
    for k in range(250, 262):
        rows[k][4:9] = rows[250][4:8] + [5]
    rows[300][4:8] = [0.0] * 4
    got = found(spark, rows)
    assert got["spike"] >= {50, 51, 52, 90, 300} and got["spike"] <= {50, 51, 52, 90, 300}
    assert got["impossible"] == {200, 300} and got["stuck"] == set(range(250, 262))
    for k in range(250, 261):
        rows[k][4:9] = rows[250][4:8] + [5]
    rows[261][8] = 6
    assert "stuck" not in found(spark, rows)


def test_blocks_change_nothing(spark):
    rows = series(1200, 3)
    for k in (127, 128, 129, 255, 511, 640):
        move(rows[k], -50)
    for k in range(378, 392):
        rows[k][4:9] = rows[378][4:8] + [9]
    whole, cut = found(spark, rows), found(spark, rows, SpikeParams(block=128))
    assert whole == cut and whole["spike"] == {127, 128, 129, 255, 511, 640} and whole["stuck"] == set(range(378, 392))


def test_negative_spread_copies_and_nulls(spark):
    rows = series(200, 1, level=-3.0)
    move(rows[60], 30)
    copy = list(rows[60]); copy[0] = 9_000  # noqa: E702
    other = list(rows[100]); other[0] = 9_001; move(other, 30)  # noqa: E702
    late = list(rows[120]); late[0], late[7] = 9_002, None  # noqa: E702
    lost = list(rows[121]); lost[0], lost[3] = 9_003, None  # noqa: E702
    nan = list(rows[122]); nan[0], nan[3], nan[5] = 9_004, 5_000, float("nan")  # noqa: E702
    got = found(spark, rows + [copy, copy, other, late, lost, nan], kind="spread")
    assert got == {"spike": {60, 9_000, 9_001}}


def test_empty(spark):
    assert found(spark, []) == {}


def test_phi_belongs_to_the_source_and_decides(spark):
    """In a series with momentum the prediction moves on: a bar 9.5 scales off the last close is 10 off the prediction."""
    n = 2_000
    rng = np.random.default_rng(4)
    step = np.zeros(n)
    for k in range(1, n):
        step[k] = 0.8 * step[k - 1] + rng.normal(0, 0.4)
    close = 500 + np.cumsum(step)
    rows = series(n)
    for k, r in enumerate(rows):
        r[4:8] = [float(close[k]), float(close[k] + 0.5), float(close[k] - 0.5), float(close[k])]
    at = next(k for k in range(100, n - 100) if min(step[k - 1 : k + 3]) > 0.75 and max(step[k - 1 : k + 3]) < 1.2)
    # Falls away from a rising line, and the line goes on.
    for col in range(4, 8):
        rows[at][col] = float(min(close[at - 1], close[at + 1]) - 9.6)
    with_phi, without = found(spark, rows), found(spark, rows, SpikeParams(max_phi=0.0))
    assert at in with_phi.get("spike", set()) and at not in without.get("spike", set())
    assert found(spark, rows, SpikeParams(block=128)) == with_phi


def test_tests_are_repeated_until_nothing_changes(spark):
    """A good bar between two spikes of one level is taken for an excursion at first, and cleared once they are known."""
    rows = series(300, 6)
    for k in (100, 102, 104, 106, 108, 110):
        move(rows[k], 40)
    assert found(spark, rows) == {"spike": {100, 102, 104, 106, 108, 110}}


def test_four_bars_are_no_excursion(spark):
    rows = series(300, 7)
    for k in (100, 101, 102, 103):
        move(rows[k], 40)
    move(rows[105], -30)
    for k in range(200, 300):
        move(rows[k], -30)
    assert found(spark, rows) == {"spike": {105}}
