"""Single operators on hand-computed bars, and an independent loop engine on shocked bars."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import market as M
from barloom.operators import audits as A
from barloom.operators import bars as B
from barloom.operators import causality as C
from barloom.operators import indicators as I
from barloom.operators import trading as T
from barloom.operators.second_engine import reconcile_engines, run_reference, walk
from barloom.params import StrategyParams

BARS = "series_id string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"
T0 = dt.datetime(2024, 1, 2, 14, 0)


def make(spark, rows, series="all"):
    return spark.createDataFrame([(series, *r, *([1.0] if len(r) == 5 else [])) for r in rows], BARS)


def at(minutes, start=T0):
    return start + dt.timedelta(minutes=minutes)


def test_weights():
    w = M.fracdiff_weights()
    assert len(w) == 49 and w[0] == 1.0 and w[1] == pytest.approx(-0.45) and abs(w[-1]) >= 0.001
    with pytest.raises(ValueError):
        M.fracdiff_weights(max_weights=0)


def test_sessions_and_deadlines(spark):
    utc = lambda *a: dt.datetime(*a)
    df = spark.createDataFrame([(utc(2024, 1, 3, h, m),) for h, m in ((7, 59), (8, 0), (14, 29), (14, 30), (18, 0), (21, 0), (22, 0), (23, 0))] + [(utc(2024, 3, 10, 22, 0),), (utc(2024, 1, 3, 20, 0),)], "t timestamp_ntz")
    got = df.select(M.session_class(F.col("t")), M.permitted(F.col("t")), M.trading_deadline(F.col("t"))).collect()
    assert [r[0] for r in got][:8] == ["globex_asia", "london", "london", "ny_am", "ny_pm", "ny_late", "maintenance", "globex_asia"]
    assert got[8][2] == utc(2024, 3, 11, 19, 0) and got[9][1] is False and got[9][2] is None and got[7][2] == utc(2024, 1, 4, 20, 0)


def test_bracket_and_ticks(spark):
    df = spark.createDataFrame([(100.0, 1.1), (100.0, 0.1)], "e double, a double")
    rows = df.select(M.bracket(F.col("e"), F.col("a")).alias("b")).collect()
    assert tuple(rows[0]["b"]) == (98.9, 99.0, 100.55, 100.75, 1.0) and rows[1]["b"] is None
    assert df.select(M.ceil_to_tick(F.col("e") + F.col("a"), 0.1).alias("x")).first()[0] == pytest.approx(101.1)


def test_fracdiff_orientation_and_warmup(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "n int, x double")
    got = df.select("n", I.fracdiff(F.col("x"), [1.0, -0.5, 0.25], Window.orderBy("n"))).orderBy("n").collect()
    assert [r[1] for r in got] == [None, None, 3.25]


@pytest.mark.parametrize("span,block", [(60, 64), (2, 64), (1, 64), (60, 4096), (60, 1)])
def test_ema_against_loop(spark, span, block):
    from barloom.operators.blocks import with_positions

    xs = [100 + math.sin(k / 7) * 5 + k * 0.01 for k in range(500)]
    df = with_positions(make(spark, [(at(k), x, x, x, x) for k, x in enumerate(xs)]), ["series_id"], "bar_ts")
    got = [r[0] for r in I.ema(df, "close", span, "e", series=["series_id"], block=block).orderBy("bar_ts").select("e").collect()]
    a, e = 2 / (span + 1), xs[0]
    for k, x in enumerate(xs):
        e = x if k == 0 else a * x + (1 - a) * e
        assert got[k] == pytest.approx(e, abs=1e-9)


def test_features_do_not_depend_on_blocks(spark):
    xs = [100 + math.sin(k / 9) * 3 + (k % 13) * 0.1 for k in range(700)]
    bars = make(spark, [(at(k), x, x + 1, x - 1, x) for k, x in enumerate(xs)])
    a, b = (I.build_features(bars, StrategyParams(block=n)) for n in (160, 4096))
    diff = A.compare_rows(a, b, ["bar_ts"], ["fracdiff", "z", "previous_z", "ema", "mean_range", "keltner", "next_ts", "raw_long_signal"]).collect()
    assert all(r["mismatches"] == 0 for r in diff) and a.count() == 700


def test_true_range_skips_empty_buckets(spark):
    d = dt.datetime(2024, 1, 2)
    rows = [(d, 100, 101, 99, 100), (d + dt.timedelta(hours=12), 110, 112, 109, 111)]
    got = T.true_range_4h(make(spark, [(t, *map(float, r)) for t, *r in rows])).orderBy("source_start").collect()
    assert [r["tr"] for r in got] == [2.0, 12.0] and got[1]["previous_close"] == 100.0


def simulate(spark, rows, entry=100.0, stop=90.0, target=105.0, deadline=dt.datetime(2024, 1, 2, 20, 0)):
    bars = make(spark, [(t, *map(float, r)) for t, *r in rows])
    c = spark.createDataFrame([("all", rows[0][0], entry, stop, target, entry - stop, deadline)], "series_id string, entry_time timestamp_ntz, entry_price double, stop_price double, target_price double, initial_risk double, deadline timestamp_ntz")
    r = T.accounting(T.simulate(c, bars)).first()
    return (r["exit_reason"], r["exit_price"], round(r["gross_R"], 9), r["exit_time"])


def test_first_touch(spark):
    assert simulate(spark, [(at(0), 87, 88, 86, 87)])[:3] == ("SL", 87.0, -1.3)
    assert simulate(spark, [(at(0), 110, 111, 109, 110)])[:3] == ("TP", 105.0, 0.5)
    assert simulate(spark, [(at(0), 100, 106, 89, 100)])[:3] == ("SL", 90.0, -1.0)
    end = dt.datetime(2024, 1, 2, 20, 0)
    assert simulate(spark, [(at(0), 100, 101, 99, 100), (end, 102, 200, 50, 100)]) == ("FLAT_1500", 102.0, 0.2, end)
    late = dt.datetime(2024, 1, 2, 19, 59)
    assert simulate(spark, [(at(0), 100, 101, 99, 100), (late, 100, 104, 99, 103), (dt.datetime(2024, 1, 2, 20, 2), 1, 1, 1, 1)]) == ("FLAT_1500", 103.0, 0.3, late)


def test_cost_year_and_summary(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1, 0, 30),), (dt.datetime(2023, 1, 1, 5, 30),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(M.cost_points(M.entry_year(F.col("t")))).collect()] == [0.0, 1.0]
    s = T.summarize(spark.createDataFrame([(0.5,), (-1.0,), (0.25,), (0.0,)], "net_R double")).first()
    assert (s["trades"], s["wins"], s["loss_or_zero"], s["win_rate"], s["profit_factor"]) == (4, 2, 2, 50.0, 0.75)
    e = T.summarize(spark.createDataFrame([], "net_R double")).first()
    assert e["trades"] == 0 and math.isnan(e["win_rate"]) and math.isnan(e["profit_factor"]) and e["net_R"] == 0.0
    assert T.summarize(spark.createDataFrame([(1.0,)], "net_R double")).first()["profit_factor"] == math.inf


def test_engine_against_loop(spark):
    rows, last, start = [], 15000.0, dt.datetime(2024, 1, 2)
    for k in range(1800):
        c = 15000 + 0.5 * math.sin(k / 13) + (25 if k >= 960 else 0) + (12 if 1100 <= k < 1300 else 0) + (k * 37 % 11) * 0.1
        rows.append((at(k, start), last, max(last, c) + 5, min(last, c) - 5, c))
        last = c
    p = StrategyParams(z_threshold=2.5, keltner_max=50.0)
    both = reconcile_engines(make(spark, rows), p).first()
    assert both["production_trades"] >= 1 and both["matched"] and both["production_hash"] == both["reference_hash"]
    assert [r[1] for r in walk(rows, p)] == [r["entry_time"] for r in run_reference(make(spark, rows), p).orderBy("entry_time").collect()]
    assert not reconcile_engines(make(spark, rows), p).drop("matched").limit(0).collect() and run_reference(make(spark, []), p).count() == 0


def test_validation_order_and_messages(spark):
    ok = [(at(k), 100.0, 101.0, 99.0, 100.0) for k in range(3)]
    assert B.validate_bars(make(spark, ok)).count() == 3 and B.validate_bars(make(spark, [])).count() == 0
    for change, rule in (((at(0), 100.0, 101.0, 99.0, 100.0), "duplicate_timestamp"), ((at(9), 100.0, 101.0, -1.0, 100.0), "nonpositive_price"), ((at(9), float("nan"), 101.0, 99.0, 100.0), "nonfinite"), ((at(9), 102.0, 101.0, 99.0, 100.0), "open_outside")):
        with pytest.raises(ValueError, match=rule):
            B.validate_bars(make(spark, [*ok, change]))
    numbered = make(spark, [ok[1], ok[0]]).withColumn("row", F.monotonically_increasing_id())
    with pytest.raises(ValueError, match="not_chronological"):
        B.validate_bars(numbered, row="row")


def test_gap_and_manifest_counts(spark):
    rows = [(at(0), -1.0, -1.0, -1.0, -1.0), (at(1), -1.0, -1.0, -1.0, -1.0), (at(3), -1.0, -1.0, -1.0, -1.0)]
    m = B.audit_counters(make(spark, rows), 60_000_000, ts="bar_ts", contract="series_id").first()
    assert (m["rows"], m["missing_intervals"], m["nonpositive_rows"], m["malformed_rows"]) == (3, 1, 3, 0)


def test_broken_ledgers_are_caught(spark):
    base = dict(signal_time=at(0), entry_time=at(1), exit_time=at(5), entry_price=100.0, exit_price=101.0, deadline=at(300), atr_source_end=at(-10), initial_risk=1.0, gross_R=1.0, cost_R=0.0, net_R=1.0, stop_price=99.0, target_price=101.0, direction="long", row=1)

    def failing(*trades):
        rows = [base | {"row": k} | t for k, t in enumerate(trades)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, deadline timestamp_ntz, atr_source_end timestamp_ntz, initial_risk double, gross_R double, cost_R double, net_R double, stop_price double, target_price double, direction string, row bigint")
        return {r["check"] for r in A.audit_ledger(df, tick=0.25).where("status = 'FAIL'").collect()}

    assert failing({}) == set()
    later = {"signal_time": at(5), "entry_time": at(5), "exit_time": at(9)}
    assert failing({}, later) == {"one_global_position", "entry_after_signal"}
    assert failing({"exit_time": at(0), "net_R": 2.0, "initial_risk": 0.0, "direction": "short", "stop_price": 99.1, "atr_source_end": at(2)}) == {"exit_after_entry", "r_accounting", "initial_risk", "long_only", "stop_price_tick_alignment", "atr_causality"}
    assert failing({"exit_time": at(301), "entry_price": float("nan")}) == {"deadline", "trade_prices"}
    bare = spark.createDataFrame([(at(1), at(5), 1.0, 1.0, 0)], "entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, row bigint")
    for wanted in ({"required_deadline": True}, {"long_only": True}):
        for df in (bare, bare.limit(0)):
            assert [(r["check"], r["status"]) for r in A.audit_ledger(df, **wanted).collect()] == [("ledger_schema", "FAIL")]
    assert ("ledger_schema", "PASS") in {(r["check"], r["status"]) for r in A.audit_ledger(bare).collect()}


def test_verdicts(spark):
    f = lambda *rows: A.findings(spark, [(c, s, "", None, fam) for c, s, fam in rows])
    v = lambda found, m=None: A.verdict(found, m).first()[0]
    assert v(f(("a", "PASS", None))) == "VERIFIED" and v(f(("a", "WARN", None))) == A.INCOMPLETE and v(f(("a", "FAIL", None), ("b", "WARN", None))) == "FAILED"
    assert v(f(("a", "PASS", None), ("b", "FAIL", None)), ["a"]) == "VERIFIED" and v(f(("a", "PASS", "x")), ["x", "y"]) == A.INCOMPLETE and v(f(("a", "FAIL", "x")), ["x", "y"]) == "FAILED"


def test_causality_catches_a_peek(spark):
    xs = [100 + 0.01 * k + math.sin(k / 9) for k in range(200)]
    bars = make(spark, [(at(k), x, x + 1, x - 1, x) for k, x in enumerate(xs)])
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("bar_ts")
    honest = lambda b: {"features": b.withColumn("f", F.avg("close").over(w.rowsBetween(-5, 0))).select("series_id", "bar_ts", "f")}
    peek = lambda b: {"features": b.withColumn("f", F.lead("close").over(w)).select("series_id", "bar_ts", "f")}
    cut = [at(100), at(150)]
    found, coverage = C.audit_with_coverage(honest, bars, cutoffs=cut)
    assert {r["status"] for r in found.collect()} == {"PASS"} and coverage["truncation_comparisons"] == 2 and coverage["stages"] == ["features"]
    ledger = lambda b: honest(b)["features"].select("series_id", F.col("bar_ts").alias("entry_time"), F.col("bar_ts").alias("exit_time"), "f")
    old = {(r["check"], r["status"]) for r in C.audit_ledger_causality(ledger, bars, cut).collect()}
    assert old == {("truncation_invariance", "PASS"), ("future_mutation", "PASS"), ("feature_causality", "UNVERIFIED")}
    assert [r["status"] for r in C.audit_ledger_causality(ledger, bars).collect()] == ["WARN"]
    with pytest.raises(TypeError):
        C.audit_causality(lambda b: {"features": 1}, bars, cutoffs=cut)
    assert {r["status"] for r in C.audit_causality(peek, bars, cutoffs=cut).collect()} == {"FAIL"}


def test_cutoffs(spark):
    bars = make(spark, [(at(k), 1.0, 1.0, 1.0, 1.0) for k in range(600)])
    got = C.generate_cutoffs(bars, {"trades": [at(300)]}, mode="strong")
    assert len(got) == 28 and got == sorted(got) == C.generate_cutoffs(bars, {"trades": [at(300)]}, mode="strong") and len(C.generate_cutoffs(bars, mode="fast")) == 6
    assert set(C.choose_positions(50, [7], [20])) >= {1, 2, 7, 10, 19, 20, 25, 49} or len(C.choose_positions(50, [7], [20])) == 28
    assert C.generate_cutoffs(bars.limit(0)) == [] and C.generate_cutoffs(bars, explicit=[at(3), at(1), at(3)]) == [at(1), at(3)]


def test_static_scan(spark):
    from barloom.operators.static_scan import scan_table, scan_text

    found = lambda s: {(r[0].removeprefix("static_"), r[1]) for r in scan_text(s)}
    names = lambda s: {r[0] for r in found(s)}
    for text, rule in (
        ("x.shift(-1)", "negative_shift"), ("np.roll(x, -2)", "negative_roll"), ("x.rolling(5, center=True)", "centered_rolling"), ("x.fillna(method='bfill')", "fillna_bfill"), ("pd.merge_asof(a, b, direction='forward')", "forward_asof"),
        ("x.iloc[i + 1]", "future_iloc"), ("x.iloc[1 + i]", "future_iloc"), ("x[i+1:]", "future_slice"), ("x[:i+2]", "future_slice"), ("x[::-1]", "reverse_slice"), ("x.reverse()", "reverse_iteration"), ("x.mean()", "full_sample_statistic"),
        ("F.lead('x')", "spark_lead"), ("w.rowsBetween(-1, 5)", "spark_future_frame"), ("df['target_return'] = 1", "future_label"), ("a.timestamp > b", "future_timestamp_join"), ("m.fit(x)", "full_sample_fit"),
    ):
        assert rule in names(text), text
    for text in ("x[:i+1]", "x[i - m + 1 : i + 1]", "x.rolling(5).mean()", "max(x)", "x.shift(1)", "x.iloc[i]", "x.sort()"):
        assert not found(text), text
    assert found("future_return = 1") == {("future_label", "INFO")} and scan_text("def f(:")[0][:2] == ("static_syntax", "PROVEN FAILURE") and names("s = 'x.shift( -1)'") == {"negative_shift"}
    df = spark.createDataFrame([("a.py", "y = x.bfill()"), ("b.py", None)], "path string, source string")
    assert [tuple(r) for r in scan_table(df).collect()] == [("a.py", "static_backfill", "WARN", 1)]
