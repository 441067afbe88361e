"""Sources, reports, orchestrator, streams, and every registered query on the smallest tables."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.cli import main, new_strategy
from barloom.sources import bars as S


def test_csv_zones(spark, tmp_path):
    def load(lines, **kw):
        p = tmp_path / "b.csv"
        p.write_text("timestamp,open,high,low,close,volume,note\n" + "\n".join(lines))
        return S.load_bars(spark, str(p), **kw)

    assert load(["2024-01-02T14:00:00+01:00,1,2,1,2,5,x"]).first()["bar_ts"] == dt.datetime(2024, 1, 2, 13)
    with pytest.raises(ValueError, match="no time zone"):
        load(["2024-01-02T14:00:00,1,2,1,2,5,x"])
    with pytest.raises(ValueError, match="not_chronological"):
        load(["2024-01-02T14:01:00Z,1,2,1,2,5,x", "2024-01-02T14:00:00Z,1,2,1,2,5,x"])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # both hours of the night on which the session's clock goes back
        got = [r["bar_ts"] for r in load(["2024-11-03T05:30:00Z,1,2,1,2,5,x", "2024-11-03T06:30:00Z,1,2,1,2,5,x"]).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30)]
    with pytest.raises(ValueError, match="no column"):
        load(["2024-01-02T14:00:00Z,1,2,1,2,5,x"], timestamp_col="ts")
    with pytest.raises(ValueError, match="unsupported data format"):
        S.data_format("x.json")


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_stored_order_of_folders(spark, tmp_path, kind):
    """Files by name and rows by place, however large the files are."""
    folder = tmp_path / f"two parts.{kind}"
    folder.mkdir()
    for name, rows in (("a", [5, 4]), ("b", range(100, 400))):
        df = spark.createDataFrame([(int(x), "pad" * 20) for x in rows], "x bigint, pad string").coalesce(1)
        part = tmp_path / f"{name}-{kind}"
        (df.write.option("header", True).csv if kind == "csv" else df.write.parquet)(str(part))
        next(part.glob(f"part-*.{kind}")).rename(folder / f"{name}.{kind}")
    got = [int(r["x"]) for r in S.with_rows(spark, str(folder)).orderBy(S.ROW).collect()]
    assert got == [5, 4, *range(100, 400)]


def test_hashes(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    got = S.file_hashes(spark, str(tmp_path / "a.py")).first()
    assert (got["sha256"], got["bytes"]) == S.sha256_file(tmp_path / "a.py")
    before = S.hash_source(tmp_path)
    (tmp_path / "b.py").write_text("")
    assert S.hash_source(tmp_path) != before


def test_trade_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 2, 14, 0)
    rows = [(t + dt.timedelta(seconds=k), "c" if k % 2 else "d", float(k)) for k in range(0, 600, 7)]
    spark.createDataFrame(rows, "timestamp timestamp_ntz, instrument_id string, open double").write.parquet(str(tmp_path / "s.parquet"))
    trades = spark.createDataFrame([(t + dt.timedelta(seconds=130), "c"), (None, "c")], "exit_time timestamp_ntz, instrument_id string")
    got = S.load_trade_windows(spark, str(tmp_path / "s.parquet"), trades).collect()
    assert [r["timestamp"] for r in got] == [x for x, c, _ in rows if c == "c" and 120 <= (x - t).seconds < 180]


ADAPTER = """
from barloom.operators.indicators import build_features
from barloom.operators.trading import build_candidates, run_backtest
from barloom.params import StrategyParams

P = StrategyParams(z_threshold=2.5, keltner_max=50.0)


def run(bars):
    return run_backtest(bars, P)


def features(bars):
    return build_features(bars, P)


def proposed_entries(bars):
    return build_candidates(features(bars))
"""


def test_verify_end_to_end(spark, tmp_path):
    folder = new_strategy("demo", tmp_path)
    (folder / "adapter.py").write_text(ADAPTER)
    lines, last = ["timestamp,open,high,low,close,volume"], 15000.0
    for k in range(1200):
        c = 15000 + 0.5 * math.sin(k / 13) + (25 if k >= 960 else 0)
        t = dt.datetime(2024, 1, 2) + dt.timedelta(minutes=k)
        lines.append(f"{t:%Y-%m-%dT%H:%M:%SZ},{last},{max(last, c) + 5},{min(last, c) - 5},{c},1")
        last = c
    data = tmp_path / "bars.csv"
    data.write_text("\n".join(lines))
    from barloom.orchestrator import Options, audit_dataset, interval_of, load_profile, verify

    manifest, found = audit_dataset(spark, str(data))
    assert manifest["row_count"] == 1200 and manifest["timezone_interpretation"] == "texts with a zone" and manifest["chronological"] and found.where("status = 'FAIL'").count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        audit_dataset(spark, str(data), timestamp_col="ts")
    profile = folder / "profile.toml"
    assert load_profile(profile).mandatory == ["causality", "data_audit", "ledger", "static_scan"] and load_profile(profile).semantics["long_only"] is True
    assert [interval_of(x) for x in ("1min", "15 minutes", "1s", "h")] == ["1 minute", "15 minute", "1 second", "1 hour"]
    adapter = str(folder / "adapter.py")
    empty = verify(spark, Options(adapter, str(profile)))
    assert empty.verdict == "INCOMPLETE / UNVERIFIED" and empty.exit_code == 2 and {"canonical_data", "repository_health", "deterministic_tests"} <= {r["check"] for r in empty.rows}
    profile.write_text(profile.read_text().replace("static_scan = true", "high_resolution = true"))
    full = verify(spark, Options(adapter, str(profile), data=str(data), mode="fast", report_prefix=str(tmp_path / "r")))
    status = {r["check"]: r["status"] for r in full.rows}
    assert status["truncation_trades"] == status["future_mutation_features"] == status["ledger_schema"] == "PASS" and status["reference_reconciliation"] == status["high_resolution_execution"] == "UNVERIFIED"
    assert full.verdict == "INCOMPLETE / UNVERIFIED" and full.coverage["causality"]["cutoff_count"] == 6
    body = json.loads((tmp_path / "r.json").read_text())
    assert body["schema_version"] == 1 and body["mandatory_checks"] == ["causality", "data_audit", "high_resolution", "ledger"] and body["candidate"] == str((folder / "adapter.py").resolve())
    text = (tmp_path / "r.md").read_text()
    assert "- Verdict: **INCOMPLETE / UNVERIFIED**" in text and "## Coverage" in text and "## Artifacts" in text and "| PASS | ledger | ledger_schema |" in text
    bad = tmp_path / "bad.csv"
    bad.write_text("\n".join([*lines[:3], lines[2]]))
    report = verify(spark, Options(adapter, str(profile), data=str(bad)))
    assert report.verdict == "FAILED" and report.exit_code == 1 and "candidate_execution" not in {r["check"] for r in report.rows}
    (folder / "adapter.py").write_text("from pyspark.sql import functions as F\n\n\ndef run(bars):\n    return bars.select(F.raise_error(F.lit('late')).alias('entry_time'))\n")
    late = {r["check"]: r for r in verify(spark, Options(adapter, str(profile), data=str(data))).rows}
    assert late["candidate_execution"]["status"] == "FAIL" and "late" in late["candidate_execution"]["message"]
    # Spreads fail the audit unless the command is told that they may be negative.
    low = tmp_path / "low.csv"
    low.write_text("timestamp,open,high,low,close,volume\n2024-01-02T14:00:00Z,-1,-1,-2,-1,1")
    assert main(["audit-data", str(low)]) == 1 and main(["audit-data", str(low), "--allow-nonpositive-prices", "--out", str(tmp_path / "m.json")]) == 2
    assert json.loads((tmp_path / "m.json").read_text())["negative_price_rows"] == 1
    assert main(["verify", "--strategy", str(folder), "--dry-run"]) == 0


def test_cli_without_spark(tmp_path, capsys):
    f = tmp_path / "x"
    f.write_bytes(b"a")
    assert main(["hash", str(f)]) == 0 and "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb 1" in capsys.readouterr().out
    with pytest.raises(ValueError):
        new_strategy("Bad-Name", tmp_path)


def test_streams(spark, tmp_path):
    from barloom.streaming.bars import accept_stream, stream_bars

    t = dt.datetime(2024, 1, 2, 14, 0, tzinfo=dt.timezone.utc)
    ev = [(k, t + dt.timedelta(seconds=20 * k), float(k)) for k in range(10)] + [(0, t, 0.0), (99, t + dt.timedelta(hours=2), 0.0)]
    spark.createDataFrame(ev, "event_id bigint, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("event_id bigint, ts timestamp, value double").parquet(str(tmp_path / "e"))
    q = stream_bars(src).writeStream.format("memory").queryName("stream_bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("stream_bars_out").orderBy("bar_ts").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got] == [(100.0, 102.0, 3), (103.0, 105.0, 3), (106.0, 108.0, 3), (109.0, 109.0, 1)]
    m = lambda a: t + dt.timedelta(minutes=a)
    trades = [("s", m(0), m(5)), ("s", m(5), m(6)), ("s", m(6), m(8)), ("u", m(1), m(2))]
    schema = "series_id string, entry_time timestamp, exit_time timestamp"
    spark.createDataFrame(trades, schema).coalesce(1).write.parquet(str(tmp_path / "t"))
    q = accept_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("accepted_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("accepted_out").count() == 3


def test_entry_and_query_names(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and {f"p{n}_found" for n in range(1, 6)} <= set(queries)
    assert "signal_time" in entry.entry(spark).columns


SMALL = ["bars_ohlcv", "data_audit_counters", "ema60", "p2_found", "p3_found", "p4_found", "p5_found"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, data)
    got = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(clean(x) for x in r) for r in got.fetchall()), key=order)
    have = sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=order)
    assert sorted(df.columns) == sorted(names) and have == want
    assert F is not None
