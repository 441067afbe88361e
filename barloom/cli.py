"""Command line: ``python -m barloom.cli COMMAND``. Exit codes: 0 verified, 1 failed, 2 incomplete."""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.operators import audits as A
from barloom.operators.causality import audit_with_coverage
from barloom.operators.static_scan import scan_paths
from barloom.operators.trading import run_backtest, summarize
from barloom.operators.second_engine import reconcile_engines
from barloom.orchestrator import Options, audit_dataset, load_adapter, stages_of, verify
from barloom.report import Report, write_manifest
from barloom.session import cut_lineage
from barloom.sources.bars import load_bars, read_any, sha256_file, write_ledger

STUB = '''"""Adapter of a strategy."""


def run(bars):
    """Bars (series_id, bar_ts, open, high, low, close, volume) to a ledger DataFrame."""
    raise NotImplementedError
'''
PROFILE = '''name = "{name}"
version = "0.1"

[semantics]
long_only = true
bar_interval = "1min"

[checks]
data_audit = true
static_scan = true
ledger = true
causality = true

[causality]
mode = "strong"
seed = 1729
'''
#: Options of each command: name, and what argparse is told of it.
_TIMES = {"--timestamp-col": {"default": "timestamp"}, "--contract-col": {}, "--allow-nonpositive-prices": {"action": "store_true"}}
_MODE = {"choices": ("fast", "standard", "strong")}
COMMANDS = {
    "verify": ("all audits of a strategy", {
        "--strategy": {"help": "folder with adapter.py and profile.toml"}, "--candidate": {"help": "adapter; default: adapter.py of the folder"}, "--source": {}, "--data": {}, **_TIMES, "--symbol-col": {},
        "--selection-map": {}, "--expected-contract-col": {"default": "expected_contract_id"}, "--high-res-data": {}, "--high-res-timestamp-col": {"default": "ts_event"}, "--high-res-contract-col": {"default": "instrument_id"},
        "--high-res-symbol-col": {"default": "symbol"}, "--audit-mode": _MODE, "--tests": {"help": "folder whose tests are run"}, "--report-prefix": {}, "--dry-run": {"action": "store_true", "help": "show the options only"},
    }),
    "run-all": ("verify every strategy below a folder", {"--root": {"default": "strategies"}, "--data": {}, **_TIMES, "--audit-mode": _MODE}),
    "audit-candidate": ("data, ledger and causality of one adapter", {"--adapter": {"required": True}, "--source": {}, "--data": {"required": True}, **_TIMES, "--tick-size": {"type": float}, "--allow-same-timestamp-reentry": {"action": "store_true"}, "--audit-mode": {**_MODE, "default": "strong"}}),
    "audit-data": ("manifest and findings of a dataset", {"data": {}, **_TIMES, "--symbol-col": {}, "--interval": {"default": "1 minute"}, "--out": {}}),
    "audit-roll": ("a contract selection against the expected one", {"selected": {}, "expected": {}, "--timestamp-col": {"default": "timestamp"}, "--contract-col": {"default": "contract_id"}, "--expected-contract-col": {"default": "expected_contract_id"}}),
    "backtest": ("ledger and summary of bars", {"data": {}, "--timestamp-col": {"default": "timestamp"}, "--ledger": {"required": True}, "--summary": {}}),
    "reconcile": ("both engines over the same bars", {"data": {}, "--timestamp-col": {"default": "timestamp"}}),
    "hash": ("sha256 and size of files", {"files": {"nargs": "+"}}),
    "new-strategy": ("a folder with an adapter and a profile", {"name": {}, "--root": {"default": "strategies"}}),
}


def new_strategy(name: str, root: str | Path = "strategies") -> Path:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError("a strategy's name is lower case, starts with a letter and holds letters, digits and underscores")
    folder = Path(root) / name
    folder.mkdir(parents=True, exist_ok=False)
    (folder / "adapter.py").write_text(STUB)
    (folder / "profile.toml").write_text(PROFILE.format(name=name))
    return folder


def _options(a: argparse.Namespace, folder: Path | None, adapter: str | None) -> Options:
    get = lambda name, other=None: getattr(a, name, other)
    profile = folder / "profile.toml" if folder else None
    return Options(
        str(adapter or folder / "adapter.py"), str(profile) if profile and profile.exists() else None, get("source"), a.data, a.timestamp_col, a.contract_col, get("symbol_col"), get("selection_map"),
        get("expected_contract_col", "expected_contract_id"), get("high_res_data"), get("high_res_timestamp_col", "ts_event"), get("high_res_contract_col"), get("high_res_symbol_col"), a.audit_mode, get("tests"),
        a.allow_nonpositive_prices, report_prefix=get("report_prefix"),
    )


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (text, arguments) in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        for word, told in arguments.items():
            p.add_argument(word, **told)
    a = parser.parse_args(argv)

    if a.command == "hash":
        for f in a.files:
            print(*sha256_file(f), f)
        return 0
    if a.command == "new-strategy":
        print(new_strategy(a.name, a.root))
        return 0
    if a.command == "verify":
        if not a.strategy and not a.candidate:
            parser.error("verify needs --strategy or --candidate")
        options = _options(a, Path(a.strategy) if a.strategy else None, a.candidate)
        if a.dry_run:
            print(json.dumps(asdict(options), indent=2))
            return 0

    spark = SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "verify":
        return verify(spark, options).print()
    if a.command == "run-all":
        folders = sorted(p.parent for p in Path(a.root).glob("*/adapter.py"))
        return max([verify(spark, _options(a, f, None)).print() for f in folders], default=0)
    if a.command == "audit-candidate":
        return audit_candidate(spark, a)
    if a.command == "audit-data":
        manifest, found = audit_dataset(spark, a.data, timestamp_col=a.timestamp_col, interval=a.interval, contract_col=a.contract_col, symbol_col=a.symbol_col, allow_nonpositive=a.allow_nonpositive_prices)
        if a.out:
            write_manifest(manifest, a.out)
        return Report(found).print()
    if a.command == "audit-roll":
        names = {"ts": a.timestamp_col, "contract": a.contract_col, "expected_contract": a.expected_contract_col}
        return Report(A.audit_selection_map(read_any(spark, a.selected), read_any(spark, a.expected), **names)).print()
    bars = load_bars(spark, a.data, a.timestamp_col).withColumn("series_id", F.lit("all"))
    if a.command == "reconcile":
        print(json.dumps(reconcile_engines(bars).first().asDict(), default=str))
        return 0
    trades = run_backtest(bars)
    write_ledger(trades, a.ledger)
    summary = summarize(trades).first().asDict()
    if a.summary:
        Path(a.summary).write_text(json.dumps(summary, indent=2) + "\n")
    print(json.dumps(summary))
    return 0


def audit_candidate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Findings on data, ledger, causality and source of one adapter; data that fail aren't run."""
    _, found = audit_dataset(spark, a.data, timestamp_col=a.timestamp_col, contract_col=a.contract_col, allow_nonpositive=a.allow_nonpositive_prices)
    if found.where("status = 'FAIL'").head(1):
        return Report(found).print()
    adapter = load_adapter(a.adapter)
    bars = cut_lineage(load_bars(spark, a.data, a.timestamp_col, validate=not a.allow_nonpositive_prices).withColumn("series_id", F.lit("all")))
    trades = A.numbered(cut_lineage(adapter.run(bars)), ["entry_time"]).withColumn("row", F.col("_rn") - 1)
    causal, coverage = audit_with_coverage(lambda b: stages_of(adapter, b), bars, mode=a.audit_mode)
    print("CAUSALITY COVERAGE:", json.dumps(coverage, indent=2))
    scanned = A.findings(spark, scan_paths(a.source)) if a.source else A.findings(spark, []).limit(0)
    return Report(A.together(found, A.audit_ledger(trades, strict_reentry=not a.allow_same_timestamp_reentry, tick=a.tick_size), causal, scanned)).print()


if __name__ == "__main__":
    sys.exit(main())
