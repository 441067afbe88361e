"""Running all audits for a strategy: profile, adapter, data, ledger, causality, reference, contracts, high resolution, verdict."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import audits as A
from barloom.operators.bars import audit_counters, gap_samples
from barloom.operators.causality import STAGES, audit_with_coverage
from barloom.operators.static_scan import scan_paths
from barloom.report import Report
from barloom.session import cut_lineage
from barloom.sources.bars import ROW, hash_source, load_bars, load_trade_windows, read_any, sha256_file, timestamp_kind, to_utc, with_rows

RESERVED = ("semantics", "checks", "causality", "name", "version")


@dataclass(frozen=True)
class Profile:
    name: str = ""
    version: str = "UNVERSIONED"
    semantics: dict = field(default_factory=dict)
    checks: dict = field(default_factory=dict)
    causality: dict = field(default_factory=dict)

    @property
    def mandatory(self) -> list[str]:
        """Checks set to true: without their evidence there is no verdict VERIFIED."""
        return sorted(k for k, v in self.checks.items() if v is True)


def load_profile(path: str | Path) -> Profile:
    """TOML; top-level keys that aren't reserved are semantics, and the table of that name wins over them."""
    raw = tomllib.loads(Path(path).read_text())
    loose = {k: v for k, v in raw.items() if k not in RESERVED}
    return Profile(str(raw.get("name", Path(path).resolve().parent.name)), str(raw.get("version", "UNVERSIONED")), loose | raw.get("semantics", {}), {k: bool(v) for k, v in raw.get("checks", {}).items()}, raw.get("causality", {}))


def load_adapter(path: str | Path) -> ModuleType:
    """A Python file with ``run(bars) -> ledger``; its code runs in this process."""
    spec = importlib.util.spec_from_file_location(f"adapter_{Path(path).stem}", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"no adapter at {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "run", None)):
        raise ValueError("an adapter needs a callable run")
    return module


def stages_of(adapter: ModuleType, bars: DataFrame) -> dict[str, DataFrame]:
    """Frames of all stages that the adapter offers, from one run where it has ``audit_stages``."""
    if callable(getattr(adapter, "audit_stages", None)):
        stages = adapter.audit_stages(bars)
        if not isinstance(stages, dict):
            raise TypeError("audit_stages must give a dict of DataFrames")
        stages = dict(stages)
    else:
        stages = {s: getattr(adapter, s)(bars) for s in STAGES if s != "trades" and callable(getattr(adapter, s, None))}
    if "trades" not in stages:
        stages["trades"] = adapter.run(bars)
    return {s: stages[s] for s in STAGES if s in stages}


@dataclass(frozen=True)
class Options:
    adapter: str
    profile: str | None = None
    source: str | None = None  # what is hashed and scanned; the adapter's file by default
    data: str | None = None
    timestamp_col: str = "timestamp"
    contract_col: str | None = None
    symbol_col: str | None = None
    selection_map: str | None = None
    expected_contract_col: str = "expected_contract_id"
    high_resolution: str | None = None
    high_timestamp_col: str = "ts_event"
    high_contract_col: str | None = "instrument_id"
    high_symbol_col: str | None = "symbol"
    mode: str | None = None  # wins over the profile's
    tests: str | None = None  # folder whose tests are run
    allow_nonpositive: bool = False
    max_rows: int | None = None
    report_prefix: str | None = None


_UNITS = {"s": "second", "sec": "second", "second": "second", "min": "minute", "t": "minute", "minute": "minute", "h": "hour", "hour": "hour", "d": "day", "day": "day"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def interval_of(text: str) -> str:
    """``1min``, ``15 minutes``, ``1s`` and the like as ``15 minute``."""
    at = next(i for i, c in enumerate(text + "x") if not (c.isdigit() or c.isspace()))
    number, unit = text[:at].strip() or "1", text[at:].strip().lower()
    if unit not in _UNITS and unit.endswith("s"):
        unit = unit[:-1]
    if unit not in _UNITS:
        raise ValueError(f"no interval: {text}")
    return f"{int(number)} {_UNITS[unit]}"


def interval_us(text: str) -> int:
    number, unit = interval_of(text).split()
    return int(number) * _SECONDS[unit] * 1_000_000


# Texts on the provenance of contracts.
_PROVENANCE = {
    2: "RAW CONTRACT IDENTIFIERS/SYMBOLS PRESENT; CONTINUOUS ROLL SELECTION UNVERIFIED WITHOUT A FROZEN SELECTION POLICY/MAP",
    1: "CONTRACT IDENTIFIERS PRESENT; ROLL POLICY CORRECTNESS UNVERIFIED",
    0: "ROLL PROVENANCE UNVERIFIED",
}


def audit_dataset(spark: SparkSession, path: str, *, timestamp_col: str = "timestamp", interval: str | None = "1 minute", contract_col: str | None = None, symbol_col: str | None = None, allow_nonpositive: bool = False, sha256: str | None = None) -> tuple[dict, DataFrame]:
    """(manifest, findings) of one dataset, in its stored order. Missing columns raise."""
    df = with_rows(spark, path)
    missing = sorted({timestamp_col, "open", "high", "low", "close"} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    contract, symbol = (c if c in df.columns else None for c in (contract_col, symbol_col))
    schema = {f.name: f.dataType.simpleString() for f in df.schema if f.name != ROW}
    kind = timestamp_kind(df, timestamp_col)
    naive = kind == "not explicit"
    try:
        df = df.withColumn("bar_ts", F.col(timestamp_col)) if naive else to_utc(df, timestamp_col)
    except ValueError:
        naive, df = True, df.withColumn("bar_ts", F.try_to_timestamp(F.col(timestamp_col)).cast("timestamp_ntz"))
    step = interval_us(interval or "1 minute")
    row = audit_counters(df, step, ts="bar_ts", contract=contract, symbol=symbol, row=ROW, allow_nonpositive=allow_nonpositive, order=True).first().asDict()
    samples = [r.asDict() for r in gap_samples(df, step, ts="bar_ts", keys=[contract] if contract else []).collect()] if interval else []
    one_file = Path(path).is_file()
    if sha256 is None and one_file:
        sha256, _ = sha256_file(path)
    provenance = _PROVENANCE[bool(contract) + bool(contract and symbol)]
    conflicts = row.pop("symbol_conflicts", 0)
    notes = []
    if allow_nonpositive and row["nonpositive_rows"]:
        notes.append("prices of zero or less were counted, not taken for malformed; spreads can be negative")
    if conflicts:
        notes.append(f"{conflicts} symbols beyond the first of their contract")
    zone = ("not explicit" if naive else "UTC explicit") if kind != "not a timestamp" else ("texts without a zone" if naive else "texts with a zone")
    stamp = lambda t: f"{t.isoformat()}+00:00" if t else None
    # Keys of the manifest.
    manifest = {
        "path": path, "filename": Path(path).name, "bytes": Path(path).stat().st_size if one_file else None, "sha256": sha256, "format": Path(path).suffix.lstrip(".").lower(), "row_count": row["rows"],
        "first_timestamp": stamp(row["first_timestamp"]), "final_timestamp": stamp(row["final_timestamp"]), "timestamp_column": timestamp_col, "timezone_interpretation": zone, "schema": schema,
        "chronological": row["out_of_order"] == 0, "duplicate_count": row["duplicate_rows"], "malformed_row_count": row["malformed_rows"], "nonfinite_cell_count": row["nonfinite_cells"],
        "missing_interval_count": row["missing_intervals"] if interval else None, "missing_interval_samples": samples, "contract_provenance_status": provenance, "contract_columns": [c for c in (contract, symbol) if c],
        "negative_price_rows": row["nonpositive_rows"], "zero_volume_rows": row["zero_volume_rows"], "notes": notes,
    }
    verdicts = {
        "data_identity": (True, f"sha256 {sha256}; {manifest['bytes']} bytes; {row['rows']} rows"), "data_timezone": (not naive, zone),
        "data_ordering": (manifest["chronological"], f"{row['out_of_order']} rows before the row stored ahead of them"), "data_duplicates": (not row["duplicate_rows"], f"{row['duplicate_rows']} repeated times of a contract"),
        "data_geometry": (not row["malformed_rows"], f"{row['malformed_rows']} malformed rows; {row['nonfinite_cells']} cells that aren't finite"),
    }
    found = [(check, "PASS" if good else "FAIL", text, None, "data_audit") for check, (good, text) in verdicts.items()]
    found.append(("contract_provenance", "UNVERIFIED", provenance, None, "contract_provenance"))
    if interval:
        found.append(("missing_intervals", "INFO", f"{row['missing_intervals']} missing; never filled", None, "data_audit", str(samples)))
    return manifest, A.findings(spark, found)


# Families without evidence where no data are given, with their checks.
_WITHOUT_DATA = {"data_audit": "canonical_data", "ledger": "ledger", "causality": "causality", "feature_causality": "feature_causality", "reference_reconciliation": "reference_reconciliation", "contract_provenance": "contract_provenance"}


class _Run:
    """One verification: findings are collected audit by audit, so an exception in a lazy frame belongs to the audit that caused it."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.o = spark, options
        self.profile = load_profile(options.profile) if options.profile else Profile(Path(options.adapter).resolve().parent.name)
        self.rows: list[tuple] = []
        self.artifacts: dict = {}
        self.coverage: dict = {}
        self.bars: DataFrame | None = None
        self.trades: DataFrame | None = None

    def add(self, *row) -> None:
        self.rows.append((*row, *[None] * (7 - len(row))))

    def take(self, found: DataFrame) -> list[tuple]:
        new = [tuple(r) for r in A.complete(found).collect()]
        self.rows += new
        return new

    def sources(self) -> None:
        o = self.o
        for family in ("repository_health", "deterministic_tests"):
            if o.tests is None:
                self.add(family, "UNVERIFIED", "tests weren't run", None, family)
        if o.tests is not None:
            done = subprocess.run([sys.executable, "-m", "pytest", "-q"], cwd=o.tests, capture_output=True, text=True)
            text = (done.stdout + done.stderr).strip()
            self.artifacts["repository_tests"] = {"pytest_exit_code": done.returncode, "pytest_output": text}
            for family in ("repository_health", "deterministic_tests"):
                self.add(family, "FAIL" if done.returncode else "PASS", text.splitlines()[-1] if text else f"exit code {done.returncode}", None, family)
        source = o.source or o.adapter
        self.artifacts["candidate_source"] = {"path": str(Path(source).resolve()), "sha256": hash_source(source)}
        for row in scan_paths(source):
            self.add(*row)

    def data(self) -> None:
        o = self.o
        if o.data is None:
            for family, check in _WITHOUT_DATA.items():
                self.add(check, "UNVERIFIED", "no data given", None, family)
            return
        manifest, found = audit_dataset(self.spark, o.data, timestamp_col=o.timestamp_col, interval=self.interval, contract_col=o.contract_col, symbol_col=o.symbol_col, allow_nonpositive=o.allow_nonpositive)
        self.artifacts["canonical_data_manifest"] = manifest
        if not any(r[1] == "FAIL" and r[4] == "data_audit" for r in self.take(found)):
            try:
                self.candidate()
            except Exception as e:  # the candidate's own code may raise anything
                self.add("candidate_execution", "FAIL", f"{type(e).__name__}: {str(e)[:300]}", None, "ledger")
        if o.selection_map and o.contract_col:
            selected, expected = (x.withColumn(o.timestamp_col, F.col(o.timestamp_col).cast("string")) for x in (read_any(self.spark, o.data), read_any(self.spark, o.selection_map)))
            self.take(A.audit_selection_map(to_utc(selected, o.timestamp_col), to_utc(expected, o.timestamp_col), ts="bar_ts", contract=o.contract_col, expected_contract=o.expected_contract_col))

    @property
    def interval(self) -> str:
        return interval_of(str(self.profile.semantics.get("bar_interval", "1min")))

    def candidate(self) -> None:
        o, s = self.o, self.profile.semantics
        adapter = load_adapter(o.adapter)
        self.bars = cut_lineage(load_bars(self.spark, o.data, o.timestamp_col, max_rows=o.max_rows, validate=not o.allow_nonpositive).withColumn("series_id", F.lit("all")))
        trades = adapter.run(self.bars)
        if not isinstance(trades, DataFrame):
            self.add("adapter", "FAIL", "run gave no DataFrame", None, "ledger")
            return
        self.trades = trades = cut_lineage(trades)
        if "entry_time" in trades.columns:
            trades = A.numbered(trades, ["entry_time"]).withColumn("row", F.col("_rn") - 1)
        self.take(A.audit_ledger(trades, strict_reentry=bool(s.get("strict_same_timestamp_reentry", True)), tick=s.get("tick_size"), long_only=s.get("long_only"), required_deadline=s.get("required_deadline") is not None))
        mode, seed = o.mode or self.profile.causality.get("mode", "strong"), int(self.profile.causality.get("seed", 1729))
        found, self.coverage["causality"] = audit_with_coverage(lambda b: stages_of(adapter, b), self.bars, mode=mode, seed=seed)
        self.take(found)
        if callable(getattr(adapter, "reference", None)):
            self.take(A.reconcile_ledgers(self.trades, adapter.reference(self.bars)))
        else:
            self.add("reference_reconciliation", "UNVERIFIED", "no reference engine", None, "reference_reconciliation")

    def fine(self) -> None:
        o, family = self.o, "high_resolution"
        if o.high_resolution is None:
            if self.profile.checks.get(family):
                self.add("high_resolution_execution", "UNVERIFIED", "no high-resolution data given", None, family)
            return
        manifest, found = audit_dataset(self.spark, o.high_resolution, timestamp_col=o.high_timestamp_col, interval="1s", contract_col=o.high_contract_col, symbol_col=o.high_symbol_col, allow_nonpositive=True)
        self.artifacts["high_resolution_data_manifest"] = manifest
        for r in A.complete(found).where(F.col("family") == "data_audit").collect():
            self.add("high_resolution_data_audit", r["status"], f"{r['check']}: {r['message']}", r["rows"], family, r["evidence"], r["classification"])
        why = (
            "no trades of the candidate" if self.trades is None
            else "seconds of raw contracts can't be matched to trades without contract identity" if not o.contract_col or o.contract_col not in self.trades.columns
            else "no contract column of the seconds given" if not o.high_contract_col else None
        )
        if why:
            self.add("high_resolution_execution", "UNVERIFIED", why, None, family)
            return
        try:
            keys = [o.contract_col]
            fine = load_trade_windows(self.spark, o.high_resolution, self.trades, timestamp_col=o.high_timestamp_col, fine_contract=o.high_contract_col, trade_contract=o.contract_col, interval=self.interval)
            fine = cut_lineage(to_utc(fine.drop(*[k for k in keys if k != o.high_contract_col]).withColumnRenamed(o.high_contract_col, o.contract_col), o.high_timestamp_col))
            trades = A.numbered(self.trades, ["entry_time"])
            new = self.take(A.audit_high_resolution(trades, self.bars, fine, trade="_rn", keys=keys, interval=self.interval))
            self.take(A.audit_aggregation(fine, self.bars, keys=keys, interval=self.interval))
            self.coverage[family] = {"loaded_rows": fine.count(), "classifications": [r[5] for r in new]}
        except Exception as e:
            self.add("high_resolution_execution", "UNVERIFIED", f"not available: {type(e).__name__}: {str(e)[:300]}", None, family)

    def report(self) -> Report:
        for part in (self.sources, self.data, self.fine):
            part()
        return Report(A.findings(self.spark, self.rows), self.profile.mandatory, self.artifacts, self.coverage, f"{self.profile.name} v{self.profile.version}", str(Path(self.o.adapter).resolve()))


def verify(spark: SparkSession, o: Options) -> Report:
    """All findings and the verdict. Data that fail their audit are not run; an exception of the candidate is a finding."""
    report = _Run(spark, o).report()
    if o.report_prefix:
        report.write_json(f"{o.report_prefix}.json")
        report.write_markdown(f"{o.report_prefix}.md")
    return report
