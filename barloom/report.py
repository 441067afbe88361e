"""Reports: manifest and verification report as JSON and Markdown, console summary, exit codes."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from barloom.operators.audits import FAILED, FINDING, INCOMPLETE, VERIFIED, complete, verdict

# Exit codes of the verdicts.
EXIT_CODES = {VERIFIED: 0, FAILED: 1, INCOMPLETE: 2}


def _write(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def as_json(body: dict) -> str:
    return json.dumps(body, indent=2, default=str) + "\n"


def write_manifest(manifest: dict, path: str | Path) -> None:
    _write(path, as_json(manifest))


@dataclass
class Report:
    """Findings are few (a row a check); they are collected once."""

    findings: DataFrame
    mandatory: list[str] = field(default_factory=list)
    artifacts: dict = field(default_factory=dict)
    coverage: dict = field(default_factory=dict)
    strategy: str = ""
    candidate: str = ""
    generated_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def __post_init__(self) -> None:
        names = [c.split()[0] for c in FINDING.split(", ")]
        self.rows = [r.asDict(recursive=True) for r in complete(self.findings).collect()]
        held = self.findings.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in self.rows], FINDING)
        self.verdict = verdict(held, self.mandatory).first()[0]

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.verdict]

    def to_dict(self) -> dict:
        # Keys of the report's format.
        head = {"schema_version": 1, "generated_at": self.generated_at, "strategy": self.strategy, "candidate": self.candidate, "verdict": self.verdict, "exit_code": self.exit_code}
        return head | {"mandatory_checks": sorted(self.mandatory), "coverage": self.coverage, "artifacts": self.artifacts, "findings": self.rows}

    def write_json(self, path: str | Path) -> None:
        _write(path, as_json(self.to_dict()))

    def write_markdown(self, path: str | Path) -> None:
        cell = lambda v: str(v or "").replace("|", "\\|").replace("\r", " ").replace("\n", " ")
        facts = {"Verdict": f"**{self.verdict}**", "Candidate": f"`{self.candidate}`", "Generated": f"`{self.generated_at}`", "Mandatory checks": ", ".join(sorted(self.mandatory)) or "none configured"}
        columns = {"Status": "status", "Family": "family", "Check": "check", "Classification": "classification", "Result": "message"}
        parts = [f"# Verification Report — {self.strategy}", "\n".join(f"- {k}: {v}" for k, v in facts.items()), "## Findings"]
        rows = [list(columns), ["---"] * len(columns), *([cell(r[c] or (r["check"] if c == "family" else "")) for c in columns.values()] for r in self.rows)]
        parts.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
        for title, body in (("Coverage", self.coverage), ("Artifacts", self.artifacts)):
            if body:
                parts += [f"## {title}", f"```json\n{as_json(body)}```"]
        _write(path, "\n\n".join(parts) + "\n")

    def print(self) -> int:
        for r in self.rows:
            print(f"{r['status']:<10} {r['check']}" + (f" [{r['classification']}]" if r["classification"] else "") + f": {r['message']}")
            if r["rows"]:
                print(f"           rows: {r['rows']}")
        print("Summary:", *(f"{k}={v}" for k, v in sorted(Counter(r["status"] for r in self.rows).items())))
        print("VERDICT:", self.verdict)
        return self.exit_code
