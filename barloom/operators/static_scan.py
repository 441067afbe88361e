"""Static scan of strategy sources for idioms that may look ahead, in pandas and in Spark.

``scan_text`` applies tables of rules to the nodes of a syntax tree, and a few
patterns to the text for what the tree doesn't show; ``scan_table`` runs it as a
Python table function over a DataFrame of sources; ``scan_paths`` over files.
Classes: a proven failure becomes FAIL, a high risk WARN, INFO stays INFO.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of findings and the status of each.
PROVEN, HIGH, INFO = "PROVEN FAILURE", "HIGH-RISK / MANUAL REVIEW", "INFO"
STATUS = {PROVEN: "FAIL", HIGH: "WARN", INFO: "INFO"}
# Rules and their classes.
RULES = {
    "negative_shift": HIGH, "negative_roll": HIGH, "centered_rolling": HIGH, "backfill": HIGH, "fillna_bfill": HIGH, "forward_asof": HIGH, "silent_sort": HIGH,
    "drop_duplicates": HIGH, "interpolate": HIGH, "full_sample_fit": HIGH, "full_sample_statistic": INFO, "reverse_iteration": INFO, "future_iloc": HIGH,
    "future_slice": HIGH, "reverse_slice": INFO, "future_label": INFO, "future_timestamp_join": INFO, "spark_lead": HIGH, "spark_future_frame": HIGH,
}
# Calls that are reported wherever they stand.
CALLS = {
    "backfill": ("bfill", "backfill"), "silent_sort": ("sort_index", "sort_values", "orderBy"), "drop_duplicates": ("drop_duplicates", "dropDuplicates"),
    "interpolate": ("interpolate",), "full_sample_fit": ("fit", "fit_transform"), "reverse_iteration": ("reversed", "reverse"), "spark_lead": ("lead",),
}
STATISTICS = ("mean", "std", "quantile", "median")
WINDOWED = ("rolling", "expanding", "groupby", "window")
LABELS = ("future_return", "forward_return", "future_label", "target_return")
#: Patterns of the text, for sources with parts the tree doesn't show.
TEXT = {"negative_shift": r"\.shift\s*\(\s*-\d", "backfill": r"\.(bfill|backfill)\s*\(", "interpolate": r"\.interpolate\s*\("}


def _value(node: ast.AST | None):
    """A literal's value; null for anything else."""
    try:
        return ast.literal_eval(node) if node is not None else None
    except (ValueError, TypeError, SyntaxError):
        return None


def _below_zero(node: ast.AST | None) -> bool:
    v = _value(node)
    return isinstance(v, (int, float)) and v < 0


def _steps(node: ast.AST | None) -> tuple[float, ast.AST | None]:
    """Of a sum with a literal: the literal and the other term."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        for own, other in ((node.right, node.left), (node.left, node.right)):
            if isinstance(v := _value(own), (int, float)):
                return v, other
    return 0, None


def _call(node: ast.Call) -> Iterator[str]:
    text = ast.unparse(node.func)
    owner, _, name = text.rpartition(".")
    given = {k.arg: k.value for k in node.keywords}
    at = lambda i, word: node.args[i] if len(node.args) > i else given.get(word)
    yield from (rule for rule, names in CALLS.items() if name in names)
    if name in STATISTICS and not any(w in owner.lower() for w in WINDOWED):
        yield "full_sample_statistic"
    ahead = {
        "negative_shift": (name == "shift" and _below_zero(at(0, "periods"))) or (name == "lag" and _below_zero(at(1, "offset"))),
        "negative_roll": name == "roll" and _below_zero(at(1, "shift")),
        "centered_rolling": name == "rolling" and _value(given.get("center")) is True,
        "fillna_bfill": name == "fillna" and any(w in ast.unparse(node).lower() for w in ("bfill", "backfill")),
        "forward_asof": name == "merge_asof" and _value(given.get("direction")) == "forward",
        "spark_future_frame": name in ("rowsBetween", "rangeBetween") and len(node.args) == 2 and ((_value(node.args[1]) or 0) > 0 or ast.unparse(node.args[1]).endswith("unboundedFollowing")),
    }
    yield from (rule for rule, there in ahead.items() if there)


def _subscript(node: ast.Subscript) -> Iterator[str]:
    part = node.slice
    if not isinstance(part, ast.Slice):
        if ast.unparse(node.value).endswith(("iloc", "iat")) and _steps(part)[0] > 0:
            yield "future_iloc"
        return
    # An upper bound one ahead still ends with the present row.
    step, base = _steps(part.lower)
    if (step > 0 and isinstance(base, ast.Name)) or _steps(part.upper)[0] > 1:
        yield "future_slice"
    if _below_zero(part.step):
        yield "reverse_slice"


def _assign(node: ast.Assign) -> Iterator[str]:
    if any(w in ast.unparse(t).lower() for t in node.targets for w in LABELS):
        yield "future_label"


def _compare(node: ast.Compare) -> Iterator[str]:
    sides = [ast.unparse(x).lower() for x in (node.left, *node.comparators)]
    later = any(isinstance(op, (ast.Gt, ast.GtE)) for op in node.ops)
    if later and any("timestamp" in s for s in sides):
        yield "future_timestamp_join"


NODES = {ast.Call: _call, ast.Subscript: _subscript, ast.Assign: _assign, ast.Compare: _compare}


def scan_text(source: str) -> list[tuple[str, str, int]]:
    """(check, class, line), ordered by line; a syntax error is one proven failure."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [("static_syntax", PROVEN, getattr(e, "lineno", 0) or 0)]
    found = {(rule, node.lineno) for node in ast.walk(tree) if type(node) in NODES for rule in NODES[type(node)](node)}
    for rule, pattern in TEXT.items():
        found |= {(rule, source.count("\n", 0, m.start()) + 1) for m in re.finditer(pattern, source, re.IGNORECASE)}
    return sorted(((f"static_{rule}", RULES[rule], line) for rule, line in found), key=lambda x: (x[2], x[0]))


def scan_paths(path: str | Path) -> list[tuple]:
    """Finding rows of one file or of all Python files below a folder."""
    root = Path(path)
    row = lambda check, kind, message, lines=None, status=None: (check, status or STATUS[kind], message, lines, "static_scan", None, kind)
    if not root.exists():
        return [row("static_source", PROVEN, f"no such path: {root}")]
    out = []
    for file in [root] if root.is_file() else sorted(root.rglob("*.py")):
        try:
            text = file.read_text(encoding="utf-8", errors="replace")
        except OSError as e:
            out.append(row("static_source", HIGH, f"{file}: {e}"))
            continue
        out += [row(check, kind, f"{file}: line {line}", [line]) for check, kind, line in scan_text(text)]
    return out or [row("static_scan", INFO, "nothing found; a clean scan proves nothing", status="PASS")]


def scan_table(sources: DataFrame, name: str = "path", text: str = "source") -> DataFrame:
    """One row a finding for a table of sources: ``path``, ``rule``, ``status``, ``line``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="rule string, status string, line int")
    class Scan:
        def eval(self, source: str):
            yield from ((check, STATUS[kind], line) for check, kind, line in scan_text(source or ""))

    spark = sources.sparkSession
    spark.udtf.register("barloom_static_scan", Scan)
    view = "barloom_sources"
    sources.select(F.col(name).alias("path"), F.col(text).alias("source")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT s.path, f.rule, f.status, f.line FROM {view} s, LATERAL barloom_static_scan(s.source) f")
