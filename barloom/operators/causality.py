"""Look-ahead detection: outputs before a cutoff must not change when the future is cut off or altered.

All scenarios run in one pass: bars are tagged by scenario (whole, cut at each
cutoff, altered from each cutoff), the scenario becomes part of the series key,
and the engine runs once over them. Scenarios beyond ``batch`` cutoffs go in
further passes, so the input is multiplied by a bounded factor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.audits import PROVEN, REASON_FORCED, compared, findings, together
from barloom.operators.indicators import SERIES
from barloom.session import cut_lineage

# Decision stages in order, each with its time column; names of time columns; cutoffs by mode.
STAGES = {"features": "bar_ts", "signals": "bar_ts", "eligible_signals": "signal_time", "proposed_entries": "entry_time", "accepted_entries": "entry_time", "trades": "entry_time"}
TIME_COLUMNS = ("decision_time", "timestamp", "bar_ts", "signal_time", "entry_time", "exit_time")
LIMITS = {"fast": 6, "standard": 16, "strong": 28}
#: Rows after which windows of the usual lengths are warm, and hours that count as transitions.
WARM = (2, 10, 25, 50, 60, 100, 160, 200, 240)
HOURS = (0, 4, 8, 12, 15, 16, 18, 20)


def mutate_future(bars: DataFrame, cutoff: str, *, keys: list[str] | None = None, ts: str = "bar_ts") -> DataFrame:
    """Bars from ``cutoff`` (a column or literal expression) on with altered prices; earlier rows unchanged.

    Opens rise from 1.7 to 2.3 times over the future rows, closes fall from 2.3
    to 1.7, high and low enclose both. Positions of future rows come from counts
    per day, so no series is windowed as a whole.
    """
    keys = keys or []
    at = F.expr(cutoff)
    later = bars.where(F.col(ts) >= at).withColumn("_d", F.date_trunc("day", F.col(ts)))
    days = later.groupBy(*keys, "_d").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    offsets = days.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(whole)}).drop("_n")
    i = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_d").orderBy(ts)) - 1
    ranked = later.join(offsets, [*keys, "_d"]).withColumn("_i", i)
    share = F.coalesce(F.col("_i") / F.nullif(F.col("_total") - 1, F.lit(0)), F.lit(0.0))
    o, c = F.col("open") * (1.7 + 0.6 * share), F.col("close") * (2.3 - 0.6 * share)
    single = F.col("_total") == 1
    c = F.when(single, F.col("close") * 1.7).otherwise(c)
    ranked = ranked.withColumns({"_o": o, "_c": c})
    moved = ranked.withColumns({"open": F.col("_o"), "close": F.col("_c"), "high": F.greatest("_o", "_c") * 1.03, "low": F.least("_o", "_c") * 0.97})
    return bars.where(F.col(ts) < at).unionByName(moved.select(*bars.columns))


def known_at(frame: DataFrame, stage: str) -> Column:
    """When a row is known. A trade that a deadline may force out is known at the later of exit and deadline."""
    if stage == "trades" and "exit_time" in frame.columns:
        if {"deadline", "exit_reason"} <= set(frame.columns):
            return F.when(F.coalesce(F.col("exit_reason").rlike(REASON_FORCED), F.lit(False)), F.greatest("exit_time", "deadline")).otherwise(F.col("exit_time"))
        return F.col("exit_time")
    return F.col(time_column(frame, stage))


def known_before(frame: DataFrame, stage: str, cutoff: str) -> DataFrame:
    """Rows known before ``cutoff``."""
    return frame.where(known_at(frame, stage) < F.expr(cutoff))


def time_column(frame: DataFrame, stage: str) -> str:
    preferred = STAGES.get(stage)
    for c in ((preferred,) if preferred else ()) + TIME_COLUMNS:
        if c in frame.columns:
            return c
    raise ValueError(f"stage {stage} has no time column")


def choose_positions(n: int, turns: list[int], marks: list[int], *, mode: str = "strong", seed: int = 1729) -> list[int]:
    """Positions of cutoffs among ``n`` ordered times: evenly spaced places, warm-up ends, seeded draws, the first transitions and the stage events, thinned to the mode's number."""
    if n < 2:
        return []
    places = {int(x) for x in np.linspace(1, n - 1, 11)} | {w for w in WARM if w < n}
    places |= {int(x) for x in np.random.default_rng(seed).choice(n - 1, size=min(10, n - 1), replace=False) + 1}
    places |= set(turns[:12])
    for k in marks:
        places |= {x for x in (k - 1, k) if 0 < x < n}
    ordered, most = sorted(places), LIMITS[mode]
    if len(ordered) > most:
        ordered = [ordered[int(k)] for k in np.unique(np.linspace(0, len(ordered) - 1, most).astype(int))]
    return ordered


def generate_cutoffs(bars: DataFrame, events: dict[str, list] | None = None, *, mode: str = "strong", seed: int = 1729, explicit: list | None = None) -> list:
    """Cutoff times. Only the number of times, twelve transitions, event positions and the chosen times come to the driver."""
    if explicit:
        return sorted(set(explicit))
    from barloom.operators.blocks import in_blocks, with_positions

    times = bars.select("bar_ts").where(F.col("bar_ts").isNotNull()).distinct().withColumn("_all", F.lit(1))
    placed = with_positions(times, ["_all"], "bar_ts")
    n = placed.count()
    turned = in_blocks(placed, 65_536, back=1).withColumn("_last", F.lag("bar_ts").over(Window.partitionBy("_block").orderBy("_pos"))).where("_core")
    # A change of day, or any row in one of the listed hours.
    turned = turned.where(F.col("_last").isNotNull() & ((F.to_date("_last") != F.to_date("bar_ts")) | F.hour("bar_ts").isin(*HOURS)))
    turns = [r[0] for r in turned.select("_pos").orderBy("_pos").limit(12).collect()]
    stamps = sorted({t for marks in (events or {}).values() for t in sorted(set(marks))[:8]})
    upto = [F.count_if(F.col("bar_ts") <= F.lit(t).cast("timestamp_ntz")).alias(f"m{k}") for k, t in enumerate(stamps)]
    marks = list(placed.agg(*upto).first()) if upto else []
    chosen = choose_positions(n, turns, marks, mode=mode, seed=seed)
    return [r[0] for r in placed.where(F.col("_pos").isin(chosen)).select("bar_ts").orderBy("bar_ts").collect()] if chosen else []


def scenario_bars(bars: DataFrame, cutoffs: list) -> DataFrame:
    """Bars of all scenarios, ``scenario`` as text: ``full``, ``cut_<i>``, ``alter_<i>``; the series key includes it."""
    out = bars.withColumn("scenario", F.lit("full"))
    for k, c in enumerate(cutoffs):
        at = f"TIMESTAMP_NTZ'{c:%Y-%m-%d %H:%M:%S.%f}'"
        out = out.unionByName(bars.where(F.col("bar_ts") < F.expr(at)).withColumn("scenario", F.lit(f"cut_{k}")))
        out = out.unionByName(mutate_future(bars, at, keys=[SERIES]).withColumn("scenario", F.lit(f"alter_{k}")))
    return out.withColumn("_base", F.col(SERIES)).withColumn(SERIES, F.concat_ws("\x1f", F.col(SERIES), F.col("scenario"))).drop("scenario", "_base")


def compare_scenarios(stages: dict[str, DataFrame], cutoffs: list, atol: float = 1e-9) -> DataFrame:
    """Per stage and scenario: rows known before the cutoff in the full run, and columns that differ. ``stages`` carry the scenario in the series key.

    A stage is computed once, and all scenarios are compared in one join and one aggregation.
    """
    spark = next(iter(stages.values())).sparkSession
    names = [(f"{kind}_{k}", k, label) for k in range(len(cutoffs)) for kind, label in (("cut", "truncation"), ("alter", "future_mutation"))]
    times = F.array(*[F.struct(F.lit(n).alias("_scenario"), F.expr(f"TIMESTAMP_NTZ'{cutoffs[k]:%Y-%m-%d %H:%M:%S.%f}'").alias("_cutoff")) for n, k, _ in names])
    every = spark.createDataFrame(names, "_scenario string, cutoff int, kind string")
    parts = []
    for stage, frame in stages.items():
        base, scenario = F.substring_index(SERIES, "\x1f", 1), F.substring_index(SERIES, "\x1f", -1)
        rows = cut_lineage(frame.withColumns({"_base": base, "_of": scenario, "_known": known_at(frame, stage)}).drop(SERIES))
        ts = time_column(frame, stage)
        columns = [c for c in rows.columns if not c.startswith("_") and c not in (ts, "next_ts", "next_open")]
        full = rows.where(F.col("_of") == "full").select("*", F.inline(F.filter(times, lambda x: F.col("_known") < x["_cutoff"])))
        other = rows.where(F.col("_of") != "full").select("*", F.inline(F.filter(times, lambda x: (F.col("_of") == x["_scenario"]) & (F.col("_known") < x["_cutoff"]))))
        pairs = compared(full, other, ["_scenario", "_base", ts], columns, atol)
        counts = pairs.groupBy("_scenario").agg(*[F.count_if(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
        n = [F.coalesce(F.col(f"c{i}"), F.lit(0)) for i in range(len(columns))]
        parts.append(every.join(counts, "_scenario", "left").select(
            F.lit(stage).alias("stage"), "kind", "cutoff", sum(((x > 0).cast("bigint") for x in n), F.lit(0).cast("bigint")).alias("columns_differing"), (F.greatest(*n) if len(n) > 1 else n[0] if n else F.lit(0).cast("bigint")).alias("rows_differing"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_stages(stages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Known stages in order; anything but frames is refused."""
    for name, frame in stages.items():
        if not isinstance(frame, DataFrame):
            raise TypeError(f"stage {name} is no DataFrame")
    return {s: stages[s] for s in STAGES if s in stages}


def causality_coverage(stages: list[str], cutoffs: list, mode: str, seed: int) -> dict:
    # Keys of the coverage record.
    n = len(stages) * len(cutoffs)
    return {"mode": mode, "seed": seed, "cutoff_count": len(cutoffs), "cutoffs": [f"{c.isoformat()}+00:00" for c in cutoffs], "stages": stages, "truncation_comparisons": n, "mutation_comparisons": n}


def audit_with_coverage(run: Callable[[DataFrame], dict[str, DataFrame]], bars: DataFrame, *, mode: str = "standard", seed: int = 1729, cutoffs: list | None = None, batch: int = 8, atol: float = 1e-9) -> tuple[DataFrame, dict]:
    """Findings ``truncation_<stage>`` and ``future_mutation_<stage>``, and what was compared. ``run``: bars -> stages, separately for each series."""
    spark = bars.sparkSession
    whole = check_stages(run(bars))
    if cutoffs is None:
        # The strategy's first events of the full run.
        events = {s: [r[0] for r in f.select(time_column(f, s)).orderBy(time_column(f, s)).limit(8).collect()] for s, f in whole.items() if s != "features"}
        cutoffs = generate_cutoffs(bars, events, mode=mode, seed=seed)
    coverage = causality_coverage(list(whole), cutoffs, mode, seed)
    if not cutoffs:
        return findings(spark, [("causality", "UNVERIFIED", "no cutoffs", None, "causality")]), coverage
    parts = [compare_scenarios(check_stages(run(scenario_bars(bars, cutoffs[k : k + batch]))), cutoffs[k : k + batch], atol) for k in range(0, len(cutoffs), batch)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    per = out.groupBy("stage", "kind").agg(F.count("*").alias("n"), F.count_if((F.col("columns_differing") > 0) | (F.col("rows_differing") > 0)).alias("bad"))
    found = per.select(
        F.concat_ws("_", "kind", "stage").alias("check"), F.when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("status"), F.format_string("%d of %d cutoffs differ", "bad", "n").alias("message"),
        F.array().cast("array<bigint>").alias("rows"), F.when(F.col("stage") == "features", "feature_causality").otherwise("causality").alias("family"), F.to_json(F.struct("n", "bad")).alias("evidence"), F.when(F.col("bad") > 0, PROVEN).alias("classification"),
    )
    if "features" not in whole:
        found = together(found, findings(spark, [("feature_causality", "UNVERIFIED", "no features stage is offered", None, "feature_causality")]))
    return found, coverage


def audit_causality(run: Callable[[DataFrame], dict[str, DataFrame]], bars: DataFrame, **options) -> DataFrame:
    """The findings of ``audit_with_coverage`` alone."""
    return audit_with_coverage(run, bars, **options)[0]


def audit_ledger_causality(run: Callable[[DataFrame], DataFrame], bars: DataFrame, cutoffs: list | None = None) -> DataFrame:
    """For engines that give a ledger only: findings ``truncation_invariance`` and ``future_mutation``; fewer than 300 bars are too few to choose cutoffs from."""
    if cutoffs is None and bars.limit(300).count() < 300:
        return findings(bars.sparkSession, [("causality", "WARN", "too few bars for a truncation audit", None, "causality")])
    found = audit_causality(lambda b: {"trades": run(b)}, bars, mode="fast", cutoffs=cutoffs)
    name = F.when(F.col("check") == "truncation_trades", "truncation_invariance").when(F.col("check") == "future_mutation_trades", "future_mutation").otherwise(F.col("check"))
    return found.withColumn("check", name)
