"""A second engine for the same strategy, bar by bar in plain Python, to check the first one against.

It shares no operator with the first: sessions by the zone database of Python,
windows by slices, four-hour ranges by a dictionary, exits by a walk over bars.
It is for verification only: a series is walked in one task, so series of more
than ``MAX_ROWS`` bars are refused, not cut.
"""

from __future__ import annotations

import bisect
import datetime as dt
import math
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.audits import RECONCILED, beside_counts, compare_rows, ledger_hash, numbered
from barloom.operators.indicators import SERIES
from barloom.params import StrategyParams
from barloom.session import written

MAX_ROWS = 12_000_000
LEDGER = "signal_time timestamp_ntz, entry_time timestamp_ntz, entry_price double, atr_source_start timestamp_ntz, atr_source_end timestamp_ntz, atr_value double, stop_price double, target_price double, initial_risk double, deadline timestamp_ntz, exit_time timestamp_ntz, exit_price double, exit_reason string, gross_R double, cost_R double, net_R double"
_NY, _CT, _UTC = ZoneInfo("America/New_York"), ZoneInfo("America/Chicago"), ZoneInfo("UTC")


def _wall(t: dt.datetime, zone: ZoneInfo) -> dt.datetime:
    return t.replace(tzinfo=_UTC).astimezone(zone)


def _deadline(t: dt.datetime) -> dt.datetime | None:
    w = _wall(t, _NY)
    if 15 <= w.hour < 18:
        return None
    day = w.date() + dt.timedelta(days=w.hour >= 18)
    return dt.datetime(day.year, day.month, day.day, 15, tzinfo=_NY).astimezone(_UTC).replace(tzinfo=None)


def _london(t: dt.datetime) -> bool:
    w = _wall(t, _CT)
    return 120 <= w.hour * 60 + w.minute < 510


def _ranges(rows: list[tuple]) -> tuple[list[dt.datetime], list[float]]:
    """Ends of the four-hour buckets and their true ranges."""
    buckets: dict[dt.datetime, list[float]] = {}
    for t, _, h, lo, c in rows:
        b = buckets.setdefault(t.replace(hour=t.hour // 4 * 4, minute=0, second=0, microsecond=0), [h, lo, c])
        b[:] = [max(b[0], h), min(b[1], lo), c]
    ends, values, before = [], [], None
    for start in sorted(buckets):
        h, lo, c = buckets[start]
        ends.append(start + dt.timedelta(hours=4))
        values.append(max([h - lo] + ([abs(h - before), abs(lo - before)] if before is not None else [])))
        before = c
    return ends, values


def _signals(rows: list[tuple], p: StrategyParams) -> Iterator[int]:
    """Rows at which z crosses its threshold inside the channel."""
    weights, logs, diffs = p.weights, [], []
    ema, z = None, None
    alpha = 2 / (p.ema_span + 1)
    for i, (_, _, _, _, c) in enumerate(rows):
        logs.append(math.log(c))
        diffs.append(sum(w * logs[i - k] for k, w in enumerate(weights)) if i >= len(weights) - 1 else None)
        last, z = z, None
        window = diffs[-p.z_window :]
        if len(window) == p.z_window and window[0] is not None:
            mean = math.fsum(window) / p.z_window
            spread = math.sqrt(math.fsum((x - mean) ** 2 for x in window) / p.z_window)
            z = (diffs[-1] - mean) / spread if spread else None
        ema = c if ema is None else alpha * c + (1 - alpha) * ema
        if z is None or last is None or not z >= p.z_threshold > last or i + 1 < p.range_window:
            continue
        width = math.fsum(r[2] - r[3] for r in rows[i + 1 - p.range_window : i + 1]) / p.range_window
        if width and (c - ema) / width <= p.keltner_max:
            yield i


def _exit(rows: list[tuple], first: int, end: int, deadline: dt.datetime, stop: float, target: float) -> tuple[dt.datetime, float, str] | None:
    for k in range(first, end):
        t, o, h, lo, c = rows[k]
        if t == deadline:
            return t, o, "FLAT_1500"
        for touched, price, why in ((o <= stop, o, "SL"), (o >= target, target, "TP"), (lo <= stop, stop, "SL"), (h >= target, target, "TP")):
            if touched:
                return t, price, why
        if k + 1 == end:
            return t, c, "FLAT_1500"
    return None


def walk(rows: list[tuple], p: StrategyParams = StrategyParams()) -> Iterator[tuple]:
    """Ledger rows of bars ``(time, open, high, low, close)`` in time order."""
    times = [r[0] for r in rows]
    ends, values = _ranges(rows)
    until = None
    up = lambda x: math.ceil(x / p.tick_size) * p.tick_size
    for i in _signals(rows, p):
        if i + 1 >= len(rows):
            return
        signal, entry, price = times[i], times[i + 1], rows[i + 1][1]
        deadline = _deadline(entry)
        if deadline is None or _deadline(signal) != deadline or _london(signal) or _london(entry) or (until and entry <= until):
            continue
        known = bisect.bisect_right(ends, entry) - 1
        if known < 0 or not 0 < values[known] < math.inf:
            continue
        atr = values[known]
        stop, target = up(price - atr), up(price + p.target_r * atr)
        risk = price - stop
        done = _exit(rows, i + 1, bisect.bisect_right(times, deadline), deadline, stop, target) if risk > 0 else None
        if done is None:
            continue
        until, left, why = done
        gross = p.target_r if why == "TP" else -1.0 if why == "SL" and left >= stop else (left - price) / risk
        cost = (0.0 if _wall(entry, _NY).year < p.cost_change_year else p.cost_points) / risk
        yield (signal, entry, price, ends[known] - dt.timedelta(hours=4), ends[known], atr, stop, target, risk, deadline, until, left, why, gross, cost, gross - cost)


def run_reference(bars: DataFrame, p: StrategyParams = StrategyParams()) -> DataFrame:
    """The ledger of each series by the second engine."""
    kind = dict(bars.dtypes)[SERIES]

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_ROWS:
            raise ValueError(f"series {key[0]} has more than {MAX_ROWS} bars")
        pdf = pdf.sort_values("bar_ts", kind="stable")
        rows = list(zip(pdf["bar_ts"].dt.to_pydatetime(), *(pdf[c].astype(float) for c in ("open", "high", "low", "close"))))
        return pd.DataFrame([(key[0], *r) for r in walk(rows, p)], columns=[SERIES, *(c.split()[0] for c in LEDGER.split(", "))])

    return bars.select(SERIES, "bar_ts", "open", "high", "low", "close").groupBy(SERIES).applyInPandas(of, f"{SERIES} {kind}, {LEDGER}")


def reconcile_engines(bars: DataFrame, p: StrategyParams = StrategyParams(), atol: float = 1e-9) -> DataFrame:
    """One row: trades of both engines, columns that differ, both hashes, and whether all agree."""
    from barloom.operators.trading import run_backtest

    first, second = run_backtest(bars, p), written(run_reference(bars, p))
    order = ["entry_time", SERIES]
    per = compare_rows(numbered(first, order), numbered(second, order), ["_rn"], list(RECONCILED), atol)
    hashes = [ledger_hash(x).select(F.col("ledger_hash").alias(n)) for x, n in ((first, "production_hash"), (second, "reference_hash"))]
    out = beside_counts({"production_trades": first, "reference_trades": second}, per.agg(F.count_if(F.col("mismatches") > 0).alias("columns_differing")), *hashes)
    return out.withColumn("matched", (F.col("production_trades") == F.col("reference_trades")) & (F.col("columns_differing") == 0))
