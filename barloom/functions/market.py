"""Column functions: fractional weights, sessions, ticks, brackets, accounting, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.params import IN_SAMPLE, OUT_OF_SAMPLE, StrategyParams

CHICAGO, NEW_YORK = "America/Chicago", "America/New_York"


def fracdiff_weights(d: float = 0.45, max_weights: int = 100, cutoff: float = 0.001) -> list[float]:
    """Weights of fractional differencing, up to but without the first one smaller than ``cutoff``."""
    if max_weights <= 0:
        raise ValueError("max_weights must be positive")
    out = [1.0]
    while len(out) < max_weights:
        k = len(out)
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < cutoff:
            break
        out.append(w)
    return out


def local_time(ts: Column, zone: str) -> Column:
    """Wall clock of a UTC TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def minute_of_day(ts: Column, zone: str) -> Column:
    wall = local_time(ts, zone)
    return F.hour(wall) * 60 + F.minute(wall)


def session_class(ts: Column) -> Column:
    m = minute_of_day(ts, CHICAGO)
    return (
        F.when((m >= 1020) | (m < 120), "globex_asia")
        .when(m < 510, "london").when(m < 720, "ny_am").when(m < 900, "ny_pm").when(m < 960, "ny_late")
        .otherwise("maintenance")
    )


def permitted(ts: Column) -> Column:
    m = minute_of_day(ts, NEW_YORK)
    return (m >= 1080) | (m < 900)


def trading_deadline(ts: Column) -> Column:
    """15:00 New York of the session's day, as UTC; null outside the permitted interval. Calendar arithmetic, so safe across clock changes."""
    wall = local_time(ts, NEW_YORK)
    day = F.date_add(F.to_date(wall), F.when(F.hour(wall) >= 18, 1).otherwise(0))
    close = day.cast("timestamp_ntz") + F.expr("INTERVAL '15' HOUR")
    return F.when(permitted(ts), F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), close))


def session_key(ts: Column) -> Column:
    """Deadline of the session a bar can end: its own deadline, and for the 15:00 bar that very time; null in between sessions."""
    wall = local_time(ts, NEW_YORK)
    return F.when((F.hour(wall) == 15) & (F.minute(wall) == 0) & (F.second(wall) == 0), ts).otherwise(trading_deadline(ts))


def eligible_pair(signal: Column, entry: Column) -> Column:
    quiet = lambda t: (session_class(t) != "london") & permitted(t)
    return F.coalesce(quiet(signal) & quiet(entry) & (trading_deadline(signal) == trading_deadline(entry)), F.lit(False))


def bucket(ts: Column, interval: str) -> Column:
    """Start of the epoch-aligned bucket."""
    return F.window(ts, interval).start


def ceil_to_tick(price: Column, tick: float = 0.25) -> Column:
    """Up to the next tick. Ticks that are powers of two are exact in doubles; others go through decimals."""
    numerator, denominator = float(tick).as_integer_ratio()
    if tick <= 0:
        raise ValueError("tick must be positive")
    if denominator <= 1 << 20 and (numerator & (numerator - 1)) == 0:
        return F.ceil(price / tick).cast("double") * tick
    step = F.lit(str(tick)).cast("decimal(18,9)")
    return (F.ceil(price.cast("string").cast("decimal(28,12)") / step) * step).cast("double")


def bracket(entry: Column, atr: Column, p: StrategyParams = StrategyParams()) -> Column:
    """Struct of unrounded and rounded stop and target and the initial risk; null where there is no positive finite risk."""
    stop_u, target_u = entry - atr, entry + F.lit(p.target_r) * atr
    stop, target = ceil_to_tick(stop_u, p.tick_size), ceil_to_tick(target_u, p.tick_size)
    risk = entry - stop
    return F.when(
        (risk > 0) & ~F.isnan(risk) & (risk < float("inf")),
        F.struct(stop_u.alias("stop_unrounded"), stop.alias("stop_price"), target_u.alias("target_unrounded"), target.alias("target_price"), risk.alias("initial_risk")),
    )


def entry_year(ts: Column) -> Column:
    return F.year(local_time(ts, NEW_YORK))


def sample_label(year: Column) -> Column:
    return F.when(year.isin(*IN_SAMPLE), "IS").when(year.isin(*OUT_OF_SAMPLE), "OOS").otherwise("UNLABELED")


def gross_r(reason: Column, entry: Column, exit_: Column, stop: Column, risk: Column, p: StrategyParams = StrategyParams()) -> Column:
    moved = (exit_ - entry) / F.nullif(risk, F.lit(0.0))
    known = F.when(reason == "TP", F.lit(p.target_r)).when(reason == "SL", F.when(exit_ < stop, moved).otherwise(F.lit(-1.0))).when(reason == "FLAT_1500", moved)
    return F.when(reason.isin("TP", "SL", "FLAT_1500"), known).otherwise(F.raise_error(F.concat(F.lit("unknown exit reason: "), F.coalesce(reason, F.lit("null")))))


def cost_points(year: Column, p: StrategyParams = StrategyParams()) -> Column:
    return F.when(year < p.cost_change_year, F.lit(0.0)).otherwise(F.lit(p.cost_points))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    """Null previous closes are skipped."""
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def close_enough(a: Column, b: Column, atol: float = 1e-9, equal_null: bool = True) -> Column:
    near = F.coalesce(F.abs(a - b) <= atol, F.lit(False))
    return near | a.eqNullSafe(b) if equal_null else near


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
