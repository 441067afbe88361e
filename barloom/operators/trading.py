"""From signals to an accepted ledger: candidates, as-of true range, first touch, one position at a time, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.market import bracket, cost_points, eligible_pair, entry_year, gross_r, sample_label, session_key, trading_deadline, true_range
from barloom.operators.asknown import AsKnownParams, attach_as_known
from barloom.operators.bars import resample
from barloom.operators.indicators import SERIES, build_features
from barloom.params import StrategyParams
from barloom.session import cut_lineage


def build_candidates(features: DataFrame, signal: str = "signal_passes_keltner") -> DataFrame:
    """Entry at the next stored row, if both rows lie in one permitted session outside London; its deadline is shared."""
    has = [c for c in ("keltner",) if c in features.columns]
    pairs = features.where(F.col(signal) & F.col("next_ts").isNotNull() & eligible_pair(F.col("bar_ts"), F.col("next_ts")))
    return pairs.select(
        SERIES, F.col("bar_ts").alias("signal_time"), F.col("next_ts").alias("entry_time"), F.col("next_open").alias("entry_price"),
        F.col("z").alias("signal_z"), "previous_z", *[F.col(c).alias("signal_keltner") for c in has], trading_deadline(F.col("next_ts")).alias("deadline"),
    )


def true_range_4h(bars: DataFrame) -> DataFrame:
    """Completed four-hour buckets with true range; the previous close is that of the last non-empty bucket."""
    buckets = resample(bars, "4 hours", keys=[SERIES], out="source_start").select(SERIES, "source_start", "high", "low", "close")
    w = Window.partitionBy(SERIES).orderBy("source_start")
    ranged = buckets.withColumn("previous_close", F.lag("close").over(w)).withColumn("tr", true_range(F.col("high"), F.col("low"), F.col("previous_close")))
    end = F.col("source_start") + F.expr("INTERVAL '4' HOUR")
    return ranged.withColumn("source_end", end).withColumn("available_at", end)


def attach_atr(candidates: DataFrame, ranges: DataFrame) -> DataFrame:
    """The latest range available at entry (inclusive); null if it isn't positive and finite, without falling back to an older one."""
    utc = lambda c: c.cast("timestamp")
    events = candidates.withColumn("_at", utc(F.col("entry_time")))
    known = ranges.withColumn("_known", utc(F.col("available_at"))).withColumn("_id", F.unix_micros(utc(F.col("source_start"))))
    held = attach_as_known(events, known, event_entity=SERIES, event_time="_at", entity=SERIES, known_at="_known", rank=["_known"], keep=["source_start", "source_end", "tr"], row_id="_id", as_column="_atr", params=AsKnownParams())
    ok = (F.col("_atr.tr") > 0) & ~F.isnan("_atr.tr") & (F.col("_atr.tr") < float("inf"))
    return held.select(*candidates.columns, *[F.when(ok, F.col(f"_atr.{a}")).alias(b) for a, b in (("source_start", "atr_source_start"), ("source_end", "atr_source_end"), ("tr", "atr_value"))])


def with_brackets(candidates: DataFrame, p: StrategyParams = StrategyParams()) -> DataFrame:
    """Stops, targets and risk; candidates without a bracket are left out."""
    return candidates.withColumn("_b", bracket(F.col("entry_price"), F.col("atr_value"), p)).where(F.col("_b").isNotNull()).select(*candidates.columns, "_b.*")


def simulate(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """First exit of every candidate, independent of all others.

    Bars and candidates meet by session, whose bars are bounded by its length;
    the pairs are folded to the first event as they are made and never stored.
    Order of events within a bar: the deadline row's open, a gap through the
    stop at the open, a gap through the target at the target, stop, target, and
    the last close before a deadline that has no row.
    """
    keyed = bars.select(SERIES, "bar_ts", "open", "high", "low", "close", session_key(F.col("bar_ts")).alias("deadline")).where(F.col("deadline").isNotNull())
    ends = keyed.groupBy(SERIES, "deadline").agg(F.bool_or(F.col("bar_ts") == F.col("deadline")).alias("_has"), F.max(F.when(F.col("bar_ts") < F.col("deadline"), F.col("bar_ts"))).alias("_last"))
    narrow = candidates.select(SERIES, "entry_time", "deadline", "stop_price", "target_price")
    pairs = narrow.join(ends, [SERIES, "deadline"]).join(keyed, [SERIES, "deadline"]).where(F.col("bar_ts") >= F.col("entry_time"))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    stop, target = F.col("stop_price"), F.col("target_price")
    event = lambda price, why: F.struct(F.col("bar_ts").alias("exit_time"), price.alias("exit_price"), F.lit(why).alias("exit_reason"))
    first = (
        F.when(F.col("bar_ts") == F.col("deadline"), event(o, "FLAT_1500"))
        .when(o <= stop, event(o, "SL")).when(o >= target, event(target, "TP"))
        .when(lo <= stop, event(stop, "SL")).when(h >= target, event(target, "TP"))
        .when(~F.col("_has") & (F.col("bar_ts") == F.col("_last")), event(c, "FLAT_1500"))
    )
    # Pairs carry a candidate's key and prices only; its other columns come back by the key, an entry time of a series.
    found = pairs.withColumn("_e", first).groupBy(SERIES, "entry_time").agg(F.min("_e").alias("_e")).where(F.col("_e").isNotNull())
    return candidates.join(found, [SERIES, "entry_time"]).select(*candidates.columns, "_e.*")


def accept_one_at_a_time(simulated: DataFrame) -> DataFrame:
    """Entries in order; one is skipped while an earlier accepted trade is open, its exit minute included.

    Every exit lies within its session and the next session's entries after it,
    so sessions are independent groups, folded in order of entry.
    """
    fields = simulated.columns
    groups = simulated.groupBy(SERIES, "deadline").agg(F.array_sort(F.collect_list(F.struct("entry_time", F.struct(*fields).alias("_t")))).alias("_all"))
    kind = groups.schema["_all"].dataType.elementType.fields[1].dataType
    start = F.struct(F.array().cast(f"array<{kind.simpleString()}>").alias("kept"), F.lit(None).cast("timestamp_ntz").alias("until"))
    free = lambda a, x: a["until"].isNull() | (x["entry_time"] > a["until"])
    step = lambda a, x: F.struct(
        F.when(free(a, x), F.concat(a["kept"], F.array(x["_t"]))).otherwise(a["kept"]).alias("kept"), F.when(free(a, x), x["_t"]["exit_time"]).otherwise(a["until"]).alias("until")
    )
    return groups.select(F.inline(F.aggregate("_all", start, step, lambda a: a["kept"]))).select(*fields)


def accounting(trades: DataFrame, p: StrategyParams = StrategyParams()) -> DataFrame:
    year = entry_year(F.col("entry_time"))
    out = trades.withColumn("gross_R", gross_r(F.col("exit_reason"), F.col("entry_price"), F.col("exit_price"), F.col("stop_price"), F.col("initial_risk"), p))
    out = out.withColumn("cost_points", cost_points(year, p)).withColumn("cost_R", F.col("cost_points") / F.col("initial_risk"))
    return out.withColumn("net_R", F.col("gross_R") - F.col("cost_R")).withColumn("entry_year", year).withColumn("sample", sample_label(year)).withColumn("direction", F.lit("long"))


def proposed(bars: DataFrame, p: StrategyParams = StrategyParams(), *, channel: bool = True) -> DataFrame:
    features = build_features(bars, p, with_ema=channel)
    return build_candidates(features, "signal_passes_keltner" if channel else "raw_long_signal")


def run_backtest(bars: DataFrame, p: StrategyParams = StrategyParams(), *, channel: bool = True) -> DataFrame:
    """Accepted ledger of each series. Bars, candidates and ledger are each computed once, however often they are read on."""
    bars = cut_lineage(bars)
    held = attach_atr(cut_lineage(proposed(bars, p, channel=channel)), true_range_4h(bars)).where(F.col("atr_value").isNotNull())
    return cut_lineage(accounting(accept_one_at_a_time(simulate(with_brackets(held, p), bars)), p))


def summarize(trades: DataFrame) -> DataFrame:
    """One row, also for an empty ledger: counts, win rate in percent, profit factor (infinite without losses, NaN without either), net R."""
    r = F.col("net_R")
    plus, minus = F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))
    n, wins = F.count("*"), F.count_if(r > 0)
    s = trades.agg(n.alias("trades"), wins.alias("wins"), F.count_if(r <= 0).alias("loss_or_zero"), F.coalesce(plus, F.lit(0.0)).alias("_p"), F.coalesce(minus, F.lit(0.0)).alias("_m"), F.coalesce(F.sum(r), F.lit(0.0)).alias("net_R"))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    factor = F.when(F.col("_m") > 0, F.col("_p") / F.nullif(F.col("_m"), F.lit(0.0))).when(F.col("_p") > 0, inf).otherwise(nan)
    rate = F.when(F.col("trades") > 0, 100.0 * F.col("wins") / F.nullif(F.col("trades"), F.lit(0))).otherwise(nan)
    return s.select("trades", "wins", "loss_or_zero", rate.alias("win_rate"), factor.alias("profit_factor"), "net_R")
