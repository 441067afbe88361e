"""Features of a bar series: fractional differences, rolling statistics, EMA, channel, signals.

All windows look back over stored rows, so each runs inside blocks of stored
rows with a halo of the rows before; only the EMA reaches back without end and
gets its carry from one summary row a block. Missing values are null. Input
rows need positive finite closes where a value is to come out; others give
null there, and an EMA skips them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.market import finite
from barloom.operators.blocks import in_blocks, with_positions
from barloom.params import StrategyParams
from barloom.session import cut_lineage

SERIES = "series_id"
FOLD = 256


def fracdiff(x: Column, weights: list[float], w) -> Column:
    """Weighted sum of the last values, newest first; null unless all of them are there."""
    m = len(weights)
    values = F.collect_list(x).over(w.rowsBetween(-(m - 1), 0))
    reverse = F.array(*[F.lit(v) for v in reversed(weights)])
    return F.when(F.size(values) == m, F.aggregate(F.zip_with(values, reverse, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))


def rolling(x: Column, n: int, how, w) -> Column:
    """``how`` over the last ``n`` stored rows; null unless ``n`` are valid."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, how(x).over(frame))


def zscore(x: Column, n: int, w) -> Column:
    mean, std = rolling(x, n, F.avg, w), rolling(x, n, F.stddev_pop, w)
    return (x - mean) / F.nullif(std, F.lit(0.0))


def ema(df: DataFrame, column: str, span: int, out: str, *, series: list[str], block: int = 4_096) -> DataFrame:
    """First-order recurrence seeded by the first stored value. Needs ``_pos``.

    A block's own part is a prefix sum of scaled values; what comes from before
    is one carry a block, folded over block summaries in order, ``FOLD`` at a time.
    """
    alpha = 2.0 / (span + 1)
    keep = 1.0 - alpha
    # Scaled values must stay within the range of doubles.
    size = block if keep <= 0 else max(1, min(block, int(200 / -math.log(keep)))) if keep < 1 else block
    blocked = df.withColumn("_eb", F.floor(F.col("_pos") / size)).withColumn("_ej", (F.col("_pos") % size).cast("double"))
    w = Window.partitionBy(*series, "_eb").orderBy("_pos")
    x = F.col(column)
    if keep == 0:
        return df.withColumn(out, x)
    scaled = F.sum(alpha * x * F.pow(F.lit(keep), -F.col("_ej"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    blocked = blocked.withColumn("_part", F.pow(F.lit(keep), F.col("_ej")) * scaled)
    summary = blocked.groupBy(*series, "_eb").agg(F.max_by("_part", "_pos").alias("_p"), F.count("*").alias("_n"), F.min_by(column, "_pos").alias("_x0"))
    # Summaries compose, so they are folded in two levels: groups of blocks, then blocks within a group from the group's carry.
    grouped = summary.withColumn("_g", F.floor(F.col("_eb") / FOLD)).groupBy(*series, "_g").agg(F.array_sort(F.collect_list(F.struct("_eb", "_p", "_n", "_x0"))).alias("_s"))
    after = lambda carry, s: s["_p"] + carry * F.pow(F.lit(keep), s["_n"].cast("double"))
    whole = grouped.select(*series, "_g", F.aggregate("_s", F.lit(0.0), after).alias("_p"), F.aggregate("_s", F.lit(0).cast("bigint"), lambda n, s: n + s["_n"]).alias("_n"), F.col("_s")[0]["_x0"].alias("_x0"))

    def carried(rows: Column, first: Column, at: str) -> Column:
        """Carry before each of some summaries in order; ``first`` before the first one, null where the series begins."""
        step = lambda acc, s: F.struct(
            F.concat(acc["list"], F.array(F.struct(s[at].alias(at), F.coalesce(acc["carry"], s["_x0"]).alias("_carry")))).alias("list"), after(F.coalesce(acc["carry"], s["_x0"]), s).alias("carry")
        )
        return F.aggregate(rows, F.struct(F.array().cast(f"array<struct<{at}:bigint,_carry:double>>").alias("list"), first.alias("carry")), step, lambda x: x["list"])

    groups = whole.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("_g", "_p", "_n", "_x0"))).alias("_s"))
    groups = groups.select(*series, F.inline(carried(F.col("_s"), F.lit(None).cast("double"), "_g")))
    carries = grouped.join(groups, [*series, "_g"]).select(*series, F.inline(carried(F.col("_s"), F.col("_carry"), "_eb")))
    joined = blocked.join(carries, [*series, "_eb"])
    return joined.withColumn(out, F.col("_part") + F.col("_carry") * F.pow(F.lit(keep), F.col("_ej") + 1)).drop("_eb", "_ej", "_part", "_carry")


def keltner(close: Column, ema_: Column, mean_range: Column) -> Column:
    return (close - ema_) / F.nullif(mean_range, F.lit(0.0))


def build_features(bars: DataFrame, p: StrategyParams = StrategyParams(), series: str = SERIES, *, with_ema: bool = True) -> DataFrame:
    """``bars`` (series, bar_ts, prices, volume) with fracdiff, z, previous_z, ema, mean_range, keltner, the next row's time and open, and the signals."""
    close = finite(F.col("close").cast("double"))
    # Positioned bars are read by the EMA's two passes and the windows; they are computed once.
    rows = cut_lineage(with_positions(bars, [series], "bar_ts"))
    if with_ema:
        rows = ema(rows, "close", p.ema_span, "ema", series=[series], block=p.block)
    back = p.lookback
    block = max(p.block, back)
    rows = in_blocks(rows, block, back=back, ahead=1)
    w = Window.partitionBy(series, "_block").orderBy("_pos")
    rows = rows.withColumn("log_close", F.when(close > 0, F.ln(close)))
    rows = rows.withColumn("fracdiff", fracdiff(F.col("log_close"), p.weights, w))
    rows = rows.withColumn("z", zscore(F.col("fracdiff"), p.z_window, w)).withColumn("mean_range", rolling(F.col("high") - F.col("low"), p.range_window, F.avg, w))
    rows = rows.withColumns({"previous_z": F.lag("z").over(w), "next_ts": F.lead("bar_ts").over(w), "next_open": F.lead("open").over(w)})
    rows = rows.where("_core").drop("_core", "_block", "log_close")
    crossing = F.coalesce((F.col("z") >= p.z_threshold) & (F.col("previous_z") < p.z_threshold), F.lit(False))
    rows = rows.withColumn("raw_long_signal", crossing)
    if not with_ema:
        return rows
    rows = rows.withColumn("keltner", keltner(F.col("close"), F.col("ema"), F.col("mean_range")))
    return rows.withColumn("signal_passes_keltner", F.col("raw_long_signal") & F.coalesce(F.col("keltner") <= p.keltner_max, F.lit(False)))
