"""Bars: building, resampling, validation and the counters of the data audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.market import bucket, finite

PRICES = ["open", "high", "low", "close"]


def resample(df: DataFrame, interval: str, *, ts: str = "bar_ts", keys: list[str] | None = None, tie: list[str] | None = None, out: str = "bar_ts") -> DataFrame:
    """OHLCV of the non-empty epoch-aligned buckets of each key; first and last by time, then ``tie``. Null volumes count as 0."""
    order = F.struct(ts, *(tie or []))
    return (
        df.withColumn("_bucket", bucket(F.col(ts), interval))
        .groupBy(*(keys or []), F.col("_bucket").alias(out))
        .agg(
            F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.count("*").alias("rows"),
        )
    )


def bars_from_events(events: DataFrame, interval: str = "1 minute", keys: list[str] | None = None, offset: float = 100.0) -> DataFrame:
    """Bars of the event stream: price ``offset + value`` in the order of (ts, event_id), volume the number of events."""
    price = F.lit(offset) + F.col("value")
    ticks = events.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).select(
        *(keys or []), F.col("ts").alias("bar_ts"), "event_id", *[price.alias(c) for c in PRICES], F.lit(1).cast("bigint").alias("volume")
    )
    return resample(ticks, interval, keys=keys, tie=["event_id"]).drop("rows")


def beside(*frames: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out, *rest = (f.withColumn("_one", F.lit(1)) for f in frames)
    for f in rest:
        out = out.join(f, "_one")
    return out.drop("_one")


def _cells(df: DataFrame) -> list[str]:
    return [c for c in [*PRICES, "volume"] if c in df.columns]


def geometry_broken() -> Column:
    o, h, lo, c = (finite(F.col(x).cast("double")) for x in PRICES)
    return F.coalesce((h < lo) | (o < lo) | (o > h) | (c < lo) | (c > h), F.lit(False))


def malformed(df: DataFrame, ts: str = "bar_ts", allow_nonpositive: bool = False) -> Column:
    """True once for a row with a missing time, a cell that isn't a finite number, broken geometry, a price of zero or less or negative volume."""
    bad = F.col(ts).isNull() | geometry_broken()
    for c in _cells(df):
        bad = bad | finite(F.col(c).cast("double")).isNull()
    if not allow_nonpositive:
        bad = bad | F.coalesce(F.least(*[F.col(c).cast("double") for c in PRICES]) <= 0, F.lit(False))
    if "volume" in df.columns:
        bad = bad | F.coalesce(F.col("volume") < 0, F.lit(False))
    return bad


#: Rules of ``validate_bars`` in the order in which the first violation is raised.
RULES = ("empty_timestamp", "not_chronological", "duplicate_timestamp", "nonfinite", "nonpositive_price", "negative_volume", "high_below_low", "open_outside", "close_outside")


def _previous(df: DataFrame, ts: str, row: str, keys: list[str], block: int = 65_536) -> DataFrame:
    """``_prev``: the value of the stored row before. Rows are ordered within stretches of row numbers, and a stretch meets the last row of the one before; row numbers may have gaps."""
    placed = df.withColumn("_b", F.floor(F.col(row) / block))
    ends = placed.where(F.col("_b").isNotNull()).groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(ts).alias("v")), row).alias("_end"))
    ends = ends.select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b"))["v"].alias("_carry"))
    w = Window.partitionBy(*keys, "_b").orderBy(row)
    joined = placed.join(ends, [*keys, "_b"], "left")
    return joined.withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(ts).over(w))).drop("_b", "_carry")


def validation_counts(df: DataFrame, *, ts: str = "bar_ts", row: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row a key set with the number of violations of each rule. ``row`` is the stored row number (order is checked only with it)."""
    keys = keys or []
    o, h, lo, c = (finite(F.col(x).cast("double")) for x in PRICES)
    seen = df.groupBy(*keys, ts).agg(F.count("*").alias("_k"))
    dup = seen.groupBy(*keys).agg(F.sum(F.when(F.col(ts).isNotNull(), F.col("_k") - 1).otherwise(0)).alias("duplicate_timestamp"))
    ordered = _previous(df, ts, row, keys) if row else df.withColumn("_prev", F.lit(None).cast("timestamp_ntz"))
    cells = [finite(F.col(x).cast("double")) for x in _cells(df)]
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    counts = ordered.groupBy(*keys).agg(
        F.count("*").alias("rows"), n(F.col(ts).isNull()).alias("empty_timestamp"), n(F.col(ts) < F.col("_prev")).alias("not_chronological"),
        sum((F.count_if(x.isNull()) for x in cells), F.lit(0)).alias("nonfinite"), n(F.least(o, h, lo, c) <= 0).alias("nonpositive_price"),
        (n(F.col("volume") < 0) if "volume" in df.columns else F.lit(0).cast("bigint")).alias("negative_volume"),
        n(h < lo).alias("high_below_low"), n((o < lo) | (o > h)).alias("open_outside"), n((c < lo) | (c > h)).alias("close_outside"),
    )
    joined = counts.join(dup, keys) if keys else beside(counts, dup)
    return joined.select(*keys, "rows", *[F.coalesce(F.col(r), F.lit(0)).alias(r) for r in RULES])


def validate_bars(df: DataFrame, *, ts: str = "bar_ts", row: str | None = None) -> DataFrame:
    """The five bar columns of ``df`` unchanged, or ValueError naming the first violated rule. An empty frame is valid."""
    missing = [c for c in [ts, *PRICES, "volume"] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    counts = validation_counts(df, ts=ts, row=row).first()
    for rule in RULES:
        if counts and counts[rule]:
            raise ValueError(f"{rule}: {counts[rule]} rows")
    return df.select(ts, *PRICES, "volume")


def _steps(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """``keys``, ``ts``, ``_last`` and ``_step`` (microseconds) between successive times."""
    from barloom.operators.blocks import in_blocks, with_positions

    rows = in_blocks(with_positions(df.where(F.col(ts).isNotNull()).select(*keys, ts), keys, ts), 65_536, back=1)
    last = F.lag(ts).over(Window.partitionBy(*keys, "_block").orderBy("_pos"))
    return rows.withColumn("_last", last).where("_core").withColumn("_step", F.expr(f"timestampdiff(MICROSECOND, _last, {ts})"))


def _missing(interval_us: int) -> Column:
    return F.when(F.col("_step") > interval_us, F.greatest(F.floor(F.col("_step") / interval_us) - 1, F.lit(0)).cast("bigint"))


def gaps(df: DataFrame, interval_us: int, *, ts: str, keys: list[str]) -> DataFrame:
    """Per key the missing intervals between stored rows; gaps are never filled."""
    return _steps(df, ts, keys).groupBy(*keys).agg(F.count_if(F.col("_step") > interval_us).alias("gaps"), F.coalesce(F.sum(_missing(interval_us)), F.lit(0)).alias("missing_intervals"))


def gap_samples(df: DataFrame, interval_us: int, *, ts: str, keys: list[str], most: int = 20) -> DataFrame:
    """The first gaps by key and time: ``contract``, ``after``, ``before``, ``missing_intervals``."""
    held = df if keys else df.withColumn("_one", F.lit("__series__"))
    own = keys or ["_one"]
    rows = _steps(held, ts, own).where(F.col("_step") > interval_us)
    return rows.select(F.concat_ws("/", *[F.col(k).cast("string") for k in own]).alias("contract"), F.col("_last").alias("after"), F.col(ts).alias("before"), _missing(interval_us).alias("missing_intervals")).orderBy("contract", "after").limit(most)


def symbol_conflicts(df: DataFrame, contract: str, symbol: str) -> DataFrame:
    """Per contract the number of distinct symbols beyond one (independent of how the data were batched)."""
    pairs = df.where(F.col(symbol).isNotNull()).groupBy(contract, symbol).agg(F.lit(1).alias("_1"))
    return pairs.groupBy(contract).agg((F.count("*") - 1).alias("conflicts"))


def contract_multiplicity(df: DataFrame, ts: str, contract: str) -> DataFrame:
    """Timestamps that several contracts share, with their number."""
    return df.groupBy(ts, contract).agg(F.lit(1).alias("_1")).groupBy(ts).agg(F.count("*").alias("contracts")).where("contracts > 1")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: members, and those beyond the first."""
    return df.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1").withColumn("beyond_first", F.col("members") - 1)


def audit_counters(df: DataFrame, interval_us: int, *, ts: str, contract: str | None = None, symbol: str | None = None, row: str | None = None, allow_nonpositive: bool = True, order: bool = False) -> DataFrame:
    """The data manifest's counters, one row. ``order`` adds ``out_of_order``: rows (by ``row``) whose time lies before that of the row stored ahead of them."""
    cells = [finite(F.col(c).cast("double")) for c in _cells(df)]
    o, h, lo, c = (finite(F.col(x).cast("double")) for x in PRICES)
    keys = [contract] if contract else []
    timed = F.when(F.col(ts).isNotNull(), F.col(row)) if row else None
    first, last = (F.min_by(ts, timed), F.max_by(ts, timed)) if row else (F.min(ts), F.max(ts))
    base = df.agg(
        F.count("*").alias("rows"), first.alias("first_timestamp"), last.alias("final_timestamp"),
        F.count_if(malformed(df, ts, allow_nonpositive)).alias("malformed_rows"), sum((F.count_if(x.isNull()) for x in cells), F.lit(0)).alias("nonfinite_cells"),
        F.count_if(F.coalesce(F.least(o, h, lo, c) <= 0, F.lit(False))).alias("nonpositive_rows"),
        (F.count_if(F.coalesce(F.col("volume") == 0, F.lit(False))) if "volume" in df.columns else F.lit(0).cast("bigint")).alias("zero_volume_rows"),
    )
    # One row a contract and time, from which both repeated rows and gaps come.
    held = df if keys else df.withColumn("_one", F.lit(1))
    own = keys or ["_one"]
    times = held.groupBy(*own, ts).agg((F.count("*") - 1).alias("_d"))
    dup = times.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("duplicate_rows"))
    gap = gaps(times, interval_us, ts=ts, keys=own).agg(F.coalesce(F.sum("missing_intervals"), F.lit(0)).alias("missing_intervals"))
    parts = [base, dup, gap]
    if contract and symbol:
        parts.append(symbol_conflicts(df, contract, symbol).agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("symbol_conflicts")))
    if order and row:
        parts.append(_previous(df.where(F.col(ts).isNotNull()).select(ts, row), ts, row, []).agg(F.count_if(F.col(ts) < F.col("_prev")).alias("out_of_order")))
    return beside(*parts)
