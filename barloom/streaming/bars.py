"""Bars and acceptance over streams: watermarked resampling, deduplication, one position at a time per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, interval: str = "1 minute", late: str = "10 minutes", keys: list[str] | None = None, offset: float = 100.0) -> DataFrame:
    """Bars of an event stream (``event_id``, ``ts`` TIMESTAMP, ``value``); a bar is final once the watermark has passed it. Redelivered events count once."""
    price = F.lit(offset) + F.col("value")
    order = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
        .withColumn("price", price)
        .groupBy(F.window("ts", interval), *(keys or []))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
        .select(F.col("window.start").alias("bar_ts"), *(keys or []), "open", "high", "low", "close", "volume")
    )


def accept_stream(simulated: DataFrame, series: str = "series_id") -> DataFrame:
    """Accepted trades of a stream of simulated ones (``series``, ``entry_time``, ``exit_time``), which must arrive in order of entry per series. The state is one time a series."""
    schema = simulated.schema

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = pd.Timestamp(state.get[0], unit="us", tz="UTC") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["entry_time", "exit_time"])
        kept = []
        for r in rows.itertuples(index=False):
            entry, end = (pd.Timestamp(t) if pd.Timestamp(t).tzinfo else pd.Timestamp(t).tz_localize("UTC") for t in (r.entry_time, r.exit_time))
            if until is None or entry > until:
                until = end
                kept.append(r)
        if until is not None:
            state.update((int(until.value // 1000),))
        if kept:
            yield pd.DataFrame(kept, columns=rows.columns)

    return simulated.groupBy(series).applyInPandasWithState(accept, schema, "until long", "append", GroupStateTimeout.NoTimeout)
