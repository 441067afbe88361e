"""Row positions and overlapping blocks: windows over a fixed number of stored rows without one task a series.

A series may hold a third of all rows, so nothing here windows over a whole
series. Positions come from counts per series and day (partial aggregation), a
window over those counts, and row numbers within a day. Rows near the end of a
block are repeated in the next block as its halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, series: list[str], ts: str, tie: list[str] | None = None) -> DataFrame:
    """Adds ``_pos``: 0, 1, 2, ... in time order within each series."""
    day = F.date_trunc("day", F.col(ts))
    dated = df.withColumn("_day", day)
    counts = dated.groupBy(*series, "_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*series).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*series, "_day", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*series, "_day").orderBy(ts, *(tie or [])))
    return dated.join(offsets, [*series, "_day"]).withColumn("_pos", (F.col("_before") + rank - 1).cast("bigint")).drop("_day", "_before")


def in_blocks(df: DataFrame, block: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Adds ``_block`` and ``_core``; rows within ``back`` of a block's end stand in the next block too, those within ``ahead`` of its start in the one before."""
    if max(back, ahead) > block:
        raise ValueError("a halo can't be longer than a block")
    home = F.floor(F.col("_pos") / block)
    spot = F.col("_pos") % block
    places = F.array_compact(F.array(home, F.when(spot >= block - back, home + 1) if back else F.lit(None), F.when((spot < ahead) & (home > 0), home - 1) if ahead else F.lit(None)))
    return df.withColumn("_home", home).withColumn("_block", F.explode(places)).withColumn("_core", F.col("_block") == F.col("_home")).drop("_home")
