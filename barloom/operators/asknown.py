"""Attributes as known at event time.

``attach_as_known`` gives each event the attribute row in force at its time:
of the entity's rows that had become known by then, the one that ranks highest
(here: latest ``source_end``, then latest ``available_at``, then highest id).

Method: attributes are cut into periods. Per entity and period the *change log*
keeps the rows that became known in it, and a *snapshot* holds the best row
known before the period began. Snapshots come from a two-level running maximum:
one maximum a period (partial aggregation), then a window over period maxima
only, so an entity with a third of all rows costs one row a period. An event
joins its own period's snapshot, and only the changes within that period are
replayed against its time. Change logs longer than ``max_inline`` rows aren't
collected into arrays: for them the same is done again by second and by
microsecond, a running maximum over at most 86,400 seconds of a day and one over
at most a million microseconds of a second, so no hot entity and no hot day is
one group, and no event is paired with changes. Both ways give the same rows.

Defined results: an event whose time or entity is null, or for which nothing
was known, gets a null row. Attribute rows with null entity, null time of
becoming known or null rank never count. Whole repeated rows count once; ties
fall to the higher id. Empty inputs work. Columns of events keep their names;
the row in force comes as one struct column, so names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AsKnownParams:
    period_seconds: int = 86_400
    max_inline: int = 256  # change-log rows of one entity and period that are replayed from an array


def _period(ts: Column, params: AsKnownParams) -> Column:
    return F.floor(F.unix_seconds(ts) / params.period_seconds).cast("bigint")


def snapshots_and_changes(attributes: DataFrame, wanted: DataFrame, params: AsKnownParams) -> tuple[DataFrame, DataFrame]:
    """``attributes``: _k, _known, _row (rank first). ``wanted``: _k, _per of events. Returns one row a (_k, _per)."""
    log = attributes.withColumn("_per", _period(F.col("_known"), params))
    blocks = log.groupBy("_k", "_per").agg(F.max("_row").alias("_best"), F.count("*").alias("_n"))
    needed = wanted.distinct().select("_k", "_per", F.lit(None).cast(attributes.schema["_row"].dataType).alias("_best"), F.lit(None).cast("bigint").alias("_n"), F.lit(True).alias("_want"))
    grid = blocks.withColumn("_want", F.lit(False)).unionByName(needed).groupBy("_k", "_per").agg(F.max("_best").alias("_best"), F.max("_n").alias("_n"), F.max("_want").alias("_want"))
    earlier = Window.partitionBy("_k").orderBy("_per").rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("_snap", F.max("_best").over(earlier)).where("_want").select("_k", "_per", "_snap", "_n"), log


def attach_as_known(
    events: DataFrame,
    attributes: DataFrame,
    *,
    event_entity: str,
    event_time: str,
    entity: str,
    known_at: str,
    rank: list[str],
    keep: list[str],
    row_id: str,
    as_column: str = "in_force",
    params: AsKnownParams = AsKnownParams(),
) -> DataFrame:
    """``events`` with the struct ``as_column`` of ``rank``, ``row_id`` and ``keep`` of the row in force, or null."""
    fields = list(dict.fromkeys([*rank, row_id, *keep]))
    usable = attributes.where(F.col(entity).isNotNull() & F.col(known_at).isNotNull() & F.col(rank[0]).isNotNull() & F.col(row_id).isNotNull())
    rows = usable.select(F.col(entity).alias("_k"), F.col(known_at).alias("_known"), F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)]).alias("_row"))
    held = events.select(F.struct("*").alias("_event"), F.col(event_entity).alias("_k"), F.col(event_time).alias("_at")).withColumn("_per", _period(F.col("_at"), params))
    snaps, log = snapshots_and_changes(rows, held.where(F.col("_k").isNotNull() & F.col("_per").isNotNull()).select("_k", "_per"), params)
    small = F.coalesce(F.col("_n"), F.lit(0)) <= params.max_inline
    long_keys = log.groupBy("_k", "_per").count().where(F.col("count") > params.max_inline).select("_k", "_per")
    short = log.join(long_keys, ["_k", "_per"], "left_anti").groupBy("_k", "_per").agg(F.collect_list(F.struct("_known", "_row")).alias("_changes"))
    joined = held.join(snaps, ["_k", "_per"], "left").join(short, ["_k", "_per"], "left")
    replayed = F.aggregate(
        F.coalesce(F.col("_changes"), F.array().cast(short.schema["_changes"].dataType)),
        F.col("_snap"),
        lambda best, c: F.when((c["_known"] <= F.col("_at")) & (best.isNull() | (c["_row"] > best)), c["_row"]).otherwise(best),
    )
    quick = joined.where(small).select("_event", replayed.alias("_row"))
    # The rest: running maxima by second of the period and by microsecond of the second.
    us = lambda c: F.unix_micros(c)
    hot = log.join(long_keys, ["_k", "_per"], "left_semi").select("_k", "_per", us(F.col("_known")).alias("_us"), "_row")
    asking = held.join(long_keys, ["_k", "_per"], "left_semi").withColumn("_us", us(F.col("_at")))
    second = F.floor(F.col("_us") / 1_000_000).alias("_s")
    times = hot.unionByName(asking.select("_k", "_per", "_us", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    grid = times.groupBy("_k", "_per", second, "_us").agg(F.max("_row").alias("_best"))
    upto = Window.partitionBy("_k", "_per", "_s").orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    within = grid.withColumn("_in", F.max("_best").over(upto)).select("_k", "_per", "_s", "_us", "_in")
    earlier = Window.partitionBy("_k", "_per").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    seconds = grid.groupBy("_k", "_per", "_s").agg(F.max("_best").alias("_best")).select("_k", "_per", "_s", F.max("_best").over(earlier).alias("_before"))
    slow = asking.withColumn("_s", second).join(within, ["_k", "_per", "_s", "_us"]).join(seconds, ["_k", "_per", "_s"]).join(snaps.drop("_n"), ["_k", "_per"], "left")
    slow_out = slow.select("_event", F.greatest("_in", "_before", "_snap").alias("_row"))
    named = F.when(F.col("_row").isNotNull(), F.struct(*[F.col("_row")[f"f{i}"].alias(c) for i, c in enumerate(fields)]))
    return quick.unionByName(slow_out).select("_event.*", named.alias(as_column))
