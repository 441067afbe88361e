"""Implausible readings in bar series: physical violations, stuck runs, spikes.

``implausible_bars`` flags, per source (series), readings that can't be real
relative to that source's own behaviour.

Method: each source has a scale (median of ``high - low``, at least one tick)
and a robust first-order autoregression of its close-to-close changes: sums of
changes clipped at ``clip`` scales, over the whole source, give the coefficient
``phi`` and the residual scale ``sigma``. The level is predicted from the last
good bar before and, run backwards, from the first one after. Two tests are
iterated on the residuals:

* additive outlier: every bar of an excursion of up to ``max_excursion`` bars
  has a high, low or close that is off both predictions, to one side each, by
  more than ``critical`` sigma and ``threshold`` scales;
* level shift: a good bar whose residual passes ``critical`` sigma but which
  isn't an outlier moves the level for good; its change isn't carried on by
  ``phi``.

Outliers leave the predictions. The set of outliers first only grows, until no
further bar passes, and then only shrinks, until every bar in it passes against
the final levels; both ends are reached, there is no limit of passes. Because
changes are clipped, sigma is at most ``clip`` scales and ``critical * clip``
lies below ``threshold``: the test against sigma loses no excursion beyond the
threshold. Predictions leave the last good bar by at most ``max_shift`` scales.
Stuck runs and physical violations are separate reasons.

Scale: sources are cut into blocks of ``block`` sequence numbers with a halo of
neighbours on both sides, so a source with a third of all rows is many tasks.
One aggregation collects the distinct versions of each block (redelivered
copies are collapsed before the shuffle); flagged versions are joined to the
delivered copies by series, sequence number and a hash of the values. Blocks
give the same result as whole series unless excursions follow on each other
without a good bar between them for a whole halo.

Defined results: reasons ``impossible``, ``stuck``, ``spike`` (a bar may have
several; one row each). Prices that are null or NaN are not judged and break a
stuck run; a null source or sequence number is judged for ``impossible`` only.
A source without known tick uses scale alone. Different versions of one
sequence number are each judged against the levels around them, which come
from the version that sorts first. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import written

PRICES = ["open", "high", "low", "close"]
VALUES = [*PRICES, "volume"]


@dataclass(frozen=True)
class SpikeParams:
    threshold: float = 10.0  # scales off both predictions
    critical: float = 3.5  # sigmas
    clip: float = 2.5  # scales of a change that count for phi and sigma
    max_shift: float = 1.9  # scales by which phi may move a prediction
    max_phi: float = 0.95
    max_excursion: int = 3
    stuck: int = 12
    block: int = 8_192

    @property
    def halo(self) -> int:
        return max(2 * self.stuck, 12 * (self.max_excursion + 1))


@dataclass(frozen=True)
class Source:
    scale: float
    phi: float
    sigma: float


def change_sums(seq: np.ndarray, close: np.ndarray, core: np.ndarray, scale: float, p: SpikeParams) -> tuple[int, float, float]:
    """Of pairs of successive changes that end in ``core``: number, sum of squares, sum of products, all clipped."""
    if len(seq) < 3 or not scale > 0:
        return 0, 0.0, 0.0
    d = np.clip(np.diff(close), -p.clip * scale, p.clip * scale)
    use = (seq[2:] - seq[:-2] == 2) & core[2:] & np.isfinite(d[1:]) & np.isfinite(d[:-1])
    x, y = d[:-1][use], d[1:][use]
    return int(use.sum()), float((x * x + y * y).sum()) / 2, float((x * y).sum())


def _levels(close: np.ndarray, good: np.ndarray, src: Source, p: SpikeParams) -> np.ndarray:
    """At each place (and the end) the level predicted from the good bars before it; NaN where there are none."""
    out = np.full(len(close) + 1, np.nan)
    at = np.flatnonzero(good)
    if not len(at):
        return out
    x = close[at]
    change = np.diff(x, prepend=x[0])
    limit = p.max_shift * src.scale
    carried = np.clip(src.phi * change, -limit, limit)
    # A significant residual that isn't an outlier is a level shift; it isn't carried on.
    carried[np.abs(change - np.r_[0.0, carried[:-1]]) > p.critical * src.sigma] = 0.0
    before = np.searchsorted(at, np.arange(len(close) + 1), side="left") - 1
    there = before >= 0
    out[there] = (x + carried)[before[there]]
    return out


def _outliers(top: np.ndarray, bottom: np.ndarray, close: np.ndarray, judged: np.ndarray, bad: np.ndarray, src: Source, p: SpikeParams) -> np.ndarray:
    """Bars that pass the outlier test when ``bad`` bars are left out of the predictions."""
    n, good = len(close), judged & ~bad
    ahead = _levels(close, good, src, p)
    behind = _levels(close[::-1], good[::-1], src, p)[::-1]  # behind[i]: from bars i, i + 1, ...
    limit = max(p.threshold * src.scale, p.critical * src.sigma)
    found = np.zeros(n, bool)
    for length in range(1, min(p.max_excursion, n) + 1):
        m = n - length + 1
        a, b = ahead[:m], behind[length:]
        off = np.ones(m, bool)
        with np.errstate(invalid="ignore"):
            hi, lo = np.fmax(a, b) + limit, np.fmin(a, b) - limit
            known = np.isfinite(a) & np.isfinite(b)
            for k in range(length):
                off &= known & ((top[k : m + k] > hi) | (bottom[k : m + k] < lo))
        start = np.flatnonzero(off)
        for k in range(length):
            found[start + k] = True
    return found & judged


def spikes(high: np.ndarray, low: np.ndarray, close: np.ndarray, src: Source, p: SpikeParams) -> np.ndarray:
    """The outliers of one series or block; see the module's text."""
    bad = np.zeros(len(close), bool)
    if not src.scale > 0:
        return bad
    judged = np.isfinite(high) & np.isfinite(low) & np.isfinite(close)
    top, bottom = np.fmax(high, close), np.fmin(low, close)
    while True:
        more = bad | _outliers(top, bottom, close, judged, bad, src, p)
        if (more == bad).all():
            break
        bad = more
    while bad.any():
        fewer = bad & _outliers(top, bottom, close, judged, bad, src, p)
        if (fewer == bad).all():
            break
        bad = fewer
    return bad


def _ordered(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order of one block's versions, and in it their sequence numbers and values (NaN for null)."""
    seq = rows.field(0).to_numpy(zero_copy_only=False)
    values = [rows.field(i + 1).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for i in range(len(VALUES))]
    order = np.lexsort([*values[::-1], seq])
    return order, seq[order], [v[order] for v in values]


def _judge(seq: np.ndarray, values: list[np.ndarray], core: np.ndarray, src: Source, p: SpikeParams) -> tuple[np.ndarray, np.ndarray]:
    """Spike and stuck flags of a block's versions."""
    first = np.r_[True, seq[1:] != seq[:-1]]
    group = np.cumsum(first) - 1
    o, h, lo, c, vol = (v[first] for v in values)
    spike = spikes(h, lo, c, src, p)
    same = np.zeros(len(c), bool)
    if len(c) > 1:
        eq = lambda a: a[1:] == a[:-1]
        same[1:] = eq(o) & eq(h) & eq(lo) & eq(c) & (eq(vol) | (np.isnan(vol[1:]) & np.isnan(vol[:-1]))) & (np.diff(seq[first]) == 1)
    run = np.cumsum(~same)
    stuck = np.bincount(run)[run] >= p.stuck
    spike = spike[group]
    # Other versions of a sequence number are judged by their own values at the same place.
    for r in np.flatnonzero(~first & core):
        g = group[r]
        a, b = max(0, g - p.halo), g + p.halo + 1
        near = [x[a:b].copy() for x in (h, lo, c)]
        for x, v in zip(near, values[1:4]):
            x[g - a] = v[r]
        spike[r] = spikes(*near, src, p)[g - a]
    return spike, stuck[group]


def implausible_bars(bars: DataFrame, instruments: DataFrame, params: SpikeParams = SpikeParams(), *, row_id: str = "bar_id") -> DataFrame:
    """Columns ``row_id`` and ``reason`` of every implausible bar, redelivered ones included."""
    info = instruments.groupBy(F.col("instrument_id").alias("_ins")).agg(F.max("kind").alias("_kind"), F.max("tick_size").alias("_tick"))
    rows = bars.select(
        F.col(row_id).alias("_id"), F.col("publisher_id").alias("_pub"), F.col("instrument_id").alias("_ins"), F.col("seq_no").cast("bigint").alias("_seq"),
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in PRICES], F.col("volume").cast("bigint").alias("volume"),
    )
    o, h, lo, c = (F.col(x) for x in PRICES)
    geometry = (h < lo) | (o < lo) | (o > h) | (c < lo) | (c > h)
    nonpositive = (F.col("_kind") == "outright") & (F.least(o, h, lo, c) <= 0)
    impossible = rows.join(info, "_ins", "left").where(F.coalesce(geometry, F.lit(False)) | F.coalesce(nonpositive, F.lit(False))).select("_id", F.lit("impossible").alias("reason"))

    p, block, halo = params, params.block, min(params.halo, params.block)
    placed = rows.where(F.col("_pub").isNotNull() & F.col("_ins").isNotNull() & F.col("_seq").isNotNull())
    at, spot = F.floor(F.col("_seq") / block), F.pmod(F.col("_seq"), F.lit(block))
    homes = F.array_compact(F.array(at, F.when(spot < halo, at - 1), F.when(spot >= block - halo, at + 1)))
    versions = placed.select("_pub", "_ins", F.explode(homes).alias("_blk"), F.struct("_seq", *VALUES).alias("_v")).groupBy("_pub", "_ins", "_blk").agg(F.collect_set("_v").alias("_rows"))
    scales = placed.groupBy("_pub", "_ins").agg(F.percentile_approx(h - lo, 0.5, 1000).alias("_med")).join(info, "_ins", "left")
    scales = written(scales.select("_pub", "_ins", F.greatest(F.coalesce("_med", F.lit(0.0)), F.coalesce("_tick", F.lit(0.0))).alias("_scale")))
    blocks = written(versions)
    config = asdict(params)
    kinds = {n: t for n, t in blocks.dtypes}
    key = f"_pub {kinds['_pub']}, _ins {kinds['_ins']}"

    def in_core(seq: np.ndarray, blk: int) -> np.ndarray:
        return seq // block == blk

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = SpikeParams(**config)
        for batch in batches:
            found = []
            for blk, scale, part in zip(batch["_blk"].to_pylist(), batch["_scale"].to_pylist(), batch["_rows"]):
                _, seq, values = _ordered(part.values)
                first = np.r_[True, seq[1:] != seq[:-1]]
                found.append(change_sums(seq[first], values[3][first], in_core(seq, blk)[first], scale, q))
            n, xx, xy = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["_pub"], batch["_ins"], batch["_scale"], pa.array(n, pa.int64()), pa.array(xx, pa.float64()), pa.array(xy, pa.float64())], names=["_pub", "_ins", "_scale", "n", "xx", "xy"])

    joined = blocks.join(scales, ["_pub", "_ins"])
    total = joined.select("_pub", "_ins", "_blk", "_scale", "_rows").mapInArrow(sums, f"{key}, _scale double, n bigint, xx double, xy double")
    total = total.groupBy("_pub", "_ins", "_scale").agg(F.sum("n").alias("n"), F.sum("xx").alias("xx"), F.sum("xy").alias("xy"))
    usable = (F.col("n") >= 30) & (F.col("xx") > 0)
    phi = F.when(usable, F.round(F.least(F.greatest(F.col("xy") / F.col("xx"), F.lit(-p.max_phi)), F.lit(p.max_phi)), 9)).otherwise(0.0)
    sigma = F.when(usable, F.sqrt(F.col("xx") / F.col("n") * (1 - F.col("_phi") * F.col("_phi")))).otherwise(F.col("_scale"))
    sources = written(total.withColumn("_phi", phi).withColumn("_sigma", sigma).select("_pub", "_ins", "_scale", "_phi", "_sigma"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = SpikeParams(**config)
        for batch in batches:
            for k, part in enumerate(batch["_rows"]):
                order, seq, values = _ordered(part.values)
                core = in_core(seq, batch["_blk"][k].as_py())
                flags = _judge(seq, values, core, Source(*(batch[x][k].as_py() for x in ("_scale", "_phi", "_sigma"))), q)
                for reason, flag in zip(("spike", "stuck"), flags):
                    pick = np.flatnonzero(flag & core)
                    if len(pick):
                        n = len(pick)
                        price = lambda v: pa.array(v[pick], pa.float64(), from_pandas=True)
                        whole = part.values.field(len(VALUES)).take(pa.array(order[pick]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch["_pub"][k].as_py()] * n, batch["_pub"].type), pa.array([batch["_ins"][k].as_py()] * n, batch["_ins"].type), pa.array(seq[pick]), *(price(v) for v in values[:4]), whole, pa.array([reason] * n)],
                            names=["_pub", "_ins", "_seq", *VALUES, "reason"],
                        )

    judged = blocks.join(sources, ["_pub", "_ins"]).mapInArrow(judge, f"{key}, _seq bigint, open double, high double, low double, close double, volume bigint, reason string")
    hashed = F.xxhash64(*VALUES).alias("_h")
    flagged = written(judged.select("_pub", "_ins", "_seq", hashed, "reason"))
    # Back to every delivered copy of a flagged version.
    copies = rows.select("_id", "_pub", "_ins", "_seq", hashed).join(flagged, ["_pub", "_ins", "_seq", "_h"]).select("_id", "reason")
    return impossible.unionByName(copies).select(F.col("_id").alias(row_id), "reason")
