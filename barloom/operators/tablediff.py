"""Differences between two copies of a keyed dataset, field by field.

Method: content-defined chunking. Each copy is reduced to one narrow row a key
(key, two 64-bit row hashes) before anything wide is moved. Rows sorted by key
are cut into chunks wherever a rolling hash over the last ``window`` keys meets
a condition, so an inserted or missing row changes the chunks around it and no
others. Chunks are compared by fingerprint (first key, count, xor of both
hashes); an anti-join leaves the chunks that differ, and only rows of those
chunks are read again with their fields and compared.

Sorting happens inside buckets, the same in both copies: ranges of integral keys
between quantiles of both copies' keys, so a bucket holds about ``bucket_rows``
rows however the keys are spread; other key types are bucketed and sorted by
hash of the key. The narrow rows and their chunks are written once and read from
then on.

Defined results: whole rows repeated count once; of different rows with one key
the one with the latest ``version`` counts, then the one with the greater
hashes. Null and NaN are both missing, and missing on both sides is equal.
Numbers differ beyond ``atol``; other types differ if not identical. Rows with
a null key can't be matched and are left out. Empty tables work. Output:
``key``, ``field``, ``left_value``, ``right_value`` as text; a key missing on
one side gives one row with the field ``only_<name of the other copy>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import written


@dataclass(frozen=True)
class DiffParams:
    atol: float = 1e-9
    window: int = 4  # keys in the rolling hash
    mean_chunk: int = 16  # a row starts a chunk with probability 1 / mean_chunk
    bucket_rows: int = 65_536
    max_ranges: int = 4_096  # of integral keys; more rows make larger buckets, which are sorted with spilling


def _canonical(df: DataFrame, field: str, atol: float) -> Column:
    """Equal results imply equal under the rules above; the converse may fail and only costs a look at the fields."""
    kind, c = df.schema[field].dataType, F.col(field)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        # Values of one cell of this width differ by less than atol; far from zero the cell is the value itself.
        c = F.when(F.abs(c) < 1e6, F.floor(c / (atol or 1e-300)).cast("double")).otherwise(c) if atol else c
        return F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c


def _bucket(sides: list[DataFrame], params: DiffParams) -> Column:
    """Bucket of ``_key``, sized by the rows of the larger side."""
    kind = sides[0].schema["_key"].dataType
    want = max(1, -(-max(x.count() for x in sides) // params.bucket_rows))
    if not isinstance(kind, T.IntegralType):
        return F.pmod(F.xxhash64(F.col("_key")), F.lit(want)).cast("bigint")
    want = min(want, params.max_ranges)
    if want == 1:
        return F.lit(0).cast("bigint")
    keys = sides[0].select("_key").unionByName(sides[1].select("_key"))
    bounds = keys.agg(F.percentile_approx(F.col("_key").cast("bigint"), [k / want for k in range(1, want)], 20 * want)).first()[0]
    bounds = sorted(set(bounds or []))
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    # Number of bounds at or below the key, bit by bit.
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, k: F.when(F.coalesce(F.get(held, at + k - 1) <= F.col("_key"), F.lit(False)), at + k).otherwise(at)).cast("bigint")


def _narrow(df: DataFrame, key: str, fields: list[str], version: str | None, params: DiffParams) -> DataFrame:
    canon = [_canonical(df, f, params.atol) for f in fields]
    hashes = F.struct(
        *([F.col(version).alias("_v")] if version else []),
        F.xxhash64(F.col(key), *[F.struct(c) for c in canon]).alias("_h1"),
        F.xxhash64(F.lit("second"), *[F.struct(c) for c in canon], F.col(key)).alias("_h2"),
    )
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), hashes.alias("_r"))
    return rows.groupBy("_key").agg(F.max("_r").alias("_r"))


def _chunks(narrow: DataFrame, bucket: Column, params: DiffParams) -> DataFrame:
    kind = narrow.schema["_key"].dataType
    order = [F.col("_key")] if isinstance(kind, T.IntegralType) else [F.xxhash64("_key"), F.col("_key")]
    w = Window.partitionBy("_b").orderBy(*order)
    rolling = F.xxhash64(*[F.lag("_key", i).over(w) for i in range(params.window)])
    cut = F.when((F.row_number().over(w) == 1) | (F.pmod(rolling, F.lit(params.mean_chunk)) == 0), 1).otherwise(0)
    return narrow.withColumn("_b", bucket).withColumn("_cut", cut).withColumn("_chunk", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _prints(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("_b", "_chunk").agg(
        F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.count("*").alias("_n"),
        F.bit_xor(F.col("_r._h1")).alias("_x1"), F.bit_xor(F.col("_r._h2")).alias("_x2"),
    )


def unmatched_rows(left: DataFrame, right: DataFrame, key: str, fields: list[str], version: str | None = None, params: DiffParams = DiffParams()) -> tuple[DataFrame, DataFrame]:
    """Keys and hashes of the rows, on either side, that lie in chunks without an equal chunk on the other side."""
    sides = [written(_narrow(x, key, fields, version, params)) for x in (left, right)]
    bucket = _bucket(sides, params)
    a, b = (written(_chunks(x, bucket, params)) for x in sides)
    pa, pb = _prints(a), _prints(b)
    same = ["_b", "_lo", "_hi", "_n", "_x1", "_x2"]
    out = []
    for chunks, own, other in ((a, pa, pb), (b, pb, pa)):
        odd = own.join(other.select(*same), same, "left_anti").select("_b", "_chunk")
        out.append(chunks.join(odd, ["_b", "_chunk"], "left_semi").select("_key", F.col("_r._h1").alias("_h1"), F.col("_r._h2").alias("_h2")))
    return out[0], out[1]


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    fields: list[str],
    version: str | None = None,
    names: tuple[str, str] = ("left", "right"),
    params: DiffParams = DiffParams(),
) -> DataFrame:
    """Columns ``key``, ``field``, ``left_value``, ``right_value``; see the module's text."""
    odd_left, odd_right = unmatched_rows(left, right, key, fields, version, params)
    # Rows that are equal on both sides but share a chunk with a difference drop out by their hashes.
    hl, hr = (x.select("_key", "_h1", "_h2") for x in (odd_left, odd_right))
    keys = written(hl.withColumn("_s", F.lit(1)).unionByName(hr.withColumn("_s", F.lit(2))).groupBy("_key").agg(
        F.max(F.when(F.col("_s") == 1, F.struct("_h1", "_h2"))).alias("_l"), F.max(F.when(F.col("_s") == 2, F.struct("_h1", "_h2"))).alias("_r")
    ).where(~F.col("_l").eqNullSafe(F.col("_r"))))

    def wide(df: DataFrame, side: str) -> DataFrame:
        canon = [F.struct(_canonical(df, f, params.atol)) for f in fields]
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)], F.xxhash64(F.col(key), *canon).alias("_h1"))
        wanted = keys.where(F.col(side).isNotNull()).select("_key", F.col(side)["_h1"].alias("_h1"))
        return rows.join(wanted, ["_key", "_h1"], "left_semi").groupBy("_key").agg(F.max(F.struct(*[f"_f{i}" for i in range(len(fields))])).alias(side))

    both = wide(left, "_l").join(wide(right, "_r"), "_key", "full")
    found = []
    for i, f in enumerate(fields):
        kind = left.schema[f].dataType
        a, b = F.col("_l")[f"_f{i}"], F.col("_r")[f"_f{i}"]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            a, b = (F.nanvl(x.cast("double"), F.lit(None).cast("double")) for x in (a, b))
            differs = (a.isNull() != b.isNull()) | F.coalesce((F.abs(a - b) > params.atol) & (a != b), F.lit(False))
        else:
            differs = ~a.eqNullSafe(b)
        found.append(F.when(differs, F.struct(F.lit(f).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))))
    none = F.lit(None).cast("string")
    only = lambda name: F.array(F.struct(F.lit(f"only_{name}").alias("field"), none.alias("left_value"), none.alias("right_value")))
    rows = F.when(F.col("_r").isNull(), only(names[0])).when(F.col("_l").isNull(), only(names[1])).otherwise(F.array_compact(F.array(*found)))
    return both.select(F.col("_key").alias(key), F.inline(rows))
