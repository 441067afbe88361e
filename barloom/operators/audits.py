"""Audits of ledgers, contract selections, execution and causality, as findings.

A finding is one row: ``check, status, message, rows, family, evidence``.
Checks are one aggregation over the audited table; ``rows`` holds up to twenty
offending row numbers, kept small inside the aggregation by ``first_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.market import close_enough
from barloom.operators.bars import beside, resample

FINDING = "check string, status string, message string, rows array<bigint>, family string, evidence string, classification string"
# Verdicts.
VERIFIED, FAILED, INCOMPLETE = "VERIFIED", "FAILED", "INCOMPLETE / UNVERIFIED"
PROVEN = "PROVEN FAILURE"
EVIDENCE = 20
REASON_FORCED = r"(?i)FLAT|FORCED|TIME"


def findings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (check, status, message[, rows, family, evidence, classification])."""
    return spark.createDataFrame([tuple([*r, *[None] * (7 - len(r))]) for r in rows], FINDING)


def complete(found: DataFrame) -> DataFrame:
    """All columns of a finding in order; null where the audit gives none."""
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None).cast(kind)).alias(c) for c, kind in (x.split() for x in FINDING.split(", "))])


def together(*frames: DataFrame) -> DataFrame:
    out, *rest = (complete(f) for f in frames)
    for f in rest:
        out = out.unionByName(f)
    return out


def _unpivot(counts: DataFrame, checks: list[tuple[str, str, str, str]], family: str) -> DataFrame:
    """``checks``: (check, count column, status if above zero, message)."""
    parts = []
    for check, column, bad, message in checks:
        n = F.coalesce(F.col(column).cast("bigint"), F.lit(0))
        parts.append(F.struct(
            F.lit(check).alias("check"), F.when(n > 0, bad).otherwise("PASS").alias("status"), F.when(n > 0, F.concat(F.lit(message + ": "), n.cast("string"), F.lit(" rows"))).otherwise("ok").alias("message"),
            (F.coalesce(F.col(f"{column}_rows"), F.array().cast("array<bigint>")) if f"{column}_rows" in counts.columns else F.array().cast("array<bigint>")).alias("rows"),
            F.lit(family).alias("family"), F.to_json(F.struct(n.alias("count"))).alias("evidence"),
        ))
    return counts.select(F.inline(F.array(*parts)))


def first_rows(bad: Column, row: str) -> Column:
    """The first offending row numbers."""
    return F.slice(F.sort_array(F.collect_list(F.when(bad, F.col(row)))), 1, EVIDENCE)


def _bounded(df: DataFrame, bad: dict[str, Column], row: str) -> DataFrame:
    """Counts, and the first row numbers, of each condition: lists are cut per chunk of rows before they meet."""
    chunk = F.floor(F.col(row) / 65_536)
    parts = df.select(chunk.alias("_c"), F.col(row).alias("_r"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in bad.items()])
    small = parts.groupBy("_c").agg(*[F.count_if(F.col(k)).alias(k) for k in bad], *[first_rows(F.col(k), "_r").alias(f"{k}_rows") for k in bad])
    # Lists of chunks meet in groups first, so no task holds those of all chunks.
    merged = [F.slice(F.sort_array(F.flatten(F.collect_list(F.when(F.size(f"{k}_rows") > 0, F.col(f"{k}_rows"))))), 1, EVIDENCE).alias(f"{k}_rows") for k in bad]
    small = small.groupBy(F.floor(F.col("_c") / 512)).agg(*[F.sum(k).alias(k) for k in bad], *merged)
    near = small.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in bad], *[F.slice(F.sort_array(F.flatten(F.collect_list(F.when(F.size(f"{k}_rows") > 0, F.col(f"{k}_rows"))))), 1, EVIDENCE).alias(f"{k}_rows") for k in bad])
    return near


def audit_bars(bars: DataFrame, *, ts: str = "bar_ts", row: str = "row", contract: str | None = None) -> DataFrame:
    """Findings on times, schema, finite cells, geometry, positive prices, volume and contracts."""
    from barloom.operators.bars import PRICES, _previous, geometry_broken
    from barloom.functions.market import finite

    spark = bars.sparkSession
    missing = [c for c in PRICES if c not in bars.columns]
    if missing:
        return findings(spark, [("ohlc_schema", "FAIL", f"missing columns: {missing}", None, "data_audit")])
    cells = [finite(F.col(c).cast("double")) for c in [*PRICES, *(["volume"] if "volume" in bars.columns else [])]]
    odd = cells[0].isNull()
    for c in cells[1:]:
        odd = odd | c.isNull()
    dup = bars.groupBy(ts).agg(F.count("*").alias("_k"))
    ordered = _previous(bars, ts, row, [])
    counts = _bounded(ordered, {
        "parse": F.col(ts).isNull(), "order": F.col(ts) < F.col("_prev"), "odd": odd, "geometry": geometry_broken(),
        "nonpositive": F.least(*cells[:4]) <= 0, "negative": (F.col("volume") < 0) if "volume" in bars.columns else F.lit(False),
    }, row)
    counts = beside(counts, dup.agg(F.coalesce(F.sum(F.when(F.col(ts).isNotNull(), F.col("_k") - 1)), F.lit(0)).alias("dup")))
    whole = counts.withColumn("geometry", F.when(F.col("odd") == 0, F.col("geometry"))).withColumn("nonpositive", F.when(F.col("odd") == 0, F.col("nonpositive")))
    out = _unpivot(whole, [
        ("timestamps_parse", "parse", "FAIL", "times that don't parse"), ("timestamps_monotonic", "order", "FAIL", "times before the previous row's"), ("timestamps_unique", "dup", "FAIL", "repeated times"),
        ("ohlc_finite", "odd", "FAIL", "cells that aren't finite numbers"), ("ohlc_geometry", "geometry", "FAIL", "prices outside low and high"), ("ohlc_positive", "nonpositive", "FAIL", "prices of zero or less"),
        *([("volume", "negative", "FAIL", "negative volume")] if "volume" in bars.columns else []),
    ], "data_audit")
    extra = [("timestamps_timezone", "PASS" if dict(bars.dtypes)[ts] == "timestamp" else "FAIL", f"time column is {dict(bars.dtypes)[ts]}", None, "data_audit"), ("ohlc_schema", "PASS", "all price columns present", None, "data_audit")]
    if "volume" not in bars.columns:
        extra.append(("volume", "WARN", "no volume column", None, "data_audit"))
    if not contract:
        extra.append(("contract_provenance", "UNVERIFIED", "no contract column", None, "contract_provenance"))
        return together(out, findings(spark, extra))
    ids = bars.groupBy(ts).agg(F.count_distinct(contract).alias("_n"))
    switches = _previous(bars.withColumn("_cid", F.col(contract)), "_cid", row, [])
    more = beside(
        bars.agg(F.count_if(F.col(contract).isNull()).alias("lost")), ids.agg(F.count_if(F.col("_n") > 1).alias("several")),
        switches.agg(F.count_if(F.coalesce(F.col("_prev") != F.col(contract), F.lit(False))).alias("switched")),
    )
    more = _unpivot(more, [("contract_id_missing", "lost", "FAIL", "missing contract ids"), ("contract_multiple_per_timestamp", "several", "FAIL", "times with several contracts"), ("contract_switches", "switched", "INFO", "changes of contract")], "contract_provenance")
    return together(out, more, findings(spark, extra))


LEDGER_COLUMNS = ("entry_time", "exit_time", "entry_price", "exit_price")


def audit_ledger(trades: DataFrame, *, row: str = "row", strict_reentry: bool = True, tick: float | None = None, long_only: bool | None = None, required_deadline: bool = False) -> DataFrame:
    """Findings on a trade ledger. Optional checks run where their columns exist; overlap is checked against the adjacent earlier trade."""
    spark, have = trades.sparkSession, set(trades.columns)
    required = [*LEDGER_COLUMNS, *(["deadline"] if required_deadline else []), *(["direction"] if long_only else [])]
    missing = [c for c in required if c not in have]
    if missing:
        return findings(spark, [("ledger_schema", "FAIL", f"missing columns: {missing}", None, "ledger")])
    # Overlap looks at neighbours in (entry, exit) order: months are ordered apart, and a month meets the last trade of the one before.
    month = F.date_trunc("month", F.col("entry_time"))
    t = trades.withColumn("_m", month)
    order = F.struct("entry_time", "exit_time", row)
    w = Window.partitionBy("_m").orderBy("entry_time", "exit_time", row)
    ends = t.where(F.col("_m").isNotNull()).groupBy("_m").agg(F.max_by("exit_time", order).alias("_end"))
    ends = ends.select("_m", F.lag("_end").over(Window.orderBy("_m")).alias("_carry"))  # one row a month
    t = t.join(ends, "_m", "left").withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag("exit_time").over(w)))
    fin = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    bad: dict[str, Column] = {
        "ledger_timestamps": F.col("entry_time").isNull() | F.col("exit_time").isNull(),
        "exit_after_entry": F.col("exit_time") < F.col("entry_time"),
        "one_global_position": (F.col("entry_time") <= F.col("_prev")) if strict_reentry else (F.col("entry_time") < F.col("_prev")),
        "trade_prices": ~fin("entry_price") | ~fin("exit_price") | (F.col("entry_price") <= 0) | (F.col("exit_price") <= 0),
    }
    if "signal_time" in have:
        bad["entry_after_signal"] = F.col("entry_time") <= F.col("signal_time")
    if "deadline" in have:
        bad["deadline"] = F.col("exit_time") > F.col("deadline")
    if "atr_source_end" in have:
        bad["atr_causality"] = F.col("atr_source_end") > F.col("entry_time")
    if "initial_risk" in have:
        bad["initial_risk"] = ~fin("initial_risk") | (F.col("initial_risk") <= 0)
    if {"gross_R", "cost_R", "net_R"} <= have:
        bad["r_accounting"] = ~close_enough(F.col("gross_R") - F.col("cost_R"), F.col("net_R"), 1e-9, equal_null=False)
    if tick:
        for c in ("stop_price", "target_price"):
            if c in have:
                bad[f"{c}_tick_alignment"] = ~close_enough(F.round(F.col(c) / tick) * tick, F.col(c), 1e-9, equal_null=False)
    if long_only is not False and "direction" in have:
        bad["long_only"] = ~F.coalesce(F.lower(F.col("direction").cast("string")).isin("long", "1", "buy"), F.lit(False))
    counts = beside(_bounded(t, bad, row), trades.agg(F.count("*").alias("_trades")))
    out = _unpivot(counts, [(k, k, "FAIL", k.replace("_", " ") + " violated") for k in bad], "ledger")
    n = counts.select(F.lit("trade_count").alias("check"), F.lit("INFO").alias("status"), F.concat(F.col("_trades").cast("string"), F.lit(" trades")).alias("message"),
                      F.array().cast("array<bigint>").alias("rows"), F.lit("ledger").alias("family"), F.to_json(F.struct(F.col("_trades").alias("count"))).alias("evidence"))
    return together(findings(spark, [("ledger_schema", "PASS", "all required columns present", None, "ledger")]), out, n)


# Columns of a ledger that are compared.
RECONCILED = ("signal_time", "entry_time", "entry_price", "atr_source_start", "atr_source_end", "atr_value", "stop_price", "target_price", "initial_risk", "deadline", "exit_time", "exit_price", "exit_reason", "gross_R", "cost_R", "net_R")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``_rn`` from 1 in ``order``: counts per day of the leading time column, then row numbers within a day."""
    from barloom.operators.blocks import with_positions

    return with_positions(df.withColumn("_all", F.lit(1)), ["_all"], order[0], order[1:]).withColumn("_rn", F.col("_pos") + 1).drop("_pos", "_all")


def beside_counts(frames: dict[str, DataFrame], *more: DataFrame) -> DataFrame:
    """Row counts by name, beside frames of one row each."""
    return beside(*[f.agg(F.count("*").alias(n)) for n, f in frames.items()], *more)


def compared(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], atol: float = 1e-9) -> DataFrame:
    """``keys`` and per column whether the row differs: numbers (and booleans) beyond ``atol``, others as text; rows missing on one side differ."""
    kinds = dict(a.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c] in ("double", "float", "int", "bigint", "smallint", "boolean") or kinds[c].startswith("decimal"):
            x, y = x.cast("double"), y.cast("double")
            same = close_enough(F.nanvl(x, F.lit(None).cast("double")), F.nanvl(y, F.lit(None).cast("double")), atol)
        else:
            same = x.cast("string").eqNullSafe(y.cast("string"))
        return F.col("a._there").isNull() | F.col("b._there").isNull() | ~same

    left, right = (x.select(*keys, *columns).withColumn("_there", F.lit(True)) for x in (a, b))
    joined = left.alias("a").join(right.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[differs(c).alias(c) for c in columns])


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], atol: float = 1e-9) -> DataFrame:
    """Per column the number of rows that differ; compared by the position ``_rn``, also the first of them."""
    flagged = compared(a, b, keys, columns, atol)
    if keys != ["_rn"]:
        counts = flagged.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])
        return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in columns])))
    counts = _bounded(flagged, {c: F.col(c) for c in columns}, "_rn")
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches"), F.col(f"{c}_rows").alias("rows")) for c in columns])))


def reconcile_ledgers(candidate: DataFrame, reference: DataFrame, *, columns: list[str] | None = None, order: list[str] = ["entry_time"], atol: float = 1e-9) -> DataFrame:
    """Findings of family ``reference_reconciliation``: one for the whole, and one for each column with its mismatching rows by position."""
    spark, family = candidate.sparkSession, "reference_reconciliation"
    columns = [c for c in (columns or RECONCILED) if c in reference.columns]
    missing = [c for c in columns if c not in candidate.columns]
    if missing:
        return findings(spark, [(family, "FAIL", f"missing columns: {missing}", None, family)])
    a, b = numbered(candidate, order), numbered(reference, order)
    counts = beside(a.agg(F.count("*").alias("x")), b.agg(F.count("*").alias("y")))
    per = compare_rows(a, b, ["_rn"], columns, atol)
    none = F.array().cast("array<bigint>")
    rows = per.select(F.concat(F.lit("reference_"), "column").alias("check"), F.when(F.col("mismatches") > 0, "FAIL").otherwise("PASS").alias("status"), F.format_string("%d mismatches", "mismatches").alias("message"),
                      "rows", F.lit(family).alias("family"), F.to_json(F.struct("mismatches")).alias("evidence"), F.when(F.col("mismatches") > 0, PROVEN).alias("classification"))
    bad = beside(counts, per.agg(F.count_if(F.col("mismatches") > 0).alias("z")))
    whole = F.when(F.col("x") != F.col("y"), F.format_string("trade count mismatch: %d and %d", "x", "y")).when(F.col("z") > 0, F.format_string("%d columns differ", "z")).otherwise(F.format_string(f"%d trades agree in {len(columns)} columns", "x"))
    total = bad.select(F.lit(family).alias("check"), F.when((F.col("x") == F.col("y")) & (F.col("z") == 0), "PASS").otherwise("FAIL").alias("status"), whole.alias("message"), none.alias("rows"), F.lit(family).alias("family"))
    return together(total, rows)


def selection_counts(selected: DataFrame, expected: DataFrame, *, ts: str = "timestamp", contract: str = "contract_id", expected_contract: str = "expected_contract_id") -> DataFrame:
    """One row: overlapping rows, wrong contracts, expected times never selected, members of repeated selections."""
    s = selected.select(F.col(ts).alias("_t"), F.col(contract).cast("string").alias("_c"))
    e = expected.select(F.col(ts).alias("_t"), F.col(expected_contract).cast("string").alias("_e"))
    both = s.join(e, "_t").agg(F.count("*").alias("overlap"), F.count_if(~F.col("_c").eqNullSafe(F.col("_e"))).alias("wrong_contract"))
    absent = e.join(s.select("_t").distinct(), "_t", "left_anti").agg(F.count("*").alias("not_selected"))
    twice = s.groupBy("_t").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"))
    return beside(both, absent, twice)


def audit_selection_map(selected: DataFrame, expected: DataFrame, **names: str) -> DataFrame:
    c = selection_counts(selected, expected, **names)
    c = c.withColumn("wrong_contract", F.when(F.col("overlap") == 0, F.greatest(F.col("wrong_contract"), F.lit(1))).otherwise(F.col("wrong_contract")))
    return _unpivot(c, [("roll_selection", "wrong_contract", "FAIL", "wrong contract, or nothing overlaps"), ("roll_selection_coverage", "not_selected", "FAIL", "expected times never selected"), ("roll_duplicate_selection", "duplicate_rows", "FAIL", "times selected more than once")], "contract_provenance")


def contract_switches(selected: DataFrame, *, ts: str = "timestamp", contract: str = "contract_id", row: str | None = None) -> DataFrame:
    """``ts``, ``old``, ``new`` of every change; the first row is none."""
    from barloom.operators.blocks import in_blocks, with_positions

    rows = in_blocks(with_positions(selected.withColumn("_all", F.lit(1)), ["_all"], ts, [row] if row else [contract]), 65_536, back=1)
    old = F.lag(contract).over(Window.partitionBy("_block").orderBy("_pos"))
    return rows.withColumn("old", old).where(F.col("_core") & F.col("old").isNotNull() & (F.col("old") != F.col(contract))).select(ts, "old", F.col(contract).alias("new"))


def expired_rows(selected: DataFrame, expiry: DataFrame, *, ts: str = "timestamp", contract: str = "contract_id") -> DataFrame:
    """Rows at or after their contract's ``expiry``."""
    return selected.join(expiry.select(F.col(contract), F.col("expiry")), contract, "left").where(F.col(ts) >= F.col("expiry"))


def audit_contract_timeline(selected: DataFrame, *, ts: str = "timestamp", contract: str = "contract_id", permitted_switch=None, expiry: DataFrame | None = None) -> DataFrame:
    """``permitted_switch``: (ts, old, new) -> bool, called for switch rows only."""
    spark = selected.sparkSession
    lost = selected.agg(F.count_if(F.col(contract).isNull()).alias("lost"))
    dup = selected.groupBy(ts).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("dup"))
    switches = contract_switches(selected, ts=ts, contract=contract)
    frames, checks, extra = [lost, dup, switches.agg(F.count("*").alias("switched"))], [("contract_timeline_missing", "lost", "FAIL", "missing contract ids"), ("contract_timeline_duplicates", "dup", "FAIL", "repeated times"), ("contract_switches", "switched", "INFO", "changes of contract")], []
    if permitted_switch is None:
        extra.append(("roll_policy", "UNVERIFIED", "no roll policy given", None, "contract_provenance"))
    else:
        allowed = F.udf(lambda t, a, b: bool(permitted_switch(t, a, b)), "boolean")
        frames.append(switches.agg(F.count_if(~allowed(F.col(ts), F.col("old"), F.col("new"))).alias("forbidden")))
        checks.append(("roll_policy", "forbidden", "FAIL", "switches outside the policy"))
    if expiry is not None:
        frames.append(expired_rows(selected, expiry, ts=ts, contract=contract).agg(F.count("*").alias("expired")))
        checks.append(("expired_contract", "expired", "FAIL", "rows of expired contracts"))
    out = _unpivot(beside(*frames), checks, "contract_provenance")
    return together(out, findings(spark, extra)) if extra else out


def compare_independent_selector(raw: DataFrame, selected: DataFrame, selector=None, **names: str) -> DataFrame:
    """``selector``: raw bars -> (timestamp, expected_contract_id), or None."""
    if selector is None:
        return findings(raw.sparkSession, [("independent_selector", "UNVERIFIED", "no independent selector", None, "contract_provenance")])
    return audit_selection_map(selected, selector(raw), **names)


AMBIGUOUS = ("SL_OPEN", "TP_OPEN", "SL", "TP", "STILL_AMBIGUOUS", "DATA_UNAVAILABLE")


def ambiguous_trades(trades: DataFrame, coarse: DataFrame, *, keys: list[str] | None = None, interval: str = "1 minute", ts: str = "bar_ts") -> DataFrame:
    """Trades whose exit bar opened inside the bracket and touched both sides of it; ``coarse_bar_time`` is that bar."""
    from barloom.functions.market import bucket

    keys = keys or []
    t = trades.withColumn("coarse_bar_time", bucket(F.col("exit_time"), interval))
    first = coarse.groupBy(*keys, F.col(ts).alias("coarse_bar_time")).agg(*[F.min_by(c, F.struct(*["open", "high", "low", "close"])).alias(f"_{c}") for c in ("open", "high", "low")])
    hit = t.join(first, [*keys, "coarse_bar_time"])
    stop, target = F.col("stop_price"), F.col("target_price")
    return hit.where((F.col("_open") > stop) & (F.col("_open") < target) & (F.col("_low") <= stop) & (F.col("_high") >= target)).drop("_open", "_high", "_low")


def resolve_ambiguous(ambiguous: DataFrame, fine: DataFrame, *, trade: str, keys: list[str] | None = None, interval: str = "1 minute", ts: str = "bar_ts") -> DataFrame:
    """First event of each ambiguous trade in the finer bars of its coarse bar: ``trade``, ``classification``, ``event_time``.

    Fine and coarse bars meet by equality of the coarse bucket, so no range is
    scanned; a literal range of all windows prunes the fine table's files.
    """
    from barloom.functions.market import bucket

    keys = keys or []
    o, h, lo = F.col("open"), F.col("high"), F.col("low")
    event = (
        F.when(o <= F.col("stop_price"), "SL_OPEN").when(o >= F.col("target_price"), "TP_OPEN")
        .when((lo <= F.col("stop_price")) & (h >= F.col("target_price")), "STILL_AMBIGUOUS")
        .when(lo <= F.col("stop_price"), "SL").when(h >= F.col("target_price"), "TP")
    )
    inner = fine.withColumn("coarse_bar_time", bucket(F.col(ts), interval)).select(*keys, "coarse_bar_time", F.col(ts).alias("_ts"), "open", "high", "low")
    joined = ambiguous.select(trade, *keys, "coarse_bar_time", "stop_price", "target_price").join(inner, [*keys, "coarse_bar_time"], "left")
    found = joined.withColumn("_e", event).groupBy(trade).agg(F.min(F.when(F.col("_e").isNotNull(), F.struct("_ts", "_e"))).alias("_f"))
    return found.select(trade, F.coalesce(F.col("_f._e"), F.lit("DATA_UNAVAILABLE")).alias("classification"), F.col("_f._ts").alias("event_time"))


def audit_high_resolution(trades: DataFrame, coarse: DataFrame, fine: DataFrame, *, trade: str, keys: list[str] | None = None, interval: str = "1 minute") -> DataFrame:
    """PASS unless a trade has no fine data; trades that stay ambiguous don't fail."""
    resolved = resolve_ambiguous(ambiguous_trades(trades, coarse, keys=keys, interval=interval), fine, trade=trade, keys=keys, interval=interval)
    counts = resolved.agg(*[F.count_if(F.col("classification") == c).alias(c) for c in AMBIGUOUS])
    return counts.select(
        F.lit("high_resolution_execution").alias("check"), F.when(F.col("DATA_UNAVAILABLE") > 0, "UNVERIFIED").otherwise("PASS").alias("status"),
        F.to_json(F.struct(*AMBIGUOUS)).alias("message"), F.array().cast("array<bigint>").alias("rows"), F.lit("high_resolution").alias("family"), F.to_json(F.struct(*AMBIGUOUS)).alias("evidence"),
    )


def compare_aggregation(fine: DataFrame, coarse: DataFrame, *, keys: list[str], interval: str = "1 minute", atol: float = 1e-9) -> DataFrame:
    """Fine bars resampled against coarse bars on (time, keys): compared rows and mismatches of each column."""
    columns = ["open", "high", "low", "close", "volume"]
    a = resample(fine, interval, keys=keys).select(*keys, "bar_ts", *[F.col(c).alias(f"a_{c}") for c in columns])
    joined = a.join(coarse.select(*keys, "bar_ts", *columns), [*keys, "bar_ts"])
    return joined.agg(F.count("*").alias("compared"), *[F.count_if(~close_enough(F.col(f"a_{c}").cast("double"), F.col(c).cast("double"), atol)).alias(f"{c}_mismatches") for c in columns])


def audit_aggregation(fine: DataFrame, coarse: DataFrame, *, keys: list[str], interval: str = "1 minute", atol: float = 1e-9) -> DataFrame:
    """Finding ``high_resolution_aggregation``: whether the fine bars make up the coarse ones."""
    c = compare_aggregation(fine, coarse, keys=keys, interval=interval, atol=atol)
    bad = sum((F.col(x) for x in c.columns if x.endswith("_mismatches")), F.lit(0))
    status = F.when(F.col("compared") == 0, "UNVERIFIED").when(bad > 0, "FAIL").otherwise("PASS")
    return complete(c.select(F.lit("high_resolution_aggregation").alias("check"), status.alias("status"), F.format_string("%d bars compared, %d cells differ", "compared", bad.cast("bigint")).alias("message"), F.lit("high_resolution").alias("family"), F.to_json(F.struct(*c.columns)).alias("evidence")))


def verdict(found: DataFrame, mandatory: list[str] | None = None) -> DataFrame:
    """One row ``verdict``: FAILED, INCOMPLETE or VERIFIED. A mandatory name matches a finding's family or check; the family defaults to the check."""
    status = F.col("status")
    if not mandatory:
        s = found.agg(F.count_if(status == "FAIL").alias("f"), F.count_if(status.isin("UNVERIFIED", "WARN")).alias("u"))
        return s.select(F.when(F.col("f") > 0, FAILED).when(F.col("u") > 0, INCOMPLETE).otherwise(VERIFIED).alias("verdict"))
    named = found.select("status", F.explode(F.array_distinct(F.array(F.coalesce("family", "check"), "check"))).alias("_name")).where(F.col("_name").isin(mandatory))
    per = named.groupBy("_name").agg(F.bool_or(status == "FAIL").alias("f"), F.bool_or(status.isin("UNVERIFIED", "WARN")).alias("u"), F.bool_or(status.isin("PASS", "INFO")).alias("p"))
    s = per.agg(F.count_if("f").alias("f"), F.count_if(F.col("u") | ~F.col("p")).alias("u"), F.count("*").alias("n"))
    return s.select(F.when(F.col("f") > 0, FAILED).when((F.col("u") > 0) | (F.col("n") < len(set(mandatory))), INCOMPLETE).otherwise(VERIFIED).alias("verdict"))


def ledger_hash(trades: DataFrame, columns: list[str] = list(RECONCILED)) -> DataFrame:
    """One row: sha256 of the ledger as CSV with a header, doubles with nine decimals, times with their offset, lines ended by a line feed, in order of entry.

    Lines are hashed as one text, so this is for ledgers, not for bars.
    """
    kinds = dict(trades.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            value = F.round(F.col(c), 9)
            return F.when(value.isNull() | F.isnan(value), "").otherwise(F.format_string("%.9f", value))
        if kinds[c].startswith("timestamp"):
            shown = F.substring(F.col(c).cast("string"), 1, 19)
            return F.when(F.col(c).isNull(), "").otherwise(F.concat(shown, F.lit("+00:00")))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    line = F.array_join(F.array(*[text(c) for c in columns]), ",")
    lines = trades.agg(F.array_sort(F.collect_list(F.struct("entry_time", line.alias("_l")))).alias("_s"))
    body = F.array_join(F.concat(F.array(F.lit(",".join(columns))), F.transform("_s", lambda s: s["_l"])), "\n")
    return lines.select(F.sha2(F.concat(body, F.lit("\n")), 256).alias("ledger_hash"))
