"""Queries p1 to p5: the general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.asknown import attach_as_known
from barloom.operators.rejects import accepted, load_records, rejected
from barloom.operators.spikes import implausible_bars
from barloom.operators.tablediff import diff_tables
from barloom.operators.timestamps import normalise_timestamps, utc_text
from barloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instant of every bar and second bar whose text is not already plain UTC."""
    manifests = table(spark, sf_dir, "manifests")

    def of(name: str, row_id: str, column: str, order_by: str) -> DataFrame:
        out = normalise_timestamps(table(spark, sf_dir, name), manifests, column, order_by=order_by, row_id=row_id, plain_utc=False)
        # Every time that occurred has an instant here: of a repeated hour that nothing decides, the likelier.
        instant = F.coalesce("ts_utc", F.get("alternatives", F.lit(0)))
        return out.select(F.lit(name).alias("src"), F.col(row_id).alias("row_id"), F.coalesce(utc_text(instant), F.lit("none")).alias("ts_utc"))

    return of("bars", "bar_id", "timestamp", "seq_no").unionByName(of("second_bars", "row_id", "ts_event", "row_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades whose recorded ATR isn't the one in force at entry, with the right one."""
    recorded = F.nanvl(F.col("atr_value"), F.lit(None).cast("double"))
    trades = table(spark, sf_dir, "trades").select("trade_id", "instrument_id", "entry_time", "atr_source_end", recorded.alias("atr_value")).where(F.col("atr_value").isNotNull())
    atr = table(spark, sf_dir, "atr_4h").withColumn("tr", F.nanvl(F.col("tr"), F.lit(None).cast("double"))).where(F.col("tr").isNotNull())
    held = attach_as_known(
        trades, atr, event_entity="instrument_id", event_time="entry_time", entity="instrument_id", known_at="available_at",
        rank=["source_end", "available_at"], keep=["tr"], row_id="atr_id",
    )
    right = held["in_force"]
    fits = right.isNotNull() & F.coalesce(F.col("atr_source_end") == right["source_end"], F.lit(False)) & (F.abs(F.col("atr_value") - right["tr"]) <= 1e-9)
    return held.where(~fits).select("trade_id", F.coalesce(right["atr_id"], F.lit(-1).cast("bigint")).alias("atr_id")).distinct()


P2_SQL = """
WITH t AS (
  SELECT DISTINCT trade_id, instrument_id, entry_time, atr_source_end, atr_value FROM trades
  WHERE atr_value IS NOT NULL AND CAST(atr_value AS VARCHAR) <> 'nan'
), a AS (SELECT DISTINCT atr_id, instrument_id, source_end, available_at, tr FROM atr_4h WHERE tr IS NOT NULL AND CAST(tr AS VARCHAR) <> 'nan'),
j AS (
  SELECT t.trade_id, t.atr_source_end, t.atr_value,
         max(ROW(a.source_end, a.available_at, a.atr_id, a.tr)) AS r
  FROM t LEFT JOIN a ON a.instrument_id = t.instrument_id AND a.available_at <= t.entry_time
  GROUP BY ALL
), k AS (
  SELECT trade_id, atr_source_end, atr_value, r[1] AS source_end, r[3] AS atr_id, r[4] AS tr FROM j
)
SELECT DISTINCT trade_id, coalesce(atr_id, -1)::BIGINT AS atr_id FROM k
WHERE atr_id IS NULL OR atr_source_end IS NULL OR atr_source_end <> source_end OR abs(atr_value - tr) > 1e-9
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that can't be real for their series."""
    return implausible_bars(table(spark, sf_dir, "bars"), table(spark, sf_dir, "instruments")).select("bar_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't load as bars, with the reason."""
    return rejected(load_records(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "manifests")))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load, typed."""
    return accepted(load_records(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "manifests"))).drop("extra")


P5_FIELDS = ["exit_price", "gross_R", "net_R", "exit_reason", "exit_time"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades missing on either side of the two ledgers, and each differing field of the others."""
    found = diff_tables(table(spark, sf_dir, "trades"), table(spark, sf_dir, "trades_ref"), key="trade_id", fields=P5_FIELDS, version="recorded_at", names=("trades", "trades_ref"))
    only = F.when(F.col("field") == "only_trades", "only_trades").when(F.col("field") == "only_trades_ref", "only_trades_ref").otherwise(F.col("field"))
    return found.select("trade_id", only.alias("field"))


_P5_SIDE = """SELECT trade_id, max(ROW(recorded_at, {})) AS r FROM {} WHERE trade_id IS NOT NULL GROUP BY trade_id"""


def _p5_sql() -> str:
    # NaN is told by its text: the files' statistics leave NaN out, and isnan() is folded by them.
    clean = {"exit_price": 1, "gross_R": 1, "net_R": 1}
    cols = ", ".join(f"CASE WHEN CAST({f} AS VARCHAR) <> 'nan' THEN {f} END" if f in clean else f for f in P5_FIELDS)
    parts = ["SELECT trade_id, 'only_trades' AS field FROM j WHERE b IS NULL", "SELECT trade_id, 'only_trades_ref' AS field FROM j WHERE a IS NULL"]
    for i, f in enumerate(P5_FIELDS, 2):
        differs = f"(a[{i}] IS NULL) <> (b[{i}] IS NULL) OR coalesce(abs(a[{i}] - b[{i}]) > 1e-9, false)" if f in clean else f"a[{i}] IS DISTINCT FROM b[{i}]"
        parts.append(f"SELECT trade_id, '{f}' AS field FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND ({differs})")
    sides = f"a AS ({_P5_SIDE.format(cols, 'trades')}), b AS ({_P5_SIDE.format(cols, 'trades_ref')})"
    return f"WITH {sides}, j AS (SELECT trade_id, a.r AS a, b.r AS b FROM a FULL JOIN b USING (trade_id)) " + " UNION ALL ".join(parts)


def _p3_sql() -> str:
    """The statement's cases over whole series: neighbouring closes are the levels before and after an excursion."""
    off = lambda x, k, n: f"least(abs(lead({x}, {k}) OVER w - lag(close) OVER w), abs(lead({x}, {k}) OVER w - lead(close, {n}) OVER w))"
    strays = lambda k, n: f"greatest({off('high', k, n)}, {off('low', k, n)}, {off('close', k, n)}) > 12 * u"
    starts = ", ".join(f"coalesce({' AND '.join(strays(k, n) for k in range(n))}, false) AS e{n}" for n in (1, 2, 3))
    member = " OR ".join(f"lag(e{n}, {k}, false) OVER w" for n in (1, 2, 3) for k in range(n))
    return f"""
WITH i AS (SELECT instrument_id, max(kind) AS kind, max(tick_size) AS tick FROM instruments GROUP BY 1),
b AS (SELECT bars.*, kind, tick FROM bars LEFT JOIN i USING (instrument_id)),
s AS (SELECT publisher_id, instrument_id, greatest(median(high - low), max(tick)) AS u FROM b GROUP BY 1, 2),
d AS (SELECT DISTINCT publisher_id, instrument_id, seq_no, open, high, low, close, volume, u FROM b JOIN s USING (publisher_id, instrument_id)),
e AS (SELECT *, {starts}, coalesce(open = lag(open) OVER w AND high = lag(high) OVER w AND low = lag(low) OVER w AND close = lag(close) OVER w
    AND volume IS NOT DISTINCT FROM lag(volume) OVER w AND seq_no = lag(seq_no) OVER w + 1, false) AS same
  FROM d WINDOW w AS (PARTITION BY publisher_id, instrument_id ORDER BY seq_no)),
g AS (SELECT *, ({member}) AS stray, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w AS run FROM e WINDOW w AS (PARTITION BY publisher_id, instrument_id ORDER BY seq_no)),
f AS (SELECT publisher_id, instrument_id, seq_no FROM g QUALIFY stray OR count(*) OVER (PARTITION BY publisher_id, instrument_id, run) >= 12)
SELECT bar_id FROM b WHERE (kind = 'outright' AND least(open, high, low, close) <= 0) OR high < low OR open < low OR open > high OR close < low OR close > high
UNION SELECT bar_id FROM b JOIN f USING (publisher_id, instrument_id, seq_no)"""


def _p4_sql(loaded: bool) -> str:
    """Fields by pattern for each delimiter, and the typed rules on the first field that breaks one."""
    full, parts = [], []
    for d in (",", ";", "|", "\t"):
        c = {"|": r"\|", "\t": r"\t"}.get(d, d)
        field = f'"(?:[^"]|"")*"|[^"{c}][^{c}]*|'
        name = "chr(9)" if d == "\t" else f"'{d}'"
        full.append(f"WHEN {name} THEN regexp_full_match(t, '(?s)(?:{field})(?:{c}(?:{field}))*')")
        parts.append(f"WHEN {name} THEN regexp_extract_all({name} || t, '(?s){c}({field})', 1)")
    unquoted = "CASE WHEN starts_with(v, '\"') THEN replace(v[2:-2], '\"\"', '\"') ELSE v END"
    number = r"regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(v AS DOUBLE)), false)"
    whole = r"regexp_full_match(v, '[+]?[0-9]+|-0+') AND TRY_CAST(v AS BIGINT) IS NOT NULL"
    time = r"regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z| ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])') AND left(v, 4) <> '0000' AND TRY_CAST(left(v, 10) AS DATE) IS NOT NULL"
    read = f"""
WITH m AS (SELECT manifest_id, max(delimiter) AS d, json_keys(max(schema_json)::JSON) AS cols FROM manifests WHERE schema_json IS NOT NULL GROUP BY 1),
r AS (SELECT line_id, manifest_id, line_no, d, cols, regexp_replace(line, chr(13) || '$', '') AS t FROM raw_lines JOIN m USING (manifest_id) WHERE line_no > 1),
p AS (SELECT *, CASE d {' '.join(full)} END AS fits, CASE d {' '.join(parts)} END AS f FROM r),
x AS (SELECT line_id, manifest_id, line_no, unnest(cols) AS c, unnest(f) AS v, unnest(range(len(cols))) AS k FROM p WHERE fits AND len(f) = len(cols)),
y AS (SELECT * EXCLUDE (v), u, trim(u, ' ' || chr(9)) AS v FROM (SELECT *, {unquoted} AS u FROM x)),
b AS (SELECT *, NOT CASE WHEN c IN ('open', 'high', 'low', 'close') THEN {number} WHEN c = 'volume' THEN {whole} WHEN c = 'timestamp' THEN {time} ELSE true END AS bad FROM y)"""
    if loaded:
        doubles = ", ".join(f"TRY_CAST(max(v) FILTER (c = '{c}') AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close"))
        return f"""{read} SELECT line_id, any_value(manifest_id) AS manifest_id, any_value(line_no) AS line_no, TRY_CAST(max(left(v, 10) || ' ' || substr(v, 12, 8)) FILTER (c = 'timestamp') AS TIMESTAMP) AS "timestamp",
  max(u) FILTER (c = 'symbol') AS symbol, {doubles}, TRY_CAST(max(v) FILTER (c = 'volume') AS BIGINT) AS volume, max(u) FILTER (c = 'note') AS note FROM b GROUP BY line_id HAVING NOT bool_or(bad)"""
    return f"""{read}, z AS (SELECT line_id, min_by(c, k) AS field FROM b WHERE bad GROUP BY 1)
SELECT line_id, 'quoting' AS reason, '' AS field FROM p WHERE NOT fits
UNION ALL SELECT line_id, 'column_count', '' FROM p WHERE fits AND len(f) <> len(cols)
UNION ALL SELECT line_id, 'bad_value', field FROM z"""


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found}
ORACLES: dict[str, str] = {"p2_found": P2_SQL, "p3_found": _p3_sql(), "p4_found": _p4_sql(False), "p4_loaded": _p4_sql(True), "p5_found": _p5_sql()}
