"""Queries over bars built from ``events``, and over the ledgers computed from them, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import market as M
from barloom.operators import audits as A
from barloom.operators import bars as B
from barloom.operators import causality as C
from barloom.operators import indicators as I
from barloom.operators import trading as T
from barloom.params import IN_SAMPLE, OUT_OF_SAMPLE, StrategyParams
from barloom.session import cut_lineage, table

#: The test stream is too calm for the frozen threshold; the operators take it as a parameter.
P = StrategyParams(z_threshold=2.0, keltner_max=99.0)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, d: str, interval: str = "1 minute") -> DataFrame:
    return B.bars_from_events(table(spark, d, "events"), interval).withColumn(I.SERIES, F.lit("all"))


def contract_bars(spark: SparkSession, d: str, interval: str = "1 minute") -> DataFrame:
    return B.bars_from_events(table(spark, d, "events"), interval, keys=["event_type"])


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """The raw stream as one-tick bars: contract is the event type, the row number the event id."""
    p = F.lit(100.0) + F.col("value")
    return table(spark, d, "events").select(F.col("ts").alias("bar_ts"), "event_id", "event_type", F.col("user_id").cast("string").alias("symbol"), *[p.alias(c) for c in B.PRICES], F.col("value").cast("bigint").alias("volume"))


# --- SQL building blocks ---------------------------------------------------------------------------


def bars_sql(interval: str = "1 minute", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}time_bucket(INTERVAL '{interval}', ts) AS bar_ts, first(100 + value ORDER BY ts, event_id) AS open, max(100 + value) AS high,
      min(100 + value) AS low, last(100 + value ORDER BY ts, event_id) AS close, count(*) AS volume
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL"""


def local_sql(ts: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


def minute_sql(ts: str, zone: str) -> str:
    w = local_sql(ts, zone)
    return f"(hour({w}) * 60 + minute({w}))"


def class_sql(ts: str) -> str:
    m = minute_sql(ts, M.CHICAGO)
    return f"CASE WHEN {m} >= 1020 OR {m} < 120 THEN 'globex_asia' WHEN {m} < 510 THEN 'london' WHEN {m} < 720 THEN 'ny_am' WHEN {m} < 900 THEN 'ny_pm' WHEN {m} < 960 THEN 'ny_late' ELSE 'maintenance' END"


def permitted_sql(ts: str) -> str:
    m = minute_sql(ts, M.NEW_YORK)
    return f"({m} >= 1080 OR {m} < 900)"


def deadline_sql(ts: str) -> str:
    w = local_sql(ts, M.NEW_YORK)
    return f"CASE WHEN {permitted_sql(ts)} THEN timezone('UTC', timezone('{M.NEW_YORK}', CAST(CAST({w} AS DATE) + CAST(hour({w}) >= 18 AS INTEGER) AS TIMESTAMP) + INTERVAL 15 HOUR)) END"


def eligible_sql(a: str, b: str) -> str:
    return f"({class_sql(a)}) <> 'london' AND {permitted_sql(a)} AND ({class_sql(b)}) <> 'london' AND {permitted_sql(b)} AND ({deadline_sql(a)}) = ({deadline_sql(b)})"


W = P.weights
_FD = " + ".join(f"({w!r}) * lag(x, {k}) OVER w" if k else f"({w!r}) * x" for k, w in enumerate(W))
_F100 = f"(ORDER BY bar_ts ROWS BETWEEN {P.z_window - 1} PRECEDING AND CURRENT ROW)"


def features_sql(interval: str = "1 minute", source: str | None = None) -> str:
    return f"""bars AS ({source or bars_sql(interval)}),
    f1 AS (SELECT *, {_FD} AS fracdiff FROM (SELECT *, ln(close) AS x FROM bars) WINDOW w AS (ORDER BY bar_ts)),
    f2 AS (SELECT *, CASE WHEN count(fracdiff) OVER w = {P.z_window} THEN (fracdiff - avg(fracdiff) OVER w) / nullif(stddev_pop(fracdiff) OVER w, 0) END AS z,
      CASE WHEN count(*) OVER (ORDER BY bar_ts ROWS BETWEEN {P.range_window - 1} PRECEDING AND CURRENT ROW) = {P.range_window}
        THEN avg(high - low) OVER (ORDER BY bar_ts ROWS BETWEEN {P.range_window - 1} PRECEDING AND CURRENT ROW) END AS mean_range
      FROM f1 WINDOW w AS {_F100}),
    f3 AS (SELECT *, lag(z) OVER w AS previous_z, lead(bar_ts) OVER w AS next_ts, lead(open) OVER w AS next_open, row_number() OVER w AS rn FROM f2 WINDOW w AS (ORDER BY bar_ts)),
    f4 AS (SELECT *, coalesce(z >= {P.z_threshold} AND previous_z < {P.z_threshold}, false) AS raw_long_signal FROM f3)"""


_ALPHA = 2.0 / (P.ema_span + 1)
EMA_SQL = f"""e AS (SELECT rn, close AS ema FROM f4 WHERE rn = 1 UNION ALL
      SELECT f.rn, {_ALPHA!r} * f.close + {1 - _ALPHA!r} * e.ema FROM e JOIN f4 f ON f.rn = e.rn + 1),
    f5 AS (SELECT f4.*, e.ema, (close - e.ema) / nullif(mean_range, 0) AS keltner FROM f4 JOIN e USING (rn)),
    f6 AS (SELECT *, raw_long_signal AND coalesce(keltner <= {P.keltner_max}, false) AS passes FROM f5)"""


def candidates_sql(channel: bool, interval: str = "1 minute") -> str:
    """CTEs up to ``cand``, recursive where the channel takes part."""
    base = features_sql(interval)
    source, flag = ("f6", "passes") if channel else ("f4", "raw_long_signal")
    ema = f", {EMA_SQL}" if channel else ""
    k = ", keltner AS signal_keltner" if channel else ""
    return f"""WITH RECURSIVE {base}{ema},
    cand AS (SELECT bar_ts AS signal_time, next_ts AS entry_time, next_open AS entry_price, z AS signal_z, previous_z{k}, {deadline_sql('next_ts')} AS deadline
      FROM {source} WHERE {flag} AND next_ts IS NOT NULL AND {eligible_sql('bar_ts', 'next_ts')})"""


RANGES_SQL = """b4 AS (SELECT time_bucket(INTERVAL '4 hours', bar_ts) AS source_start, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close FROM bars GROUP BY 1),
    tr AS (SELECT *, greatest(high - low, abs(high - previous_close), abs(low - previous_close)) AS tr, source_start + INTERVAL 4 HOUR AS source_end
      FROM (SELECT *, lag(close) OVER (ORDER BY source_start) AS previous_close FROM b4))"""
ATR_SQL = f"""{RANGES_SQL}, atr AS (SELECT c.*, CASE WHEN t.tr > 0 THEN t.source_start END AS atr_source_start, CASE WHEN t.tr > 0 THEN t.source_end END AS atr_source_end, CASE WHEN t.tr > 0 THEN t.tr END AS atr_value
      FROM cand c ASOF LEFT JOIN tr t ON c.entry_time >= t.source_end)"""
BRACKET_SQL = f"""{ATR_SQL}, br AS (SELECT *, entry_price - stop_price AS initial_risk FROM (SELECT *, entry_price - atr_value AS stop_unrounded, ceil((entry_price - atr_value) * 4) / 4 AS stop_price,
      entry_price + 0.5 * atr_value AS target_unrounded, ceil((entry_price + 0.5 * atr_value) * 4) / 4 AS target_price FROM atr WHERE atr_value IS NOT NULL) WHERE entry_price - stop_price > 0)"""
_NY = local_sql("bar_ts", M.NEW_YORK)
SIMULATED_SQL = f"""{BRACKET_SQL},
    keyed AS (SELECT *, CASE WHEN hour({_NY}) = 15 AND minute({_NY}) = 0 THEN bar_ts ELSE {deadline_sql('bar_ts')} END AS deadline FROM bars),
    ends AS (SELECT deadline, bool_or(bar_ts = deadline) AS has_row, max(CASE WHEN bar_ts < deadline THEN bar_ts END) AS last_ts FROM keyed WHERE deadline IS NOT NULL GROUP BY 1),
    ev AS (SELECT br.*, k.bar_ts AS exit_time, CASE WHEN k.bar_ts = k.deadline THEN 'F' WHEN k.open <= stop_price THEN 'A' WHEN k.open >= target_price THEN 'T' WHEN k.low <= stop_price THEN 'S'
        WHEN k.high >= target_price THEN 'T' WHEN NOT has_row AND k.bar_ts = last_ts THEN 'L' END AS e, k.open AS o, k.close AS c
      FROM br JOIN ends USING (deadline) JOIN keyed k ON k.deadline = br.deadline AND k.bar_ts >= br.entry_time),
    sim AS (SELECT * EXCLUDE (e, o, c), CASE e WHEN 'F' THEN o WHEN 'A' THEN o WHEN 'T' THEN target_price WHEN 'S' THEN stop_price ELSE c END AS exit_price,
        CASE e WHEN 'A' THEN 'SL' WHEN 'S' THEN 'SL' WHEN 'T' THEN 'TP' ELSE 'FLAT_1500' END AS exit_reason
      FROM ev WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signal_time ORDER BY exit_time) = 1)"""
_YEAR = f"year({local_sql('entry_time', M.NEW_YORK)})"
ACCEPTED_SQL = f"""{SIMULATED_SQL},
    num AS (SELECT *, row_number() OVER (ORDER BY entry_time) AS n FROM sim),
    walk AS (SELECT n, true AS taken, exit_time AS until FROM num WHERE n = 1 UNION ALL
      SELECT num.n, num.entry_time > walk.until, CASE WHEN num.entry_time > walk.until THEN num.exit_time ELSE walk.until END FROM walk JOIN num ON num.n = walk.n + 1),
    acc AS (SELECT num.* EXCLUDE (n) FROM num JOIN walk USING (n) WHERE taken),
    led AS (SELECT *, gross_R - cost_R AS net_R FROM (SELECT *, CASE exit_reason WHEN 'TP' THEN 0.5 WHEN 'SL' THEN CASE WHEN exit_price < stop_price THEN (exit_price - entry_price) / initial_risk ELSE -1.0 END
        ELSE (exit_price - entry_price) / initial_risk END AS gross_R, cost_points / initial_risk AS cost_R FROM (SELECT *, CASE WHEN {_YEAR} < 2023 THEN 0.0 ELSE 1.0 END AS cost_points, {_YEAR} AS entry_year FROM acc)))"""


def sql_round(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


PRICE_COLS = ["open", "high", "low", "close"]
BRACKET_COLS = ["entry_price", "atr_value", "stop_unrounded", "stop_price", "target_unrounded", "target_price", "initial_risk"]

# --- bars, validation, data audit ------------------------------------------------------------------


@query(f"SELECT bar_ts, {sql_round(PRICE_COLS)}, volume FROM ({bars_sql()})")
def bars_ohlcv(spark, d):
    return rounded(bars(spark, d).select("bar_ts", *PRICE_COLS, "volume"))


@query(f"SELECT event_type, bar_ts, {sql_round(PRICE_COLS)}, volume FROM ({bars_sql('1 minute', 'event_type')})")
def bars_by_contract(spark, d):
    return rounded(contract_bars(spark, d).select("event_type", "bar_ts", *PRICE_COLS, "volume"))


_MINUTE = "TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 MINUTE * seq_no"


def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """The delivered bars, dirt and redelivered rows included, each at the minute of its place in the series; stored in the order of ``bar_id``."""
    start = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq_no").cast("int"), F.lit(0))
    return table(spark, d, "bars").withColumns({"bar_ts": start, "contract": F.concat_ws("/", F.col("publisher_id").cast("string"), F.col("instrument_id").cast("string"))})


_STORED = f"b AS (SELECT *, {_MINUTE} AS ts, concat_ws('/', publisher_id, instrument_id) AS contract FROM bars)"
_BROKEN = "coalesce(high < low OR open < low OR open > high OR close < low OR close > high, false)"


@query(f"""WITH {_STORED}, e AS (SELECT *, lag(ts) OVER (PARTITION BY contract ORDER BY bar_id) AS prev FROM b), k AS (SELECT contract, count(ts) - count(DISTINCT ts) AS dup FROM b GROUP BY 1)
SELECT contract, count(*) AS rows, count(*) FILTER (ts IS NULL) AS empty_timestamp, count(*) FILTER (ts < prev) AS not_chronological, any_value(dup) AS duplicate_timestamp,
  5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume) AS nonfinite, count(*) FILTER (least(open, high, low, close) <= 0) AS nonpositive_price, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (open < low OR open > high) AS open_outside, count(*) FILTER (close < low OR close > high) AS close_outside FROM e JOIN k USING (contract) GROUP BY 1""")
def bar_validation_counts(spark, d):
    return B.validation_counts(stored_bars(spark, d), row="bar_id", keys=["contract"])


_MANIFEST = f"""WITH {_STORED}, t AS (SELECT DISTINCT contract, ts FROM b), g AS (SELECT date_diff('microsecond', lag(ts) OVER (PARTITION BY contract ORDER BY ts), ts) AS step FROM t)
SELECT (SELECT count(*) FROM b) AS rows, (SELECT arg_min(ts, bar_id) FROM b) AS first_timestamp, (SELECT arg_max(ts, bar_id) FROM b) AS final_timestamp,
  (SELECT count(*) FROM b WHERE ts IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR volume < 0 OR {_BROKEN}) AS malformed_rows,
  (SELECT 5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume) FROM b) AS nonfinite_cells,
  (SELECT count(*) FROM b WHERE least(open, high, low, close) <= 0) AS nonpositive_rows, (SELECT count(*) FROM b WHERE volume = 0) AS zero_volume_rows,
  (SELECT count(*) - (SELECT count(*) FROM t) FROM b)::BIGINT AS duplicate_rows,
  (SELECT coalesce(sum(greatest(step // 60000000 - 1, 0)) FILTER (step > 60000000), 0)::BIGINT FROM g) AS missing_intervals,
  (SELECT sum(n - 1)::BIGINT FROM (SELECT count(DISTINCT symbol) AS n FROM b WHERE symbol IS NOT NULL GROUP BY contract)) AS symbol_conflicts,
  (SELECT count(*) FILTER (ts < prev) FROM (SELECT ts, lag(ts) OVER (ORDER BY bar_id) AS prev FROM b)) AS out_of_order"""


@query(_MANIFEST)
def data_audit_counters(spark, d):
    return B.audit_counters(stored_bars(spark, d), 60_000_000, ts="bar_ts", contract="contract", symbol="symbol", row="bar_id", order=True)


@query("SELECT user_id, event_type, count(*) AS members, count(*) - 1 AS beyond_first FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return B.duplicate_keys(table(spark, d, "events"), ["user_id", "event_type"])


_GAPS = "WITH t AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM events), s AS (SELECT *, date_diff('microsecond', prev, ts) AS step FROM t)"


@query(f"{_GAPS} SELECT event_type, count(*) FILTER (step > 60000000) AS gaps, coalesce(sum(greatest(step // 60000000 - 1, 0)) FILTER (step > 60000000), 0)::BIGINT AS missing_intervals FROM s GROUP BY 1")
def missing_intervals(spark, d):
    return B.gaps(ticks(spark, d), 60_000_000, ts="bar_ts", keys=["event_type"])


@query(f"{_GAPS} SELECT event_type AS contract, prev AS after, ts AS before, greatest(step // 60000000 - 1, 0)::BIGINT AS missing_intervals FROM s WHERE step > 60000000 ORDER BY contract, prev LIMIT 20")
def gap_samples(spark, d):
    """The first gaps, as a data manifest lists them."""
    return B.gap_samples(ticks(spark, d), 60_000_000, ts="bar_ts", keys=["event_type"])


@query(f"SELECT bar_ts, count(DISTINCT event_type) AS contracts FROM ({bars_sql('1 minute', 'event_type')}) GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def contract_multiplicity(spark, d):
    return B.contract_multiplicity(contract_bars(spark, d), "bar_ts", "event_type")


@query("SELECT instrument_id, count(DISTINCT symbol) - 1 AS conflicts FROM second_bars WHERE symbol IS NOT NULL GROUP BY 1")
def symbol_conflicts(spark, d):
    return B.symbol_conflicts(table(spark, d, "second_bars"), "instrument_id", "symbol")


_AUDITED = {
    "timestamps_parse": ("FAIL", "ts IS NULL"), "timestamps_monotonic": ("FAIL", "ts < prev"), "ohlc_finite": ("FAIL", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL"),
    "volume": ("FAIL", "volume < 0"), "contract_id_missing": ("FAIL", "contract IS NULL"), "contract_switches": ("INFO", "contract <> held"),
}


@query(f"WITH {_STORED}, e AS (SELECT *, lag(ts) OVER w AS prev, lag(contract) OVER w AS held FROM b WINDOW w AS (ORDER BY bar_id)) " + " UNION ALL ".join(
    [f"SELECT '{k}' AS \"check\", CASE WHEN count(*) FILTER ({x}) > 0 THEN '{bad}' ELSE 'PASS' END AS status, count(*) FILTER ({x}) AS n, coalesce(min(bar_id) FILTER ({x if bad == 'FAIL' and k != 'contract_id_missing' else 'false'}), -1) AS first_row FROM e" for k, (bad, x) in _AUDITED.items()]
    + ["SELECT 'timestamps_unique', CASE WHEN count(ts) > count(DISTINCT ts) THEN 'FAIL' ELSE 'PASS' END, count(ts) - count(DISTINCT ts), -1 FROM b",
       "SELECT 'contract_multiple_per_timestamp', CASE WHEN count(*) FILTER (k > 1) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (k > 1), -1 FROM (SELECT count(DISTINCT contract) AS k FROM b GROUP BY ts)"]))
def bars_audit(spark, d):
    """Findings on the delivered bars as one table; geometry and price checks need cells that are all finite, so they are left to ``bar_validation_counts``."""
    found = A.audit_bars(stored_bars(spark, d), row="bar_id", contract="contract").where(F.col("evidence").isNotNull() & ~F.col("check").isin("ohlc_geometry", "ohlc_positive"))
    return found.select("check", "status", F.get_json_object("evidence", "$.count").cast("bigint").alias("n"), F.coalesce(F.get("rows", F.lit(0)), F.lit(-1)).alias("first_row"))


# --- indicators ------------------------------------------------------------------------------------


@query(f"WITH {features_sql()} SELECT bar_ts, round(fracdiff, 6) + 0.0 AS fracdiff FROM f4")
def fracdiff(spark, d):
    return rounded(I.build_features(bars(spark, d), P, with_ema=False).select("bar_ts", "fracdiff"))


@query(f"WITH {features_sql()} SELECT bar_ts, {sql_round(['z', 'previous_z', 'mean_range'])} FROM f4")
def rolling_z(spark, d):
    return rounded(I.build_features(bars(spark, d), P, with_ema=False).select("bar_ts", "z", "previous_z", "mean_range"))


@query(f"WITH RECURSIVE {features_sql()}, {EMA_SQL} SELECT bar_ts, round(ema, 6) + 0.0 AS ema FROM f6")
def ema60(spark, d):
    return rounded(I.build_features(bars(spark, d), P).select("bar_ts", "ema"))


@query(f"WITH RECURSIVE {features_sql()}, {EMA_SQL} SELECT bar_ts, round(keltner, 6) + 0.0 AS keltner FROM f6")
def keltner(spark, d):
    return rounded(I.build_features(bars(spark, d), P).select("bar_ts", "keltner"))


@query(f"WITH {features_sql()} SELECT bar_ts, {sql_round(['z', 'previous_z'])} FROM f4 WHERE raw_long_signal")
def raw_signals(spark, d):
    return rounded(I.build_features(bars(spark, d), P, with_ema=False).where("raw_long_signal").select("bar_ts", "z", "previous_z"))


@query(f"WITH RECURSIVE {features_sql()}, {EMA_SQL} SELECT bar_ts, {sql_round(['z', 'keltner'])} FROM f6 WHERE passes")
def eligible_signals(spark, d):
    return rounded(I.build_features(bars(spark, d), P).where("signal_passes_keltner").select("bar_ts", "z", "keltner"))


# --- sessions --------------------------------------------------------------------------------------


@query(f"SELECT event_id, {class_sql('ts')} AS session FROM events")
def session_class(spark, d):
    return table(spark, d, "events").select("event_id", M.session_class(F.col("ts")).alias("session"))


@query(f"SELECT event_id, {permitted_sql('ts')} AS permitted, {deadline_sql('ts')} AS deadline FROM events")
def permitted_deadline(spark, d):
    return table(spark, d, "events").select("event_id", M.permitted(F.col("ts")).alias("permitted"), M.trading_deadline(F.col("ts")).alias("deadline"))


# --- trades ----------------------------------------------------------------------------------------


@query(f"{candidates_sql(True)} SELECT signal_time, entry_time, {sql_round(['entry_price', 'signal_z', 'previous_z', 'signal_keltner'])}, deadline FROM cand")
def proposed_entries(spark, d):
    return rounded(T.proposed(bars(spark, d), P).drop(I.SERIES))


@query(f"WITH bars AS ({bars_sql()}), {RANGES_SQL} SELECT source_start, source_end, {sql_round(['high', 'low', 'close', 'previous_close', 'tr'])}, source_end AS available_at FROM tr")
def true_range_4h(spark, d):
    return rounded(T.true_range_4h(bars(spark, d)).drop(I.SERIES))


def _held(spark, d):
    b = cut_lineage(bars(spark, d))
    return T.attach_atr(cut_lineage(T.proposed(b, P, channel=False)), T.true_range_4h(b)), b


@query(f"{candidates_sql(False)}, {ATR_SQL} SELECT entry_time, atr_source_start, atr_source_end, round(atr_value, 6) + 0.0 AS atr_value FROM atr")
def atr_asof(spark, d):
    return rounded(_held(spark, d)[0].select("entry_time", "atr_source_start", "atr_source_end", "atr_value"))


@query(f"{candidates_sql(False)}, {BRACKET_SQL} SELECT entry_time, {sql_round(BRACKET_COLS)} FROM br")
def brackets(spark, d):
    held, _ = _held(spark, d)
    return rounded(T.with_brackets(held.where(F.col("atr_value").isNotNull()), P).select("entry_time", *BRACKET_COLS))


@query(f"{candidates_sql(False)}, {SIMULATED_SQL} SELECT entry_time, exit_time, exit_reason, round(exit_price, 6) + 0.0 AS exit_price FROM sim")
def simulated_trades(spark, d):
    held, b = _held(spark, d)
    return rounded(T.simulate(T.with_brackets(held.where(F.col("atr_value").isNotNull()), P), b).select("entry_time", "exit_time", "exit_reason", "exit_price"))


LEDGER_COLS = ["signal_time", "entry_time", "deadline", "exit_time", "exit_reason", "atr_source_start", "atr_source_end"]
LEDGER_NUMBERS = ["entry_price", "signal_z", "previous_z", "signal_keltner", *BRACKET_COLS[1:], "exit_price"]


@query(f"{candidates_sql(True)}, {ACCEPTED_SQL} SELECT {', '.join(LEDGER_COLS)}, {sql_round(LEDGER_NUMBERS)} FROM led")
def accepted_trades(spark, d):
    return rounded(T.run_backtest(bars(spark, d), P).select(*LEDGER_COLS, *LEDGER_NUMBERS))


@query(f"{candidates_sql(True, '15 minutes')}, {ACCEPTED_SQL} SELECT {', '.join(LEDGER_COLS)}, {sql_round(LEDGER_NUMBERS)} FROM led")
def accepted_trades_15m(spark, d):
    return rounded(T.run_backtest(bars(spark, d, "15 minutes"), P).select(*LEDGER_COLS, *LEDGER_NUMBERS))


_SAMPLE = f"CASE WHEN entry_year IN {IN_SAMPLE} THEN 'IS' WHEN entry_year IN {OUT_OF_SAMPLE} THEN 'OOS' ELSE 'UNLABELED' END AS sample"


@query(f"{candidates_sql(True)}, {ACCEPTED_SQL} SELECT entry_time, {sql_round(['gross_R', 'cost_points', 'cost_R', 'net_R'])}, entry_year::INTEGER AS entry_year, {_SAMPLE} FROM led")
def r_accounting(spark, d):
    return rounded(T.run_backtest(bars(spark, d), P).select("entry_time", "gross_R", "cost_points", "cost_R", "net_R", "entry_year", "sample"))


@query(f"""{candidates_sql(True)}, {ACCEPTED_SQL}, s AS (SELECT count(*) AS trades, count(*) FILTER (net_R > 0) AS wins, count(*) FILTER (net_R <= 0) AS loss_or_zero,
  coalesce(sum(net_R) FILTER (net_R > 0), 0) AS p, coalesce(abs(sum(net_R) FILTER (net_R < 0)), 0) AS m, coalesce(sum(net_R), 0) AS net_R FROM led)
SELECT trades, wins, loss_or_zero, round(100.0 * wins / nullif(trades, 0), 6) + 0.0 AS win_rate, round(p / nullif(m, 0), 6) + 0.0 AS profit_factor, round(net_R, 6) + 0.0 AS net_R FROM s""")
def trade_summary(spark, d):
    return rounded(T.summarize(T.run_backtest(bars(spark, d), P)))


# --- audits ----------------------------------------------------------------------------------------


def _ledger(spark, d) -> DataFrame:
    return T.run_backtest(bars(spark, d), P)


def _damaged(ledger: DataFrame) -> DataFrame:
    """The ledger with faults planted by the minute of entry: times, risk, accounting and direction."""
    m = F.minute("entry_time")
    return ledger.withColumns({
        "exit_time": F.when(m % 7 == 0, F.col("entry_time") - F.expr("INTERVAL '1' MINUTE")).otherwise(F.col("exit_time")),
        "initial_risk": F.when(m % 11 == 0, 0.0).otherwise(F.col("initial_risk")), "net_R": F.when(m % 5 == 0, F.col("net_R") + 0.01).otherwise(F.col("net_R")),
        "direction": F.when(m % 13 == 0, "short").otherwise("LONG"),
    })


_DAMAGED = """dam AS (SELECT * REPLACE (CASE WHEN minute(entry_time) % 7 = 0 THEN entry_time - INTERVAL 1 MINUTE ELSE exit_time END AS exit_time,
    CASE WHEN minute(entry_time) % 11 = 0 THEN 0.0 ELSE initial_risk END AS initial_risk, CASE WHEN minute(entry_time) % 5 = 0 THEN net_R + 0.01 ELSE net_R END AS net_R),
    CASE WHEN minute(entry_time) % 13 = 0 THEN 'short' ELSE 'LONG' END AS direction FROM led)"""
_CHECKS = {
    "ledger_timestamps": "entry_time IS NULL OR exit_time IS NULL", "exit_after_entry": "exit_time < entry_time", "one_global_position": "entry_time <= prev", "trade_prices": "entry_price IS NULL OR exit_price IS NULL OR entry_price <= 0 OR exit_price <= 0",
    "entry_after_signal": "entry_time <= signal_time", "deadline": "exit_time > deadline", "atr_causality": "atr_source_end > entry_time", "initial_risk": "initial_risk <= 0",
    "r_accounting": "NOT coalesce(abs(gross_R - cost_R - net_R) <= 1e-9, false)", "stop_price_tick_alignment": "abs(round(stop_price / 0.25) * 0.25 - stop_price) > 1e-9",
    "target_price_tick_alignment": "abs(round(target_price / 0.25) * 0.25 - target_price) > 1e-9", "long_only": "lower(direction) NOT IN ('long', '1', 'buy')",
}


def _audit_sql(rows: str) -> str:
    parts = [f"SELECT '{k}' AS \"check\", CASE WHEN count(*) FILTER ({v}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER ({v}) AS n FROM {rows}" for k, v in _CHECKS.items()]
    return " UNION ALL ".join([*parts, f"SELECT 'trade_count', 'INFO', count(*) FROM {rows}", "SELECT 'ledger_schema', 'PASS', 0"])


def _found(findings: DataFrame) -> DataFrame:
    return findings.select("check", "status", F.coalesce(F.get_json_object("evidence", "$.count").cast("bigint"), F.lit(0)).alias("n"))


_WITH_DAMAGE = f"{candidates_sql(True)}, {ACCEPTED_SQL}, {_DAMAGED}, rows AS (SELECT *, lag(exit_time) OVER (ORDER BY entry_time, exit_time) AS prev FROM dam)"


def _audited(spark, d) -> DataFrame:
    rows = _damaged(_ledger(spark, d)).withColumn("row", F.unix_micros(F.col("entry_time").cast("timestamp")))
    return A.audit_ledger(rows, tick=0.25, long_only=True)


@query(f"{_WITH_DAMAGE} {_audit_sql('rows')}")
def ledger_audit(spark, d):
    return _found(_audited(spark, d))


@query(f"{_WITH_DAMAGE}, f AS ({_audit_sql('rows')}) SELECT status, count(*) AS n FROM f GROUP BY 1")
def findings_status_counts(spark, d):
    return _audited(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_MANDATORY = ["exit_after_entry", "trade_prices", "deadline", "long_only"]


@query(f"""{_WITH_DAMAGE}, f AS ({_audit_sql('rows')}) SELECT CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAILED' WHEN count(*) < {len(_MANDATORY)} THEN 'INCOMPLETE / UNVERIFIED' ELSE 'VERIFIED' END AS verdict
  FROM f WHERE "check" IN {tuple(_MANDATORY)}""")
def verdict(spark, d):
    return A.verdict(_audited(spark, d), _MANDATORY)


_NUMBERS = ("entry_price", "atr_value", "stop_price", "target_price", "initial_risk", "exit_price", "gross_R", "cost_R", "net_R")


def _reconcile_sql() -> str:
    differs = {c: f"a.{c} IS DISTINCT FROM b.{c}" if c not in _NUMBERS else f"(a.{c} IS NULL) <> (b.{c} IS NULL) OR abs(a.{c} - b.{c}) > 1e-9" for c in A.RECONCILED}
    parts = [f"SELECT 'reference_{c}' AS \"check\", count(*) FILTER ({x}) AS mismatches, coalesce(min(n) FILTER ({x}), -1) AS first_row FROM j" for c, x in differs.items()]
    sides = ", ".join(f"{k} AS (SELECT *, row_number() OVER (ORDER BY entry_time) AS n FROM {t})" for k, t in (("a", "dam"), ("b", "led")))
    return f"{_WITH_DAMAGE}, {sides}, j AS (SELECT a, b, n FROM a FULL JOIN b USING (n)) " + " UNION ALL ".join(parts)


@query(_reconcile_sql())
def ledger_reconcile(spark, d):
    ledger = _ledger(spark, d)
    found = A.reconcile_ledgers(_damaged(ledger), ledger).where(F.col("check") != "reference_reconciliation")
    return found.select("check", F.get_json_object("evidence", "$.mismatches").cast("bigint").alias("mismatches"), F.coalesce(F.get("rows", F.lit(0)), F.lit(-1)).alias("first_row"))


@query(f"{candidates_sql(True)}, {ACCEPTED_SQL} SELECT count(*) AS production_trades, count(*) AS reference_trades, 0::BIGINT AS columns_differing, true AS matched FROM led")
def engines_agree(spark, d):
    """The ledgers of both engines over the same bars."""
    from barloom.operators.second_engine import reconcile_engines

    return reconcile_engines(bars(spark, d), P).drop("production_hash", "reference_hash")


def _selected(spark, d) -> DataFrame:
    """Contract of highest volume of each fifteen-minute bar."""
    b = contract_bars(spark, d, "15 minutes")
    return b.groupBy(F.col("bar_ts").alias("timestamp")).agg(F.max_by("event_type", F.struct("volume", "event_type")).alias("contract_id"))


_SEL = f"cb AS ({bars_sql('15 minutes', 'event_type')}), sel AS (SELECT bar_ts AS timestamp, event_type AS contract_id FROM cb QUALIFY row_number() OVER (PARTITION BY bar_ts ORDER BY volume DESC, event_type DESC) = 1)"


@query(f"""WITH {_SEL}, ex AS (SELECT timestamp + INTERVAL 1 DAY AS timestamp, contract_id AS expected FROM sel)
SELECT (SELECT count(*) FROM sel JOIN ex USING (timestamp)) AS overlap, (SELECT count(*) FROM sel JOIN ex USING (timestamp) WHERE contract_id <> expected) AS wrong_contract,
  (SELECT count(*) FROM ex ANTI JOIN sel USING (timestamp)) AS not_selected, 0::BIGINT AS duplicate_rows""")
def selection_map_audit(spark, d):
    s = _selected(spark, d)
    return A.selection_counts(s, s.select((F.col("timestamp") + F.expr("INTERVAL '1' DAY")).alias("timestamp"), F.col("contract_id").alias("expected_contract_id")))


@query(f"WITH {_SEL}, p AS (SELECT timestamp, lag(contract_id) OVER (ORDER BY timestamp) AS old, contract_id AS new FROM sel) SELECT timestamp, old, new FROM p WHERE old <> new")
def contract_timeline(spark, d):
    return A.contract_switches(_selected(spark, d))


@query(f"WITH {_SEL} SELECT timestamp, contract_id FROM sel JOIN (SELECT event_type, TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * length(event_type) AS expiry FROM (SELECT DISTINCT event_type FROM events)) ON event_type = contract_id WHERE timestamp >= expiry")
def expired_contract(spark, d):
    day = F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'") + F.make_dt_interval(F.length("event_type"), F.lit(0), F.lit(0), F.lit(0))
    expiry = table(spark, d, "events").select(F.col("event_type").alias("contract_id")).distinct().withColumn("event_type", F.col("contract_id")).withColumn("expiry", day)
    return A.expired_rows(_selected(spark, d), expiry).select("timestamp", "contract_id")


@query(f"""WITH c AS ({bars_sql('15 minutes')}), m AS ({bars_sql()}),
t AS (SELECT bar_ts AS trade, open - 0.25 * (high - low) AS stop_price, open + 0.25 * (high - low) AS target_price, * FROM c), amb AS (SELECT * FROM t WHERE open > stop_price AND open < target_price AND low <= stop_price AND high >= target_price),
ev AS (SELECT trade, m.bar_ts, CASE WHEN m.open <= stop_price THEN 'SL_OPEN' WHEN m.open >= target_price THEN 'TP_OPEN' WHEN m.low <= stop_price AND m.high >= target_price THEN 'STILL_AMBIGUOUS' WHEN m.low <= stop_price THEN 'SL' WHEN m.high >= target_price THEN 'TP' END AS e
  FROM amb JOIN m ON time_bucket(INTERVAL '15 minutes', m.bar_ts) = amb.trade)
SELECT amb.trade, coalesce(f.e, 'DATA_UNAVAILABLE') AS classification, f.bar_ts AS event_time FROM amb LEFT JOIN (SELECT * FROM ev WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade ORDER BY bar_ts) = 1) f USING (trade)""")
def highres_resolution(spark, d):
    coarse = bars(spark, d, "15 minutes")
    reach = F.lit(0.25) * (F.col("high") - F.col("low"))
    trades = coarse.select(F.col("bar_ts").alias("trade"), F.col("bar_ts").alias("exit_time"), (F.col("open") - reach).alias("stop_price"), (F.col("open") + reach).alias("target_price"))
    return A.resolve_ambiguous(A.ambiguous_trades(trades, coarse, interval="15 minutes"), bars(spark, d), trade="trade", interval="15 minutes")


@query(f"""WITH f AS ({bars_sql('1 minute', 'event_type')}), c AS ({bars_sql('15 minutes', 'event_type')}),
a AS (SELECT event_type, time_bucket(INTERVAL '15 minutes', bar_ts) AS bar_ts, first(open ORDER BY bar_ts) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY bar_ts) AS cl, sum(volume) AS v FROM f GROUP BY ALL)
SELECT count(*) AS compared, count(*) FILTER (abs(o - open) > 1e-9) AS open_mismatches, count(*) FILTER (abs(h - high) > 1e-9) AS high_mismatches, count(*) FILTER (abs(l - low) > 1e-9) AS low_mismatches,
  count(*) FILTER (abs(cl - (close + CASE WHEN hour(bar_ts) = 3 THEN 0.5 ELSE 0 END)) > 1e-9) AS close_mismatches, count(*) FILTER (v <> volume) AS volume_mismatches FROM a JOIN c USING (event_type, bar_ts)""")
def aggregation_compare(spark, d):
    coarse = contract_bars(spark, d, "15 minutes").withColumn("close", F.col("close") + F.when(F.hour("bar_ts") == 3, 0.5).otherwise(0.0))
    return A.compare_aggregation(contract_bars(spark, d), coarse, keys=["event_type"], interval="15 minutes")


CUT = "2024-01-15 00:00:00"
_MUTATED = f"""src AS ({bars_sql()}), r AS (SELECT *, row_number() OVER (ORDER BY bar_ts) - 1 AS i, count(*) OVER () AS n FROM src WHERE bar_ts >= TIMESTAMP '{CUT}'),
  m1 AS (SELECT bar_ts, open * (1.7 + 0.6 * coalesce(i / nullif(n - 1, 0), 0)) AS open, close * CASE WHEN n = 1 THEN 1.7 ELSE 2.3 - 0.6 * coalesce(i / nullif(n - 1, 0), 0) END AS close, volume FROM r),
  mutated AS (SELECT bar_ts, open, high, low, close, volume FROM src WHERE bar_ts < TIMESTAMP '{CUT}' UNION ALL SELECT bar_ts, open, greatest(open, close) * 1.03, least(open, close) * 0.97, close, volume FROM m1)"""


@query(f"WITH {_MUTATED} SELECT bar_ts, {sql_round(PRICE_COLS)}, volume FROM mutated")
def mutate_future(spark, d):
    return rounded(C.mutate_future(bars(spark, d), f"TIMESTAMP_NTZ'{CUT}'", keys=[I.SERIES]).select("bar_ts", *PRICE_COLS, "volume"))


def _scenario(spark, d, kind: str) -> DataFrame:
    """Features before the cutoff, of all bars and of bars without or with another future: compared and differing rows."""
    b, at = bars(spark, d), f"TIMESTAMP_NTZ'{CUT}'"
    other = b.where(F.col("bar_ts") < F.expr(at)) if kind == "truncation" else C.mutate_future(b, at, keys=[I.SERIES])
    both = b.withColumn(I.SERIES, F.lit("full")).unionByName(other.withColumn(I.SERIES, F.lit("other")))
    f = cut_lineage(I.build_features(both, P))
    f = C.known_before(f, "features", at).select(I.SERIES, "bar_ts", "z", "ema", "mean_range", "keltner")
    x, y = (f.where(F.col(I.SERIES) == s).drop(I.SERIES) for s in ("full", "other"))
    return A.beside(x.agg(F.count("*").alias("rows")), A.compare_rows(x, y, ["bar_ts"], ["z", "ema", "mean_range", "keltner"]).agg(F.sum("mismatches").alias("differing")))


def _scenario_sql(source: str, extra: str = "") -> str:
    """Independent restatement: the earlier features from the altered bars, against those from all bars."""
    full = f"WITH RECURSIVE {features_sql()}, {EMA_SQL} SELECT bar_ts, z, ema, mean_range, keltner FROM f6 WHERE bar_ts < TIMESTAMP '{CUT}'"
    other = f"WITH RECURSIVE {extra}{features_sql(source=source)}, {EMA_SQL} SELECT bar_ts, z, ema, mean_range, keltner FROM f6 WHERE bar_ts < TIMESTAMP '{CUT}'"
    differs = lambda c: f"count(*) FILTER ((x.{c} IS NULL) <> (y.{c} IS NULL) OR abs(x.{c} - y.{c}) > 1e-9)"
    total = " + ".join(differs(c) for c in ("z", "ema", "mean_range", "keltner"))
    return f"SELECT count(x.bar_ts) AS rows, ({total})::BIGINT AS differing FROM ({full}) x FULL JOIN ({other}) y USING (bar_ts)"


@query(_scenario_sql(f"SELECT * FROM ({bars_sql()}) WHERE bar_ts < TIMESTAMP '{CUT}'"))
def truncation_compare(spark, d):
    return _scenario(spark, d, "truncation")


@query(_scenario_sql("SELECT * FROM mutated", _MUTATED + ", "))
def mutation_compare(spark, d):
    return _scenario(spark, d, "mutation")


_HASHED = list(A.RECONCILED)
_LINE = " || ',' || ".join(f"format('{{:.9f}}', round({c}, 9))" if c in _NUMBERS else c if c == "exit_reason" else f"strftime({c}, '%Y-%m-%d %H:%M:%S+00:00')" for c in _HASHED)


@query(f"""{candidates_sql(True)}, {ACCEPTED_SQL}, l AS (SELECT entry_time, {_LINE} AS line FROM led)
SELECT sha256('{",".join(_HASHED)}' || chr(10) || string_agg(line, chr(10) ORDER BY entry_time) || chr(10)) AS ledger_hash FROM l""")
def ledger_hash(spark, d):
    return A.ledger_hash(_ledger(spark, d), _HASHED)


# --- without SQL counterpart -----------------------------------------------------------------------


@query()
def file_sha256(spark, d):
    from barloom.sources.bars import file_hashes

    return file_hashes(spark, f"{d}/events.parquet")


@query()
def static_scan(spark, d):
    """The scanner over this package's own sources."""
    from pathlib import Path

    from barloom.operators.static_scan import scan_table

    root = Path(__file__).resolve().parents[1]
    rows = [(p.relative_to(root).as_posix(), p.read_text()) for p in sorted(root.rglob("*.py"))]
    return scan_table(spark.createDataFrame(rows, "path string, source string"))


@query()
def cutoffs(spark, d):
    found = C.generate_cutoffs(bars(spark, d, "15 minutes"), mode="strong")
    return spark.createDataFrame([(k, t) for k, t in enumerate(found)], "cutoff int, bar_ts timestamp_ntz")
