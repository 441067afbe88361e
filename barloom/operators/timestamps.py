"""Normalising timestamps that arrive in many formats, precisions and zones.

``normalise_timestamps`` turns the text of one column into one UTC instant.

How a text is read
    Every text is matched against the format grammar below and rewritten to one
    canonical list of parts. A text has zero, one or several valid *readings*:
    ``03/04/2020`` is a day-first and a month-first date. For each source
    (delivered file) a mixture over readings is fitted by expectation-
    maximisation: a text contributes its likelihood under each valid reading,
    the source's note on the order of day and month enters as prior counts, and
    the posterior picks the reading. Only counts of distinct reading sets per
    source enter the fit, so its input is a handful of rows per file. Zone
    abbreviations that several countries use (``CST``, ``IST``, ``BST``, ...) are
    read as the one whose offset the source's own zone has, else as the first.

Which instant a wall clock means
    An offset, zone name or Unix count in the text decides; otherwise the zone
    named by the source's free text. Its two candidates are the instants by the
    offset of a day before and of a day after, so a change of the clocks by any
    step is seen: a skipped wall clock has no instant, one that occurred twice has
    two. Which of them is settled by the order of rows within the file: only rows
    of files that hold such an hour, within ``anchor_hours`` of it, are windowed,
    in groups of a day. Where no row before or after decides, the distances in
    time to both neighbours do, and the posterior says how clearly.

Defined results (``status``)
    ``ok`` · ``missing`` (null or blank) · ``unreadable`` (no format fits or an
    impossible date) · ``off_format`` (readable only against the source's own
    order of day and month) · ``ambiguous`` (posterior below the threshold; of a
    repeated wall clock ``alternatives`` holds both instants, likelier first) ·
    ``no_zone`` (wall clock of a source without a known zone) · ``skipped``
    (never occurred). All but ``ok`` have a null instant. Repeated rows give
    repeated results; an empty table gives an empty result; rows of unknown
    sources are read without hints.
"""

from __future__ import annotations

import functools
import zoneinfo
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import cut_lineage, spread

# Month names and offsets (minutes) of zone abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330,
    "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Further offsets (minutes) of abbreviations that several countries use.
SHARED = {"CST": (480,), "IST": (60, 120), "BST": (360,), "EST": (600,), "EDT": (660,), "MST": (480,), "PST": (480,)}
# Wordings that name a zone without its identifier, tried in this order.
ZONE_WORDS = (
    (r"chicago|us[ /]central", "America/Chicago"),
    (r"new york|us[ /]eastern", "America/New_York"),
    (r"us[ /]pacific|los angeles", "America/Los_Angeles"),
    (r"london|british", "Europe/London"),
    (r"berlin|central european|frankfurt", "Europe/Berlin"),
    (r"sydney", "Australia/Sydney"),
    (r"tokyo|\bjst\b", "Asia/Tokyo"),
    (r"kolkata|mumbai|\bist\b", "Asia/Kolkata"),
    (r"\butc\b|\bzulu\b|\bgmt\b", "UTC"),
)

_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_ZONE = r"(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
#: name, pattern, replacement to ``a|b|c|hour|minute|second|fraction|am-pm|zone|bracket``.
GRAMMAR = (
    ("ymd", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK} ?{_ZONE}(?:\[([A-Za-z0-9_+/-]+)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("compact", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("slash", r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AP])\.?M\.?)?$", "$1|$2|$3|$4|$5|$6|$7|$8||"),
    ("month_first", rf"(?i)^([A-Z]{{3}})[a-z]*\.? (\d{{1,2}}), ?(\d{{4}}) {_CLOCK}(?: ?([AP])\.?M\.?)?$", "$1|$2|$3|$4|$5|$6|$7|$8||"),
    ("day_first", rf"(?i)^(\d{{1,2}})-([A-Z]{{3}})-(\d{{4}}) {_CLOCK} ?([A-Z]{{1,5}})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("mail", rf"(?i)^(?:[A-Z]{{3}}, )?(\d{{1,2}}) ([A-Z]{{3}}) (\d{{4}}) {_CLOCK} ?([+-]\d{{4}}|[A-Z]{{1,5}})$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
)
EPOCH = r"^(\d{10}(\.\d+)?|\d{13}|\d{16}|\d{19})$"


@dataclass(frozen=True)
class TimestampParams:
    note_prior: float = 200.0  # pseudo-counts that a note on day/month order is worth
    base_prior: float = 0.5  # Dirichlet pseudo-count of every reading
    em_steps: int = 12
    min_posterior: float = 0.9
    anchor_hours: int = 3


def _fenced(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``select`` whose results the optimizer takes as given: filters on them aren't pushed below, so deep expressions aren't copied into each filter."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


@functools.cache
def _zone_names() -> str:
    return ",".join(sorted(zoneinfo.available_timezones()))


def _known_zone(name: Column) -> Column:
    names = F.split(F.lit(_zone_names()), ",")
    return F.array_contains(names, name)


def _zone_of(text: Column) -> Column:
    """Zone identifier named by a source's free text, or null."""
    named = F.regexp_extract(text, r"([A-Z][A-Za-z]+/[A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_]+)?)", 1)
    offset = F.regexp_extract(text, r"UTC ?([+-]\d{1,2}(?::\d{2})?)", 1)
    hours = F.regexp_extract(offset, r"(\d{1,2})", 1)
    fixed = F.concat(F.substring(offset, 1, 1), F.lpad(hours, 2, "0"), F.when(offset.contains(":"), F.regexp_extract(offset, r"(:\d{2})", 1)).otherwise(F.lit(":00")))
    low = F.lower(text)
    words = F.lit(None).cast("string")
    for pattern, zone in reversed(ZONE_WORDS):
        words = F.when(low.rlike(pattern), F.lit(zone)).otherwise(words)
    return F.when(_known_zone(named), named).when((offset != "") & (hours.cast("int") <= 14), fixed).otherwise(words)


def source_hints(manifests: DataFrame, source: str = "manifest_id") -> DataFrame:
    """One row a source: ``zone`` and ``date_order`` ('dmy', 'mdy' or null)."""
    notes = F.lower(F.array_join(F.coalesce(F.col("notes"), F.array().cast("array<string>")), " ; "))
    order = (
        F.when(notes.rlike(r"day/month/year|day comes before month|day first"), F.lit("dmy"))
        .when(notes.rlike(r"month/day/year|month comes before day|month first"), F.lit("mdy"))
    )
    return (
        manifests.select(F.col(source).alias("_src"), _zone_of(F.col("timezone_interpretation")).alias("_zone"), order.alias("_order"))
        .where(F.col("_src").isNotNull())
        .groupBy("_src")
        .agg(F.max("_zone").alias("_zone"), F.max("_order").alias("_order"))
    )


def _month(c: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(c)).cast("int")
    return F.when(at > 0, at)


def _zone_offsets(zone: Column) -> Column:
    """Offsets (minutes) that a zone has in winter and in summer."""
    moved = lambda day: F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ'{day} 12:00:00', convert_timezone('UTC', coalesce(_zone, 'UTC'), TIMESTAMP_NTZ'{day} 12:00:00'))").cast("int")
    return F.when(zone.isNotNull(), F.array(moved("2020-01-01"), moved("2020-07-01")))


def _offset_minutes(zone: Column, offsets: Column) -> Column:
    """``offsets``: those of the source's own zone, which choose among the readings of a shared abbreviation."""
    z = F.upper(zone)
    digits = F.regexp_replace(F.substring(z, 2, 5), ":", "")
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    usual = F.try_element_at(names, z)
    shared = F.create_map(*[x for k, v in SHARED.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    fits = F.array_intersect(F.concat(F.array(usual), F.coalesce(F.try_element_at(shared, z), F.array().cast("array<int>"))), offsets)
    return F.when(z.rlike(r"^[+-]"), numeric).when(z.isin(*SHARED), F.coalesce(F.get(fits, F.lit(0)), usual)).otherwise(usual)


def _parts(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_fmt`` and the readings; ``_dmy`` and ``_mdy`` are those of slashed dates, ``_dmy`` is the one of any other date.

    A look at single characters chooses the one pattern a text can fit, so every text meets one regular expression.
    """
    t = F.col("_t")
    at = lambda i: F.substring(t, i, 1)
    digits = F.length(t).isin(10, 13, 16, 19) | (at(11) == ".")
    fmt = (
        F.when(at(3).isin("/") | at(2).isin("/"), "slash")
        .when(at(5) == "-", "ymd")
        .when(at(9).isin("T", "t", " ") & (F.length(t) >= 15) & t.rlike(r"^\d{8}"), "compact")
        .when(at(3).isin("-") | at(2).isin("-"), "day_first")
        .when(digits & t.rlike(EPOCH), "epoch")
        .when((at(4) == ",") | at(1).between("0", "9"), "mail")
        .otherwise("month_first")
    )
    canon = F.lit(None).cast("string")
    for name, pattern, to in GRAMMAR:
        canon = F.when(F.col("_fmt") == name, F.regexp_replace(t, pattern, to)).otherwise(canon)
    out = df.withColumn("_t", F.trim(F.col(column), F.lit(" \t\r\n\u00a0\ufeff"))).withColumn("_fmt", fmt).withColumn("_c", canon)
    out = out.withColumn("_p", F.when(F.col("_c").contains("|"), F.split("_c", r"\|")))
    out = out.withColumn("_fmt", F.when(F.col("_p").isNotNull() | (F.col("_fmt") == "epoch"), F.col("_fmt")))
    p = lambda i: F.col("_p")[i]
    num = lambda c: c.try_cast("int")
    year = F.when(F.col("_fmt").isin("ymd", "compact"), num(p(0))).otherwise(num(p(2)))
    hour = num(p(3))
    half = F.upper(p(7))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    second = F.when(p(5) == "", F.lit(0)).otherwise(num(p(5)))
    second = F.when(second < 60, second)
    fraction = F.rpad(F.substring(p(6), 1, 6), 6, "0")
    sec = F.concat(second.cast("string"), F.lit("."), fraction).try_cast("decimal(8,6)")

    def instant(month: Column, day: Column) -> Column:
        return F.try_make_timestamp_ntz(year, month, day, hour, num(p(4)), sec)

    plain = F.col("_fmt").isin("ymd", "compact")
    first = F.when(plain, instant(num(p(1)), num(p(2)))).when(F.col("_fmt") == "month_first", instant(_month(p(0)), num(p(1)))).otherwise(
        F.when(F.col("_fmt") == "slash", instant(num(p(1)), num(p(0)))).otherwise(instant(_month(p(1)), num(p(0))))
    )
    other = F.when(F.col("_fmt") == "slash", instant(num(p(0)), num(p(1))))
    whole = F.regexp_extract(F.col("_t"), r"^(\d+)", 1)
    digits = F.length(whole)
    seconds = (
        F.when(digits == 10, F.concat(whole, F.lit("."), F.rpad(F.substring(F.regexp_extract(F.col("_t"), r"\.(\d+)$", 1), 1, 6), 6, "0")))
        .when(digits == 13, F.concat(F.substring(whole, 1, 10), F.lit("."), F.substring(whole, 11, 3)))
        .otherwise(F.concat(F.substring(whole, 1, 10), F.lit("."), F.substring(whole, 11, 6)))
    ).try_cast("decimal(18,6)")
    origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    epoch = F.when(F.col("_fmt") == "epoch", origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds))
    zone_text = F.when(p(8) != "", p(8))
    bracket = F.when(p(9) != "", p(9))
    return _fenced(
        out, [*df.columns, "_fmt"],
        first.alias("_dmy"), other.alias("_mdy"), epoch.alias("_epoch"),
        _offset_minutes(zone_text, F.col("_offsets") if "_offsets" in df.columns else F.lit(None).cast("array<int>")).alias("_off"),
        zone_text.isNotNull().alias("_zoned"),
        F.when(_known_zone(bracket), bracket).alias("_named"),
    )


def date_order_posteriors(df: DataFrame, hints: DataFrame, column: str, source: str, params: TimestampParams = TimestampParams()) -> DataFrame:
    """EM over the readings of slashed dates: per source ``_pd``, the posterior that such a date is day-first.

    Input is aggregated to counts per source and reading set before anything is
    shuffled; a source contributes at most three rows to its fit.
    """
    slashed = _parts(df.where(F.col(column).contains("/")).select(F.col(source).alias("_src"), F.col(column).alias("_x")), "_x").where(F.col("_fmt") == "slash")
    sets = slashed.groupBy("_src").agg(
        F.count_if(F.col("_dmy").isNotNull() & F.col("_mdy").isNull()).cast("double").alias("_d"),
        F.count_if(F.col("_dmy").isNull() & F.col("_mdy").isNotNull()).cast("double").alias("_m"),
        F.count_if(F.col("_dmy").isNotNull() & F.col("_mdy").isNotNull()).cast("double").alias("_both"),
    )
    sets = sets.join(hints, "_src", "left")
    a = F.lit(params.base_prior) + F.when(F.col("_order") == "dmy", params.note_prior).otherwise(0.0)
    b = F.lit(params.base_prior) + F.when(F.col("_order") == "mdy", params.note_prior).otherwise(0.0)
    d, m, both = F.col("_d"), F.col("_m"), F.col("_both")
    total = d + m + both + a + b
    # E step: an ambiguous text counts for day-first by the present weight; M step: new weight from expected counts and prior.
    weight = F.aggregate(F.sequence(F.lit(1), F.lit(params.em_steps)), a / (a + b), lambda w, _: (d + both * w + a) / total)
    return sets.select("_src", weight.alias("_pd"))


def normalise_timestamps(
    df: DataFrame,
    manifests: DataFrame,
    column: str,
    *,
    source: str = "manifest_id",
    order_by: str,
    row_id: str,
    params: TimestampParams = TimestampParams(),
    plain_utc: bool = True,
) -> DataFrame:
    """Columns ``row_id``, ``ts_utc`` (TIMESTAMP_NTZ, UTC), ``status``, ``posterior``, ``alternatives`` for every row of ``df``.

    ``order_by`` follows true time within a source. ``plain_utc=False`` leaves
    out rows whose text already is a real UTC time ``YYYY-MM-DDTHH:MM:SSZ``.
    """
    hints = source_hints(manifests, source)
    posteriors = date_order_posteriors(df, hints, column, source, params)
    settings = hints.withColumn("_offsets", _zone_offsets(F.col("_zone"))).join(posteriors, "_src", "left")
    rows = spread(df.select(F.col(row_id).alias("_id"), F.col(source).alias("_src"), F.col(order_by).cast("bigint").alias("_seq"), F.col(column).alias("_x")))
    canonical = F.coalesce(
        F.col("_x").rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$") & F.substring("_x", 1, 10).try_cast("date").isNotNull() & (F.substring("_x", 1, 4) != "0000"),
        F.lit(False),
    )

    def resolved(part: DataFrame) -> DataFrame:
        read = _parts(part.join(settings, "_src", "left"), "_x")
        share = F.coalesce(F.col("_pd"), F.lit(0.5))
        slash = F.col("_fmt") == "slash"
        both = F.col("_dmy").isNotNull() & F.col("_mdy").isNotNull()
        posterior = F.when(slash, F.when(F.col("_dmy").isNotNull() & ((share >= 0.5) | F.col("_mdy").isNull()), share).otherwise(1 - share)).otherwise(1.0)
        wall = F.when(slash, F.when(both, F.when(share >= 0.5, F.col("_dmy")).otherwise(F.col("_mdy"))).otherwise(F.coalesce("_dmy", "_mdy"))).otherwise(F.col("_dmy"))
        off_format = slash & ~both & (posterior < 1 - params.min_posterior)
        unsure = slash & both & (posterior < params.min_posterior) & (F.col("_dmy") != F.col("_mdy"))
        zone = F.when(~F.col("_zoned") | F.col("_zoned").isNull(), F.coalesce("_named", "_zone"))
        read = read.select("_id", "_src", "_seq", "_x", "_fmt", "_off", "_zoned", "_epoch", wall.alias("_wall"), posterior.alias("_post"), off_format.alias("_offf"), unsure.alias("_unsure"), zone.alias("_tz"))
        shifted = F.when(F.col("_off").isNotNull(), F.col("_wall") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("_off"), F.lit(0)))
        walled = ~F.col("_zoned") & F.col("_tz").isNotNull()
        moving = walled & ~F.col("_tz").rlike(r"^(UTC|[+-].*)$")
        there = lambda c: F.convert_timezone(F.lit("UTC"), F.col("_tz"), c)
        by_offset_of = lambda c: F.when(moving, F.col("_wall") - (there(c) - c))
        day = F.expr("INTERVAL '1' DAY")
        read = read.withColumns({"_before": by_offset_of(F.col("_wall") - day), "_after": by_offset_of(F.col("_wall") + day)})
        one = F.when(there(F.col("_before")) == F.col("_wall"), F.col("_before"))
        two = F.when(there(F.col("_after")) == F.col("_wall"), F.col("_after"))
        fixed = F.when(walled & ~moving, F.convert_timezone(F.col("_tz"), F.lit("UTC"), F.col("_wall")))
        read = read.withColumns({"_local": F.coalesce(fixed, F.least(one, two)), "_later": F.greatest(one, two)})
        skipped = moving & F.col("_wall").isNotNull() & F.col("_local").isNull()
        second = F.when(F.col("_later") > F.col("_local"), F.col("_later"))
        first = F.coalesce(F.col("_epoch"), shifted, F.col("_local"))
        status = (
            F.when(F.col("_x").isNull() | (F.trim("_x") == ""), "missing")
            .when(F.col("_fmt").isNull() | (F.col("_wall").isNull() & F.col("_epoch").isNull()), "unreadable")
            .when(F.col("_offf"), "off_format")
            .when(F.col("_unsure"), "ambiguous")
            .when(F.coalesce(skipped, F.lit(False)), "skipped")
            .when(first.isNull(), F.when(F.col("_zoned"), "unreadable").otherwise("no_zone"))
            .otherwise("ok")
        )
        read = read.select("_id", "_src", "_seq", "_post", status.alias("_status"), first.alias("_a"), second.alias("_b"))
        ok = F.col("_status") == "ok"
        return _fenced(read, ["_id", "_src", "_seq", "_post"], F.col("_status"), F.when(ok, F.col("_a")).alias("_u0"), F.when(ok, F.col("_b")).alias("_u1"))

    # Plain UTC texts skip the grammar; where they aren't wanted they still serve as anchors in files on a moving clock.
    moving_zone = F.col("_zone").isNotNull() & ~F.col("_zone").rlike(r"^(UTC|[+-].*)$")
    plain = rows.where(canonical)
    plain_read = plain if plain_utc else plain.join(settings.where(moving_zone).select("_src"), "_src", "left_semi")
    plain_at = F.to_timestamp_ntz(F.substring("_x", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    plain_read = plain_read.select("_id", "_src", "_seq", F.lit(1.0).alias("_post"), F.lit("ok").alias("_status"), plain_at.alias("_u0"), F.lit(None).cast("timestamp_ntz").alias("_u1"), F.lit(True).alias("_plain"))
    near = cut_lineage(resolved(rows.where(~canonical)).withColumn("_plain", F.lit(False)).unionByName(plain_read))
    single = near.where(F.col("_u1").isNull() & (F.lit(plain_utc) | ~F.col("_plain"))).select("_id", F.col("_u0").alias("ts_utc"), "_status", "_post")
    # Twice-occurring wall clocks: only the files that hold them, and of those only the hours around, are windowed.
    span = F.make_dt_interval(F.lit(0), F.lit(params.anchor_hours), F.lit(0), F.lit(0))
    hours = near.where(F.col("_u1").isNotNull()).groupBy("_src", F.date_trunc("day", F.col("_u0")).alias("_day")).agg((F.min("_u0") - span).alias("_from"), (F.max("_u1") + span).alias("_to"))
    around = near.where(F.col("_u0").isNotNull()).join(hours, "_src").where((F.col("_u0") >= F.col("_from")) & (F.col("_u0") <= F.col("_to")))
    w = Window.partitionBy("_src", "_day").orderBy("_seq", "_id")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    sure = F.when(F.col("_u1").isNull(), F.col("_u0"))
    around = around.withColumns({
        "_p": F.last(sure, True).over(before), "_n": F.first(sure, True).over(after),
        "_run": F.sum(F.when(F.col("_u1").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_drop": F.when(F.col("_u1").isNotNull() & (F.lag("_u0").over(w) > F.col("_u0")) & F.lag("_u1").over(w).isNotNull(), 1).otherwise(0),
    })
    r = Window.partitionBy("_src", "_day", "_run").orderBy("_seq", "_id")
    whole = Window.partitionBy("_src", "_day", "_run")
    amb = around.where(F.col("_u1").isNotNull()).withColumns({
        "_fallen": F.sum("_drop").over(r.rowsBetween(Window.unboundedPreceding, 0)), "_falls": F.sum("_drop").over(whole),
        "_first": F.min("_u0").over(whole), "_last": F.max("_u1").over(whole),
    })
    far = F.lit(1e18)
    gap = lambda a, b: F.coalesce(F.unix_micros(b.cast("timestamp")).cast("double") - F.unix_micros(a.cast("timestamp")), far)
    # By order where it decides (1 or 0), else by the distances in time to the rows around.
    to_first, to_second = gap(F.col("_p"), F.col("_first")), gap(F.col("_last"), F.col("_n"))
    later = (
        F.when(F.col("_p") >= F.col("_u1"), 1.0)
        .when(F.col("_n") <= F.col("_u0"), 0.0)
        .when(F.col("_falls") > 0, F.when(F.col("_fallen") > 0, 1.0).otherwise(0.0))
        .when(F.col("_p") > F.col("_u0"), 1.0)
        .when(F.col("_n") < F.col("_u1"), 0.0)
        .otherwise(F.coalesce(to_first / F.nullif(to_first + to_second, F.lit(0.0)), F.lit(0.5)))
    )
    twice = amb.withColumn("_later", later)
    likely = F.when(F.col("_later") > 0.5, F.array("_u1", "_u0")).otherwise(F.array("_u0", "_u1"))
    sureness = F.greatest(F.col("_later"), 1 - F.col("_later"))
    clear = sureness >= params.min_posterior
    twice = twice.select("_id", F.when(clear, likely[0]).alias("ts_utc"), F.when(clear, F.col("_status")).otherwise("ambiguous").alias("_status"), (F.col("_post") * sureness).alias("_post"), F.when(~clear, likely).alias("alternatives"))
    single = single.withColumn("alternatives", F.lit(None).cast("array<timestamp_ntz>"))
    return single.unionByName(twice).select(F.col("_id").alias(row_id), "ts_utc", F.col("_status").alias("status"), F.col("_post").alias("posterior"), "alternatives")


def utc_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of a TIMESTAMP_NTZ, independent of the session's zone."""
    text = ts.cast(T.StringType())
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"))
