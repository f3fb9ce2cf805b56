"""Timestamps in mixed notations and on mixed clocks, brought to UTC seconds.

``with_moment`` reads one text column into calendar parts with JVM expressions only. ``resolve_utc`` turns the local
parts into UTC by joining them, as of their local time, to the zone-offset intervals of their clock: two intervals that
hold the local time mean it is ambiguous (the first occurrence is taken), none means it was skipped (it moves forward by
the gap), one gives the offset directly.

Defined results: null, empty and unreadable texts, impossible dates, and local times without a known clock give null.
Repeated rows stay repeated. Outer white space of any kind is ignored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets in seconds of zone abbreviations, for clocks whose zone rules do not define the abbreviation.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200, "WAT": 3600,
    "CAT": 7200, "SAST": 7200, "EET": 7200, "EEST": 10800, "EAT": 10800, "MSK": 10800, "GST": 14400, "PKT": 18000,
    "IST": 19800, "HKT": 28800, "SGT": 28800, "JST": 32400, "KST": 32400, "AEST": 36000, "AEDT": 39600, "NZST": 43200,
    "NZDT": 46800, "AST": -14400, "ADT": -10800, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000,
    "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
BUCKET_S = 1 << 25  # about a year: the index cell of the zone-offset intervals
FIRST_YEAR, LAST_YEAR = 1900, 2100

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,12})?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*([+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}))?(?:\[[A-Za-z_/+-]+\])?"
_TAIL = rf"(?:(?:[T,]\s*|,?\s+){_CLOCK}{_AMPM}{_ZONE})?$"
# every pattern is rewritten to year|month|day|hour|minute|second|half|zone
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TAIL
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?(?:[.,]\d{1,12})?" + _ZONE + ")?$"
_LAST = r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})" + _TAIL
_NAMED = r"^(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4})" + _TAIL
_US = r"^(?:[A-Za-z]{3,9}\.?,\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TAIL


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as the only row of an inlined array. The optimizer moves no filter or projection through it, so each
    expression stays one expression and is not copied into all that use it."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))


def stripped(c: Column) -> Column:
    """``c`` without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def _month(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(zip(MONTHS, MONTH_NAMES, strict=True)) for x in ((a, str(i + 1)) if a == b else (a, str(i + 1), b, str(i + 1)))], F.lit("sept"), F.lit("9"))
    return F.try_element_at(table, F.lower(c))


def with_moment(df: DataFrame, text: Column, day_first: Column, out: str) -> DataFrame:
    """Add ``out``: struct of ``local_s`` (seconds of the written calendar time), ``epoch_s`` (if the text counts from an
    epoch), ``zone`` (the offset or abbreviation shown, else null); null where the text names no moment.

    ``day_first`` decides all-digit dates whose year comes last. The steps are columns of their own, so that each
    pattern runs once a row.
    """
    s, n, digits = F.col("__s"), F.length("__s"), F.col("__s").rlike(r"^\d+$")
    first = F.ascii(s)
    number = (first >= 48) & (first <= 57)
    pattern = (
        F.when(digits, F.when(n.isin(8, 12, 14), "compact"))
        .when(number & F.substring(s, 5, 1).isin("-", "/", "."), "iso")
        .when(number & (F.substring(s, 9, 1) == "T"), "compact")
        .when(number & s.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"), F.when(day_first, "dmy").otherwise("mdy"))
        .when(number | s.rlike(r"^[A-Za-z]{3,9}\.?,?\s+\d{1,2}(?:st|nd|rd|th)?[\s-]+[A-Za-z]"), "named")
        .when(s.rlike(r"^[A-Za-z]"), "us")
    )
    kind = F.col("__kind")
    raw = (
        F.when(kind == "iso", F.regexp_replace(s, _ISO, "$1|$2|$3|$4|$5|$6|$7|$8"))
        .when(kind == "dmy", F.regexp_replace(s, _LAST, "$4|$3|$1|$5|$6|$7|$8|$9"))
        .when(kind == "mdy", F.regexp_replace(s, _LAST, "$4|$1|$3|$5|$6|$7|$8|$9"))
        .when(kind == "named", F.regexp_replace(s, _NAMED, "$3|$2|$1|$4|$5|$6|$7|$8"))
        .when(kind == "compact", F.regexp_replace(s, _COMPACT, "$1|$2|$3|$4|$5|$6||$7"))
        .when(kind == "us", F.regexp_replace(s, _US, "$3|$1|$2|$4|$5|$6|$7|$8"))
    )
    part = lambda i: F.try_element_at(F.col("__parts"), F.lit(i))
    num = lambda i: F.when(part(i) != "", part(i).try_cast("int")).otherwise(0)
    month = F.when(F.ascii(part(2)).between(48, 57), part(2)).otherwise(_month(part(2)))
    half = F.upper(part(7))
    hour = F.when(half == "", num(4)).when(num(4).between(1, 12), num(4) % 12 + F.when(half == "P", 12).otherwise(0))
    size = F.length("__whole")
    v = F.col("__whole").try_cast("long")
    digits_read = F.col("__size")
    epoch = F.when(digits_read.isin(9, 10), F.col("__whole")).when(digits_read == 13, F.expr("__whole div 1000")).when(digits_read == 16, F.expr("__whole div 1000000")).when(digits_read == 19, F.expr("__whole div 1000000000"))
    serial = F.when((n == 5) & digits, (s.try_cast("long") - 25569) * 86400)
    zone = F.when(part(8) != "", F.upper(part(8)))
    fits = (F.col("__h") <= 23) & (F.col("__mi") <= 59) & (F.col("__se") <= 59)
    local = F.coalesce(F.when(fits, F.unix_date("__day").cast("long") * 86400 + F.col("__h") * 3600 + F.col("__mi") * 60 + F.col("__se")), F.col("__serial"))
    shape = "struct<local_s:bigint,epoch_s:bigint,zone:string>"
    steps = [
        {"__s": stripped(text)},
        {"__kind": pattern, "__whole": F.when(number & ~(digits & n.isin(12, 14)), F.regexp_extract(s, r"^(\d{9,19})(?:[.,]\d{1,12})?$", 1)), "__serial": serial},
        {"__parts": F.split(raw, r"\|"), "__whole": F.when(size >= 9, v), "__size": size},
        {"__day": F.concat_ws("-", part(1), F.lpad(month, 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date"), "__h": hour, "__mi": num(5), "__se": num(6), "__zone": zone, "__epoch": epoch},
        {out: F.when(F.coalesce("__epoch", local).isNotNull(), F.struct(local.alias("local_s"), F.col("__epoch").alias("epoch_s"), F.col("__zone").alias("zone"))).cast(shape)},
    ]
    for step in steps:
        df = settled(df, step)
    return df.drop("__s", "__kind", "__whole", "__size", "__serial", "__parts", "__day", "__h", "__mi", "__se", "__zone", "__epoch")


def zone_intervals(zones: Iterable[str]) -> list[tuple[str, int, int, int]]:
    """Rows (tz, start_utc, end_utc, offset) of constant offset, by bisection over the public zone rules.

    The size is bounded by the time-zone database: some 600 zones with a few hundred changes each.
    """
    rows = []
    utc = dt.UTC
    first, last = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=utc).timestamp()), int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=utc).timestamp())
    for name in sorted(set(zones)):
        try:
            zone = ZoneInfo(name)
        except (ZoneInfoNotFoundError, ValueError):
            continue
        offset = lambda t, z=zone: int(dt.datetime.fromtimestamp(t, z).utcoffset().total_seconds())
        start, known = first, offset(first)
        step = 86400 * 7
        t = first
        while t < last:
            nxt = min(t + step, last)
            if offset(nxt) != known:
                lo, hi = t, nxt
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == known else (lo, mid)
                rows.append((name, start, hi, known))
                start, known, nxt = hi, offset(hi), hi
            t = nxt
        rows.append((name, start, last, known))
    return rows


def interval_index(spark: SparkSession, zones: Iterable[str]) -> DataFrame:
    """The intervals on the local time line, exploded to index cells: (tz, cell, spans array<struct<lo, hi, off>>).

    Every cell also holds the neighbouring intervals, so that a skipped time finds the interval that ended before it.
    """
    cells: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for name, start, end, off in zone_intervals(zones):
        lo, hi = start + off, end + off
        for cell in range((lo - 86400) // BUCKET_S, (hi + 86400) // BUCKET_S + 1):
            cells.setdefault((name, cell), []).append((lo, hi, off))
    return spark.createDataFrame([(z, c, spans) for (z, c), spans in cells.items()], "tz string, cell long, spans array<struct<lo:long,hi:long,off:long>>")


def abbreviation_offsets(zones: Iterable[str]) -> dict[str, int]:
    """``tz|ABBR`` to offset in seconds, as each zone itself uses the abbreviation since 1970."""
    out: dict[str, int] = {}
    for name in sorted(set(zones)):
        try:
            zone = ZoneInfo(name)
        except (ZoneInfoNotFoundError, ValueError):
            continue
        for year in range(1970, 2038):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 15, tzinfo=zone)
                if (abbr := t.tzname()) and abbr.isalpha():
                    out[f"{name}|{abbr.upper()}"] = int(t.utcoffset().total_seconds())
    return out


def resolve_utc(df: DataFrame, moment: str, tz: str, zones: Iterable[str], out: str = "utc_second") -> DataFrame:
    """Add ``out`` (UTC second) and ``out_status`` (``epoch``, ``offset``, ``exact``, ``ambiguous``, ``nonexistent``, null).

    ``moment`` is a ``with_moment`` column, ``tz`` the name of the row's home clock (may be null: then only stamps that
    show their zone get a result). ``zones`` are the clocks that occur; the interval index over them is bounded by the
    time-zone database and therefore broadcast.
    """
    zones = [z for z in zones if z]
    local, zone = F.col("__l"), F.col("__z")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    bare = F.regexp_replace(zone, "[+:-]", "")
    hours, minutes = F.substring(bare, 1, 2).try_cast("int"), F.when(F.length(bare) == 4, F.substring(bare, 3, 2).try_cast("int")).otherwise(0)
    numeric = F.when(zone.rlike(r"^[+-]"), sign * (hours * 3600 + minutes * 60))
    names = F.create_map(*[F.lit(x) for kv in {**ABBREVIATIONS, **abbreviation_offsets(zones)}.items() for x in kv])
    universal = zone.isin("Z", "UTC", "UT", "GMT")
    named = F.when(universal, F.lit(0)).otherwise(F.coalesce(F.try_element_at(names, F.concat_ws("|", F.col(tz), zone)), F.try_element_at(names, zone)))
    index = interval_index(df.sparkSession, zones).withColumnsRenamed({"tz": "__tz", "cell": "__cell", "spans": "__spans"})
    keyed = settled(df, {"__l": F.col(f"{moment}.local_s"), "__e": F.col(f"{moment}.epoch_s"), "__z": F.col(f"{moment}.zone")})
    keyed = settled(keyed, {"__k": F.when(zone.isNull() & local.isNotNull(), F.col(tz)), "__c": F.floor(local / F.lit(BUCKET_S)), "__o": F.when(zone.isNotNull(), F.coalesce(numeric, named))})
    joined = keyed.join(F.broadcast(index), (F.col("__k") == F.col("__tz")) & (F.col("__c") == F.col("__cell")), "left")
    holding = F.filter("__spans", lambda x: (x["lo"] <= local) & (local < x["hi"]))
    before = F.filter("__spans", lambda x: x["hi"] <= local)
    k = F.size("__hold")
    gap = F.array_max(F.transform(before, lambda x: F.struct(x["hi"], x["off"])))["off"]
    joined = settled(joined, {"__hold": F.when(F.col("__spans").isNotNull(), holding)})
    joined = settled(joined, {"__off": F.when(k == 1, F.col("__hold")[0]["off"]).when(k > 1, F.array_max(F.transform("__hold", lambda x: x["off"]))).when(k == 0, gap)})
    status = (
        F.when(F.col("__e").isNotNull(), "epoch")
        .when(F.col("__o").isNotNull(), "offset")
        .when(F.col("__spans").isNull(), F.lit(None).cast("string"))
        .when(k == 1, "exact").when(k >= 2, "ambiguous").otherwise("nonexistent")
    )
    utc = F.coalesce(F.col("__e"), local - F.col("__o"), local - F.col("__off"))
    return settled(joined, {out: utc, f"{out}_status": status}).drop("__l", "__e", "__z", "__k", "__c", "__o", "__tz", "__cell", "__spans", "__hold", "__off")


def clock_names(*dims: tuple[DataFrame, str]) -> list[str]:
    """The distinct clock names of dimension columns, of those the time-zone database has; no others come to the driver."""
    names: set[str] = set()
    for df, c in dims:
        names |= {r[0] for r in df.select(c).where(F.col(c).isin(sorted(available_timezones()))).distinct().collect()}
    return sorted(names)


def price_moments(prices: DataFrame, companies: DataFrame) -> DataFrame:
    """``prices`` plus ``code`` (trimmed, upper case) and ``utc_second`` of its day-first ``Date``.

    Rows whose code is unknown get a result only if the stamp shows its zone.
    """
    clocks = companies.select(F.upper(stripped(F.col("ticker"))).alias("__ticker"), F.col("listing_tz").alias("__home")).dropDuplicates(["__ticker"])
    base = with_moment(prices.withColumn("code", F.upper(stripped(F.col("Stock Code")))), F.col("Date"), F.lit(True), "__m")
    joined = base.join(clocks, F.col("code") == F.col("__ticker"), "left")
    return resolve_utc(joined, "__m", "__home", clock_names((companies, "listing_tz"))).drop("__m", "__home", "__ticker")


def article_moments(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``articles`` plus ``utc_second`` of ``published_at``, on the outlet's clock and in its date order."""
    dims = sources.select(F.col("source_name").alias("__source"), F.col("home_tz").alias("__home"), (F.lower("date_order") != "mdy").alias("__dmy")).dropDuplicates(["__source"])
    joined = articles.join(dims, F.col("source_name") == F.col("__source"), "left")
    moments = with_moment(joined, F.col("published_at"), F.coalesce(F.col("__dmy"), F.lit(True)), "__m")
    return resolve_utc(moments, "__m", "__home", clock_names((sources, "home_tz"))).drop("__m", "__home", "__dmy", "__source")


def normalised_moments(articles: DataFrame, prices: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """(table_name, row_id, utc_second) of every readable stamp that is not yet in the canonical form."""
    news = articles.select("id", "published_at", "source_name").where(~F.col("published_at").rlike(CANONICAL))
    rows = prices.select("price_id", "Stock Code", "Date").where(~F.col("Date").rlike(CANONICAL))
    a = article_moments(news, sources).select(F.lit("news_articles").alias("table_name"), F.col("id").cast("long").alias("row_id"), "utc_second")
    p = price_moments(rows, companies).select(F.lit("prices").alias("table_name"), F.col("price_id").cast("long").alias("row_id"), "utc_second")
    return a.unionByName(p).where(F.col("utc_second").isNotNull())
