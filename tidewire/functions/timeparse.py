"""Reading of timestamps written as text, as column expressions only (no Python per row).

``with_parts`` reads a text column into wall-clock parts and a stated zone; ``with_instant`` turns such
parts, and a zone for the zoneless ones, into microseconds since 1970 UTC. Both are total: null, empty,
impossible and meaningless values give null.
"""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120,
    "eest": 180, "msk": 180, "msd": 240, "мск": 180, "samt": 240, "yekt": 300, "yekst": 360, "omst": 360,
    "ist": 330, "novt": 420, "krat": 420, "irkt": 480, "yakt": 540, "jst": 540, "vlat": 600, "vlast": 660,
    "magt": 660, "pett": 720, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420,
}
# Month names by their first three letters.
MONTHS = {
    "янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10,
    "ноя": 11, "дек": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "oct": 10, "nov": 11, "dec": 12,
}
# Relative days.
RELATIVE = {"сегодня": 0, "вчера": -1, "позавчера": -2, "завтра": 1, "today": 0, "yesterday": -1, "tomorrow": 1}

_T = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*(z|[+-]\d{1,2}(?::?\d{2})?|[a-zа-я]{2,5}|[a-z]+(?:/[a-z_+-]+)+)?(?:\s*\[([a-z_/+-]+)\])?"
_MON = r"([a-zа-я]{3})[a-zа-я]*\.?"
_YEAR = r"(\d{4}|\d{2})"
_G = r"(?:\s*г(?:\.|ода)?)?"
_AMPM = r"\s*([ap])\.?m\.?"

#: Order matters only between AM/PM and plain slashes. Parts of the template: year|month|day|hour|minute|second|fraction|zone|am/pm
_FORMS = (
    # 2025-01-31, 2025-01-31T10:20[:30[.123]][zone]
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:[t]|,?\s+){_T}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    # 20250131T102030Z
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    # 01/31/2025 10:20 PM: month first
    (rf"^(\d{{1,2}})/(\d{{1,2}})/{_YEAR},?\s+{_T}{_AMPM}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    # 31.01.2025 [10:20[:30]], 31/01/2025
    (rf"^(\d{{1,2}})([./-])(\d{{1,2}})\2{_YEAR}(?:(?:,?\s+|t|\s+в\s+){_T}{_ZONE})?$", "$4|$3|$1|$5|$6|$7|$8|$9|"),
    # Fri, 31 Jan 2025 10:20:30 +0300; 31 января 2025 г., 10:20; 31 янв. 2025 в 10.20
    (rf"^(?:[a-zа-я]{{2,11}}\.?,?\s+)?(\d{{1,2}})[\s-]+{_MON}[\s-]+{_YEAR}{_G}(?:(?:,?\s+в\s+|,?\s+){_T}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    # 10:20, 31 января 2025
    (rf"^{_T},?\s+(\d{{1,2}})\s+{_MON}\s+{_YEAR}{_G}{_ZONE}$", "$7|$6|$5|$1|$2|$3|$4|$8|"),
    # January 31, 2025 10:20 p.m.
    (rf"^(?:[a-z]{{3,9}},\s+)?{_MON}\s+(\d{{1,2}}),?\s+{_YEAR}(?:,?\s+(?:at\s+)?{_T}(?:{_AMPM})?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    # сегодня, 10:20; вчера в 10:20
    (rf"^(сегодня|вчера|позавчера|завтра|today|yesterday|tomorrow)(?:,?\s*(?:в|at)?\s*{_T}{_ZONE})?$", "|$1||$2|$3|$4|$5|$6|"),
)
_EPOCH = r"^([+-]?\d{9,11}|[+-]?\d{12,14})(?:\.(\d+))?$"


@lru_cache(maxsize=1)
def known_zones() -> dict[str, str]:
    """IANA names by their lower-case form; about 600, a fixed set."""
    return {z.lower(): z for z in zoneinfo.available_timezones() if "/" in z or z == "UTC"}


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, behind a one-row Generate, however often they are used.

    Project collapsing and filter pushdown would else copy a long expression into every place of use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


PARTS = ("kind", "epoch_us", "rel_days", "year", "month", "day", "hour", "minute", "second", "micros", "offset_min", "zone")


def with_parts(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_p_*`` columns of the text column ``value``: the wall-clock parts it names (see PARTS).

    kind is 'epoch', 'date', 'relative' or null where the value is unreadable. offset_min is a stated
    offset, zone a stated IANA name.
    """
    df = let(df, _t=F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col(value), r"(?U)[\s\x{200B}\x{FEFF}\x{2060}]+", " "), r"[\x{2010}-\x{2015}\x{2212}](?=\d)", "-"))))
    clean = F.col("_t")
    canonical = F.coalesce(*[F.when(clean.rlike(p), F.regexp_replace(clean, p, t)) for p, t in _FORMS])
    df = let(df, _p=F.split(canonical, r"\|", -1), _n=F.regexp_extract(clean, _EPOCH, 1), _f=F.regexp_extract(clean, _EPOCH, 2))
    piece = lambda i: F.get("_p", F.lit(i))
    names = ("_y", "_mo", "_d", "_h", "_mi", "_s", "_us", "_z", "_ap")
    df = let(df, **{n: F.when(piece(i) != "", piece(i)) for i, n in enumerate(names)})
    df = let(df, _zd=F.regexp_replace("_z", r"[^0-9]", ""), _r=F.try_element_at(_lookup(RELATIVE), F.col("_mo")), _iana=F.try_element_at(_lookup(known_zones()), F.col("_z")))
    month = F.when(F.col("_r").isNull(), F.coalesce(F.col("_mo").try_cast("int"), F.try_element_at(_lookup(MONTHS), F.substring("_mo", 1, 3))))
    year = F.col("_y").try_cast("int")
    year = F.when(F.length("_y") <= 2, year + 2000).otherwise(year)
    hour = F.coalesce(F.col("_h").try_cast("int"), F.lit(0))
    hour = F.when(F.col("_ap").isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0))
    short = F.length("_zd") <= 2
    hh = F.when(short, F.col("_zd").try_cast("int")).otherwise(F.substring(F.lpad("_zd", 4, "0"), 1, 2).try_cast("int"))
    mm = F.when(short, 0).otherwise(F.substring(F.lpad("_zd", 4, "0"), 3, 2).try_cast("int"))
    sign = F.when(F.substring("_z", 1, 1) == "-", -1).otherwise(1)
    numeric = F.col("_z").rlike(r"^[+-]\d")
    offset = F.when(numeric & (hh <= 18) & (mm < 60), sign * (hh * 60 + mm)).when(~numeric, F.try_element_at(_lookup(ABBREVIATIONS), F.col("_z")))
    secs = F.col("_n").try_cast("long")
    frac = F.coalesce(F.substring(F.rpad("_f", 6, "0"), 1, 6).try_cast("long"), F.lit(0).cast("long"))
    few = F.length(F.regexp_replace("_n", r"[+-]", "")) <= 11
    epoch = F.when(F.col("_n") != "", F.when(few, secs * 1_000_000 + frac).otherwise(secs * 1000 + F.floor(frac / 1000).cast("long")))
    df = let(df, _p_epoch_us=epoch, _p_offset_min=offset.cast("int"), _p_year=year.cast("int"))
    bad_zone = F.col("_z").isNotNull() & F.col("_p_offset_min").isNull() & F.col("_iana").isNull()
    kind = F.when(F.col("_p_epoch_us").isNotNull(), "epoch").when(bad_zone, None).when(F.col("_r").isNotNull(), "relative").when(F.col("_p_year").isNotNull(), "date")
    df = let(
        df,
        _p_kind=kind,
        _p_rel_days=F.col("_r"),
        _p_month=month.cast("int"),
        _p_day=F.col("_d").try_cast("int"),
        _p_hour=hour.cast("int"),
        _p_minute=F.coalesce(F.col("_mi").try_cast("int"), F.lit(0)),
        _p_second=F.coalesce(F.col("_s").try_cast("int"), F.lit(0)),
        _p_micros=F.coalesce(F.substring(F.rpad("_us", 6, "0"), 1, 6).try_cast("int"), F.lit(0)),
        _p_zone=F.col("_iana"),
    )
    return df.drop("_t", "_p", "_n", "_f", *names, "_zd", "_r", "_iana")


_ORIGIN = "1970-01-01 00:00:00"


def _ntz_us(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(_ORIGIN).cast("timestamp_ntz"), ntz)


def us_ntz(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit(_ORIGIN).cast("timestamp_ntz"))


def to_utc_us(wall: Column, zone: Column) -> Column:
    """Wall-clock microseconds in an IANA zone to UTC ones: the first of two, and before a gap the old offset."""
    return _ntz_us(F.convert_timezone(zone, F.lit("UTC"), us_ntz(wall)))


def with_wall(df: DataFrame, zone: str, reference: str) -> DataFrame:
    """Adds ``_wall``: the parts' wall clock as if it were UTC, in microseconds; null for epochs and impossible
    dates. ``zone`` and ``reference`` (an instant) say which day a relative day is."""
    local = F.convert_timezone(F.lit("UTC"), F.coalesce("_p_zone", zone), us_ntz(F.unix_micros(F.col(reference).cast("timestamp"))))
    stated = us_ntz(F.unix_micros(F.col(reference).cast("timestamp")) + F.col("_p_offset_min").cast("long") * 60_000_000)
    df = let(df, _today=F.when(F.col("_p_kind") == "relative", F.date_add(F.coalesce(stated, local).cast("date"), F.coalesce("_p_rel_days", F.lit(0)))))
    rel = F.col("_today").isNotNull()
    y = F.when(rel, F.year("_today")).otherwise(F.col("_p_year"))
    m = F.when(rel, F.month("_today")).otherwise(F.col("_p_month"))
    d = F.when(rel, F.dayofmonth("_today")).otherwise(F.col("_p_day"))
    ok = F.col("_p_second").between(0, 59) & F.col("_p_minute").between(0, 59) & F.col("_p_hour").between(0, 23)
    ntz = F.when(ok & (y > 0), F.try_make_timestamp_ntz(y, m, d, F.col("_p_hour"), F.col("_p_minute"), F.col("_p_second").cast("decimal(16,6)")))
    return let(df, _wall=F.when(F.col("_p_kind") != "epoch", _ntz_us(ntz) + F.col("_p_micros"))).drop("_today")


def with_instant(df: DataFrame, zone: str, reference: str, out: str) -> DataFrame:
    """Adds ``out``: microseconds since 1970 UTC. ``zone`` (a column of IANA names, not null) counts where the
    value states no zone."""
    df = with_wall(df, zone, reference)
    by_offset = F.col("_wall") - F.col("_p_offset_min").cast("long") * 60_000_000
    by_zone = to_utc_us(F.col("_wall"), F.coalesce("_p_zone", zone))
    value = F.when(F.col("_p_kind") == "epoch", F.col("_p_epoch_us")).when(F.col("_p_offset_min").isNotNull(), by_offset).otherwise(by_zone)
    return let(df, **{out: value}).drop("_wall", *[f"_p_{n}" for n in PARTS])
