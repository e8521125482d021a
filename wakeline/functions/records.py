"""Cleaning of raw position reports: coercion, validation, classification and quality flags as Column expressions."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_NAME = "未知目标"
# What counts as a missing name, compared case-folded and trimmed.
MISSING_NAMES = ("", "-", "--", "<na>", "n/a", "na", "nan", "none", "null", "unknown", "unknown target", "未命名", "未知", "未知船名", "未知船舶")
# Fixed values of the message standard: which types carry a position, which carry particulars.
POSITION_TYPES = (1, 2, 3, 18, 19, 27)
PARTICULAR_TYPES = (5, 24)
HOME_PREFIXES = ("412", "413", "414")


def first_filled(*columns: str | Column) -> Column:
    """The first that is neither null nor blank."""
    found = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in found))


def finite(c: Column) -> Column:
    """As double; text that is no number, NaN and infinities become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def whole(c: Column) -> Column:
    """As integer, cut toward zero."""
    return finite(c).try_cast("int")


def truth(c: Column) -> Column:
    """Three-valued: yes for 1/true/yes/y/是, null for blank, else no."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isNull() | (text == ""), None).otherwise(text.isin("1", "1.0", "true", "yes", "y", "是"))


def clean_name(c: Column) -> Column:
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*MISSING_NAMES), UNKNOWN_NAME).otherwise(F.trim(c))


def valid_mmsi(c: Column) -> Column:
    """Nine digits, else null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike("^[0-9]{9}$"), text)


def ship_mmsi(c: Column) -> Column:
    """Nine digits of a ship station: the first is 2 to 7."""
    return F.when(F.trim(c.cast("string")).rlike("^[2-7][0-9]{8}$"), F.trim(c.cast("string")))


def registry(c: Column) -> Column:
    """'chinese' or 'foreign' by the country digits; null for no ship station."""
    return F.when(ship_mmsi(c).isNull(), None).when(F.substring(ship_mmsi(c), 1, 3).isin(*HOME_PREFIXES), "chinese").otherwise("foreign")


def message_kind(msg_type: Column, lon: Column, lat: Column) -> Column:
    return (
        F.when(msg_type.isin(*POSITION_TYPES), "dynamic").when(msg_type.isin(*PARTICULAR_TYPES), "static")
        .when(msg_type.isNull() & lon.isNotNull() & lat.isNotNull(), "dynamic").otherwise("unsupported")
    )


def event_time(c: Column) -> Column:
    """Timestamps from ISO text (naive: UTC) or epoch numbers, whose unit shows in their magnitude."""
    n = finite(c)
    seconds = F.when(F.abs(n) < 1e11, n).when(F.abs(n) < 1e14, n / 1e3).when(F.abs(n) < 1e17, n / 1e6).otherwise(n / 1e9)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(c.cast("string")))


def filter_time(text: str | None, end: bool = False) -> datetime | None:
    """The moment that a filter's text means, naive ones in UTC; the end of a bare date is the next day's start. None for no text; what is no time raises."""
    if not text:
        return None
    found = datetime.fromisoformat(text)
    if len(text.strip()) <= 10:
        found += timedelta(days=int(end))
    return found if found.tzinfo else found.replace(tzinfo=UTC)


#: The particulars that a static report may bring, besides its name: text and numbers.
STATIC_TEXT, STATIC_NUMBERS = ("imo", "flag", "ship_type", "source"), ("draught", "length", "width", "to_bow", "to_stern", "to_port", "to_starboard")


def normalise_static(reports: DataFrame) -> DataFrame:
    """Static reports (mmsi, t, msg_type, name, iso3 and any of the particulars) with coerced fields; those without a valid mmsi or time go, and others than static ones.

    Text is trimmed and empty text is null, numbers must be finite, iso3 is upper case; particulars that the input has no column for are null.
    """
    have = set(reports.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    text = lambda c: F.nullif(F.trim(get(c).cast("string")), F.lit(""))
    kind = message_kind(whole(get("msg_type")), F.lit(None).cast("double"), F.lit(None).cast("double"))
    own = reports.filter(kind == "static").withColumn("mmsi", valid_mmsi(F.col("mmsi"))).filter("mmsi is not null and t is not null")
    return own.select("mmsi", "t", clean_name(get("name")).alias("name"), F.upper(text("iso3")).alias("iso3"), *(text(c).alias(c) for c in STATIC_TEXT), *(finite(get(c)).alias(c) for c in STATIC_NUMBERS))


def normalise(reports: DataFrame) -> DataFrame:
    """Position reports with coerced fields; a value that is missing or out of range is null and leaves a flag. Needs mmsi, t, lon, lat, speed, course, heading, rot.

    Rows without a valid mmsi or position are dropped, as nothing can be placed without them.
    """
    valid = {
        "speed": lambda x: x.between(0, 102.2), "course": lambda x: (x >= 0) & (x < 360),
        "heading": lambda x: (x >= 0) & (x < 360), "rot": lambda x: x != -128,
    }
    out = reports.withColumns({"mmsi": valid_mmsi(F.col("mmsi")), **{c: finite(F.col(c)) for c in ("lon", "lat", *valid)}})
    out = out.filter(F.col("mmsi").isNotNull() & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    missing = F.array(*(F.when(~F.coalesce(ok(F.col(c)), F.lit(False)), f"{c}_unavailable") for c, ok in valid.items()))
    return out.withColumn("quality_flags", F.array_compact(missing)).withColumns({c: F.when(ok(F.col(c)), F.col(c)) for c, ok in valid.items()})


def identity_mismatch(mmsi: Column, iso3: Column, flag: Column) -> Column:
    """Whether the country digits say China or Hong Kong and the stated registry the other one; an unknown side is no mismatch."""
    expected = F.when(F.substring(mmsi.cast("string"), 1, 3) == "477", "HKG").when(F.substring(mmsi.cast("string"), 1, 3).isin(*HOME_PREFIXES), "CHN")
    code, words = F.upper(F.coalesce(iso3, F.lit(""))), F.upper(F.coalesce(flag, F.lit("")))
    # How a flag field names the two registries.
    by_flag = F.when(words.isin("CHINA", "CN", "CHN", "中国"), "CHN").when(words.isin("HONG KONG", "HKG", "香港"), "HKG")
    stated = F.when(code == "", by_flag).otherwise(code)
    return F.coalesce(stated.isin("CHN", "HKG") & (expected != stated), F.lit(False))


def split_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, particulars); unsupported messages are left out."""
    kind = message_kind(whole(F.col("msg_type")), finite(F.col("lon")), finite(F.col("lat")))
    return reports.filter(kind == "dynamic"), reports.filter(kind == "static")


def at_night(t: Column, offset_hours: float, start: int, end: int) -> Column:
    """Local hour within [start, end), across midnight if start > end, always if equal. ``t`` in epoch seconds."""
    hour = F.floor(F.pmod(t + offset_hours * 3600, F.lit(86400)) / 3600)
    if start == end:
        return F.lit(True)
    inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
    return inside


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def matches_text(query: str, *columns: str) -> Column:
    """Case-insensitive containment in any column."""
    return any_of([F.lower(F.col(c).cast("string")).contains(query.lower()) for c in columns])


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


# Fixed values of the reporting standard: (speed up to, seconds, seconds while turning); beyond the last row the fallback.
_CLASS_A = ((14.0, 10.0, 10.0 / 3.0), (23.0, 6.0, 2.0))
_CLASS_B = ((2.0, 180.0, 180.0), (14.0, 30.0, 30.0), (23.0, 15.0, 5.0))


def reporting_interval(msg_type: Column, speed: Column, nav_status: Column, rot: Column) -> Column:
    """Nominal seconds between a vessel's position reports, by message class, speed, status and turning; an unknown speed counts as slow."""
    turning, knots = F.coalesce(F.abs(rot) > 1e-9, F.lit(False)), F.coalesce(speed, F.lit(0.0))

    def ladder(steps: tuple[tuple[float, float, float], ...], beyond: float) -> Column:
        out = F.lit(beyond)
        for most, steady, turned in reversed(steps):
            out = F.when(knots <= most, F.when(turning, turned).otherwise(steady)).otherwise(out)
        return out

    moored = nav_status.isin(1, 5) & (knots <= 3)
    return F.when(msg_type == 27, 180.0).when(msg_type.isin(18, 19), ladder(_CLASS_B, 5.0)).when(moored, 180.0).otherwise(ladder(_CLASS_A, 2.0))
