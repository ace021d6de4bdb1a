"""Tolerant coercion of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import normalize_text, text



def int_or_null(c: Column | str) -> Column:
    """1,234 and 1.234 are 1234; a plain decimal is cut; anything else is NULL."""
    v = F.trim(text(c))
    grouped = v.rlike(r"^\d{1,3}([.,]\d{3})+$")
    plain = F.regexp_replace(v, ",", "").try_cast("double")
    return F.when(v == "", None).when(grouped, F.regexp_replace(v, "[.,]", "").try_cast("bigint")).otherwise(F.when(plain >= 0, F.floor(plain)).otherwise(F.ceil(plain)).cast("bigint"))


def decimal_or_null(c: Column | str) -> Column:
    """Half-up to two places within 0..5."""
    v = F.round(F.trim(text(c)).try_cast("decimal(20,6)"), 2)
    return F.when(v.between(0, 5), v).cast("decimal(3,2)")


def float_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.trim(text(c)).try_cast("double"), F.lit(0.0))


def bool_value(c: Column | str) -> Column:
    return normalize_text(c).isin("1", "true", "yes", "y", "on", "do not contact", "dnc")


def status_value(c: Column | str) -> Column:
    """verified, not_verified or other, from free text."""
    n = normalize_text(c)
    good = n.isin("verified", "valid", "approved", "complete", "yes", "a") | F.contains(n, F.lit("verified")) | n.rlike("^(a |b |high|complete)")
    held = n.rlike("needs proof|pending|not verified|unverified|incomplete|no contact")
    return F.when(n.isin("not verified", "invalid", "failed", "undeliverable", "no"), "not_verified").when(good & ~held, "verified").otherwise("other")


def video_status_value(c: Column | str) -> Column:
    v = F.replace(normalize_text(c), F.lit(" "), F.lit("_"))
    return F.when(v.isin(fixed.VIDEO_STATUSES), v).otherwise("not_checked")


def clean_contact(c: Column | str) -> Column:
    v = F.trim(text(c))
    return F.when(F.lower(v).isin("", "none", "no", "n/a", "null", "false"), "").otherwise(v)


def repair_shifted(df: DataFrame, name: str = "author_name", phone: str = "phone", mail: str = "email", mail_proof: str = "email_proof", phone_proof: str = "phone_proof") -> DataFrame:
    """df with cells that slipped by a column put back: a name that stands as the phone, and an address that stands as its own proof (the phone's proof then becomes the address's, if it is a link)."""
    number, address, proof, other = clean_contact(phone), clean_contact(mail), F.trim(text(mail_proof)), F.trim(text(phone_proof))
    link = lambda c: c.rlike("^https?://")
    named = F.lower(text(name)).rlike("children|verified") & (number != "") & ~number.rlike(r"\p{N}")
    moved = (address == "") & F.contains(proof, F.lit("@")) & ~link(proof)
    return df.withColumns({
        name: F.when(named, number).otherwise(text(name)), phone: F.when(named, "").otherwise(number), mail: F.when(moved, proof).otherwise(address),
        mail_proof: F.when(moved & link(other), other).when(moved, "").otherwise(proof), phone_proof: F.when(moved & link(other), "").otherwise(other),
    })


def children_flags(c: Column | str) -> Column:
    """struct(is_childrens, is_picture), three-valued, from a proof text."""
    v = F.lower(F.trim(text(c)))
    known = v.rlike("children|kid|picture|illustrated|illustration|yes")
    child = F.when(v.startswith("no"), False).when((v != "") & known, v.rlike("children|kid") | (v == "yes"))
    picture = F.when(v.startswith("no"), False).when((v != "") & known, v.rlike("picture|illustrated|illustration"))
    return F.struct(child.alias("is_childrens"), picture.alias("is_picture"))


def clamp_confidence(c: Column | str) -> Column:
    """Labels as numbers, numbers within 0..1, anything else 0."""
    v = F.lower(F.trim(text(c)))
    labels = {"very high": 0.95, "high": 0.85, "medium": 0.55, "moderate": 0.55, "low": 0.25, "very low": 0.1, "unclear": 0.2}
    out = F.when(F.lit(False), 0.0)
    for k, x in labels.items():
        out = out.when(v == k, x)
    return out.otherwise(F.least(F.greatest(F.coalesce(v.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def merge_confidence(*columns: Column | str) -> Column:
    """Mean of the clamped values that are not NULL, half-even to two places; 0 without any."""
    values = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() if isinstance(c, str) else c.isNotNull(), clamp_confidence(c)) for c in columns)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when(F.size(values) > 0, F.rint(mean * 100) / 100).otherwise(0.0)


def publication_year(*columns: Column | str) -> Column:
    """The first year from 1500 to 2099 in any of the values."""
    return F.regexp_extract(F.concat_ws(" ", *map(text, columns)), r"\b(1[5-9]\d{2}|20\d{2})\b", 1).try_cast("int")


MONTHS = "january february march april may june july august september october november december".split()


def clean_pub_date(c: Column | str) -> Column:
    """ISO day, written month, year and month, or year; else blank."""
    v = F.trim(F.replace(F.trim(text(c)), F.lit(" 00:00:00"), F.lit("")))
    pad = lambda x: F.lpad(x, 2, "0")
    iso = r"\b(19\d{2}|20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
    written = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),?\s+(20\d{2}|19\d{2})"
    ym = r"\b(19\d{2}|20\d{2})[-/](\d{1,2})\b"
    g = lambda p, i: F.regexp_extract(v, p, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(g(written, 1))).cast("string")
    return (
        F.when(v.rlike(r"^\d+\.0$"), F.regexp_replace(v, r"\.0$", ""))
        .when(v.rlike(iso), F.concat_ws("-", g(iso, 1), pad(g(iso, 2)), pad(g(iso, 3))))
        .when(v.rlike(written), F.concat_ws("-", g(written, 3), pad(month), pad(g(written, 2))))
        .when(v.rlike(ym), F.concat_ws("-", g(ym, 1), pad(g(ym, 2))))
        .otherwise(g(r"\b(19\d{2}|20\d{2})\b", 1))
    )


def year_in_window(c: Column | str, start: int | None, end: int | None, lenient: bool) -> Column:
    """Whether the first four characters are a year within the bounds. Unknown years pass if lenient, else only without bounds."""
    y = F.left(text(c), F.lit(4)).try_cast("int")
    inside = F.lit(True)
    if start:
        inside = inside & (y >= start)
    if end:
        inside = inside & (y <= end)
    return F.coalesce(inside & y.isNotNull(), F.lit(False)) | (y.isNull() & F.lit(lenient or not (start or end)))


def year_window_string(c: Column | str, start: int | None, end: int | None) -> Column:
    """Blank left out; compared as text."""
    v = text(c)
    out = v != ""
    if start is not None:
        out = out & (v >= str(start))
    if end is not None:
        out = out & (v < str(end + 1))
    return out


def rating_of_text(c: Column | str) -> Column:
    v = text(c)
    short = F.when(F.length(v) <= 5, F.regexp_extract(v, r"^\s*([0-5](?:\.\d)?)\s*$", 1))
    return F.coalesce(F.nullif(F.regexp_extract(v, r"(?i)([0-5](?:\.\d{1,2})?)\s*(?:out of|/)\s*5", 1), F.lit("")), short).try_cast("double")


def review_count_of_text(c: Column | str) -> Column:
    v = text(c)
    counted = F.nullif(F.regexp_extract(v, r"(?i)(\d[\d,]*)\s*(?:global\s+)?(?:ratings?|reviews?)", 1), F.lit(""))
    short = F.when(F.length(v) <= 12, F.nullif(F.regexp_extract(v, r"^\s*\(?([\d,]+)\)?\s*$", 1), F.lit("")))
    return F.replace(F.coalesce(counted, short), F.lit(","), F.lit("")).try_cast("bigint")


def follower_count(c: Column | str) -> Column:
    """The largest of the "12.3K followers" forms of a text."""
    pattern = r"(?i)([\d][\d.,]*)\s*([KMB])?\s*(?:followers|subscribers)"
    v = text(c)
    numbers, units = F.regexp_extract_all(v, F.lit(pattern), 1), F.regexp_extract_all(v, F.lit(pattern), 2)
    scaled = F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda x: (F.replace(x["n"], F.lit(","), F.lit("")).try_cast("double") * F.when(F.upper(x["u"]) == "K", 1e3).when(F.upper(x["u"]) == "M", 1e6).when(F.upper(x["u"]) == "B", 1e9).otherwise(1.0)))
    return F.array_max(scaled).cast("bigint")


def state_field(c: Column | str, field: str, default: str = "") -> Column:
    """A field of a JSON state column, or the default."""
    return F.coalesce(F.get_json_object(text(c), f"$.{field}"), F.lit(default))


def next_occurrence(reference: Column, frequency: Column, hours: Column, days: Column, run_time: Column) -> Column:
    """The next run strictly after reference (session time zone): after interval hours (1..720), daily, or on weekdays (mon…sun; none: that of reference)."""
    seconds = F.split_part(run_time, F.lit(":"), F.lit(1)).cast("int") * 3600 + F.split_part(run_time, F.lit(":"), F.lit(2)).cast("int") * 60
    names = F.array(*map(F.lit, "mon tue wed thu fri sat sun".split()))
    known = F.filter(days, lambda d: F.array_contains(names, d))
    wanted = F.when(F.size(known) > 0, known).otherwise(F.array(F.element_at(names, F.weekday(reference) + 1)))
    at = lambda i: F.timestamp_add("SECOND", seconds, F.date_add(F.to_date(reference), i).cast("timestamp"))
    days_ahead = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((at(i) > reference) & ((frequency == "daily") | F.array_contains(wanted, F.element_at(names, F.weekday(at(i)) + 1))), at(i)))
    calendar = F.coalesce(F.array_min(F.filter(days_ahead, lambda x: x.isNotNull())), at(F.lit(7)))
    interval = F.timestamp_add("HOUR", F.least(F.greatest(F.coalesce(hours, F.lit(1)), F.lit(1)), F.lit(720)).cast("int"), reference)
    return F.when(frequency == "interval_hours", interval).otherwise(calendar)
