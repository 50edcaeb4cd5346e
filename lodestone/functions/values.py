"""Numbers, dates, codes and steps as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import classify

#: Seconds of each cadence; null is never stale.
CADENCE = {"hourly": 3600, "daily": 86400, "weekly": 604800, "biweekly": 1209600, "monthly": 2678400, "quarterly": 7948800, "semiannual": 15897600, "annual": 31622400}
#: Minutes between polls, with slack for a run that fires early.
POLL_MINUTES = {"hourly": 50, "daily": 20 * 60, "weekly": 9360, "event_driven": 20 * 60, "archival_refresh": 27 * 24 * 60, "one_time": 365 * 24 * 60}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}


def half_up(c: Column) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(c + 0.5)


def parse_number(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


#: Fixed value: an amount and its magnitude.
AMOUNT = r"(-?\d+(?:\.\d+)?)\s*(billion|million|thousand|b|m|k)?\b"


def parse_usd_scaled(c: Column) -> Column:
    """"$1.2 billion" to whole dollars, halves toward plus infinity; null without a number."""
    s = F.trim(F.regexp_replace(F.lower(c.cast("string")), "[$,]", ""))
    unit = F.substring(F.regexp_extract(s, AMOUNT, 2), 1, 1)
    by = F.when(unit == "b", 1e9).when(unit == "m", 1e6).when(unit.isin("k", "t"), 1e3).otherwise(1.0)
    return half_up(F.regexp_extract(s, AMOUNT, 1).try_cast("double") * by).cast("bigint")


#: A date at the start, year first or last; a day or month with its name anywhere; a bare year.
ISO_DATE, US_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
NAMED_DAY, NAMED_MONTH, BARE_YEAR = r"\b([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b", r"\b([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\b", r"^(\d{4})$"


def parse_date_any(c: Column) -> Column:
    """y-m-d, m/d/y or m-d-y at the start, "Mon d, yyyy" or "Mon yyyy" (first of the month) anywhere, "yyyy" (first of the year), else null.

    A text that has the form of a date but isn't one is null.
    """
    s = F.trim(c)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    x = lambda p, i: F.regexp_extract(s, p, i)
    months = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    month = lambda p: F.try_element_at(months, F.lower(x(p, 1)))
    return (
        F.when(s.rlike(ISO_DATE), day(x(ISO_DATE, 1), x(ISO_DATE, 2), x(ISO_DATE, 3)))
        .when(s.rlike(US_DATE), day(x(US_DATE, 3), x(US_DATE, 1), x(US_DATE, 2)))
        .when(s.rlike(NAMED_DAY) & month(NAMED_DAY).isNotNull(), day(x(NAMED_DAY, 3), month(NAMED_DAY), x(NAMED_DAY, 2)))
        .when(s.rlike(NAMED_MONTH) & month(NAMED_MONTH).isNotNull(), day(x(NAMED_MONTH, 2), month(NAMED_MONTH), F.lit("1")))
        .when(s.rlike(BARE_YEAR), day(s, F.lit("1"), F.lit("1")))
    )


def epoch_ms_to_date(c: Column) -> Column:
    return F.to_date(F.timestamp_millis(c.try_cast("bigint")))


def years_between(a: Column, b: Column) -> Column:
    """Years of 365.25 days to one decimal; null if reversed."""
    return F.when(b >= a, half_up(F.datediff(b, a) / 365.25 * 10) / 10)


def lag_days(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def extract_kv(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"([0-9]{2,4})\s*-?\s*kv\b", 1).try_cast("int")


#: The patterns of plan texts, and words that are no names.
COUNTY = r"\bin\s+([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*?)\s+[Cc]ount(?:y|ies)\b"
NAME = r"[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*"
STATION_WORDS = "Switching Station|Substation|Switchyard|Switch|SS|Station"
TRAILING_WORDS = "Switching Station|Switching|Switchyard|Substation|Switch|Station|SS|Line|Project"
NO_NAMES = ("The", "A", "New", "Rebuild", "Construct", "Add", "Amend", "Line", "Energize")


def extract_county(c: Column, title_case: bool = False) -> Column:
    found = F.nullif(F.trim(F.regexp_extract(c, COUNTY, 1)), F.lit(""))
    return F.initcap(F.lower(found)) if title_case else found


def county_from_authority(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i)^(.+?)\s+county\b", 1)), F.lit(""))


def year4(c: Column) -> Column:
    """The first four digits in a row."""
    return F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")


def extract_station_names(c: Column) -> Column:
    """Names before a station word, then both ends of "A to B"; trailing type words off, distinct, without stop words."""
    named = F.regexp_extract_all(c, F.lit(rf"({NAME})\s+(?:{STATION_WORDS})\b"), F.lit(1))
    ends = [F.regexp_extract_all(c, F.lit(rf"({NAME})\s+to\s+({NAME})\b"), F.lit(i)) for i in (1, 2)]
    both = F.flatten(F.zip_with(*ends, lambda a, b: F.array(a, b)))
    tidy = F.transform(F.concat(named, both), lambda x: F.trim(F.regexp_replace(F.trim(x), rf"(?i)(?:\s+(?:{TRAILING_WORDS})){{1,3}}$", "")))
    return F.array_distinct(F.filter(tidy, lambda x: (F.length(x) > 2) & ~x.isin(*NO_NAMES)))


def classify_date_type(section: Column, status: Column) -> Column:
    """What a plan row's date is: the status decides before the section does."""
    s, t = F.lower(F.coalesce(section, F.lit(""))), F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(t.rlike("energiz|in.?service|complete|closed out") | s.rlike("completed"), "actual")
        .when(s.rlike("cancel") | t.rlike("cancel"), "unknown")
        .when(t.rlike("construction"), "required")
        .when(s.rlike("future|rtp|planned|proposed"), "projected")
        .otherwise("unknown")
    )


#: What drives a project, first match first; what marks a large load; kinds of incentive.
DRIVERS = [
    (r"data\s?center|hyperscale|large\s?load|\bAI\b", "load_growth"),
    (r"generation|interconnection|solar|wind|battery|storage|\bGIA\b|POI", "generation_interconnection"),
    (r"reliability|contingency|overload|thermal|voltage", "reliability"),
    (r"economic|congestion|market efficiency", "economic"),
    (r"policy|renewable|CREZ|public policy", "policy"),
    (r"asset condition|aging|rebuild|end of life|replace", "asset_condition"),
]
LARGE_LOAD = r"(?i)data\s?center|hyperscale|large\s?load|crypto|\bAI\b"
INCENTIVES = [
    (r"tax increment|reinvestment zone|\btif\b", "tif"),
    (r"abat", "abatement"),
    (r"exempt", "exemption"),
    (r"payment.?in.?lieu|pilot", "pilot"),
    (r"credit", "credit"),
    (r"grant", "grant"),
    (r"loan", "loan"),
]


def classify_driver(c: Column) -> Column:
    """The first bucket that fits; null for none."""
    return classify(c, DRIVERS)


def is_large_load(c: Column) -> Column:
    return F.coalesce(c.rlike(LARGE_LOAD), F.lit(False))


def normalize_incentive_type(c: Column) -> Column:
    return F.when(F.length(c) > 0, classify(c, INCENTIVES, "other"))


#: Industries by leading digits, the first that fits.
INDUSTRIES = (("3313", "smelter"), ("331", "steel"), ("322", "paper"), ("3344", "fab"), ("324", "refinery"), ("3254", "pharma"), ("325", "chemical"), ("3361", "auto"), ("3362", "auto"), ("3363", "auto"))


def industry_class(naics: Column) -> Column:
    digits = F.regexp_replace(naics, "[^0-9]", "")
    out = F.lit("other")
    for prefix, label in reversed(INDUSTRIES):
        out = F.when(digits.startswith(prefix), label).otherwise(out)
    return F.when(naics.isNull() | (naics == ""), "unknown").otherwise(out)


def map_status(c: Column, mapping: dict[str, str], default: str = "unknown") -> Column:
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(F.lower(F.trim(c)) == k, v).otherwise(out)
    return out


def cadence_seconds(c: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for k, v in CADENCE.items():
        out = F.when(F.lower(c) == k, v).otherwise(out)
    return out


def normalize_cadence(c: Column) -> Column:
    """A free-text cadence in the poller's words; what isn't recognised is refreshed from archives."""
    return classify(c, [("hourly", "hourly"), ("daily", "daily"), ("weekly", "weekly"), ("per |continuous|event", "event_driven")], "archival_refresh")


def is_due(cadence: Column, last: Column, as_of: Column) -> Column:
    """Due if never polled, or the poll interval has run out; an unknown cadence polls daily."""
    minutes = F.lit(POLL_MINUTES["daily"])
    for k, v in POLL_MINUTES.items():
        minutes = F.when(cadence == k, v).otherwise(minutes)
    return last.isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp(last) >= minutes * 60)


def dimension_score(c: Column, kind: str = "level") -> Column:
    """1 to 5 of a 0-100 measure: by its level, falling with capacity to oppose, or rising with openness."""
    x = c.cast("double")
    raw = {"level": x / 20 + 0.5, "opposition": 5 - 4 * x / 100, "openness": 1 + 4 * x / 100}[kind]
    return F.greatest(F.lit(1), F.least(F.lit(5), F.round(raw))).cast("bigint") + F.when(c.isNull(), None).otherwise(0)


def power_score(watts: Column, access: Column) -> Column:
    """1 to 5 by watts a head, held down where few have electricity; null without capacity."""
    have = F.when(access.isNull(), 5).otherwise(_ladder(access, ((95, 5), (80, 4), (50, 3)), 2))
    return F.when(watts.isNotNull(), F.least(_ladder(watts, ((1000, 5), (300, 4), (100, 3), (20, 2)), 1), have)).cast("bigint")


def _ladder(c: Column, cuts: tuple[tuple[float, int], ...], least: int) -> Column:
    out = F.lit(least)
    for at, score in reversed(cuts):
        out = F.when(c >= at, score).otherwise(out)
    return out


def headroom(total: Column, used: Column) -> Column:
    return F.greatest(F.coalesce(total, F.lit(0.0)) - F.coalesce(used, F.lit(0.0)), F.lit(0.0))
