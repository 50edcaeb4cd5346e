"""Names, dates and screening of regulatory docket titles, which are all in capitals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

#: Words that an endpoint doesn't start with, words for a station, what cuts a span, what parts endpoints.
LEADING = ("THE", "FOR", "OF", "AND", "TO", "A", "AN", "NEW", "PROPOSED", "APPLICATION", "AMEND", "ITS", "CERTIFICATE", "CONVENIENCE", "NECESSITY", "JOINT", "PETITION")
STATION = r"(?i)\b(SWITCHING STATION|SUBSTATION|SWITCHYARD|SWITCH|SS|STATION|POI|TAP|INTERCHANGE)\b"
CUT = r"(?i)\b(SINGLE-CIRCUIT|DOUBLE-CIRCUIT|CONVERSION|REBUILD|PROJECT)\b.*$"
PARTED = r"(?i)\s+TO\s+|-TO-|\s+-\s+|\s+–\s+"
SPANS = (r"(?i).*\bFOR THE\s+(.*?)\s+\d{2,4}\s*-?\s*KV\b", r"(?i).*\bFOR THE\s+(.*?)\s+TRANSMISSION LINE")
STANDALONE = r"\bFOR THE\s+([A-Z][A-Z0-9.'-]*(?:\s+[A-Z0-9.'-]+){0,3})\s+(?:SWITCHING STATION|SUBSTATION)\b"
COUNTY = r"(?i)\bin\s+([A-Za-z][A-Za-z.'-]+(?:\s+[A-Za-z.'-]+){0,3}?)\s+count(?:y|ies)\b"
#: What a title's date is, and which titles are candidates.
ACTUAL = r"(?i)\b(energiz|placed in service|in-service date|commercial operation|final order|completed)\b"
APPROVED = r"(?i)\b(CCN|CPCN|certificate of convenience|application|petition|amend)\b"
WANTED = r"(?i)\b(CCN|CPCN|certificate of convenience|transmission line|switch|switching station|substation|kv|interconnection|in-service|energiz)\b"
UNWANTED = r"(?i)\b(wholesale transmission rate|rate update|cost recovery factor|code of conduct waiver|interim update|monthly rate)\b"
SITING = r"(?i)\bTRANSMISSION LINE\b|\b(SWITCHING STATION|SUBSTATION)\b"


def tidy_title(c: Column) -> Column:
    """White space and escaped tabs as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "&#9;", " "), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Lower case, but for the first letter of each run of letters and digits."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def _endpoint(c: Column) -> Column:
    """A phrase without station words and leading words, in title case."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(c, STATION, " "), r"\s+", " ")), " ")
    # Words are taken up from the first on that isn't a leading one.
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda got, w: F.when((F.size(got) == 0) & F.upper(w).isin(*LEADING), got).otherwise(F.concat(got, F.array(w))))
    return title_case(F.trim(F.array_join(kept, " ")))


def extract_endpoints(title: Column) -> Column:
    """Stations that a line's title names: the ends in the last "FOR THE" span before the voltage; else stations named alone.

    Distinct, in order, each over two characters and no leading word. Without any, and for a null title, an empty array.
    """
    none = F.array().cast("array<string>")

    def ends(t: Column) -> Column:
        span = F.when(t.rlike(SPANS[0]), F.regexp_extract(t, SPANS[0], 1)).when(t.rlike(SPANS[1]), F.regexp_extract(t, SPANS[1], 1)).otherwise("")
        parts = F.filter(F.transform(F.split(F.trim(F.regexp_replace(span, CUT, "")), PARTED), lambda p: F.trim(p)), lambda p: p != "")
        several = let(parts, lambda p: F.when((F.size(p) >= 2) | ((F.size(p) == 1) & t.rlike("(?i)SWITCH|SUBSTATION|STATION")), F.transform(p, _endpoint)).otherwise(none))
        return F.when(t.rlike("(?i)TRANSMISSION LINE"), F.filter(several, lambda e: e != "")).otherwise(none)

    def named(t: Column) -> Column:
        alone = F.filter(F.transform(F.regexp_extract_all(t, F.lit(STANDALONE), F.lit(1)), _endpoint), lambda e: e != "")
        return let(ends(t), lambda e: F.array_distinct(F.when(F.size(e) > 0, e).otherwise(alone)))

    every = let(F.coalesce(tidy_title(title), F.lit("")), named)
    return F.filter(every, lambda e: (F.length(e) > 2) & ~F.upper(e).isin(*LEADING))


def docket_county(title: Column) -> Column:
    return let(F.trim(F.regexp_extract(title, COUNTY, 1)), lambda found: F.when(found != "", title_case(found)))


def docket_date_type(title: Column) -> Column:
    """An order or energization is actual, an application only approved, anything else projected."""
    t = F.coalesce(title, F.lit(""))
    return F.when(t.rlike(ACTUAL), "actual").when(t.rlike(APPROVED), "approved").otherwise("projected")


def screen_docket(title: Column) -> Column:
    """Struct of is_candidate, reason, names, is_siting: a candidate is a siting case with names, and no rate or procedural one."""
    t = F.coalesce(F.trim(F.regexp_replace(title, "&#9;", " ")), F.lit(""))
    flags = F.struct(extract_endpoints(t).alias("names"), t.rlike(UNWANTED).alias("bad"), t.rlike(WANTED).alias("good"), t.rlike(SITING).alias("siting"))

    def decide(f: Column) -> Column:
        some = F.size(f["names"]) > 0
        reason = F.when(f["bad"], "excluded:rate/procedural").when(f["good"] & some, "candidate:endpoints").when(f["good"], "candidate:keyword").otherwise("no-match")
        return F.struct((f["good"] & ~f["bad"] & f["siting"] & some).alias("is_candidate"), reason.alias("reason"), f["names"].alias("names"), f["siting"].alias("is_siting"))

    return let(flags, decide)
