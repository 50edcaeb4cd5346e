"""Award rows as landed (one JSON text each) in one record of 19 columns: all sources in one scan of the landing table.

A source is data: fixed values, fields that are only renamed, and expressions for the rest. The row is parsed once, and
each column is one CASE over the sources, so a further source adds branches and no further read or union.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.functions.text import blank_to_null
from lodestone.functions.values import county_from_authority, epoch_ms_to_date, normalize_incentive_type, parse_number, parse_usd_scaled, year4, years_between

#: The record: name and type of its columns, between source_key and raw.
COLUMNS = {
    "state_abbr": "string",
    "source_record_id": "string",
    "recipient_name": "string",
    "project_name": "string",
    "project_address": "string",
    "parcel_id": "string",
    "place_name": "string",
    "county_name": "string",
    "incentive_type": "string",
    "raw_incentive_type": "string",
    "program_name": "string",
    "statute_citation": "string",
    "award_value_usd": "double",
    "term_start": "date",
    "term_end": "date",
    "term_years": "double",
    "source_url": "string",
}

_ZONE = {
    "state_abbr": "OR",
    "incentive_type": "exemption",
    "raw_incentive_type": "Enterprise Zone property tax exemption",
    "statute_citation": "ORS 285C",
}
#: What is the same in all rows of a source.
FIXED = {
    "ny_esd_dei": {"state_abbr": "NY", "source_url": "https://data.ny.gov/d/26ei-n4eb"},
    "ny_ida_projects": {"state_abbr": "NY", "statute_citation": "NY General Municipal Law §859", "source_url": "https://data.ny.gov/d/9rtk-3fkw"},
    "ct_decd_business_assistance": {"state_abbr": "CT", "source_url": "https://data.ct.gov/d/xnw3-nytd"},
    "md_commerce_finance_tracker": {"state_abbr": "MD", "source_url": "https://opendata.maryland.gov/d/cf3i-xdgb"},
    "or_ez_parta_2025": _ZONE | {"source_url": "https://data.oregon.gov/d/9cc3-52ar"},
    "or_ez_parta_2024": _ZONE | {"source_url": "https://data.oregon.gov/d/ecbu-9t3b"},
    "or_energy_incentive_program": {"state_abbr": "OR", "incentive_type": "credit", "source_url": "https://data.oregon.gov/d/ria5-vqsx"},
    "de_eeif_grants": {
        "state_abbr": "DE",
        "incentive_type": "grant",
        "raw_incentive_type": "Energy Efficiency Investment Fund grant",
        "program_name": "Energy Efficiency Investment Fund",
        "source_url": "https://data.delaware.gov/d/vukm-g6g5",
    },
    "ok_quality_jobs": {
        "state_abbr": "OK",
        "incentive_type": "rebate",
        "program_name": "Oklahoma Quality Jobs Program",
        "statute_citation": "68 O.S. §3601 et seq.",
        "source_url": "https://data.ok.gov/dataset/oklahoma-quality-jobs-program",
    },
    "wi_wedc_ared": {"state_abbr": "WI", "source_url": "https://www.wedc.org/about-wedc/transparency/"},
    "ia_ieda_awards": {"state_abbr": "IA", "source_url": "https://www.iowaeda.com/impact/"},
    "dc_tif_areas": {
        "state_abbr": "DC",
        "county_name": "District of Columbia",
        "program_name": "DC Tax Increment Financing",
        "source_url": "https://maps2.dcgis.dc.gov/dcgis/rest/services/DCGIS_DATA/Business_Incentives_WebMercator/MapServer/26",
    },
}
_ZONE_FIELDS = {"recipient_name": "name_of_qualified_business", "county_name": "oregon_county", "program_name": "enterprise_zone_name"}
#: The source's own names of text fields that are taken over.
FIELDS = {
    "ny_esd_dei": {"source_record_id": "project_id_number", "project_name": "name_of_project", "county_name": "county", "raw_incentive_type": "assistance_type", "program_name": "program_through_which_the_funding_was_awarded"},
    "ny_ida_projects": {"recipient_name": "applicant_name", "project_name": "project_name", "project_address": "project_address_line_1", "place_name": "project_city", "program_name": "authority_name"},
    "ct_decd_business_assistance": {
        "recipient_name": "company_name",
        "project_address": "company_address",
        "place_name": "municipality",
        "county_name": "county_1",
        "raw_incentive_type": "funding_source",
        "program_name": "funding_source",
        "statute_citation": "statutory_reference",
    },
    "md_commerce_finance_tracker": {"recipient_name": "recipient", "project_address": "address", "place_name": "city", "county_name": "county", "raw_incentive_type": "incentive_type"},
    "or_ez_parta_2025": _ZONE_FIELDS,
    "or_ez_parta_2024": _ZONE_FIELDS,
    "or_energy_incentive_program": {"recipient_name": "applicant_business_name", "project_name": "project_type", "project_address": "site_address", "place_name": "site_city", "county_name": "site_county", "program_name": "program"},
    "de_eeif_grants": {"source_record_id": "control_number", "recipient_name": "name_of_grantee", "project_name": "project_description", "project_address": "street_address", "place_name": "city", "county_name": "county"},
    "ok_quality_jobs": {"recipient_name": "Vendor Name", "project_address": "Street Address", "place_name": "Vendor Address City"},
    "wi_wedc_ared": {"recipient_name": "awardRecipient", "project_name": "projectName", "place_name": "municipality", "county_name": "county", "raw_incentive_type": "awardType", "program_name": "awardProgram"},
    "ia_ieda_awards": {"recipient_name": "contract_name", "place_name": "city", "county_name": "county", "raw_incentive_type": "program", "program_name": "program"},
    "dc_tif_areas": {"recipient_name": "NAME", "project_name": "NAME", "raw_incentive_type": "TYPE", "statute_citation": "DC_CODE"},
}


#: Further fields, which expressions read.
OTHERS = (
    "recipient_name", "original_recipient", "total_lead_agency_benefits_awarded", "assistance_amount", "start_date", "end_date",
    "project_code", "fiscal_year_end_date", "total_pilot_made", "project_purpose", "total_exemptions", "net_exemptions", "date_project_approved", "planned_end_year",
    "grant_amount", "loan_amount", "contract_execution_date", "fiscal_year", "total_assistance",
    "program_name_level_one", "program_name_level_two", "approved_amount", "loan_guarantee_amount",
    "year_s_exemption_s_began", "exemption_period_years_2", "property_tax_year", "property_taxes_abated_6",
    "date_final_certificate", "application", "final_tax_credit_or_grant",
    "final_award_amount", "app_completed_to_fiscal_date",
    "Fiscal Year", "Issue Date", "Payment Amount", "Department Description", "Account Description",
    "uid", "id", "ObjectId", "awardAmount",
    "primary_funding_agreement", "direct_assistance_awarded", "tax_benefits_awarded", "award_date", "project_completion_date",
    "GLOBALID", "WARD", "YEAR_AUTHORIZED", "MATURITY_YEAR", "INITIAL_AUTHORIZATION",
)
#: Epoch milliseconds as a number; a string in their place is none.
NUMERIC = ("awardDate",)


def landed_schema() -> StructType:
    """All fields of all sources, as text but for NUMERIC: one pass over a row's JSON reads what its source has."""
    names = dict.fromkeys([*(f for spec in FIELDS.values() for f in spec.values()), *OTHERS])
    return StructType([StructField(n, StringType()) for n in names] + [StructField(n, LongType()) for n in NUMERIC])


def raw_field(name: str) -> Column:
    """A field's value as text."""
    return F.col("_row").getField(name)


def text(name: str) -> Column:
    """A field's trimmed text; null where it is blank. A number counts as its text."""
    return blank_to_null(raw_field(name))


def number(name: str) -> Column:
    return parse_number(raw_field(name))


def day(name: str, us: bool = False) -> Column:
    """The date that a text starts with: y-m-d, and with `us` also m/d/y."""
    s = F.trim(raw_field(name)) if us else raw_field(name)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    mdy = r"^(\d{1,2}/\d{1,2}/\d{4})"
    return F.when(s.rlike(mdy), F.try_to_date(F.regexp_extract(s, mdy, 1), "M/d/yyyy")).otherwise(iso) if us else iso


def _key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _of_year(year: Column, month: int, dom: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(dom))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def computed() -> dict[str, dict[str, Column]]:
    """Of each source the columns that are neither fixed nor only renamed."""
    out: dict[str, dict[str, Column]] = {}

    out["ny_esd_dei"] = {
        "recipient_name": F.coalesce(text("recipient_name"), text("original_recipient")),
        "incentive_type": normalize_incentive_type(text("assistance_type")),
        # The first field that is there counts, even if it holds no number.
        "award_value_usd": parse_number(F.coalesce(raw_field("total_lead_agency_benefits_awarded"), raw_field("assistance_amount"))),
        "term_start": day("start_date"),
        "term_end": day("end_date"),
    }
    out["ny_ida_projects"] = {
        "source_record_id": _key(text("project_code"), day("fiscal_year_end_date")),
        "county_name": county_from_authority(text("authority_name")),
        "incentive_type": F.when(_zero(number("total_pilot_made")) > 0, "pilot").otherwise("abatement"),
        "raw_incentive_type": F.coalesce(text("project_purpose"), F.lit("IDA exemptions/PILOT")),
        "award_value_usd": F.coalesce(number("total_exemptions"), number("net_exemptions")),
        "term_start": day("date_project_approved"),
        "term_end": _of_year(year4(raw_field("planned_end_year")), 12, 31),
    }
    grant, loan = _zero(number("grant_amount")), _zero(number("loan_amount"))
    out["ct_decd_business_assistance"] = {
        "source_record_id": _key(text("company_name"), day("contract_execution_date"), text("fiscal_year")),
        "incentive_type": F.when(grant >= loan, "grant").otherwise("loan"),
        "award_value_usd": F.coalesce(number("total_assistance"), F.when(grant + loan > 0, grant + loan)),
        "term_start": day("contract_execution_date"),
    }
    levels = F.nullif(F.concat_ws(" / ", text("program_name_level_one"), text("program_name_level_two")), F.lit(""))
    out["md_commerce_finance_tracker"] = {
        "source_record_id": _key(text("recipient"), text("fiscal_year"), levels),
        "incentive_type": normalize_incentive_type(text("incentive_type")),
        "program_name": levels,
        "award_value_usd": F.coalesce(number("approved_amount"), number("loan_guarantee_amount")),
    }
    began, years = year4(raw_field("year_s_exemption_s_began")), number("exemption_period_years_2")
    out["or_ez_parta_2025"] = out["or_ez_parta_2024"] = {
        "source_record_id": _key(text("name_of_qualified_business"), text("enterprise_zone_name"), text("property_tax_year")),
        "award_value_usd": number("property_taxes_abated_6"),
        "term_start": _of_year(began, 1, 1),
        "term_end": F.when(years != 0, _of_year((began + F.ceil(years)).cast("int"), 1, 1)),
        "term_years": years,
    }
    out["or_energy_incentive_program"] = {
        "source_record_id": _key(text("applicant_business_name"), day("date_final_certificate"), text("application")),
        "raw_incentive_type": F.coalesce(text("program"), F.lit("Energy Incentive Program tax credit")),
        "award_value_usd": number("final_tax_credit_or_grant"),
        "term_start": day("date_final_certificate"),
    }
    out["de_eeif_grants"] = {"award_value_usd": number("final_award_amount"), "term_start": day("app_completed_to_fiscal_date")}
    out["ok_quality_jobs"] = {
        "source_record_id": _key(text("Vendor Name"), text("Fiscal Year"), text("Issue Date"), text("Payment Amount")),
        "raw_incentive_type": F.coalesce(text("Department Description"), text("Account Description")),
        "award_value_usd": number("Payment Amount"),
        "term_start": day("Issue Date", us=True),
    }
    out["wi_wedc_ared"] = {
        "source_record_id": F.coalesce(text("uid"), text("id"), F.concat(F.lit("oid:"), raw_field("ObjectId"))),
        "incentive_type": normalize_incentive_type(text("awardType")),
        "award_value_usd": number("awardAmount"),
        "term_start": epoch_ms_to_date(raw_field("awardDate")),
    }
    direct, relief = _zero(number("direct_assistance_awarded")), _zero(number("tax_benefits_awarded"))
    out["ia_ieda_awards"] = {
        "source_record_id": F.coalesce(text("primary_funding_agreement"), _key(text("contract_name"), day("award_date"))),
        "incentive_type": F.when((direct > 0) & (relief > 0), "mixed").when(direct > 0, "grant").when(relief > 0, "credit").otherwise("other"),
        "award_value_usd": F.when(direct + relief > 0, direct + relief),
        "term_start": day("award_date"),
        "term_end": day("project_completion_date"),
    }
    authorised = year4(raw_field("YEAR_AUTHORIZED"))
    out["dc_tif_areas"] = {
        "source_record_id": F.coalesce(text("GLOBALID"), _key(text("NAME"), authorised)),
        "place_name": F.concat(F.lit("Ward "), text("WARD")),
        "incentive_type": F.coalesce(normalize_incentive_type(text("TYPE")), F.lit("tif")),
        "award_value_usd": parse_usd_scaled(raw_field("INITIAL_AUTHORIZATION")),
        "term_start": _of_year(authorised, 1, 1),
        "term_end": _of_year(year4(raw_field("MATURITY_YEAR")), 12, 31),
    }
    return out


def map_awards(landed: DataFrame) -> DataFrame:
    """The record of each row of `landed` (source_key, raw, and any others, which stay unless the record has their name).

    Sources without a mapper and texts that are no JSON give none. term_years is that between the term's ends where a source doesn't name it.
    """
    specs = computed()
    own = [c for c in landed.columns if c not in COLUMNS]
    rows = landed.select(*own).filter(F.col("source_key").isin(*FIXED)).filter(F.try_parse_json("raw").isNotNull()).withColumn("_row", F.from_json("raw", landed_schema()))

    def pick(name: str, kind: str) -> Column:
        def of(source: str) -> Column:
            if name in specs[source]:
                return specs[source][name]
            return F.lit(FIXED[source][name]) if name in FIXED[source] else text(FIELDS[source][name])

        case: Any = F  # F.when(...).when(...): one flat CASE
        for source in FIXED:
            if name in specs[source] or name in FIXED[source] or name in FIELDS[source]:
                case = case.when(F.col("source_key") == source, of(source).cast(kind))
        return (F.lit(None).cast(kind) if case is F else case).alias(name)

    out = rows.select(*own, *[pick(c, k) for c, k in COLUMNS.items()])
    return out.withColumn("term_years", F.coalesce("term_years", years_between(F.col("term_start"), F.col("term_end"))))


def map_portal_row(df: DataFrame, cells: str, patterns: dict[str, list[str]], money: list[str], dates: list[str]) -> DataFrame:
    """`df` with a column for each of `patterns`, from `cells`, a map of a portal's headers to cells with markup.

    A pattern stands for the first header that it matches; a column takes the cell of the first of its patterns that has
    one which isn't blank. Markup goes and white space is one blank. `money` columns become numbers; `dates` the first
    y-m-d or y/m/d in the cell, or else the first m/d/y.
    """
    entries = F.map_entries(F.col(cells))

    def first(pattern: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"].rlike(f"(?i){pattern}")), F.lit(0))["value"]

    def cell(candidates: list[str]) -> Column:
        found = F.coalesce(*[F.when(F.trim(first(p)) != "", first(p)) for p in candidates])
        tidy = F.regexp_replace(found, r"<[^>]*>|&nbsp;", " ")
        return blank_to_null(F.regexp_replace(tidy, r"\s+", " "))

    def dated(c: Column) -> Column:
        x = lambda p, i: F.regexp_extract(c, p, i)
        ymd, mdy = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
        us = F.try_to_date(F.concat_ws("-", x(mdy, 3), x(mdy, 1), x(mdy, 2)), "y-M-d")
        return F.when(c.rlike(ymd), F.try_to_date(F.concat_ws("-", x(ymd, 1), x(ymd, 2), x(ymd, 3)), "y-M-d")).otherwise(us)

    out = {name: cell(candidates) for name, candidates in patterns.items()}
    out |= {name: parse_number(out[name]) for name in money} | {name: dated(out[name]) for name in dates}
    return df.select("*", *[c.alias(name) for name, c in out.items()])
