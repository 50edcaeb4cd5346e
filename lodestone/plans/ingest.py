"""Queries over ingest and generation operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.functions.text import recover_json
from lodestone.operators import awards as aw
from lodestone.operators import ingest as ig
from lodestone.plans.base import query, view


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def io1_scan(d):
    return d.lineitem.filter("l_shipdate >= timestamp'1998-01-01'").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


view("bodies", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('[{"id": ', CAST(user_id AS STRING), '}, {"id": 7}]') WHEN 1 THEN concat('{"results": [{"id": ', CAST(user_id AS STRING), '}]}')
  WHEN 2 THEN concat('{"data": [{"id": ', CAST(user_id AS STRING), '}, {"id": 8}]}') ELSE '{broken' END AS body, user_id FROM events""")


@query("""SELECT event_id, CAST(0 AS INTEGER) AS pos, CAST(user_id AS STRING) AS id FROM bodies WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 1, CASE event_id % 4 WHEN 0 THEN '7' ELSE '8' END FROM bodies WHERE event_id % 4 IN (0, 2)""", "bodies")
def io2_read_records(d):
    return ig.read_records(d.bodies, "body", "event_id").select("event_id", "pos", F.get_json_object("record", "$.id").alias("id"))


def _lines(d):
    k = F.col("conv_id") * 100 + F.col("turn")
    q = F.lit('\\"')
    obj = lambda n: F.concat(F.lit("{"), q, F.lit("n"), q, F.lit(f": {n}" + "}"))
    text = F.when(k % 7 == 0, F.concat(F.lit("```json\\n"), obj(1), F.lit("\\n```"))).when(k % 7 == 1, F.concat(F.lit("Here: "), obj(2), F.lit(" ok"))).when(k % 7 == 2, "no object").otherwise(obj(3))
    kind = F.when(k % 13 == 0, "errored").otherwise("succeeded")
    whole = F.concat(F.lit('{"custom_id": "c'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('", "result": {"type": "'), kind, F.lit('", "message": {"content": [{"text": "'), text, F.lit('"}]}}}'))
    return d.conversations.filter("role = 'assistant'").select("conv_id", "turn", k.alias("k"), F.when(k % 10 == 0, '{"custom_id": broken').otherwise(whole).alias("line"))


@query("""SELECT conv_id, turn, CASE WHEN k % 10 <> 0 THEN concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) END AS id, k % 10 <> 0 AND k % 13 <> 0 AND k % 7 <> 2 AS ok,
CASE WHEN k % 10 = 0 OR k % 7 = 2 THEN NULL WHEN k % 7 = 0 THEN 1 WHEN k % 7 = 1 THEN 2 ELSE 3 END AS n FROM (SELECT conv_id, turn, conv_id * 100 + turn AS k FROM conversations WHERE role = 'assistant')""")
def io3_parse_result_lines(d):
    """IO3 and F38."""
    return ig.parse_result_lines(_lines(d)).select("conv_id", "turn", "id", "ok", F.get_json_object("answer", "$.n").cast("int").alias("n"))


@query("""SELECT company_id, CASE company_id % 3 WHEN 0 THEN raw_name WHEN 1 THEN concat('M', CAST(company_id AS STRING)) END AS name FROM v4""", "v4")
def f39_mention_name(d):
    k = F.col("company_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.col("raw_name").alias("name")))).when(k == 1, F.concat(F.lit('"M'), F.col("company_id").cast("string"), F.lit('"'))).otherwise("[broken")
    return d.v4.select("company_id", ig.mention_name(raw).alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '{\"a\": 1}' END AS j FROM part")
def f38_recover_json(d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.lit('Sure!\n{"a": 1}\nDone')).otherwise(F.lit('{"a": "unescaped " quote"}'))
    return d.part.select(F.col("p_partkey").alias("id"), recover_json(raw).alias("j"))


@query("SELECT CAST(l_orderkey AS STRING) AS order_key, CAST(l_linenumber AS STRING) AS line_no, CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag END AS flag FROM lineitem")
def io4_canonicalize_headers(d):
    odd = d.lineitem.select(F.col("l_orderkey").alias("L ORDER-KEY"), F.col("l_linenumber").alias("Line No."), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")).alias("Return Flag"), F.col("l_linestatus").alias("Flag"))
    return ig.canonicalize_headers(odd, {"order_key": ["lorderkey"], "line_no": ["line_no", "line no"], "flag": ["return_flag", "flag"]}, ["order_key"])


@query("SELECT v, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('none', 3)) AS t(k, v) ON o_orderpriority = k GROUP BY v")
def io5_values_table(d):
    t = ig.values_table(d.spark, [("1-URGENT", 1), ("2-HIGH", 2), ("none", 3)], "k string, v int")
    return d.orders.join(F.broadcast(t), F.col("o_orderpriority") == F.col("k")).groupBy("v").agg(F.count("*").alias("n"))  # three rows


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, concat('new ', c_name) FROM customer WHERE c_custkey % 2 = 1")
def io6_insert_missing(d):
    c = d.customer.select("c_custkey", "c_name")
    new = c.withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    return ig.insert_missing(c.filter("c_custkey % 2 = 0"), new.unionByName(new), ["c_custkey"], [F.col("c_name")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0".replace("'updated'", "concat('up ', c_name)"))
def io7_upsert(d):
    c = d.customer.select("c_custkey", "c_name", "c_acctbal")
    return ig.upsert(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("up "), "c_name")), ["c_custkey"], ["c_name"])


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN concat('up ', c_name) ELSE c_name END AS c_name FROM customer")
def io8_guarded_upsert(d):
    c = d.customer.select("c_custkey", "c_mktsegment", "c_name")
    return ig.upsert(c, c.filter("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("up "), "c_name")), ["c_custkey"], ["c_name"], F.col("t.c_mktsegment") != "BUILDING")


@query("SELECT source_id, count(*) AS n, round(sum(value), 2) AS v FROM (SELECT source_id, CASE WHEN source_id = '1-URGENT' THEN 1.0 ELSE value END AS value FROM v10) GROUP BY source_id", "v10")
def io9_replace_slice(d):
    t = d.v10.select("source_id", "jurisdiction", "scenario", "published", "value")
    new = t.filter("source_id = '1-URGENT'").withColumn("value", F.lit(1.0))
    return ig.replace_slice(t, new, "source_id").groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))


@query("SELECT CASE WHEN CAST(record_id AS BIGINT) % 5 = 0 THEN 'new' WHEN CAST(record_id AS BIGINT) % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM v2 GROUP BY 1", "v2")
def io10_cdc_upsert(d):
    k = F.col("record_id").cast("bigint")
    new = d.v2.withColumn("recipient", F.when(k % 7 == 0, "x").otherwise(F.col("recipient")))
    return ig.cdc_upsert(d.v2.filter(k % 5 != 0), new, "record_id", ["recipient", "county", "award_type", "amount"]).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT state, award_type, county FROM v2)", "v2")
def io11_dedupe_by_hash(d):
    return ig.dedupe_by_hash(d.v2, ["state", "award_type", "county"], [F.col("record_id")]).agg(F.count("*").alias("n"))


_T = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_Y = "CAST(1995 + o_orderkey % 40 AS STRING)"
_C = "CASE WHEN o_custkey % 5 = 0 THEN '  ' ELSE c_name END"
#: One landed row of one of the twelve sources (and of an unknown one) for each order.
view("landed_awards", f"""SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'ny_esd_dei' WHEN 1 THEN 'ny_ida_projects' WHEN 2 THEN 'ct_decd_business_assistance' WHEN 3 THEN 'md_commerce_finance_tracker'
  WHEN 4 THEN 'or_ez_parta_2025' WHEN 5 THEN 'or_ez_parta_2024' WHEN 6 THEN 'or_energy_incentive_program' WHEN 7 THEN 'de_eeif_grants' WHEN 8 THEN 'ok_quality_jobs' WHEN 9 THEN 'wi_wedc_ared'
  WHEN 10 THEN 'ia_ieda_awards' WHEN 11 THEN 'dc_tif_areas' ELSE 'xx_unknown' END AS source_key,
 CASE o_orderkey % 13
  WHEN 0 THEN concat('{{"project_id_number": "P', CAST(o_orderkey AS STRING), '", "recipient_name": "', {_C}, '", "original_recipient": "', o_orderstatus, '", "county": "', n_name, '", "assistance_type": "', CASE o_orderpriority WHEN '1-URGENT' THEN 'Tax Increment' WHEN '2-HIGH' THEN 'Loan' ELSE o_orderpriority END, '", "start_date": "', {_D}, 'T00:00:00", "end_date": "2003-06-30T00:00:00", "assistance_amount": ', {_T}, CASE WHEN o_custkey % 2 = 0 THEN ', "total_lead_agency_benefits_awarded": "$1,200.5"}}' ELSE '}}' END)
  WHEN 1 THEN concat('{{"project_code": "', CAST(o_custkey AS STRING), '", "fiscal_year_end_date": "', {_D}, '", "applicant_name": "', c_name, '", "project_name": "', o_orderstatus, '", "project_city": "', n_name, '", "authority_name": "', n_name, CASE WHEN o_custkey % 2 = 0 THEN ' County IDA' ELSE ' City IDA' END, '", "planned_end_year": "', {_Y}, '", "date_project_approved": "', {_D}, '", "total_pilot_made": "', CAST(o_custkey % 2 AS STRING), '", "net_exemptions": "', {_T}, '"}}')
  WHEN 2 THEN concat('{{"company_name": "', c_name, '", "contract_execution_date": "', {_D}, '", "fiscal_year": "', {_Y}, '", "company_address": "', c_mktsegment, '", "municipality": "', n_name, '", "county_1": "', n_name, '", "grant_amount": "', CAST(o_custkey AS STRING), '", "loan_amount": "700", "funding_source": "', o_orderpriority, '"', CASE WHEN o_custkey % 3 = 0 THEN ', "total_assistance": null}}' ELSE concat(', "total_assistance": ', {_T}, '}}') END)
  WHEN 3 THEN concat('{{"recipient": "', {_C}, '", "fiscal_year": ', {_Y}, ', "program_name_level_one": "', n_name, '"', CASE WHEN o_custkey % 2 = 0 THEN ', "program_name_level_two": "Fund"' ELSE '' END, ', "address": "', c_mktsegment, '", "city": "', n_name, '", "county": "', n_name, '", "incentive_type": "Conditional Loan", "loan_guarantee_amount": "$', {_T}, '"}}')
  WHEN 4 THEN concat('{{"name_of_qualified_business": "', c_name, '", "enterprise_zone_name": "', n_name, '", "property_tax_year": "', {_Y}, '", "oregon_county": "', n_name, '", "property_taxes_abated_6": "', {_T}, '", "year_s_exemption_s_began": "', {_Y}, '", "exemption_period_years_2": "', CAST(o_custkey % 4 AS STRING), '"}}')
  WHEN 5 THEN concat('{{"name_of_qualified_business": "', c_name, '", "enterprise_zone_name": "', n_name, '", "oregon_county": "', n_name, '", "property_taxes_abated_6": "n/a", "year_s_exemption_s_began": "since ', {_Y}, '", "exemption_period_years_2": 2.5}}')
  WHEN 6 THEN concat('{{"applicant_business_name": "', c_name, '", "date_final_certificate": "', {_D}, '", "application": "', CAST(o_orderkey AS STRING), '", "project_type": "', o_orderpriority, '", "site_address": "', c_mktsegment, '", "site_city": "', n_name, '", "site_county": "', n_name, '", "final_tax_credit_or_grant": "', {_T}, '"}}')
  WHEN 7 THEN concat('{{"control_number": "', CAST(o_orderkey AS STRING), '", "name_of_grantee": "', {_C}, '", "project_description": "', o_orderstatus, '", "street_address": "', c_mktsegment, '", "city": "', n_name, '", "county": "', n_name, '", "final_award_amount": ', {_T}, ', "app_completed_to_fiscal_date": "', {_D}, '"}}')
  WHEN 8 THEN concat('{{"Vendor Name": "', c_name, '", "Fiscal Year": "', {_Y}, '", "Street Address": "', c_mktsegment, '", "Vendor Address City": "', n_name, '", "Issue Date": "8/15/', {_Y}, '", "Payment Amount": "$', {_T}, '", "Account Description": "', o_orderstatus, '"}}')
  WHEN 9 THEN concat('{{"ObjectId": ', CAST(o_orderkey AS STRING), CASE WHEN o_custkey % 2 = 0 THEN concat(', "uid": "FY', CAST(o_custkey AS STRING), '"') ELSE '' END, ', "awardRecipient": "', c_name, '", "projectName": "', o_orderstatus, '", "municipality": "', n_name, '", "county": "', n_name, '", "awardDate": ', CASE WHEN o_custkey % 3 = 0 THEN '"1496102400000"' ELSE '1496102400000' END, ', "awardType": "Grant", "awardAmount": ', {_T}, '}}')
  WHEN 10 THEN concat('{{"contract_name": "', c_name, '", "city": "', n_name, '", "county": "', n_name, '", "program": "', o_orderpriority, '", "award_date": "', {_D}, 'T00:00:00.000", "project_completion_date": "', {_Y}, '-07-01", "direct_assistance_awarded": ', CAST(1000 * (o_custkey % 2) AS STRING), '.0, "tax_benefits_awarded": ', CAST(1000 * (o_custkey % 3) AS STRING), '}}')
  WHEN 11 THEN concat('{{"NAME": "', c_name, '", "TYPE": ', CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '"PILOT"' END, ', "WARD": "', CAST(o_custkey % 8 AS STRING), '", "YEAR_AUTHORIZED": ', {_Y}, ', "MATURITY_YEAR": 2043, "INITIAL_AUTHORIZATION": "$', CAST(o_custkey % 90 AS STRING), '.5 million"}}')
  ELSE '{{}}' END AS raw
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

#: Of each source, what its columns hold; columns that aren't named are null.
_AWARDS = {
    "ny_esd_dei": {
        "state_abbr": "'NY'", "source_record_id": "T(project_id_number)", "recipient_name": "coalesce(T(recipient_name), T(original_recipient))", "project_name": "T(name_of_project)", "county_name": "T(county)",
        "incentive_type": "CASE T(assistance_type) WHEN 'Tax Increment' THEN 'tif' WHEN 'Loan' THEN 'loan' ELSE 'other' END", "raw_incentive_type": "T(assistance_type)", "award_value_usd": "coalesce(N(total_lead_agency_benefits_awarded), N(assistance_amount))",
        "term_start": "D(start_date)", "term_end": "D(end_date)", "source_url": "'https://data.ny.gov/d/26ei-n4eb'",
    },
    "ny_ida_projects": {
        "state_abbr": "'NY'", "source_record_id": "concat(T(project_code), ':', D(fiscal_year_end_date))", "recipient_name": "T(applicant_name)", "project_name": "T(project_name)", "place_name": "T(project_city)",
        "county_name": "CASE WHEN T(authority_name) LIKE '% County IDA' THEN replace(T(authority_name), ' County IDA', '') END", "incentive_type": "CASE WHEN N(total_pilot_made) > 0 THEN 'pilot' ELSE 'abatement' END", "raw_incentive_type": "'IDA exemptions/PILOT'",
        "program_name": "T(authority_name)", "statute_citation": "'NY General Municipal Law §859'", "award_value_usd": "N(net_exemptions)", "term_start": "D(date_project_approved)", "term_end": "CAST(concat(T(planned_end_year), '-12-31') AS DATE)", "source_url": "'https://data.ny.gov/d/9rtk-3fkw'",
    },
    "ct_decd_business_assistance": {
        "state_abbr": "'CT'", "source_record_id": "concat(T(company_name), ':', D(contract_execution_date), ':', T(fiscal_year))", "recipient_name": "T(company_name)", "project_address": "T(company_address)", "place_name": "T(municipality)", "county_name": "T(county_1)",
        "incentive_type": "CASE WHEN N(grant_amount) >= N(loan_amount) THEN 'grant' ELSE 'loan' END", "raw_incentive_type": "T(funding_source)", "program_name": "T(funding_source)", "award_value_usd": "coalesce(N(total_assistance), N(grant_amount) + N(loan_amount))",
        "term_start": "D(contract_execution_date)", "source_url": "'https://data.ct.gov/d/xnw3-nytd'",
    },
    "md_commerce_finance_tracker": {
        "state_abbr": "'MD'", "source_record_id": "concat(coalesce(T(recipient), ''), ':', T(fiscal_year), ':', concat_ws(' / ', T(program_name_level_one), T(program_name_level_two)))", "recipient_name": "T(recipient)", "project_address": "T(address)", "place_name": "T(city)",
        "county_name": "T(county)", "incentive_type": "'loan'", "raw_incentive_type": "T(incentive_type)", "program_name": "concat_ws(' / ', T(program_name_level_one), T(program_name_level_two))", "award_value_usd": "N(loan_guarantee_amount)",
        "source_url": "'https://opendata.maryland.gov/d/cf3i-xdgb'",
    },
    "or_ez_parta_2025": {
        "state_abbr": "'OR'", "source_record_id": "concat(T(name_of_qualified_business), ':', T(enterprise_zone_name), ':', T(property_tax_year))", "recipient_name": "T(name_of_qualified_business)", "county_name": "T(oregon_county)", "incentive_type": "'exemption'",
        "raw_incentive_type": "'Enterprise Zone property tax exemption'", "program_name": "T(enterprise_zone_name)", "statute_citation": "'ORS 285C'", "award_value_usd": "N(property_taxes_abated_6)", "term_start": "CAST(concat(T(year_s_exemption_s_began), '-01-01') AS DATE)",
        "term_end": "CASE WHEN N(exemption_period_years_2) > 0 THEN make_date(CAST(N(year_s_exemption_s_began) + N(exemption_period_years_2) AS BIGINT), 1, 1) END", "term_years": "N(exemption_period_years_2)", "source_url": "'https://data.oregon.gov/d/9cc3-52ar'",
    },
    "or_ez_parta_2024": {
        "state_abbr": "'OR'", "source_record_id": "concat(T(name_of_qualified_business), ':', T(enterprise_zone_name), ':')", "recipient_name": "T(name_of_qualified_business)", "county_name": "T(oregon_county)", "incentive_type": "'exemption'", "raw_incentive_type": "'Enterprise Zone property tax exemption'",
        "program_name": "T(enterprise_zone_name)", "statute_citation": "'ORS 285C'", "term_start": "CAST(concat(right(T(year_s_exemption_s_began), 4), '-01-01') AS DATE)", "term_end": "make_date(CAST(right(T(year_s_exemption_s_began), 4) AS BIGINT) + 3, 1, 1)", "term_years": "2.5", "source_url": "'https://data.oregon.gov/d/ecbu-9t3b'",
    },
    "or_energy_incentive_program": {
        "state_abbr": "'OR'", "source_record_id": "concat(T(applicant_business_name), ':', D(date_final_certificate), ':', T(application))", "recipient_name": "T(applicant_business_name)", "project_name": "T(project_type)", "project_address": "T(site_address)", "place_name": "T(site_city)",
        "county_name": "T(site_county)", "incentive_type": "'credit'", "raw_incentive_type": "'Energy Incentive Program tax credit'", "award_value_usd": "N(final_tax_credit_or_grant)", "term_start": "D(date_final_certificate)", "source_url": "'https://data.oregon.gov/d/ria5-vqsx'",
    },
    "de_eeif_grants": {
        "state_abbr": "'DE'", "source_record_id": "T(control_number)", "recipient_name": "T(name_of_grantee)", "project_name": "T(project_description)", "project_address": "T(street_address)", "place_name": "T(city)", "county_name": "T(county)", "incentive_type": "'grant'",
        "raw_incentive_type": "'Energy Efficiency Investment Fund grant'", "program_name": "'Energy Efficiency Investment Fund'", "award_value_usd": "N(final_award_amount)", "term_start": "D(app_completed_to_fiscal_date)", "source_url": "'https://data.delaware.gov/d/vukm-g6g5'",
    },
    "ok_quality_jobs": {
        "state_abbr": "'OK'", "source_record_id": "concat(T(Vendor Name), ':', T(Fiscal Year), ':', T(Issue Date), ':', T(Payment Amount))", "recipient_name": "T(Vendor Name)", "project_address": "T(Street Address)", "place_name": "T(Vendor Address City)", "incentive_type": "'rebate'",
        "raw_incentive_type": "T(Account Description)", "program_name": "'Oklahoma Quality Jobs Program'", "statute_citation": "'68 O.S. §3601 et seq.'", "award_value_usd": "N(Payment Amount)", "term_start": "CAST(concat(right(T(Issue Date), 4), '-08-15') AS DATE)",
        "source_url": "'https://data.ok.gov/dataset/oklahoma-quality-jobs-program'",
    },
    "wi_wedc_ared": {
        "state_abbr": "'WI'", "source_record_id": "coalesce(T(uid), concat('oid:', T(ObjectId)))", "recipient_name": "T(awardRecipient)", "project_name": "T(projectName)", "place_name": "T(municipality)", "county_name": "T(county)", "incentive_type": "'grant'", "raw_incentive_type": "T(awardType)",
        "award_value_usd": "N(awardAmount)", "term_start": "CASE WHEN json_type(raw, '$.awardDate') <> 'VARCHAR' THEN DATE '2017-05-30' END", "source_url": "'https://www.wedc.org/about-wedc/transparency/'",
    },
    "ia_ieda_awards": {
        "state_abbr": "'IA'", "source_record_id": "concat(T(contract_name), ':', D(award_date))", "recipient_name": "T(contract_name)", "place_name": "T(city)", "county_name": "T(county)",
        "incentive_type": "CASE WHEN N(direct_assistance_awarded) > 0 AND N(tax_benefits_awarded) > 0 THEN 'mixed' WHEN N(direct_assistance_awarded) > 0 THEN 'grant' WHEN N(tax_benefits_awarded) > 0 THEN 'credit' ELSE 'other' END", "raw_incentive_type": "T(program)", "program_name": "T(program)",
        "award_value_usd": "nullif(N(direct_assistance_awarded) + N(tax_benefits_awarded), 0)", "term_start": "D(award_date)", "term_end": "D(project_completion_date)", "source_url": "'https://www.iowaeda.com/impact/'",
    },
    "dc_tif_areas": {
        "state_abbr": "'DC'", "source_record_id": "concat(T(NAME), ':', T(YEAR_AUTHORIZED))", "recipient_name": "T(NAME)", "project_name": "T(NAME)", "place_name": "concat('Ward ', T(WARD))", "county_name": "'District of Columbia'", "incentive_type": "CASE WHEN T(TYPE) IS NULL THEN 'tif' ELSE 'pilot' END",
        "raw_incentive_type": "T(TYPE)", "program_name": "'DC Tax Increment Financing'", "award_value_usd": "1000000 * CAST(regexp_extract(T(INITIAL_AUTHORIZATION), '[0-9.]+') AS DOUBLE)", "term_start": "make_date(CAST(T(YEAR_AUTHORIZED) AS BIGINT), 1, 1)", "term_end": "DATE '2043-12-31'",
        "source_url": "'https://maps2.dcgis.dc.gov/dcgis/rest/services/DCGIS_DATA/Business_Incentives_WebMercator/MapServer/26'",
    },
}


def _awards_sql() -> str:
    """The union over the sources; T, N and D stand for a field's text, number and date."""
    at = r"raw->>'$."
    short = ((r"T\(([^()]+)\)", r"nullif(trim(FIELD\1'), '')"), (r"N\(([^()]+)\)", r"CAST(replace(replace(FIELD\1', '$', ''), ',', '') AS DOUBLE)"), (r"D\(([^()]+)\)", r"CAST(left(FIELD\1', 10) AS DATE)"))
    parts = []
    for source, spec in _AWARDS.items():
        cols = []
        for c, kind in aw.COLUMNS.items():
            e = spec.get(c, "NULL")
            for pattern, to in short:
                e = re.sub(rf"(?<![A-Za-z_]){pattern}", to, e)
            e = re.sub(r"FIELD([^']+)'", lambda m: f"({at}\"{m[1]}\"')", e)
            cols.append(f"CAST({e} AS {kind}) AS {c}")
        parts.append(f"SELECT o_orderkey, source_key, {', '.join(cols)} FROM landed_awards WHERE source_key = '{source}'")
    years = "coalesce(term_years, CASE WHEN term_end >= term_start THEN floor(date_diff('day', term_start, term_end) / 365.25 * 10 + 0.5) / 10 END)"
    return f"SELECT * REPLACE ({years} AS term_years) FROM (" + " UNION ALL ".join(parts) + ")"


@query(_awards_sql(), "landed_awards")
def e30_map_awards(d):
    """E30: all columns of the record but the landed text, of twelve sources."""
    return aw.map_awards(d.landed_awards).drop("raw")


@query("""SELECT o_orderkey, c_name AS recipient_name, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE n_name END AS place_name, CAST(floor(o_totalprice) AS DOUBLE) AS award_value_usd,
 CASE WHEN o_custkey % 3 = 0 THEN DATE '2016-03-09' ELSE CAST(o_orderdate AS DATE) END AS term_start FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def f41_map_portal_row(d):
    """cells with markup under headers that a portal renames."""
    o = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(d.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    odd = F.col("o_orderkey") % 2 == 1
    date = F.when(F.col("o_custkey") % 3 == 0, "3/9/2016").otherwise(F.date_format("o_orderdate", "yyyy/M/d"))
    headers = F.array(F.lit("amountrecaptured"), F.when(odd, "taxpayer").otherwise("name"), F.lit("primarylocations"), F.when(odd, "grant_amount").otherwise("amountoftaxcredit"), F.when(odd, "approved_on").otherwise("dateagreementapproved"))
    cells = F.array(
        F.lit("$5"), F.concat(F.lit("<a href='x'>"), F.col("c_name"), F.lit("</a>&nbsp;")), F.when(F.col("o_custkey") % 4 == 0, "<i> </i>").otherwise(F.concat(F.lit(" <b>"), F.col("n_name"), F.lit("</b>\n"))),
        F.concat(F.lit("<td>$ "), F.format_number(F.floor("o_totalprice"), 0), F.lit("</td>")), F.concat(F.lit("on "), date),
    )
    patterns = {
        "recipient_name": ["^name$", "company|recipient|business|taxpayer"],
        "place_name": ["location"],
        "award_value_usd": ["amountoftaxcredit", "tax.?credit", "amount.*credit", "grant.?amount", "award.?amount"],
        "term_start": ["date.*(approv|agreement)", "agreement.*date", "approv"],
    }
    rows = o.select("o_orderkey", F.map_from_arrays(headers, cells).alias("cells"))
    return aw.map_portal_row(rows, "cells", patterns, ["award_value_usd"], ["term_start"]).drop("cells")


@query("""SELECT source_key, name, origin, greatest(last_seen, DATE '2000-01-01' + CAST(k % 30 AS INTEGER)) AS last_seen FROM (SELECT k, CAST(k AS STRING) AS source_key, CASE WHEN s_name IS NOT NULL THEN s_name ELSE c_name END AS name, CASE WHEN s_name IS NOT NULL THEN 'feeds' ELSE 'rosters' END AS origin,
 CASE WHEN s_name IS NOT NULL THEN DATE '2000-01-10' ELSE DATE '2000-01-20' END AS last_seen FROM (SELECT coalesce(s_suppkey, c_custkey) AS k, s_name, c_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey))""")
def e31_unify_registry(d):
    key = lambda c: F.col(c).cast("string")
    specs = {"feeds": {"source_key": key("s_suppkey"), "name": F.col("s_name"), "last_seen": F.lit("2000-01-10").cast("date")}, "rosters": {"source_key": key("c_custkey"), "name": F.col("c_name"), "last_seen": F.lit("2000-01-20").cast("date")}}
    ids = d.supplier.select(F.col("s_suppkey").alias("k")).union(d.customer.select("c_custkey")).distinct()
    evidence = ids.select(key("k").alias("source_key"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("k") % 30).cast("int")).alias("evidence_at"))
    return ig.unify_registry({"feeds": d.supplier, "rosters": d.customer}, specs, evidence)


@query("SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug, c_name AS name, concat('%22', c_name, '%22%20data%20center') AS query FROM customer WHERE c_custkey % 10 <> 0")
def e32_generate_watches(d):
    from lodestone.functions.text import slug

    roster = d.customer.select("c_name", "c_custkey")
    have = d.customer.filter("c_custkey % 10 = 0").select(slug(F.col("c_name"), 60).alias("slug"))
    return ig.generate_watches(roster.unionByName(roster), have, "c_name", "c_custkey")


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(lower(text), '\\bthe\\b') THEN 'no_positive' WHEN regexp_matches(lower(text), '\\bund\\b') THEN 'negative' WHEN NOT regexp_matches(lower(text), '\\bof\\b') THEN 'no_siting' END AS reason FROM documents")
def p9_evidence_gate(d):
    out = ig.evidence_gate(d.documents, r"(?i)\bthe\b", r"(?i)\bund\b", r"(?i)\bof\b", F.split("text", " "))
    return out.select("doc_id", "reason")
