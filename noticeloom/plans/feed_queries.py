"""Feeds over the driver tables, landed in the shape in which sources publish them, as notices, prices, supplies and rules."""

from pyspark.sql import functions as F

from noticeloom.plans.registry import query
from noticeloom.plans.tables import table
from noticeloom.sources import feeds
from noticeloom.sources import reb_metadata as metadata

APT, URBAN = metadata.APT, "getUrbtyOfctlLttotPblancDetail"
DAY = "CAST(o_orderdate AS DATE)"


def later(days: int, base: str = DAY) -> str:
    return f"CAST(CAST({base} + INTERVAL {days} DAY AS DATE) AS STRING)"


# The same expressions land orders as details and lines as models in Spark and in DuckDB.
DETAILS = (
    "CAST(o_orderkey AS STRING) AS HOUSE_MANAGE_NO", "CAST(o_orderkey % 7 AS STRING) AS PBLANC_NO", "CASE WHEN o_orderkey % 50 = 0 THEN '-' ELSE o_orderpriority END AS HOUSE_NM",
    "CASE o_orderkey % 6 WHEN 0 THEN '0202' WHEN 1 THEN '0203' WHEN 2 THEN '0204' WHEN 3 THEN '0201' END AS SEARCH_HOUSE_SECD",
    "CASE o_orderkey % 11 WHEN 0 THEN '02' WHEN 1 THEN '01' WHEN 2 THEN '03' WHEN 3 THEN '4' END AS HOUSE_DTL_SECD",
    "CASE o_orderkey % 13 WHEN 0 THEN '도시형 민간임대' WHEN 1 THEN '신혼희망타운' WHEN 2 THEN '오피스텔' END AS HOUSE_DTL_SECD_NM", "CASE WHEN o_orderkey % 9 = 0 THEN '1' END AS RENT_SECD",
    f"CAST({DAY} AS STRING) AS RCRIT_PBLANC_DE", "CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN ' n ' END AS PARCPRC_ULS_AT",
    "CASE o_orderkey % 4 WHEN 0 THEN '서울 강남구' WHEN 1 THEN '부산광역시' WHEN 2 THEN '해외' END AS SUBSCRPT_AREA_CODE_NM",
    "CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END AS SPECLT_RDN_EARTH_AT", "CASE WHEN o_orderkey % 2 = 0 THEN 'Y' END AS MDAT_TRGET_AREA_SECD",
    "CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END AS BSNS_MBY_NM", "CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE o_orderstatus END AS NSPRC_NM",
    "CASE WHEN o_custkey % 4 = 0 THEN '-' WHEN o_custkey % 4 = 1 THEN 'ftp://x' ELSE 'https://a.example/n' END AS PBLANC_URL", "CASE WHEN o_custkey % 8 = 0 THEN ' http://b.example ' END AS HMPG_ADRES",
    f"CASE WHEN o_orderstatus = 'O' THEN {later(5)} END AS SPSPLY_RCEPT_BGNDE", f"CASE WHEN o_orderkey % 2 = 0 THEN {later(6)} ELSE {later(1)} END AS SPSPLY_RCEPT_ENDDE",
    f"CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN {later(7)} END AS GNRL_RNK1_CRSPAREA_RCPTDE", f"CASE WHEN o_orderkey % 4 = 0 THEN {later(9)} END AS GNRL_RNK1_CRSPAREA_ENDDE",
    f"CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN {later(8)} END AS GNRL_RNK2_ETC_AREA_RCPTDE", f"{later(4)} AS SUBSCRPT_RCEPT_BGNDE", f"{later(4)} AS SUBSCRPT_RCEPT_ENDDE",
    f"CASE WHEN o_orderkey % 5 = 0 THEN {later(20)} END AS PRZWNER_PRESNATN_DE",
)
MODELS = (
    "CAST(l_orderkey AS STRING) AS HOUSE_MANAGE_NO", "CAST(l_orderkey % 7 AS STRING) AS PBLANC_NO", "CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(l_partkey AS STRING) END AS HOUSE_TY",
    "CASE WHEN l_partkey % 10 > 0 THEN CAST(l_suppkey AS STRING) END AS TP", "CASE WHEN l_partkey % 20 > 0 THEN CAST(l_linenumber AS STRING) END AS MODEL_NO",
    "CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS STRING) WHEN l_returnflag = 'A' THEN 'G' END AS GP", "CASE WHEN l_returnflag = 'R' THEN CAST(l_suppkey + 20 AS STRING) END AS EXCLUSE_AR",
    "CAST(l_suppkey + 40 AS STRING) AS SUPLY_AR", "CASE WHEN l_linenumber = 1 THEN '0' ELSE CAST(l_partkey AS STRING) END AS SUPLY_AMOUNT", "CAST(l_partkey * 10 AS STRING) AS LTTOT_TOP_AMOUNT",
    "CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_suppkey AS STRING) END AS SUBSCRPT_REQST_AMOUNT", "CAST(l_linenumber - 1 AS STRING) AS SUPLY_HSHLDCO",
    "CASE WHEN l_returnflag = 'N' THEN '5' WHEN l_returnflag = 'A' THEN '2.5' END AS NEWBORN_HSHLDCO", "CASE WHEN l_linestatus = 'F' THEN '7' ELSE 'x' END AS TRANSR_INSTT_ENFSN_HSHLDCO",
)


def details(spark, d):
    return table(spark, d, "orders").selectExpr(*DETAILS)


def models(spark, d):
    return table(spark, d, "lineitem").selectExpr(*MODELS)


DETAILS_SQL = f"details AS (SELECT {', '.join(DETAILS)} FROM orders)"
# Blanks, categories and rentals of details, in SQL of their own.
URBAN_SQL = f"""{DETAILS_SQL}, urban AS (
  SELECT *, CASE SEARCH_HOUSE_SECD WHEN '0201' THEN 'urban' WHEN '0202' THEN 'officetel' WHEN '0203' THEN 'private_rental' WHEN '0204' THEN 'living_accommodation' ELSE
    CASE lpad(HOUSE_DTL_SECD, 2, '0') WHEN '01' THEN 'urban' WHEN '02' THEN 'officetel' WHEN '03' THEN 'private_rental' WHEN '04' THEN 'living_accommodation' ELSE
    CASE WHEN HOUSE_DTL_SECD_NM LIKE '%오피스텔%' THEN 'officetel' WHEN HOUSE_DTL_SECD_NM LIKE '%임대%' THEN 'private_rental' ELSE 'urban' END END END AS category FROM details)"""
MODELS_SQL = f"models AS (SELECT {', '.join(MODELS)}, coalesce(nullif(CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(l_partkey AS STRING) END, '-'), CASE WHEN l_partkey % 10 > 0 THEN CAST(l_suppkey AS STRING) END, CASE WHEN l_partkey % 20 > 0 THEN CAST(l_linenumber AS STRING) END) AS unit FROM lineitem)"


@query(f"""WITH {URBAN_SQL}
SELECT '{URBAN}:' || HOUSE_MANAGE_NO || ':' || PBLANC_NO AS external_id, HOUSE_NM AS title, coalesce(nullif(BSNS_MBY_NM, ''), nullif(NSPRC_NM, 'null'), '한국부동산원 청약홈') AS provider, category,
  SUBSCRPT_AREA_CODE_NM AS region_name, CAST(RCRIT_PBLANC_DE AS DATE) AS announcement_date,
  CASE WHEN PBLANC_URL = 'https://a.example/n' THEN PBLANC_URL WHEN PBLANC_URL = '-' THEN trim(HMPG_ADRES) END AS official_url,
  CASE upper(trim(PARCPRC_ULS_AT)) WHEN 'Y' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'not_applicable' END AS price_cap_status FROM urban WHERE HOUSE_NM <> '-'""")
def reb_notices(spark, d):
    return feeds.reb(details(spark, d), URBAN, "urban").select("external_id", "title", "provider", "category", "region_name", "announcement_date", "official_url", "price_cap_status")


@query(f"""WITH {DETAILS_SQL}, found AS (
  SELECT HOUSE_MANAGE_NO AS id, 'special' AS kind, '특별공급' AS label, SPSPLY_RCEPT_BGNDE AS s, SPSPLY_RCEPT_ENDDE AS e, CAST(NULL AS VARCHAR) AS audience FROM details
  UNION ALL SELECT HOUSE_MANAGE_NO, 'first_priority', '1순위', GNRL_RNK1_CRSPAREA_RCPTDE, GNRL_RNK1_CRSPAREA_ENDDE, '해당지역' FROM details
  UNION ALL SELECT HOUSE_MANAGE_NO, 'second_priority', '2순위', GNRL_RNK2_ETC_AREA_RCPTDE, NULL, '기타지역' FROM details
  UNION ALL SELECT HOUSE_MANAGE_NO, 'general', '청약 접수', SUBSCRPT_RCEPT_BGNDE, SUBSCRPT_RCEPT_ENDDE, NULL FROM details WHERE SPSPLY_RCEPT_BGNDE IS NULL AND GNRL_RNK1_CRSPAREA_RCPTDE IS NULL AND GNRL_RNK2_ETC_AREA_RCPTDE IS NULL
  UNION ALL SELECT HOUSE_MANAGE_NO, 'announcement', '당첨자 발표', PRZWNER_PRESNATN_DE, NULL, NULL FROM details)
SELECT CAST(id AS BIGINT) AS id, kind, label, CAST(s AS DATE) AS start_date, CASE WHEN e >= s THEN CAST(e AS DATE) END AS end_date, audience FROM found WHERE s IS NOT NULL""")
def unpivot_dates(spark, d):
    rows = details(spark, d)
    return rows.select(F.col("HOUSE_MANAGE_NO").cast("long").alias("id"), F.inline(feeds.reb_events(rows)))


@query(f"""WITH {DETAILS_SQL}
SELECT CAST(HOUSE_MANAGE_NO AS BIGINT) AS id, CASE HOUSE_DTL_SECD WHEN '01' THEN 'private' WHEN '03' THEN 'national' ELSE 'unknown' END AS housing_kind,
  CASE WHEN HOUSE_DTL_SECD IN ('01', '03') THEN 'official' ELSE 'unknown' END AS verification, CASE SPECLT_RDN_EARTH_AT WHEN 'Y' THEN TRUE WHEN 'N' THEN FALSE END AS speculation_zone,
  CASE MDAT_TRGET_AREA_SECD WHEN 'Y' THEN TRUE END AS overheated, CASE WHEN SUBSCRPT_AREA_CODE_NM LIKE '서울%' THEN TRUE WHEN SUBSCRPT_AREA_CODE_NM LIKE '부산%' THEN FALSE END AS capital_region,
  CASE WHEN GNRL_RNK1_CRSPAREA_RCPTDE IS NOT NULL OR GNRL_RNK2_ETC_AREA_RCPTDE IS NOT NULL THEN 'applicable' WHEN HOUSE_DTL_SECD_NM = '신혼희망타운' THEN 'not_applicable' END AS rank_status,
  CASE WHEN GNRL_RNK1_CRSPAREA_RCPTDE IS NOT NULL OR GNRL_RNK2_ETC_AREA_RCPTDE IS NOT NULL OR HOUSE_DTL_SECD_NM = '신혼희망타운' THEN TRUE END AS account_required,
  CASE WHEN GNRL_RNK1_CRSPAREA_RCPTDE IS NOT NULL OR GNRL_RNK2_ETC_AREA_RCPTDE IS NOT NULL THEN 'apt_ranked' END AS method,
  2 + CASE WHEN GNRL_RNK1_CRSPAREA_RCPTDE IS NOT NULL OR GNRL_RNK2_ETC_AREA_RCPTDE IS NOT NULL THEN 2 WHEN HOUSE_DTL_SECD_NM = '신혼희망타운' THEN 1 ELSE 0 END AS n_rules FROM details""")
def reb_apartment_rules(spark, d):
    rows = details(spark, d)
    told, place, rank = metadata.classification(rows, APT, "apt"), metadata.context(rows, APT), metadata.rank_applicability(rows, APT, "apt")
    return rows.select(
        F.col("HOUSE_MANAGE_NO").cast("long").alias("id"), told["housing_kind"].alias("housing_kind"), told["verification"].alias("verification"), place["speculation_zone"].alias("speculation_zone"),
        place["subscription_overheated"].alias("overheated"), place["capital_region"].alias("capital_region"), rank["status"].alias("rank_status"), rank["account_required"].alias("account_required"),
        metadata.application_method(rows, APT, "apt").alias("method"), F.size(metadata.metadata_rules(rows, APT, "apt")).alias("n_rules"),
    )


@query(f"""WITH {URBAN_SQL}, told AS (
  SELECT *, CASE WHEN category IN ('officetel', 'living_accommodation') THEN TRUE ELSE FALSE END AS unranked FROM urban)
SELECT CAST(HOUSE_MANAGE_NO AS BIGINT) AS id, CASE WHEN unranked THEN 'not_applicable' ELSE 'unknown' END AS housing_kind, CASE WHEN unranked THEN 'not_applicable' END AS rank_status,
  CASE WHEN unranked THEN FALSE END AS account_required, CASE WHEN unranked THEN '오피스텔·생활숙박시설은 아파트 1·2순위 적용 없음' END AS reason, CASE WHEN category = 'officetel' THEN 'officetel' END AS method FROM told""")
def reb_urban_rules(spark, d):
    rows = details(spark, d)
    rank = metadata.rank_applicability(rows, URBAN, "urban")
    return rows.select(
        F.col("HOUSE_MANAGE_NO").cast("long").alias("id"), metadata.classification(rows, URBAN, "urban")["housing_kind"].alias("housing_kind"), rank["status"].alias("rank_status"),
        rank["account_required"].alias("account_required"), rank["reason"].alias("reason"), metadata.application_method(rows, URBAN, "urban").alias("method"),
    )


@query(f"""WITH {URBAN_SQL}, {MODELS_SQL}
SELECT m.HOUSE_MANAGE_NO AS house_no, CASE WHEN GP <> unit THEN GP || ' ' || unit ELSE unit END AS unit_type, CAST(coalesce(EXCLUSE_AR, SUPLY_AR) AS DOUBLE) AS area_sqm,
  CASE WHEN category = 'private_rental' OR RENT_SECD = '1' THEN 'deposit' ELSE 'sale_max' END AS price_kind,
  CASE WHEN NOT (category = 'private_rental' OR coalesce(RENT_SECD, '') = '1') THEN nullif(CAST(SUPLY_AMOUNT AS BIGINT) * 10000, 0) END AS amount_krw,
  CASE WHEN NOT (category = 'private_rental' OR coalesce(RENT_SECD, '') = '1') AND SUPLY_AMOUNT <> '0' THEN 'official' ELSE 'unknown' END AS verification
FROM models AS m JOIN urban AS u ON m.HOUSE_MANAGE_NO = u.HOUSE_MANAGE_NO AND m.PBLANC_NO = u.PBLANC_NO WHERE unit IS NOT NULL""")
def reb_model_prices(spark, d):
    return feeds.reb_prices(details(spark, d), models(spark, d), "urban").select("house_no", "unit_type", "area_sqm", "price_kind", "amount_krw", "verification")


@query(f"""WITH {URBAN_SQL}, {MODELS_SQL}, sold AS (
  SELECT m.* FROM models AS m JOIN urban AS u ON m.HOUSE_MANAGE_NO = u.HOUSE_MANAGE_NO AND m.PBLANC_NO = u.PBLANC_NO WHERE category <> 'private_rental' AND coalesce(RENT_SECD, '') <> '1' AND unit IS NOT NULL)
SELECT HOUSE_MANAGE_NO AS house_no, unit AS unit_type, '일반공급' AS supply_type, CAST(SUPLY_HSHLDCO AS BIGINT) AS supply_count FROM sold WHERE SUPLY_HSHLDCO <> '0'
UNION ALL SELECT HOUSE_MANAGE_NO, unit, '신생아 특별공급', 5 FROM sold WHERE NEWBORN_HSHLDCO = '5'
UNION ALL SELECT HOUSE_MANAGE_NO, unit, '이전기관종사자 특별공급', 7 FROM sold WHERE TRANSR_INSTT_ENFSN_HSHLDCO = '7'""")
def reb_model_supplies(spark, d):
    return feeds.reb_supplies(details(spark, d), models(spark, d), "urban").drop("notice_no")


@query(f"""WITH {URBAN_SQL}, {MODELS_SQL}, sold AS (
  SELECT m.*, category <> 'private_rental' AND coalesce(RENT_SECD, '') <> '1' AS sale FROM models AS m JOIN urban AS u ON m.HOUSE_MANAGE_NO = u.HOUSE_MANAGE_NO AND m.PBLANC_NO = u.PBLANC_NO)
SELECT HOUSE_MANAGE_NO AS house_no, nullif(CAST(sum(CASE WHEN sale AND unit IS NOT NULL THEN CAST(SUPLY_HSHLDCO AS BIGINT) + CASE WHEN NEWBORN_HSHLDCO = '5' THEN 5 ELSE 0 END
    + CASE WHEN TRANSR_INSTT_ENFSN_HSHLDCO = '7' THEN 7 ELSE 0 END ELSE 0 END) AS BIGINT), 0) AS offered,
  count(EXCLUSE_AR) FILTER (WHERE unit IS NOT NULL) AS n_areas, CAST(coalesce(sum(CAST(SUBSCRPT_REQST_AMOUNT AS BIGINT) * 10000) FILTER (WHERE coalesce(TP, unit) IS NOT NULL), 0) AS BIGINT) AS fees FROM sold GROUP BY 1""")
def reb_inventories(spark, d):
    rows = metadata.model_rules(details(spark, d), models(spark, d), "urban")
    total = lambda c, field: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[field])
    return rows.select("house_no", total("offered", "supply_count").alias("offered"), F.size("areas").cast("long").alias("n_areas"), total("fees", "application_fee_krw").alias("fees"))


HOUSES = ("CAST(o_custkey AS STRING) AS notice_id", "CAST(o_orderkey AS STRING) AS houseSn", "CASE WHEN o_orderkey % 5 > 0 THEN ' ' || o_orderpriority ELSE ' ' END AS hsmpNm")
SUPPLIES = (
    "CAST(l_orderkey AS STRING) AS houseSn", "CASE WHEN l_linenumber = 7 THEN ' ' ELSE ' ' || CAST(l_partkey AS STRING) END AS styleNm",
    "CASE WHEN l_linenumber = 2 THEN '0' ELSE CAST(l_partkey * 1000 AS STRING) END AS sumPrice", "CASE WHEN l_returnflag = 'R' THEN 'x' ELSE CAST(l_suppkey AS STRING) || '.5' END AS prvuseAr",
)


@query(f"""WITH houses AS (SELECT {', '.join(HOUSES)} FROM orders), supplies AS (SELECT o_custkey, {', '.join(SUPPLIES)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey), several AS (
  SELECT notice_id, count(*) AS n FROM houses GROUP BY 1)
SELECT h.notice_id, CASE WHEN n > 1 AND trim(hsmpNm) <> '' THEN hsmpNm || ' · ' || trim(styleNm) ELSE trim(styleNm) END AS unit_type, TRY_CAST(prvuseAr AS DOUBLE) AS area_sqm, 'sale_total' AS price_kind,
  nullif(CAST(sumPrice AS BIGINT), 0) AS amount_krw, CASE WHEN sumPrice <> '0' THEN 'official' ELSE 'unknown' END AS verification
FROM supplies AS s JOIN houses AS h ON s.houseSn = h.houseSn JOIN several AS v ON v.notice_id = h.notice_id WHERE trim(styleNm) <> ''""".replace("hsmpNm || ' · '", "trim(hsmpNm) || ' · '"))
def myhome_detail_prices(spark, d):
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return feeds.myhome_prices(lines.selectExpr("CAST(o_custkey AS STRING) AS notice_id", *SUPPLIES), orders.selectExpr(*HOUSES))


LH = ("CASE WHEN c_custkey % 10 > 0 THEN CAST(c_custkey AS STRING) END AS PAN_ID", "c_name AS PAN_NM", "CASE WHEN c_custkey % 4 > 0 THEN '39' END AS UPP_AIS_TP_CD", "CASE WHEN c_nationkey % 2 = 0 THEN '42' END AS AIS_TP_CD",
      "CASE WHEN c_custkey % 20 > 0 THEN 'https://lh.example/v?PAN_ID=' || CAST(c_custkey + 1 AS STRING) ELSE '-' END AS DTL_URL", "'2024.01.05' AS PAN_NT_ST_DT", "'20240110' AS RCPT_ST_DT", "'2024-01-12T00:00:00' AS RCPT_ED_DT")
IH = ("CASE WHEN s_suppkey % 7 > 0 THEN s_name ELSE s_name || ' 토지 공급' END AS sj", "CASE WHEN s_suppkey % 14 = 0 THEN '주택 분양' WHEN s_suppkey % 2 = 0 THEN '임대' END AS seNm", "'https://ih.example/' || CAST(s_suppkey AS STRING) AS link")
MYHOME = ("CAST(p_partkey AS STRING) AS pblancId", "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) END AS houseSn", "CASE WHEN p_partkey % 9 = 0 THEN 'None' ELSE p_name END AS pblancNm", "p_brand AS suplyInsttNm",
          "'20240203' AS beginDe", "'20240201' AS endDe", "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey - 1 AS STRING) END AS beforePblancId")


@query(f"""WITH lh AS (SELECT {', '.join(LH)} FROM customer), ih AS (SELECT {', '.join(IH)} FROM supplier), myhome AS (SELECT {', '.join(MYHOME)} FROM part)
SELECT 'lh' AS source, coalesce(PAN_ID, nullif(regexp_extract(DTL_URL, 'PAN_ID=([0-9]+)', 1), '')) AS external_id, PAN_NM AS title, CASE WHEN UPP_AIS_TP_CD IS NULL OR AIS_TP_CD IS NULL THEN 'public_sale' ELSE 'public_rental' END AS category,
  CASE WHEN UPP_AIS_TP_CD IS NULL OR AIS_TP_CD IS NULL THEN 'unknown' ELSE 'not_applicable' END AS price_cap_status, CAST(NULL AS VARCHAR) AS correction_of_external_id, DATE '2024-01-10' AS first_start, DATE '2024-01-12' AS first_end
FROM lh WHERE PAN_ID IS NOT NULL OR DTL_URL <> '-'
UNION ALL SELECT 'ih', left(sha256(link), 32), sj, CASE WHEN seNm = '임대' THEN 'public_rental' WHEN seNm IS NULL THEN 'other' ELSE 'public_sale' END, CASE WHEN seNm = '임대' THEN 'not_applicable' ELSE 'unknown' END, NULL, NULL, NULL
FROM ih WHERE sj NOT LIKE '%토지%' OR coalesce(seNm, '') LIKE '%주택%'
UNION ALL SELECT 'myhome', pblancId || coalesce(':' || houseSn, ''), pblancNm, 'public_sale', 'unknown', beforePblancId, DATE '2024-02-03', NULL FROM myhome WHERE pblancNm <> 'None'""")
def source_union_normalise(spark, d):
    rows = feeds.union(
        feeds.lh(table(spark, d, "customer").selectExpr(*LH), "05"), feeds.ih(table(spark, d, "supplier").selectExpr(*IH)), feeds.myhome(table(spark, d, "part").selectExpr(*MYHOME)),
    )
    first = F.try_element_at("events", F.lit(1))
    return rows.select("source", "external_id", "title", "category", "price_cap_status", "correction_of_external_id", first["start_date"].alias("first_start"), first["end_date"].alias("first_end"))


CELLS = "array(named_struct('class', '', 'text', o_orderstatus, 'hrefs', array()), named_struct('class', 't', 'text', title, 'hrefs', array(href)), named_struct('class', '', 'text', day, 'hrefs', array()))"
BOARD = (
    "CASE o_orderkey % 4 WHEN 0 THEN '임대주택 입주자 모집' WHEN 1 THEN '분양주택 청약 안내' WHEN 2 THEN '채용 안내' ELSE '청약 결과' END AS title",
    "CASE WHEN o_orderkey % 3 = 0 THEN '?articleNo=' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 3 = 1 THEN '/b/' || CAST(o_orderkey AS STRING) ELSE 'https://x.example/' || CAST(o_orderkey AS STRING) END AS href",
    f"CASE WHEN o_orderkey % 2 = 0 THEN CAST({DAY} AS STRING) ELSE '24.03.05' END AS day", "o_orderstatus", "o_orderkey",
)


@query(f"""WITH rows AS (SELECT {', '.join(BOARD)} FROM orders), linked AS (
  SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'https://gh.example/list' || href WHEN 1 THEN 'https://gh.example' || href ELSE href END AS url FROM rows WHERE title <> '채용 안내')
SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE left(sha256(url), 32) END AS external_id, title, url AS official_url,
  CASE WHEN title LIKE '분양%' THEN 'public_sale' WHEN title LIKE '임대%' THEN 'public_rental' ELSE 'other' END AS category, CASE WHEN title LIKE '임대%' THEN 'not_applicable' ELSE 'unknown' END AS price_cap_status,
  CASE WHEN day = '24.03.05' THEN DATE '2024-03-05' ELSE CAST(day AS DATE) END AS announcement_date FROM linked""".replace("CAST(day AS DATE)", "TRY_CAST(day AS DATE)"))
def board_notices(spark, d):
    rows = table(spark, d, "orders").selectExpr(*BOARD).select(F.expr(CELLS).alias("cells"), F.lit("https://gh.example/list?page=1").alias("base_url"))
    return feeds.board(rows, "gh", "GH", "경기도", 1, 2, "입주자|청약").select("external_id", "title", "official_url", "category", "price_cap_status", "announcement_date")


RESULTS = (
    "CAST(l_orderkey AS STRING) AS HOUSE_MANAGE_NO", "CAST(l_orderkey % 7 AS STRING) AS PBLANC_NO", "CASE WHEN l_linenumber = 6 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS HOUSE_TY", "CAST(l_linenumber AS STRING) AS MODEL_NO",
    "CAST(l_linenumber % 3 AS STRING) AS SUBSCRPT_RANK_CODE", "CASE WHEN l_returnflag = 'N' THEN '1' WHEN l_returnflag = 'A' THEN '03' ELSE '9' END AS RESIDE_SECD", "l_returnflag AS RESIDE_SENM",
    "CASE l_linenumber WHEN 1 THEN '00' WHEN 2 THEN 'SY' WHEN 3 THEN 'SX' END AS SPSPLY_KND_CODE", "'1,200' AS SUPLY_HSHLDCO", "CASE WHEN l_linestatus = 'O' THEN '1.5' ELSE '12' END AS REQ_CNT", "CASE WHEN l_tax > 0.04 THEN '(△3)' END AS CMPET_RATE",
)


@query(f"""WITH rows AS (SELECT {', '.join(RESULTS)} FROM lineitem)
SELECT HOUSE_MANAGE_NO AS house_no, HOUSE_TY AS unit_type, CAST(nullif(SUBSCRPT_RANK_CODE, '0') AS INTEGER) AS rank, CASE RESIDE_SECD WHEN '1' THEN 'local' WHEN '03' THEN 'other_gyeonggi' ELSE 'unknown' END AS residence_area,
  CASE SPSPLY_KND_CODE WHEN '00' THEN 'general' WHEN 'SY' THEN 'young' ELSE 'unknown' END AS supply_type, CAST(1200 AS BIGINT) AS supply_count, CASE WHEN REQ_CNT = '12' THEN CAST(12 AS BIGINT) END AS application_count,
  coalesce(CMPET_RATE, '-') AS competition_rate FROM rows WHERE HOUSE_TY <> ' '""")
def competition_feed(spark, d):
    rows = feeds.competition_rows(table(spark, d, "lineitem").selectExpr(*RESULTS), "getPblPvtRentLttotPblancCmpet")
    return rows.select("house_no", "unit_type", "rank", "residence_area", "supply_type", "supply_count", "application_count", "competition_rate")
