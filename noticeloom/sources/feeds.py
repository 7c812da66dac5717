"""Rows of feeds as notices: one select for each source, then a union by name.

Each function takes landed rows (strings, as published) and returns the columns of NOTICE; a row without a title or an
id is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import korean_dates, lenient_date, short_year_date
from noticeloom.functions.text import decimal_number, first_usable, integer, manwon_to_krw, public_url, url_id, yes_no

EVENT = "struct<kind:string,label:string,start_date:date,end_date:date,audience:string>"
PRICE = "struct<unit_type:string,area_sqm:double,price_kind:string,amount_krw:bigint,monthly_krw:bigint,verification:string,document_hash:string>"
#: The columns of a notice, with those that are null or empty unless a feed gives them.
NOTICE = (
    "source", "external_id", "provider", "title", "category", "address", "region_code", "region_name", "announcement_date", "official_url", "document_hash",
    "price_cap_status", "correction_of_external_id", "events", "prices", "rules",
)

# Codes and words of the feeds.
REB_CATEGORY = {"0201": "urban", "0202": "officetel", "0203": "private_rental", "0204": "living_accommodation", "0303": "private_rental"}
REB_SUBTYPE = {"01": "urban", "02": "officetel", "03": "private_rental", "04": "living_accommodation"}
CAPITAL = ("서울", "서울특별시", "인천", "인천광역시", "경기", "경기도")
ELSEWHERE = (
    "부산", "부산광역시", "대구", "대구광역시", "광주", "광주광역시", "대전", "대전광역시", "울산", "울산광역시", "세종", "세종특별자치시", "강원", "강원도", "강원특별자치도",
    "충북", "충청북도", "충남", "충청남도", "전북", "전라북도", "전북특별자치도", "전남", "전라남도", "전남광주통합특별시", "경북", "경상북도", "경남", "경상남도", "제주", "제주특별자치도",
)
REB_SUPPLIES = {
    "SUPLY_HSHLDCO": "일반공급", "INSTT_RECOMEND_HSHLDCO": "기관추천 특별공급", "MNYCH_HSHLDCO": "다자녀가구 특별공급", "NWWDS_HSHLDCO": "신혼부부 특별공급",
    "OLD_PARNTS_SUPORT_HSHLDCO": "노부모부양 특별공급", "LFE_FRST_HSHLDCO": "생애최초 특별공급", "NEWBORN_HSHLDCO": "신생아 특별공급", "TRANSR_INSTT_ENFSN_HSHLDCO": "이전기관종사자 특별공급",
}
REB_AUDIENCES = {"CRSPAREA": "해당지역", "ETC_GG": "기타경기", "ETC_AREA": "기타지역"}
#: Pairs whose models publish SUPLY_AMOUNT, and pairs whose notices may be under the price cap.
REB_SUPPLY_AMOUNT, REB_CAPPED = ("urban", "private_rental"), ("apt", "unsold")
REB_PROVIDER = "한국부동산원 청약홈"
LH_CATEGORY = {"05": "public_sale", "06": "public_rental", "13": "public_rental", "39": "public_sale"}
AREA = {"01": "local", "02": "other", "03": "other_gyeonggi"}
PRIVATE_RENTAL_SUPPLY = {"00": "general", "SY": "young", "SN": "newlywed", "SO": "older"}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def event(kind: str, label: str, start: Column, end: Column | None = None, audience: str | None = None) -> Column:
    """An event, or null without a start; an end before the start is no end."""
    start = lenient_date(start)
    end = F.lit(None).cast("date") if end is None else lenient_date(end)
    whole = F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), start.alias("start_date"), F.when(end >= start, end).alias("end_date"), F.lit(audience).cast("string").alias("audience"))
    return F.when(start.isNotNull(), whole)


def column(rows: DataFrame, name: str) -> Column:
    """A feed's column, or null where the landed rows have none."""
    return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")


def shaped(rows: DataFrame, **values: Column) -> DataFrame:
    empty = {"events": F.expr(f"cast(array() as array<{EVENT}>)"), "prices": F.expr(f"cast(array() as array<{PRICE}>)"), "rules": F.expr("cast(array() as array<string>)"), "announcement_date": F.lit(None).cast("date")}
    out = rows.select(*[(values.get(c, empty.get(c, F.lit(None).cast("string")))).alias(c) for c in NOTICE])
    return out.filter(F.col("title").isNotNull() & F.col("external_id").isNotNull())


def reb_category(rows: DataFrame, category: str) -> Column:
    """The pair's category; of urban notices by search code, then detail code, then words of the detail name."""
    if category != "urban":
        return F.lit(category)
    name = F.coalesce(column(rows, "HOUSE_DTL_SECD_NM"), F.lit(""))
    by_name = F.when(name.contains("오피스텔"), "officetel").when(name.contains("임대"), "private_rental").when(name.contains("숙박"), "living_accommodation").otherwise("urban")
    return F.coalesce(lookup(REB_CATEGORY, column(rows, "SEARCH_HOUSE_SECD")), lookup(REB_SUBTYPE, F.lpad(column(rows, "HOUSE_DTL_SECD"), 2, "0")), by_name)


def reb_events(rows: DataFrame) -> Column:
    """Receptions by rank and area, special and general, or the plain reception where there is none of these; result and contract days."""
    c = lambda n: column(rows, n)
    ranked = [event("special", "특별공급", c("SPSPLY_RCEPT_BGNDE"), c("SPSPLY_RCEPT_ENDDE"))]
    for rank, kind in ((1, "first_priority"), (2, "second_priority")):
        for stem, audience in REB_AUDIENCES.items():
            ranked.append(event(kind, f"{rank}순위", c(f"GNRL_RNK{rank}_{stem}_RCPTDE"), c(f"GNRL_RNK{rank}_{stem}_ENDDE"), audience))
    ranked.append(event("general", "일반공급", c("GNRL_RCEPT_BGNDE"), c("GNRL_RCEPT_ENDDE")))
    found = F.array_compact(F.array(*ranked))
    plain = F.array_compact(F.array(event("general", "청약 접수", first_usable(c("SUBSCRPT_RCEPT_BGNDE"), c("RCEPT_BGNDE")), first_usable(c("SUBSCRPT_RCEPT_ENDDE"), c("RCEPT_ENDDE")))))
    after = F.array_compact(F.array(event("announcement", "당첨자 발표", c("PRZWNER_PRESNATN_DE")), event("contract", "계약", c("CNTRCT_CNCLS_BGNDE"), c("CNTRCT_CNCLS_ENDDE"))))
    return F.array_distinct(F.concat(F.when(F.size(found) > 0, found).otherwise(plain), after))


def capital_region(name: Column) -> Column:
    """Whether the province that a region's name begins with is in the capital region; unknown provinces are null."""
    province = F.element_at(F.split(F.trim(name), r"\s+"), 1)
    return F.when(province.isin(*CAPITAL), True).when(province.isin(*ELSEWHERE), False)


def reb_rental(rows: DataFrame, category: str) -> Column:
    """Rentals: of the rental category, or marked as one."""
    return (reb_category(rows, category) == "private_rental") | (F.coalesce(column(rows, "RENT_SECD"), F.lit("")) == "1")


def reb(details: DataFrame, operation: str, category: str, **more: Column) -> DataFrame:
    """Details of one operation of the national subscription feed. A cap that isn't published is unknown where there may be one.

    more: further columns of NOTICE, as reb_metadata.reb_with_rules gives them.
    """
    c = lambda n: column(details, n)
    cap = yes_no(c("PARCPRC_ULS_AT"))
    house, notice = first_usable(c("HOUSE_MANAGE_NO")), first_usable(c("PBLANC_NO"))
    return shaped(
        details, source=F.lit("cheongyak_home"), external_id=F.when(house.isNotNull() & notice.isNotNull(), F.concat_ws(":", F.lit(operation), house, notice)), title=first_usable(c("HOUSE_NM")),
        provider=F.coalesce(first_usable(c("BSNS_MBY_NM"), c("NSPRC_NM")), F.lit(REB_PROVIDER)), category=reb_category(details, category), region_code=first_usable(c("SUBSCRPT_AREA_CODE")),
        region_name=first_usable(c("SUBSCRPT_AREA_CODE_NM")), address=first_usable(c("HSSPLY_ADRES")), announcement_date=lenient_date(c("RCRIT_PBLANC_DE")),
        official_url=public_url(first_usable(c("PBLANC_URL"), c("HMPG_ADRES"))),
        price_cap_status=F.when(cap, "yes").when(~cap, "no").otherwise("unknown" if category in REB_CAPPED else "not_applicable"), events=reb_events(details), **more,
    )


def reb_unit(models: DataFrame) -> Column:
    return first_usable(column(models, "HOUSE_TY"), column(models, "TP"), column(models, "MODEL_NO"))


def _of_sales(models: DataFrame, details: DataFrame, category: str) -> DataFrame:
    """models with _rental of their notice."""
    kind = details.select("HOUSE_MANAGE_NO", "PBLANC_NO", reb_rental(details, category).alias("_rental"))
    return models.join(kind, ["HOUSE_MANAGE_NO", "PBLANC_NO"])


def reb_prices(details: DataFrame, models: DataFrame, category: str) -> DataFrame:
    """house_no, notice_no and the fields of PRICE, a row for each model with a unit.

    The unit has its group in front where it has another; the area is the exclusive one, else the supplied; the amount is
    that which the pair publishes, in won. Rentals publish no deposit, and 0 is no price.
    """
    unit, group = reb_unit(models), first_usable(column(models, "GP"))
    amount = F.nullif(manwon_to_krw(column(models, "SUPLY_AMOUNT" if category in REB_SUPPLY_AMOUNT else "LTTOT_TOP_AMOUNT")), F.lit(0).cast("long"))
    # Read before the join, which then moves three values of a model and not its texts.
    read = models.filter(unit.isNotNull()).select(
        "HOUSE_MANAGE_NO", "PBLANC_NO", F.when(group != unit, F.concat_ws(" ", group, unit)).otherwise(unit).alias("unit_type"),
        decimal_number(first_usable(column(models, "EXCLUSE_AR"), column(models, "SUPLY_AR"))).cast("double").alias("area_sqm"), amount.alias("_amount"),
    )
    amount = F.when(~F.col("_rental"), F.col("_amount"))
    return _of_sales(read, details, category).select(
        F.col("HOUSE_MANAGE_NO").alias("house_no"), F.col("PBLANC_NO").alias("notice_no"), "unit_type", "area_sqm", F.when(F.col("_rental"), "deposit").otherwise("sale_max").alias("price_kind"),
        amount.alias("amount_krw"), F.lit(None).cast("long").alias("monthly_krw"), F.when(amount.isNotNull(), "official").otherwise("unknown").alias("verification"), F.lit(None).cast("string").alias("document_hash"),
    )


def with_prices(notices: DataFrame, prices: DataFrame) -> DataFrame:
    """Notices of reb() with the prices of their models: those of reb_prices with the same house and notice number."""
    number = lambda i: F.element_at(F.split("external_id", ":"), i)
    fields = [x.split(":")[0] for x in PRICE.removeprefix("struct<").removesuffix(">").split(",")]
    own = prices.groupBy("house_no", "notice_no").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_prices"))
    out = notices.join(own, (number(-2) == own["house_no"]) & (number(-1) == own["notice_no"]), "left")
    return out.withColumn("prices", F.coalesce("_prices", "prices")).select(*notices.columns)


def reb_supplies(details: DataFrame, models: DataFrame, category: str) -> DataFrame:
    """house_no, notice_no, unit_type, supply_type, supply_count: the positive counts of a model's wide columns, as rows; none of rentals."""
    rows = _of_sales(models, details, category).filter(~F.col("_rental"))
    wide = rows.select(
        F.col("HOUSE_MANAGE_NO").alias("house_no"), F.col("PBLANC_NO").alias("notice_no"), reb_unit(models).alias("unit_type"),
        *[integer(column(models, c)).alias(label) for c, label in REB_SUPPLIES.items()],
    )
    return wide.unpivot(["house_no", "notice_no", "unit_type"], list(REB_SUPPLIES.values()), "supply_type", "supply_count").filter("supply_count > 0 AND unit_type IS NOT NULL")


def lh(rows: DataFrame, category_code: str) -> DataFrame:
    c = lambda n: column(rows, n)
    url = first_usable(c("DTL_URL"))
    parent, subtype = F.coalesce(first_usable(c("UPP_AIS_TP_CD")), F.lit(category_code)), F.coalesce(first_usable(c("AIS_TP_CD")), F.try_parse_url(url, F.lit("QUERY"), F.lit("aisTpCd")))
    category = F.when((parent == "39") & (subtype == "42"), "public_rental").otherwise(F.coalesce(lookup(LH_CATEGORY, parent), F.lit("other")))
    found = F.nullif(F.regexp_extract(url, r"(?i)PAN_ID[:=]([0-9]+)", 1), F.lit(""))
    events = F.array_compact(F.array(event("general", "신청 접수", first_usable(c("RQS_ST_DT"), c("RCPT_ST_DT")), first_usable(c("RQS_ED_DT"), c("RCPT_ED_DT"))), event("announcement", "당첨자 발표", first_usable(c("PRZWN_ANN_DT"), c("PRZWNER_PRESNATN_DE")))))
    return shaped(
        rows, source=F.lit("lh"), external_id=F.coalesce(first_usable(c("PAN_ID")), found), title=first_usable(c("PAN_NM")), provider=F.lit("한국토지주택공사 LH"), category=category,
        region_name=first_usable(c("CNP_CD_NM")), announcement_date=lenient_date(c("PAN_NT_ST_DT")), official_url=url,
        price_cap_status=F.when(category == "public_rental", "not_applicable").otherwise("unknown"), events=events,
    )


def ih(rows: DataFrame) -> DataFrame:
    c = lambda n: column(rows, n)
    words = F.concat_ws(" ", c("tyNm"), c("seNm"), c("sj"))
    kind = F.coalesce(c("seNm"), F.lit(""))
    category = F.when(kind.contains("임대"), "public_rental").when(kind.contains("분양"), "public_sale").otherwise("other")
    other = words.rlike("토지|상가|산업용지|입찰공고") & ~words.rlike("주택|아파트|입주자")
    url = first_usable(c("link"))
    return shaped(
        rows.filter(~other), source=F.lit("ih"), external_id=url_id(url), title=first_usable(c("sj")), provider=F.lit("인천도시공사 iH"), category=category, region_name=F.lit("인천광역시"),
        announcement_date=lenient_date(c("crtYmd")), official_url=url, price_cap_status=F.when(category == "public_rental", "not_applicable").otherwise("unknown"),
    )


def myhome(rows: DataFrame) -> DataFrame:
    c = lambda n: column(rows, n)
    events = F.array_compact(F.array(event("general", "청약 접수", c("beginDe"), c("endDe")), event("announcement", "당첨자 발표", c("przwnerPresnatnDe"))))
    return shaped(
        rows, source=F.lit("myhome"), external_id=F.concat_ws(":", first_usable(c("pblancId")), first_usable(c("houseSn"))), title=first_usable(c("pblancNm")), provider=first_usable(c("suplyInsttNm")),
        category=F.lit("public_sale"), region_name=F.concat_ws(" ", first_usable(c("brtcNm")), first_usable(c("signguNm"))), address=first_usable(c("fullAdres")), announcement_date=lenient_date(c("rcritPblancDe")),
        official_url=first_usable(c("url")), price_cap_status=F.lit("unknown"), correction_of_external_id=first_usable(c("beforePblancId")), events=events,
    )


def myhome_prices(supplies: DataFrame, houses: DataFrame) -> DataFrame:
    """notice_id, unit_type, area_sqm, price_kind, amount_krw, verification: the supply rows of detail pages with their house.

    supplies (notice_id, houseSn, styleNm, sumPrice, prvuseAr), houses (notice_id, houseSn, hsmpNm). The house's name
    stands before the unit where the notice has several. 0 is no price; rows without a style are left out.
    """
    several = houses.groupBy("notice_id").agg(F.count_distinct("houseSn").alias("_houses"))
    named = houses.groupBy("notice_id", "houseSn").agg(F.max("hsmpNm").alias("_name")).join(several, "notice_id")
    unit, name = F.nullif(F.trim("styleNm"), F.lit("")), F.nullif(F.trim("_name"), F.lit(""))
    amount = F.nullif(integer(F.col("sumPrice")), F.lit(0).cast("long"))
    return supplies.join(named, ["notice_id", "houseSn"], "left").filter(unit.isNotNull()).select(
        "notice_id", F.when((F.col("_houses") > 1) & name.isNotNull(), F.concat_ws(" · ", name, unit)).otherwise(unit).alias("unit_type"),
        F.when(F.col("prvuseAr").rlike(r"^\d+(?:\.\d+)?$"), F.col("prvuseAr").try_cast("double")).alias("area_sqm"), F.lit("sale_total").alias("price_kind"), amount.alias("amount_krw"),
        F.when(amount.isNotNull(), "official").otherwise("unknown").alias("verification"),
    )


def board(rows: DataFrame, source: str, provider: str, region: str, title: int, day: int, wanted: str, keep: Column | None = None) -> DataFrame:
    """Rows of a board (cells: array<struct<class, text, hrefs>>, base_url): titles that match, ids from the link or its hash."""
    cell = lambda i: F.try_element_at("cells", F.lit(i + 1))
    rows = rows.filter((F.size("cells") > max(title, day)) & cell(title)["text"].rlike(wanted))
    rows = rows if keep is None else rows.filter(keep)
    href = F.try_element_at(cell(title)["hrefs"], F.lit(1))
    url = F.when(href.rlike("^https?://"), href).when(href.rlike("^[?]"), F.concat(F.element_at(F.split("base_url", r"\?"), 1), href)).otherwise(F.concat(F.regexp_extract("base_url", r"^(https?://[^/]+)", 1), href))
    name = cell(title)["text"]
    category = F.when(name.contains("분양") & ~name.contains("임대"), "public_sale").when(name.contains("임대"), "public_rental").otherwise("other")
    return shaped(
        rows, source=F.lit(source), external_id=F.when(url.isNotNull(), F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("articleNo")), url_id(url))), title=F.nullif(name, F.lit("")), provider=F.lit(provider), category=category,
        region_name=F.lit(region), announcement_date=F.coalesce(short_year_date(cell(day)["text"]), lenient_date(cell(day)["text"])), official_url=url,
        price_cap_status=F.when(category == "public_rental", "not_applicable").otherwise("unknown"),
    )


def union(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for x in feeds[1:]:
        out = out.unionByName(x)
    return out


def competition_rows(rows: DataFrame, operation: str) -> DataFrame:
    """Rows of the results feed: codes as words; no status, which the feed does not publish."""
    c = lambda n: column(rows, n)
    rank = integer(c("SUBSCRPT_RANK_CODE"))
    supply = F.coalesce(lookup(PRIVATE_RENTAL_SUPPLY, c("SPSPLY_KND_CODE")), F.lit("unknown")) if operation == "getPblPvtRentLttotPblancCmpet" else F.lit("general")
    return rows.select(
        c("HOUSE_MANAGE_NO").alias("house_no"), c("PBLANC_NO").alias("notice_no"), first_usable(c("HOUSE_TY")).alias("unit_type"), c("MODEL_NO").alias("model_no"), F.when(rank.isin(1, 2), rank.cast("int")).alias("rank"),
        F.coalesce(lookup(AREA, F.lpad(c("RESIDE_SECD"), 2, "0")), F.lit("unknown")).alias("residence_area"), first_usable(c("RESIDE_SENM"), c("RESIDNT_PRIOR_SENM")).alias("residence_area_label"), supply.alias("supply_type"),
        integer(first_usable(c("SPSPLY_KND_HSHLDCO"), c("SUPLY_HSHLDCO"))).alias("supply_count"), integer(c("REQ_CNT")).alias("application_count"), F.coalesce(c("CMPET_RATE"), F.lit("-")).alias("competition_rate"),
        F.lit("unknown").alias("result_status"), F.lit("official").alias("verification"),
    ).filter("unit_type IS NOT NULL")


def schedule(text: Column) -> Column:
    """The first two days of a schedule's text as struct<start_date, end_date>."""
    days = korean_dates(text)
    return F.struct(F.try_element_at(days, F.lit(1)).alias("start_date"), F.try_element_at(days, F.lit(2)).alias("end_date"))
