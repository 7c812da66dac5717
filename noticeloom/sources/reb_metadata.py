"""What the national subscription feed says of a notice beside dates and prices: rules of kind metadata.

Each function gives a column of struct (null where the feed says nothing); metadata_rules gives all of them as JSON, as
notices keep their rules.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import lenient_date
from noticeloom.functions.text import decimal_number, first_usable, manwon_to_krw, yes_no
from noticeloom.sources.feeds import REB_AUDIENCES, capital_region, column, lookup, reb, reb_category, reb_supplies, reb_unit

# The operation whose detail codes tell private from national housing, and categories without ranks.
APT = "getAPTLttotPblancDetail"
HOUSING = {"01": "private", "03": "national"}
UNRANKED, REMAINDER = ("officetel", "living_accommodation"), ("unsold", "optional_supply")
RANK_REASONS = {
    "ranked": "아파트 일반공급 1·2순위 적용", "shinhee": "신혼희망타운 별도 신청자격 적용",
    "unranked": "오피스텔·생활숙박시설은 아파트 1·2순위 적용 없음", "remainder": "무순위·임의공급은 아파트 1·2순위 적용 없음",
}


def classification(rows: DataFrame, operation: str, category: str) -> Column:
    """struct<housing_kind, verification>: by the detail code of apartments; officetels and lodgings have no such kind."""
    if operation == APT:
        kind = F.coalesce(lookup(HOUSING, F.trim(column(rows, "HOUSE_DTL_SECD"))), F.lit("unknown"))
    else:
        kind = F.when(reb_category(rows, category).isin(*UNRANKED), "not_applicable").otherwise("unknown")
    return F.struct(kind.alias("housing_kind"), F.when(kind != "unknown", "official").otherwise("unknown").alias("verification"))


def context(rows: DataFrame, operation: str) -> Column:
    """struct of the area's regulations; what only apartments publish is null elsewhere. A public-housing district isn't public housing."""
    flag = lambda name: yes_no(column(rows, name)) if operation == APT else F.lit(None).cast("boolean")
    return F.struct(
        flag("SPECLT_RDN_EARTH_AT").alias("speculation_zone"), flag("MDAT_TRGET_AREA_SECD").alias("subscription_overheated"), capital_region(column(rows, "SUBSCRPT_AREA_CODE_NM")).alias("capital_region"),
        lenient_date(column(rows, "RCRIT_PBLANC_DE")).alias("original_announcement_date"), flag("PUBLIC_HOUSE_EARTH_AT").alias("public_housing_district"),
        flag("PUBLIC_HOUSE_SPCLW_APPLC_AT").alias("public_housing_special_law"), flag("NPLN_PRVOPR_PUBLIC_HOUSE_AT").alias("capital_private_public_housing_district"),
    )


def is_ranked(rows: DataFrame, operation: str) -> Column:
    """Apartments with a reception by rank: one of the ranks' days can be read."""
    days = [column(rows, f"GNRL_RNK{rank}_{stem}_RCPTDE") for rank in (1, 2) for stem in REB_AUDIENCES]
    given = [lenient_date(x).isNotNull() for x in days]
    return reduce(or_, given) if operation == APT else F.lit(False)


def rank_applicability(rows: DataFrame, operation: str, category: str) -> Column:
    """struct<status, account_required, reason>, or null where neither ranks nor their absence is told."""
    apt, kind = operation == APT, reb_category(rows, category)
    shinhee = F.coalesce(column(rows, "HOUSE_DTL_SECD_NM").contains("신혼희망타운"), F.lit(False)) & F.lit(apt)
    why = F.when(is_ranked(rows, operation), "ranked").when(shinhee, "shinhee").when(kind.isin(*UNRANKED), "unranked").when(F.lit(category in REMAINDER), "remainder")
    account = F.when(F.lit(apt), True).when(kind.isin(*UNRANKED), False)
    whole = F.struct(F.when(why == "ranked", "applicable").otherwise("not_applicable").alias("status"), account.alias("account_required"), lookup(RANK_REASONS, why).alias("reason"))
    return F.when(why.isNotNull(), whole)


def application_method(rows: DataFrame, operation: str, category: str) -> Column:
    """apt_ranked or officetel; of remainders only a document tells the method."""
    return F.when(is_ranked(rows, operation), "apt_ranked").when(reb_category(rows, category) == "officetel", "officetel")


def metadata_rules(rows: DataFrame, operation: str, category: str) -> Column:
    """array<string>: the four as JSON objects with kind, effect and source; null fields and missing rules are left out."""
    told, rank, method = classification(rows, operation, category), rank_applicability(rows, operation, category), application_method(rows, operation, category)

    def rule(kind: str, *fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit("metadata").alias("effect"), F.lit("cheongyak_home").alias("source"), *fields))

    official = F.lit("official").alias("verification")
    return F.array_compact(F.array(
        rule("housing_classification", told["housing_kind"].alias("housing_kind"), told["verification"].alias("verification")),
        rule("qualification_context", context(rows, operation).alias("value"), official),
        F.when(rank.isNotNull(), rule("rank_applicability", rank["status"].alias("status"), rank["account_required"].alias("account_required"), rank["reason"].alias("reason"), official)),
        F.when(method.isNotNull(), rule("application_method", method.alias("value"), lenient_date(column(rows, "RCRIT_PBLANC_DE")).alias("criterion_date"), official)),
    ))


def reb_with_rules(details: DataFrame, operation: str, category: str) -> DataFrame:
    """feeds.reb with the rules that the details tell."""
    return reb(details, operation, category, rules=metadata_rules(details, operation, category))


def model_rules(details: DataFrame, models: DataFrame, category: str) -> DataFrame:
    """house_no, notice_no, offered, areas, fees: arrays of structs of the official inventory, exclusive areas and application fees.

    offered is null for rentals and where no count is published; areas hold models with an exclusive area, fees those of
    urban pairs with one, in won.
    """
    keys = ["house_no", "notice_no"]
    offered = reb_supplies(details, models, category).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("supply_type", "unit_type", "supply_count"))).alias("offered"))
    group, unit = first_usable(column(models, "GP")), reb_unit(models)
    named = F.when(group != unit, F.concat_ws(" ", group, unit)).otherwise(unit)
    area, fee = decimal_number(column(models, "EXCLUSE_AR")).cast("double"), manwon_to_krw(column(models, "SUBSCRPT_REQST_AMOUNT"))
    fee_unit = first_usable(column(models, "TP"), column(models, "HOUSE_TY"), column(models, "MODEL_NO"))
    rows = models.select(
        F.col("HOUSE_MANAGE_NO").alias("house_no"), F.col("PBLANC_NO").alias("notice_no"), F.when(area.isNotNull() & named.isNotNull(), F.struct(named.alias("unit_type"), area.alias("exclusive_area_sqm"))).alias("a"),
        F.when(F.lit(category == "urban") & fee.isNotNull() & fee_unit.isNotNull(), F.struct(fee_unit.alias("unit_type"), fee.alias("application_fee_krw"))).alias("f"),
    )
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("areas"), F.array_sort(F.collect_list("f")).alias("fees")).join(offered, keys, "left").select(*keys, "offered", "areas", "fees")
