"""Regions: codes and names as provinces and districts, homes in scopes, and what part of an allocation a person is in.

The catalogue of districts is a table that a caller brings: code, name, province_code, parent_code (the city of an
ordinary district, or null) and valid_from. Provinces, with the names that they go by, are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import compact

# Provinces by code, the official name first. Renames keep a province's identity; a merger doesn't.
PROVINCES = {
    "11": ("서울특별시", "서울"), "12": ("전남광주통합특별시",), "26": ("부산광역시", "부산"), "27": ("대구광역시", "대구"), "28": ("인천광역시", "인천"), "30": ("대전광역시", "대전"),
    "31": ("울산광역시", "울산"), "36": ("세종특별자치시", "세종시", "세종"), "41": ("경기도", "경기"), "43": ("충청북도", "충북"), "44": ("충청남도", "충남"), "47": ("경상북도", "경북"),
    "48": ("경상남도", "경남"), "50": ("제주특별자치도", "제주도", "제주"), "51": ("강원특별자치도", "강원도", "강원"), "52": ("전북특별자치도", "전라북도", "전북"),
}
#: Names of several regions, names of all of a province, provinces that a merger has ended.
SEVERAL, ALL, ENDED = r"[,/·]|또는|및|부터|까지", ("", "전체", "전지역"), r"^(?:광주광역시|전라남도|전남)|^광주$"
#: A province without districts of its own; provinces whose renaming dates nothing; the merged one and its first day.
WHOLE, RENAMED, MERGED, MERGED_FROM = "36", ("51", "52"), "12", "2026-07-01"
GYEONGGI = "41"
CATALOGUE_ROWS = 10_000
PLACE = "struct<province:string,district:string,parent:string,valid_from:date>"


def province_code(name: Column) -> Column:
    """The code of a province's name or short name, spaces aside; else null."""
    out = F.lit(None).cast("string")
    for code, names in PROVINCES.items():
        out = F.when(compact(name).isin(*names), code).otherwise(out)
    return out


def province_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, names in PROVINCES.items() for x in (c, names[0])]), code)


def code_identity(code: Column) -> Column:
    """A 2-digit province or 5-digit district code of codes of 2, 5 and 10 digits; null for parts of districts and other texts."""
    plain = F.trim(code)
    ten = F.when(plain.rlike(r"^\d{2}0{8}$"), F.substring(plain, 1, 2)).when(plain.rlike(r"^\d{5}0{5}$"), F.substring(plain, 1, 5))
    plain = F.when(plain.rlike(r"^\d{10}$"), ten).otherwise(plain)
    return F.when(plain.rlike(r"^\d{2}000$"), F.substring(plain, 1, 2)).when(plain.rlike(r"^\d{2}$|^\d{5}$"), plain)


def name_identity(name: Column) -> Column:
    """struct<province, tail>: the province whose longest name a text begins with (null: none) and the rest, or null for
    empty texts, texts of several regions and provinces that a merger has ended."""
    plain = compact(name)
    province, tail = F.lit(None).cast("string"), plain
    for alias, code in sorted(((a, c) for c, names in PROVINCES.items() for a in names), key=lambda x: len(x[0])):
        starts = plain.startswith(alias)
        province, tail = F.when(starts, code).otherwise(province), F.when(starts, F.substring(plain, len(alias) + 1, 200)).otherwise(tail)
    whole = F.struct(province.alias("province"), tail.alias("tail"))
    ended = province.isNull() & plain.rlike(ENDED)
    return F.when((plain != "") & ~plain.rlike(SEVERAL) & ~ended, whole)


def _catalogue(districts: DataFrame) -> DataFrame:
    """The catalogue, sent to every executor up to CATALOGUE_ROWS rows, else joined by a shuffle."""
    return F.broadcast(districts) if districts.count() <= CATALOGUE_ROWS else districts


def _place(province: Column, prefix: str) -> Column:
    return F.struct(province.alias("province"), F.col(f"{prefix}code").alias("district"), F.col(f"{prefix}parent_code").alias("parent"), F.col(f"{prefix}valid_from").alias("valid_from"))


def by_code(rows: DataFrame, column: str, districts: DataFrame, out: str) -> DataFrame:
    """rows with `out` (PLACE): the province or district of a code column, or null."""
    d = _catalogue(districts.select(*[F.col(c).alias(f"_d_{c}") for c in ("code", "province_code", "parent_code", "valid_from")]))
    rows = rows.withColumn("_code", code_identity(F.col(column)))
    rows = rows.join(d, F.col("_code") == F.col("_d_code"), "left")
    province = F.when(F.col("_d_code").isNotNull(), F.col("_d_province_code")).when(F.col("_code").isin(*PROVINCES), F.col("_code"))
    return rows.withColumn(out, F.when(province.isNotNull(), _place(province, "_d_"))).drop("_code", *[f"_d_{c}" for c in ("code", "province_code", "parent_code", "valid_from")])


def by_name(rows: DataFrame, column: str, home_province: Column, districts: DataFrame, out: str) -> DataFrame:
    """rows with `out` (PLACE): the province, or the one district of that name in the named or home province, or null."""
    named = districts.groupBy(F.col("province_code").alias("_n_province"), compact(F.col("name")).alias("_n_name")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_n_{c}") for c in ("code", "parent_code", "valid_from")]
    )
    rows = rows.withColumn("_id", name_identity(F.col(column))).withColumn("_p", F.coalesce("_id.province", home_province))
    rows = rows.join(_catalogue(named.filter("_n = 1")), (F.col("_p") == F.col("_n_province")) & (F.col("_id.tail") == F.col("_n_name")), "left")
    whole = F.col("_id.province").isNotNull() & F.col("_id.tail").isin(*ALL)
    nothing = [F.lit(None).cast(x).alias(n) for n, x in (("district", "string"), ("parent", "string"), ("valid_from", "date"))]
    found = F.when(whole, F.struct(F.col("_id.province").alias("province"), *nothing)).when(F.col("_n").isNotNull(), _place(F.col("_p"), "_n_"))
    return rows.withColumn(out, found).drop("_id", "_p", "_n", "_n_province", "_n_name", "_n_code", "_n_parent_code", "_n_valid_from")


def resolve(rows: DataFrame, region: str, district: str, districts: DataFrame) -> DataFrame:
    """rows with region_code, district_code, needs_review, for names that older profiles hold.

    A district that isn't exactly one of its province's needs a review, as do names of no province; empty names don't.
    """
    rows = rows.withColumn("region_code", province_code(F.col(region)))
    named = districts.groupBy(F.col("province_code").alias("_province"), compact(F.col("name")).alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("code").alias("district_code"))
    own = F.nullif(compact(F.coalesce(district, F.lit(""))), F.lit(""))
    rows = rows.join(_catalogue(named.filter("_n = 1")), (F.col("region_code") == F.col("_province")) & (own == F.col("_name")), "left")
    blank = F.coalesce(F.trim(region), F.lit("")) == ""
    review = F.when(F.col("region_code").isNull(), ~blank | own.isNotNull()).otherwise(own.isNotNull() & F.col("district_code").isNull())
    return rows.withColumn("needs_review", review).drop("_province", "_name", "_n")


def district_options(districts: DataFrame, province: str, ordinary: bool = False) -> DataFrame:
    """code, name, parent_code of a province's districts; the ordinary districts of a city only where asked."""
    rows = districts.filter(F.col("province_code") == province)
    return (rows if ordinary else rows.filter("parent_code IS NULL")).select("code", "name", "parent_code")


def province_options(spark) -> DataFrame:
    return spark.createDataFrame([(c, names[0]) for c, names in PROVINCES.items()], "code string, name string")


def within(inner: Column, outer: Column) -> Column:
    """Whether a place's district is another's, or in that city."""
    return (inner["district"] == outer["district"]) | F.coalesce(inner["parent"] == outer["district"], F.lit(False))


def matches_scope(home: Column, coded: Column, named: Column, has_code: Column, has_name: Column, day: Column) -> Column:
    """Whether a home (PLACE) lies in a scope given by code, name or both (PLACE each); null: geography doesn't tell.

    A name that isn't understood is never widened by a code. On a day before a district was there, or before a merger,
    nothing is told; but a new district's city tells what it told before.
    """
    both = coded.isNotNull() & named.isNotNull()
    two = both & coded["district"].isNotNull() & named["district"].isNotNull()
    apart = both & ((coded["province"] != named["province"]) | F.coalesce(two & ~within(named, coded) & ~within(coded, named), F.lit(False)))
    target = F.when(two, F.when(within(coded, named), coded).otherwise(named)).when(F.coalesce(named["district"].isNotNull(), F.lit(False)), named).otherwise(F.coalesce(coded, named))
    unknown = (~has_code & ~has_name) | (has_name & named.isNull()) | (has_code & coded.isNull() & named.isNull()) | apart | target.isNull() | home["province"].isNull()
    new_home = (day < home["valid_from"]) & ~home["province"].isin(*RENAMED)
    before_merger = (target["province"] == MERGED) & (day < F.lit(MERGED_FROM).cast("date"))
    new_target = (day < target["valid_from"]) & ~target["province"].isin(*RENAMED)
    return (
        F.when(F.coalesce(unknown | (new_home & home["parent"].isNull()) | before_merger, F.lit(False)), None)
        .when(target["province"] != home["province"], False).when(target["district"].isNull() | (target["province"] == WHOLE), True)
        .when(home["district"].isNull() | F.coalesce(new_target, F.lit(False)) | F.coalesce(target["parent"] == home["district"], F.lit(False)), None)
        .otherwise(within(home, target))
    )


def region_decision(admitted: Column, missing_input: Column, divided: Column, local: Column, other_gyeonggi: Column) -> Column:
    """One of outside, missing_input, source_gap, not_divided, local, other_gyeonggi, other.

    admitted: pass, fail or review of the applicants' region, null without an official scope; missing_input: whether a
    review waits for the profile; divided: false where no local part is told apart; local: array of pass, fail, review or
    missing of the local part's rules, null or empty where none is known; other_gyeonggi: whether that part has the home.
    """
    has = lambda x: F.array_contains(local, x)
    return (
        F.when(admitted == "fail", "outside").when(admitted == "review", F.when(missing_input, "missing_input").otherwise("source_gap")).when(admitted.isNull(), "source_gap")
        .when(~F.coalesce(divided, F.lit(True)), "not_divided").when(F.coalesce(F.size(local), F.lit(0)) <= 0, "source_gap")
        .when(has("missing"), "missing_input").when(has("review"), "source_gap").when(F.forall(local, lambda x: x == "pass"), "local")
        .when(F.coalesce(other_gyeonggi, F.lit(False)), "other_gyeonggi").otherwise("other")
    )


def residence_area(
    decision: Column, admitted: Column, override: Column, scope_complete: Column, home_province: Column, needs_review: Column, local_matches: Column, local_provinces: Column, durations: Column,
    other_gyeonggi: Column, explicit_other: Column,
) -> Column:
    """local, other, other_gyeonggi or unknown, for results and priority days.

    decision: region_decision; override: the area that a person has chosen; scope_complete: whether the official scope is
    whole, so that the decision holds; else the local rules: whether each has the home (null: untold), its province, and
    whether its duration is met. Local rules that disagree or span provinces tell nothing.
    """
    matches = F.array_distinct(local_matches)
    same = (F.size(matches) == 1) & ~F.exists(matches, lambda x: x.isNull()) & (F.size(F.array_distinct(local_provinces)) == 1) & ~F.exists(local_provinces, lambda x: x.isNull())
    inside = F.coalesce(F.try_element_at(matches, F.lit(1)), F.lit(False))
    gyeonggi = (home_province == GYEONGGI) & F.coalesce(other_gyeonggi, F.lit(False))
    return (
        F.when((decision == "outside") | F.coalesce(admitted == "fail", F.lit(False)), "unknown").when(override.isNotNull(), override)
        .when(F.coalesce(scope_complete, F.lit(False)), F.when(decision.isin("local", "other", "other_gyeonggi"), decision).otherwise("unknown"))
        .when(home_province.isNull() | F.coalesce(needs_review, F.lit(False)) | F.coalesce(admitted == "review", F.lit(False)), "unknown")
        .when(~F.coalesce(same, F.lit(False)), "unknown").when(inside & F.forall(durations, lambda x: F.coalesce(x, F.lit(False))), "local").when(inside & F.exists(durations, lambda x: x.isNull()), "unknown")
        .when(F.coalesce(admitted == "pass", F.lit(False)), F.when(gyeonggi, "other_gyeonggi").otherwise("other")).when(F.coalesce(explicit_other, F.lit(False)), "other").when(gyeonggi, "other_gyeonggi").otherwise("unknown")
    )


def at_criterion(profiles: DataFrame, snapshots: DataFrame, day: str, fields: list[str]) -> DataFrame:
    """profiles (profile_id, fields, `day`) with the fields as they were saved for that very day; without such a snapshot as they are.

    A profile's snapshot is taken whole: a field that it leaves empty is empty. Of several for a day the last saved counts.
    """
    saved = snapshots.groupBy("profile_id", F.col("criterion_date").alias(day)).agg(F.max_by(F.struct(*fields), "saved_at").alias("_saved"))
    rows = profiles.join(saved, ["profile_id", day], "left")
    return rows.withColumns({f: F.when(F.col("_saved").isNotNull(), F.col(f"_saved.{f}")).otherwise(F.col(f)) for f in fields}).drop("_saved")


def residence_start(district_scope: Column, parent_in_scope: Column, moved: Column, moved_city: Column, moved_district: Column) -> Column:
    """The day from which residence in a scope counts: of the province, of the city where the scope is the home's city, else of the district."""
    return F.when(~district_scope, moved).when(F.coalesce(parent_in_scope, F.lit(False)), moved_city).otherwise(moved_district)


def residence_review(day: Column, district_scope: Column, province_match: Column, parent_match: Column, moved: Column, moved_city: Column, moved_district: Column) -> Column:
    """Why a home at a criterion day can't be told from today's: no_date, changed, moved, moved_city or moved_district (not entered), or null.

    parent_match: whether the home's city (null: it has none) is in the scope. A province outside the scope since before the day
    already excludes, as does a city; then moving within it changes nothing.
    """
    stable = F.coalesce(district_scope & ~province_match & (moved <= day), F.lit(False))
    stable_city = F.coalesce(district_scope & ~stable & ~parent_match & (moved_city <= day), F.lit(False))
    late = lambda x: F.coalesce(x > day, F.lit(False))
    inner = district_scope & ~stable
    own = residence_start(district_scope, parent_match, moved, moved_city, moved_district)
    changed = late(moved) | (inner & parent_match.isNotNull() & late(moved_city)) | (inner & ~stable_city & late(own))
    field = F.when(~district_scope, "moved").when(F.coalesce(parent_match, F.lit(False)), "moved_city").otherwise("moved_district")
    return F.when(day.isNull(), "no_date").when(changed, "changed").when(~stable & ~stable_city & own.isNull(), field)
