"""Applicants: who belongs to the household, which homes count, where they live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import age_at
from noticeloom.operators.dealing import dealt

OTHERS = ("sibling", "unrelated")
SPOUSE_SIDE = ("spouse_parent", "spouse_grandparent", "spouse_child", "spouse_grandchild")
SPOUSE_DESCENDANTS = ("spouse_child", "spouse_grandchild")
FIRST_DAY = "2026-06-15"
NEW_CITIES = ("51", "52")


def belongs(relation: Column, register: Column, has_spouse: Column, same_register: Column) -> Column:
    """Whether a member is of the applicant's household by law; null where undecided.

    register: applicant, spouse or separate. The applicant and the spouse belong at any address. Of the spouse's own
    descendants those on the applicant's register belong, and on the spouse's if the spouses share one.
    """
    own = F.when(relation.isin("applicant", "spouse"), True).when(relation.isNull() | register.isNull(), None).when(relation.isin(*OTHERS) | (register == "separate"), False)
    needs_spouse = relation.isin(*SPOUSE_SIDE) | (register == "spouse")
    of_spouse = F.when(register == "applicant", True).when(register == "spouse", F.when(same_register, True).when(~same_register, False))
    rest = F.when(needs_spouse & ~F.coalesce(has_spouse, F.lit(False)), None).when(relation.isin(*SPOUSE_DESCENDANTS), of_spouse).otherwise(True)
    return F.when(relation.isin("applicant", "spouse") | relation.isNull() | register.isNull() | relation.isin(*OTHERS) | (register == "separate"), own).otherwise(rest)


def households(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """members (profile_id, member_id, relation, register), profiles (profile_id, on_register, has_spouse, same_register, roster_complete)
    -> profile_id, size, complete: size counts the applicant; null while anything that decides it is open."""
    rows = dealt(members, "profile_id").join(profiles.select("profile_id", "has_spouse", "same_register"), "profile_id")
    rows = rows.withColumn("inside", belongs(F.col("relation"), F.col("register"), F.col("has_spouse"), F.col("same_register")))
    folded = rows.groupBy("profile_id").agg(
        F.count(F.when(F.col("inside") & (F.col("relation") != "applicant"), 1)).alias("others"), F.bool_or(F.col("inside").isNull() | (F.trim(F.coalesce("member_id", F.lit(""))) == "")).alias("open"),
        (F.count("member_id") != F.count_distinct("member_id")).alias("twice"), F.bool_or(F.col("relation") == "spouse").alias("listed"),
    )
    out = profiles.join(folded, "profile_id", "left")
    sure = F.coalesce(F.col("on_register") & F.col("roster_complete") & F.col("has_spouse").isNotNull(), F.lit(False)) & ~F.coalesce(F.col("open") | F.col("twice"), F.lit(False))
    sure = sure & (F.col("has_spouse") | ~F.coalesce("listed", F.lit(False)))
    return out.select("profile_id", F.when(sure, F.coalesce("others", F.lit(0)) + 1).cast("int").alias("size"), sure.alias("complete"))


def uncounted(home: dict[str, Column], day: Column) -> list[Column]:
    """The statutory clauses by which a home does not count, in order, each three-valued."""
    c, area, price, kind, capital = home, home["area_sqm"], home["price_krw"], home["kind"], home["capital"]
    rights = kind == "right"
    rental, elder = F.coalesce(c["public_rental"], F.lit(False)), F.coalesce(c["elder_supply"], F.lit(False))
    cap = lambda inside, outside: price <= F.when(capital, inside).otherwise(F.when(capital.isNotNull(), outside))
    small = F.when(kind == "apartment", (area <= 60) & cap(160_000_000, 100_000_000)).otherwise((area <= 85) & cap(500_000_000, 300_000_000))
    rural = ~capital & c["rural_detached"] & c["lived_and_moved"] & ((c["age_years"] >= 20) | (area <= 85) | c["first_domicile_inherited"])
    return [
        c["inherited_share"] & (c["disposed_on"] <= F.add_months(c["noticed_on"], 3)) & (c["disposed_on"] <= day),
        rural,
        c["developer"] & (c["sale_completed"] | (c["disposed_on"] <= F.add_months(c["noticed_on"], 3))),
        c["dormitory"] | c["policy_home"],
        c["only_home"] & (area <= 20),
        F.when(elder | rental, False).otherwise(c["ascendant"] & (age_at(c["owner_birth"], day) >= 60)),
        F.when(rights, False).otherwise(c["gone_or_other_use"] & (c["corrected_on"] <= F.add_months(c["noticed_on"], 3))),
        F.when(rights, False).otherwise(c["unauthorised_old"] & c["lawful_evidence"]),
        F.when(rental, False).otherwise(c["only_home"] & small),
        c["residual_right_first"],
        F.when(rental, False).otherwise(c["auction_of_own_rental"] & (area <= 85) & cap(300_000_000, 150_000_000)),
        F.when(kind == "apartment", False).otherwise(c["first_home_2024"] & (area <= 60) & cap(300_000_000, 200_000_000) & (c["tenant_months"] >= 12)),
    ]


def counts_as_home(home: dict[str, Column], day: Column) -> Column:
    """Whether a home counts at a day: false by the first clause that holds, null where one is open, else true.

    Officetels and homes bought later or sold before don't count; days before the rules' first are undecided.
    """
    clauses = uncounted(home, day)
    held, open_ = F.lit(False), F.lit(False)
    for x in clauses:
        held, open_ = held | F.coalesce(x, F.lit(False)), open_ | x.isNull()
    judged = F.when(held, False).when(open_ | home["area_sqm"].isNull() | home["acquired_by"].isNull(), None).otherwise(True)
    return (
        F.when(day.isNull() | (day < F.lit(FIRST_DAY).cast("date")), None).when(home["kind"] == "officetel", False).when(home["kind"].isNull() | home["relation"].isNull(), None)
        .when(home["acquired_on"].isNull(), None).when(home["acquired_on"] > day, False).when(home["disposed_on"] <= F.least(day, home["today"]), False).otherwise(judged)
    )


def children_under(births: Column, day: Column, months: int, expected: Column) -> Column:
    """How many children are born by a day and younger than `months` months at it, expected ones included; null births are unknown."""
    young = F.size(F.filter(births, lambda b: (F.add_months(b, months) > day) & (b <= day)))
    return F.when(births.isNotNull(), young + F.coalesce(expected, F.lit(0)))


def homeless(homes: DataFrame, profiles: DataFrame, counted: Column) -> DataFrame:
    """profile_id, homeless: false with a home that counts, null while one is undecided, else true (also without homes)."""
    rows = homes.withColumn("_c", counted).groupBy("profile_id").agg(F.bool_or("_c").alias("some"), F.bool_or(F.col("_c").isNull()).alias("open"))
    out = profiles.select("profile_id").join(rows, "profile_id", "left")
    return out.select("profile_id", F.when(F.col("some"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True).alias("homeless"))


def region_match(home_province: Column, home: Column, home_parent: Column, home_since: Column, target_province: Column, target: Column, target_parent: Column, target_since: Column, announced: Column) -> Column:
    """Whether an applicant's district is in a notice's region: another province no, the whole province yes; a district newer than the
    notice, or a part of the home city, null; else the same district or the city that it is a part of."""
    whole = target.isNull() | (target == target_province) | (target_province == "36")
    new_home = (home_since > announced) & home_parent.isNull() & ~home_province.isin(*NEW_CITIES)
    return (
        F.when(home_province.isNull() | target_province.isNull(), None).when(new_home, None).when(home_province != target_province, False).when(whole, True)
        .when(home.isNull(), None).when(target_since > announced, None).when(F.coalesce(target_parent == home, F.lit(False)), None)
        .otherwise((home == target) | F.coalesce(home_parent == target, F.lit(False)))
    )
