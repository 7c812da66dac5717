"""Profiles of applicants: stored answers of every version as one schema, and what an edit leaves of former facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import profile_number
from noticeloom.operators.regions import resolve

# Answers by kind, what choices are known, the first version that holds an answer, and groups of facts.
TEXTS = ("movedInDate", "cityMovedInDate", "districtMovedInDate", "dateOfBirth", "marriageDate", "privateRankBaseDate", "nationalRankBaseDate")
MONEY = ("annualIncomeKrw", "monthlyIncomeKrw", "assetsKrw", "realEstateKrw", "vehicleKrw", "privateDepositKrw")
FLAGS = ("isHouseholdHead", "hasSpouse", "employed", "dualIncome", "hasChildren", "pregnant", "relocatedWorker", "ownershipFactsKnown", "householdMembersComplete")
CHOICES = {
    "accountType": ("unknown", "comprehensive", "savings", "deposit", "installment", "none"), "maritalStatus": ("unknown", "single", "married", "engaged", "divorced", "widowed"),
    "recommendationStatus": ("unknown", "none", "pending", "confirmed"), "citizenship": ("unknown", "korean", "foreign"),
}
OF_FIRST = ("region", "district", "movedInDate", "annualIncomeKrw", "assetsKrw")
SINCE = {"ownershipFactsKnown": 3, "householdMembersComplete": 4, "citizenship": 4}
NEWEST = 5
GROUPS = {
    "household": ("hasSpouse", "householdMembersComplete", "maritalStatus"), "household_head": ("isHouseholdHead",), "income": ("annualIncomeKrw", "monthlyIncomeKrw", "dualIncome"), "assets": ("assetsKrw", "realEstateKrw", "vehicleKrw"),
    "bank_private": ("accountType", "privateRankBaseDate", "privateDepositKrw"), "employment": ("employed", "relocatedWorker"), "marital": ("maritalStatus", "hasSpouse", "marriageDate"), "children": ("hasChildren",), "pregnancy": ("pregnant",),
}
FIELDS = (*TEXTS, *MONEY, *FLAGS, *CHOICES)


def migrated(stored: DataFrame, districts: DataFrame) -> DataFrame:
    """stored (profile_id, body: JSON of any version) -> profile_id, region_code, district_code, needs_review, FIELDS.

    An answer counts if it is of its kind and of a version that asked it; texts of a choice that isn't known are unknown,
    amounts are digits alone. The first version holds five answers. Unknown keys and other texts than JSON are dropped.
    """
    v = F.try_parse_json("body")
    version = F.coalesce(F.try_variant_get(v, "$.version", "int"), F.lit(1))
    version = F.when(version.between(2, NEWEST), version).otherwise(1)
    rows = stored.select("profile_id", v.alias("v"), version.alias("version"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    def asked(name: str, value: Column) -> Column:
        first = 1 if name in OF_FIRST else SINCE.get(name, 2)
        return F.when(F.col("version") >= first, value)

    def text(name: str) -> Column:
        return asked(name, F.when(kind(name) == "STRING", F.try_variant_get("v", f"$.{name}", "string")))

    columns = {x: F.coalesce(text(x), F.lit("")) for x in TEXTS}
    columns |= {x: profile_number(text(x)) for x in MONEY}
    columns |= {x: asked(x, F.when(kind(x) == "BOOLEAN", F.try_variant_get("v", f"$.{x}", "boolean"))) for x in FLAGS}
    columns |= {x: F.when(text(x).isin(*known), text(x)).otherwise("unknown") for x, known in CHOICES.items()}
    out = rows.select("profile_id", F.coalesce(text("region"), F.lit("")).alias("region"), F.coalesce(text("district"), F.lit("")).alias("district"), *[c.alias(x) for x, c in columns.items()])
    return resolve(out, "region", "district", districts).select("profile_id", "region_code", "district_code", "needs_review", *FIELDS)


def edited(profiles: DataFrame, edits: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """profiles (profile_id, FIELDS of GROUPS, as_of: map<group, date>), edits (profile_id, field, value) -> (profile_id, changed_groups, as_of),
    (profile_id, group, day, values): the snapshots that an edit takes.

    Values are texts. A group of which a field changes keeps its former values under the day for which they were confirmed,
    if there is one, and is confirmed for today; edits that change nothing do nothing.
    """
    fields = sorted({f for fs in GROUPS.values() for f in fs})
    old = profiles.select("profile_id", "as_of", F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("string") for f in fields])).alias("old"))
    new = edits.groupBy("profile_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "value")))).alias("new"))
    rows = old.join(new, "profile_id")
    moved = F.filter(F.map_keys("new"), lambda f: ~F.col("new")[f].eqNullSafe(F.col("old")[f]))
    touched = F.array_compact(F.array(*[F.when(F.arrays_overlap(moved, F.array(*map(F.lit, fs))), g) for g, fs in GROUPS.items()]))
    rows = rows.withColumn("changed_groups", F.coalesce(touched, F.expr("cast(array() as array<string>)")))
    fresh = F.map_from_arrays("changed_groups", F.transform("changed_groups", lambda _: today))
    kept = F.map_filter(F.coalesce("as_of", F.expr("cast(map() as map<string,date>)")), lambda g, _: ~F.array_contains("changed_groups", g))
    members = F.create_map(*[x for g, fs in GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, fs)))])
    snapshots = rows.select("profile_id", F.explode("changed_groups").alias("group"), "as_of", "old").withColumn("day", F.col("as_of")[F.col("group")]).filter("day IS NOT NULL")
    snapshots = snapshots.select("profile_id", "group", "day", F.map_filter("old", lambda f, _: F.array_contains(members[F.col("group")], f)).alias("values"))
    return rows.select("profile_id", "changed_groups", F.map_concat(kept, fresh).alias("as_of")), snapshots
