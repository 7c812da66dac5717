"""Households and homes of stored profiles: nested answers of every version as arrays of one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import profile_number

# What a member and a home hold, their choices, and the first version that asks for them.
MEMBER_TEXTS, MEMBER_FLAGS = ("dateOfBirth",), ("ownsHome", "previouslyOwnedHome")
MEMBER_CHOICES = {
    "relation": ("applicant_parent", "applicant_grandparent", "spouse_parent", "spouse_grandparent", "applicant_child", "applicant_grandchild", "descendant_spouse", "spouse_child", "spouse_grandchild", "sibling", "unrelated", "unknown"),
    "register": ("applicant", "spouse", "both", "separate", "unknown"),
}
HOME_TEXTS = ("ownerMemberId", "ownerDateOfBirth", "areaSqm", "valueAsOfDate", "propertyRegionCode", "acquiredDate", "disposedDate", "notificationDate", "buildingApprovalDate", "registerCorrectedDate", "tenantResidenceStartDate")
HOME_MONEY = ("officialValueKrw", "acquisitionPriceKrw")
HOME_FLAGS = (
    "inheritedShare", "ownedShare", "outsideUrbanArea", "inMyeon", "ownerPreviouslyResided", "movedToOtherConstructionArea", "firstRegisteredDomicile", "fromAscendantOrSpouse", "builderForSale", "saleCompleted",
    "individualBusinessRegistered", "employeeDormitoryUnderHousingAct", "governmentEmployeeHousingPolicy", "standardResidentialBuilding", "abandonedOrDestroyedOrNonResidential", "oldLawUnauthorized",
    "lawfulAtConstructionEvidence", "originalResidualFirstCome", "unpaidRentalDeposit", "auctionAcquisition", "firstEverAcquisition",
)
PROPERTIES = ("apartment", "detached", "multi_family", "row_house", "urban_small", "presale_right", "occupancy_right", "officetel", "unknown")
HOME_CHOICES = {
    "ownerRelation": ("applicant", "spouse", "ascendant", "spouse_ascendant", "descendant", "other", "unknown"), "propertyKind": PROPERTIES, "underlyingPropertyKind": PROPERTIES,
    "valueBasis": ("unknown", "annex1_official", "market"), "acquisitionMethod": ("unknown", "purchase", "inheritance", "gift", "construction", "auction", "first_come"),
}
HOMES_SINCE, MEMBERS_SINCE, NEWEST = 3, 4, 5
OWNERS = ("applicant", "spouse")  # of homes of the first version that asks for them


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _text(item: Column, name: str) -> Column:
    """A field that is a text, else null."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(_kind(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _flag(item: Column, name: str) -> Column:
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(item, f"$.{name}", "boolean"))


def _choice(item: Column, name: str, known: tuple[str, ...]) -> Column:
    text = _text(item, name)
    return F.when(text.isin(*known), text).otherwise("unknown")


def _entries(body: Column, name: str, of: Callable[[Column, Column], Column]) -> Column:
    """An array's entries that are objects, each as of(entry, place from 0); empty where there is no array."""
    raw = F.try_variant_get(body, f"$.{name}", "array<variant>")
    objects = F.filter(raw, lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False)))
    made = F.transform(objects, of)
    return F.coalesce(made, F.filter(F.transform(F.array(F.try_parse_json(F.lit("{}"))), lambda x: of(x, F.lit(0))), lambda _: F.lit(False)))


def _identity(item: Column, place: Column, prefix: str) -> Column:
    return F.coalesce(_text(item, "id"), F.concat(F.lit(prefix), (place + 1).cast("string"))).alias("id")


def member(item: Column, place: Column) -> Column:
    texts = [F.coalesce(_text(item, x), F.lit("")).alias(x) for x in MEMBER_TEXTS]
    return F.struct(_identity(item, place, "family-"), *[_choice(item, x, known).alias(x) for x, known in MEMBER_CHOICES.items()], *texts, *[_flag(item, x).alias(x) for x in MEMBER_FLAGS])


def home(version: Column) -> Callable[[Column, Column], Column]:
    """Homes of the first version don't name their owner, but by relation."""

    def made(item: Column, place: Column) -> Column:
        relation = _choice(item, "ownerRelation", HOME_CHOICES["ownerRelation"])
        owner = F.when(version == HOMES_SINCE, F.when(relation.isin(*OWNERS), relation).otherwise("")).otherwise(F.coalesce(_text(item, "ownerMemberId"), F.lit("")))
        texts = [(owner if x == "ownerMemberId" else F.coalesce(_text(item, x), F.lit(""))).alias(x) for x in HOME_TEXTS]
        choices = [_choice(item, x, known).alias(x) for x, known in HOME_CHOICES.items()]
        return F.struct(_identity(item, place, "property-"), *texts, *choices, *[profile_number(_text(item, x)).alias(x) for x in HOME_MONEY], *[_flag(item, x).alias(x) for x in HOME_FLAGS])

    return made


def rosters(stored: DataFrame) -> DataFrame:
    """stored (profile_id, body: JSON of any version) -> profile_id, members, homes: arrays of structs.

    A version that didn't ask for them has none, and so have bodies that are no object. Entries that are no objects go, and
    the others count on for the ids of those that have none. Unknown keys are dropped at every depth; a field of another type than
    its own is empty, a choice that isn't known is unknown, amounts are digits or null.
    """
    body = F.try_parse_json("body")
    version = F.try_variant_get(body, "$.version", "int")
    rows = stored.select("profile_id", body.alias("_b"), F.when(version.between(2, NEWEST), version).otherwise(1).alias("_v"))
    none = lambda column: F.filter(column, lambda _: F.lit(False))
    members, homes = _entries(F.col("_b"), "householdMembers", member), _entries(F.col("_b"), "ownershipFacts", home(F.col("_v")))
    rows = rows.withColumns({"_m": members, "_h": homes})
    return rows.select("profile_id", F.when(F.col("_v") >= MEMBERS_SINCE, F.col("_m")).otherwise(none(F.col("_m"))).alias("members"), F.when(F.col("_v") >= HOMES_SINCE, F.col("_h")).otherwise(none(F.col("_h"))).alias("homes"))
