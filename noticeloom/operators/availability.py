"""From judged combinations to what can still be applied for: events, result rows and units; special supplies; counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import compact, unit_key
from noticeloom.operators.consensus import status_of
from noticeloom.operators.dealing import dealt
from noticeloom.operators.listing import is_reception, reception_overlaps

# Wordings of events, supplies and audiences.
PRIORITY_KIND, PRIORITY_LABEL, SPECIAL = r"(?i)first|second|priority|general", r"[12]순위|일반공급", r"special|특별"
GENERAL = r"^\s*일반(?:\s*공급)?\s*$"
AUDIENCES = (("other_gyeonggi", r"기타경기"), ("other", r"기타지역|타지역"), ("local", r"해당지역|당해지역"))
SPECIAL_TYPES = (
    ("newborn", r"신생아|newborn"), ("newlywed", r"신혼|newlywed"), ("first_home", r"생애최초|first.?home"), ("multi_child", r"다자녀|multi.?child"), ("elder_parent", r"노부모|elder.?parent"),
    ("institution", r"기관추천|institution"), ("young", r"청년|young"), ("relocation", r"이전기관|relocation"),
)
#: Kinds of rules of which a special supply's rules have one at least; without it something of it isn't known yet.
EXPECTED = {
    "newlywed": ("marital_status", "marriage_months_max"), "newborn": ("newborn_children_min",), "first_home": ("never_owned_home",), "multi_child": ("children_min",),
    "elder_parent": ("parent_age_min", "parent_support_months_min"), "institution": ("recommendation",), "young": ("age_min", "age_max"), "relocation": ("relocated_worker",),
}
NOT_ACTIONABLE = ("source_gap", "unverified", "selection")
COMPARED = {"mismatch": "내 조건으로 신청 불가", "possible": "내 조건과 일치", "missing": "추가 입력 %d개", "passed": "확인한 %d개 조건 충족", "nothing": "모집 정보"}
INVALIDATED = r"공고 변경|정정|근거.*무효"


def is_general(supply: Column) -> Column:
    return F.coalesce(supply.rlike(GENERAL), F.lit(False))


def is_priority(event: Column) -> Column:
    """Events (struct<kind, label, audience>) of general supply by rank."""
    return F.coalesce(event["kind"].rlike(PRIORITY_KIND), F.lit(False)) | F.concat_ws(" ", event["label"], event["audience"]).rlike(PRIORITY_LABEL)


def is_special(event: Column) -> Column:
    return F.concat_ws(" ", event["kind"], event["label"]).rlike(SPECIAL)


def audience_area(event: Column) -> Column:
    """The area that an event's audience or label names, or null."""
    words, out = F.concat_ws(" ", event["audience"], event["label"]), F.lit(None).cast("string")
    for area, pattern in reversed(AUDIENCES):
        out = F.when(words.rlike(pattern), area).otherwise(out)
    return out


def special_type(supply: Column) -> Column:
    plain, out = F.lower(compact(supply)), F.lit("other")
    for name, pattern in reversed(SPECIAL_TYPES):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def event_unavailable(event: Column, area: Column, all_general_closed: Column, combinations: Column, inventory_known: Column, common: Column) -> Column:
    """Whether an event is of no use to an applicant; what isn't known never makes it so.

    Another area's event; a general event when all general supply has closed; an event all of whose combinations
    (array<struct<supply_type, status>>, those that a special event names where it names some) are mismatches, of special
    events only where named or with a known inventory; else whether the common rules are a mismatch. A special event
    without combinations stays open.
    """
    special, general = is_special(event), is_priority(event)
    named_area = audience_area(event)
    own = F.filter(combinations, lambda c: F.when(general, is_general(c["supply_type"])).when(special, ~is_general(c["supply_type"]) & c["supply_type"].isNotNull()).otherwise(True))
    named = F.filter(own, lambda c: special & event["label"].contains(F.regexp_replace(c["supply_type"], r"\s*특별공급$", "")))
    outcomes = F.when(F.size(named) > 0, named).otherwise(own)
    all_fail = (F.size(outcomes) > 0) & F.forall(outcomes, lambda c: c["status"] == "mismatch")
    elsewhere = named_area.isNotNull() & (area != "unknown") & (named_area != area)
    return F.coalesce(
        F.when(elsewhere | (general & all_general_closed), True).when((~special | (F.size(named) > 0) | inventory_known) & all_fail, True)
        .when(special & (F.size(outcomes) == 0), False).otherwise(common == "mismatch"), F.lit(False),
    )


def row_unavailable(unit: Column, supply: Column, closed_units: Column, status: Column) -> Column:
    """Whether a result row's unit is closed to the applicant (general supply) or its combination is a mismatch; rows of
    special supply as a whole, and of none, say nothing of a combination."""
    closed = is_general(supply) & F.exists(closed_units, lambda u: unit_key(u) == unit_key(unit))
    generic = supply.isNull() | supply.rlike(r"(?i)^(?:특별공급|special)$")
    return F.coalesce(closed | (~generic & (status == "mismatch")), F.lit(False))


def units_unavailable(judged: DataFrame) -> DataFrame:
    """judged (profile_id, notice_id, unit_type or null for all units, status) -> profile_id, notice_id, unit, unavailable: all of a
    unit's combinations, those of all units included, are mismatches."""
    keys = ["profile_id", "notice_id"]
    rows = judged.withColumn("unit", unit_key(F.col("unit_type")))
    n, bad = F.count(F.lit(1)), F.count(F.when(F.col("status") == "mismatch", 1))
    own = rows.filter("unit IS NOT NULL").groupBy(*keys, "unit").agg(n.alias("n"), bad.alias("bad"))
    every = rows.filter("unit IS NULL").groupBy(*keys).agg(n.alias("all_n"), bad.alias("all_bad"))
    out = own.join(every, keys, "left")
    return out.select(*keys, "unit", (F.col("n") + F.coalesce("all_n", F.lit(0)) == F.col("bad") + F.coalesce("all_bad", F.lit(0))).alias("unavailable"))


def event_open(event: Column, area: Column, state: Column, complete: Column, units: Column, first_rank_units: Column, closed_units: Column) -> Column:
    """False for a general event once every listed unit has closed to an applicant of another area who is of the first rank in it."""
    shut = lambda u: F.array_contains(F.transform(first_rank_units, unit_key), unit_key(u)) & F.array_contains(F.transform(closed_units, unit_key), unit_key(u))
    all_closed = (area == "other") & (state == "ok") & complete & (F.size(units) > 0) & F.forall(units, shut)
    return ~F.coalesce(all_closed & is_priority(event), F.lit(False))


def historical_valid(state: Column, invalidated: Column, message: Column) -> Column:
    """Whether earlier results still hold: no correction has invalidated them; a failed retry doesn't."""
    pending = (state == "pending") & F.coalesce(message, F.lit("")).rlike(INVALIDATED)
    return ~F.coalesce(F.coalesce(invalidated, F.lit(False)) | pending, F.lit(False))


def historical_decisions(results: DataFrame, closed: DataFrame, others: DataFrame) -> DataFrame:
    """results (notice_id, unit_type, supply_type, verification), closed (notice_id, unit), others (notice_id, special: offers or receives
    special supply) -> notice_id, closed_units, all_general_closed, all_closed: for applicants of other areas, whatever their rank."""
    rows = results.filter("verification = 'official'").withColumn("unit", unit_key(F.col("unit_type"))).withColumn("general", is_general(F.col("supply_type")))
    rows = rows.join(closed.select("notice_id", "unit", F.lit(True).alias("shut")), ["notice_id", "unit"], "left")
    own = rows.groupBy("notice_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("general") & F.col("shut"), F.col("unit")))).alias("closed_units"),
        F.coalesce(F.bool_and(F.when(F.col("general"), F.coalesce("shut", F.lit(False)))), F.lit(False)).alias("all_general_closed"), F.bool_and("general").alias("only_general"),
    )
    own = own.join(others.groupBy("notice_id").agg(F.bool_or("special").alias("special")), "notice_id", "left")
    return own.select("notice_id", "closed_units", "all_general_closed", (F.col("all_general_closed") & F.col("only_general") & ~F.coalesce("special", F.lit(False))).alias("all_closed"))


def special_diagnoses(offered: DataFrame, results: DataFrame, certified: DataFrame) -> DataFrame:
    """offered (notice_id, supply_type), results (profile_id, notice_id, supply_type or null for all, kind, result), certified (notice_id,
    supply_type) -> profile_id, notice_id, supply_type, type, status of each special supply that is offered.

    A supply whose rules hold none of the kinds that its type has, and whose scope nobody has certified, is to review.
    """
    # What is offered and what is certified of it are grouped together, so that a notice's rows are dealt out once.
    said = offered.select("notice_id", "supply_type", F.lit(False).alias("sure")).unionByName(certified.select("notice_id", "supply_type", F.lit(True).alias("sure")))
    said = dealt(said.filter(~is_general(F.col("supply_type"))), "notice_id").groupBy("notice_id", "supply_type")
    rows = said.agg(F.bool_or("sure").alias("sure"), F.bool_or(~F.col("sure")).alias("offered")).filter("offered").withColumn("type", special_type(F.col("supply_type")))
    rows = rows.withColumn("sure", F.col("sure") & F.col("supply_type").isNotNull())
    own = dealt(results.select("profile_id", "notice_id", F.col("supply_type").alias("scope"), "kind", "result"), "notice_id")
    rows = rows.join(own, "notice_id").filter(F.col("scope").isNull() | (F.col("scope") == F.col("supply_type")))
    typical = F.lit(False)
    for name, kinds in EXPECTED.items():
        typical = F.when(F.col("type") == name, F.col("kind").isin(*kinds)).otherwise(typical)
    out = rows.groupBy("profile_id", "notice_id", "supply_type", "type").agg(status_of(F.col("result")).alias("status"), (F.bool_or(typical) | F.coalesce(F.max("sure"), F.lit(False))).alias("known"))
    return out.select("profile_id", "notice_id", "supply_type", "type", F.when((F.col("status") == "possible") & ~F.col("known"), "review").otherwise(F.col("status")).alias("status"))


def grouped_units(rows: DataFrame, *outcome: str) -> DataFrame:
    """rows (profile_id, notice_id, unit_type, outcome columns) -> one row for each outcome with its units: ranks, comparisons or
    regional decisions that units share."""
    return rows.groupBy("profile_id", "notice_id", *outcome).agg(F.array_sort(F.collect_set("unit_type")).alias("units"))


def unit_ranks(prices: DataFrame, ranks: DataFrame) -> DataFrame:
    """prices (notice_id, unit_type), ranks (profile_id, notice_id, unit_type or null for all, rank) -> profile_id, notice_id, unit_type, rank
    of each distinct unit: the unit's own rank, else the notice's."""
    units = prices.filter("unit_type IS NOT NULL AND unit_type <> ''").select("notice_id", "unit_type").distinct()
    keys = ["profile_id", "notice_id"]
    whole = ranks.filter("unit_type IS NULL").groupBy(*keys).agg(F.min("rank").alias("whole"))
    own = ranks.filter("unit_type IS NOT NULL").groupBy(*keys, "unit_type").agg(F.min("rank").alias("own"))
    people = ranks.select(*keys).distinct()
    rows = people.join(units, "notice_id").join(whole, keys, "left").join(own, [*keys, "unit_type"], "left")
    return rows.select(*keys, "unit_type", F.coalesce("own", "whole").alias("rank"))


def distinct_reasons(reasons: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """One row for each content of a key: the place of the first, the other columns of the last."""
    rest = [c for c in reasons.columns if c not in (*keys, *content, "pos")]
    return reasons.groupBy(*keys, *content).agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("_last")).select(*keys, *content, "pos", *[f"_last.{c}" for c in rest])


def actionable(reasons: DataFrame) -> DataFrame:
    """Reasons without those that an applicant can't act on: gaps of the source, unverified ones and choices of a type."""
    return reasons.filter(~F.coalesce(F.col("category").isin(*NOT_ACTIONABLE), F.lit(False)))


def compared_label(status: Column, n_missing: Column, n_passed: Column) -> Column:
    """What a card says of a comparison: no, yes, how many answers are missing, how many conditions hold, or nothing."""
    return (
        F.when(status == "mismatch", COMPARED["mismatch"]).when(status == "possible", COMPARED["possible"]).when(n_missing > 0, F.format_string(COMPARED["missing"], n_missing))
        .when(n_passed > 0, F.format_string(COMPARED["passed"], n_passed)).otherwise(COMPARED["nothing"])
    )


def results_summary(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """decisions (notice_id, closed_units, all_closed), results (notice_id, verification) -> one row: notices and official rows shown (of
    notices that have some), notices closed as a whole, distinct closed units."""
    own = results.filter("verification = 'official'").groupBy("notice_id").agg(F.count(F.lit(1)).alias("n"))
    rows = decisions.join(own, "notice_id", "left")
    units = F.size(F.array_distinct(F.transform("closed_units", unit_key)))
    return rows.agg(
        F.count("n").alias("notices"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("all_closed"), 1)).alias("unavailable_notices"),
        F.coalesce(F.sum(F.when(units > 0, units)), F.lit(0)).cast("long").alias("unavailable_units"),
    )


def candidate_event(event: Column, admitted: Column, area: Column, local: Column, period: Column, priority_rule: Column, priority_period: Column, names: Column) -> Column:
    """Whether an event is one for a resident: by the area that it names, else by the region's name in its wording.

    admitted: pass, or null without an official scope; anything else is no candidate. period, priority_period: whether
    durations are met, null untold. A local resident who misses the priority's duration may apply with other regions.
    """
    words = F.concat_ws(" ", event["audience"], event["label"], event["kind"])
    allowed = F.coalesce(period, F.lit(True))
    alternative = local & priority_rule & ~F.coalesce(priority_period, F.lit(False))
    named = audience_area(F.struct(event["audience"].alias("audience"), F.concat_ws(" ", event["label"], event["kind"]).alias("label")))
    found = (
        F.when(named == "other_gyeonggi", area == "other_gyeonggi").when(named == "other", (area == "other") | (admitted.isNotNull() & alternative))
        .when(named == "local", ~area.isin("other", "other_gyeonggi") & local & allowed).otherwise((F.coalesce(admitted == "pass", F.lit(False)) | F.exists(names, lambda n: words.contains(n)) | local) & allowed)
    )
    return F.coalesce(is_reception(event) & F.coalesce(admitted == "pass", F.lit(True)) & found, F.lit(False))


def candidate_in_range(events: Column, candidates: Column, first: Column, last: Column) -> Column:
    """Whether one of the events that overlap the range is a candidate; candidates: array<boolean> beside events."""
    return F.exists(F.arrays_zip(events.alias("e"), candidates.alias("c")), lambda x: F.coalesce(x["c"], F.lit(False)) & reception_overlaps(x["e"], first, last))
