"""From judged rules to what applicants see: scopes, statuses, summaries, availability, opportunities, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.text import unit_key
from noticeloom.operators.consensus import agreed, notice_status, status_of

# Which answer of a profile a kind of rule needs, and the group of facts that it belongs to.
QUESTIONS = {
    "residence_months": ("address", "residence"), "residence_region": ("address", "residence"), "region": ("address", "residence"), "household_min": ("members", "household"),
    "homeless": ("homes", "ownership"), "ownership_count_max": ("homes", "ownership"), "never_owned_home": ("homes", "ownership"), "subscription_months": ("account_since", "account"),
    "account_type": ("account_type", "account"), "deposit_min_krw": ("deposit", "account"), "recognized_payments_min": ("payments", "account"), "recognized_amount_min_krw": ("recognized_amount", "account"),
    "monthly_income_max_krw": ("monthly_income", "income"), "real_estate_assets_max_krw": ("real_estate", "assets"), "assets_max_krw": ("assets", "assets"), "income_max_krw": ("income", "income"),
    "marital_status": ("marital_status", "family"), "marriage_months_max": ("married_on", "family"), "children_min": ("children", "family"), "newborn_children_min": ("children", "family"),
    "parent_support_months_min": ("parents_since", "family"), "age_min": ("birth", "person"), "age_max": ("birth", "person"), "previous_winning": ("history", "history"), "special_winning": ("history", "history"),
    "household_head": ("household_head", "household"), "tax_years_min": ("tax_years", "income"), "employed": ("employed", "income"),
}


def in_scope(rule: dict[str, Column], unit: Column, supply: Column) -> Column:
    """Whether a rule speaks of a unit and supply: fields that it leaves open speak of all."""
    units = F.coalesce(F.array_contains(F.transform(rule["unit_types"], unit_key), unit_key(unit)), F.lit(True))
    own = lambda name, value, key: F.coalesce(key(rule[name]) == key(value), rule[name].isNull())
    return own("supply_type", supply, lambda x: x) & own("unit_type", unit, unit_key) & units


def judged_combinations(combinations: DataFrame, rules: DataFrame, results: DataFrame) -> DataFrame:
    """combinations (notice_id, supply_type, unit_type), rules (notice_id, rule_id, supply_type, unit_type, unit_types), results
    (profile_id, rule_id, result) -> profile_id, notice_id, supply_type, unit_type, status, reasons (rule_id, result).

    Rules meet the combinations of their notice alone. Profiles are those that results have; a combination without a
    rule has no row here and is unpublished: see summaries.
    """
    r = rules.select("notice_id", "rule_id", *[F.col(x).alias(f"r_{x}") for x in ("supply_type", "unit_type", "unit_types")])
    scoped = combinations.join(r, "notice_id").filter(in_scope({x: F.col(f"r_{x}") for x in ("supply_type", "unit_type", "unit_types")}, F.col("unit_type"), F.col("supply_type")))
    rows = scoped.select("notice_id", "supply_type", "unit_type", "rule_id").join(results, "rule_id")
    reasons = F.sort_array(F.collect_list(F.struct("rule_id", "result")))
    return rows.groupBy("profile_id", "notice_id", "supply_type", "unit_type").agg(status_of(F.col("result")).alias("status"), reasons.alias("reasons"))


def with_closures(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Statuses after results: general supply of a closed unit is a mismatch, whatever the rules say."""
    own = decisions.select("profile_id", "notice_id", "closed_units", "all_closed")
    out = judged.join(own, ["profile_id", "notice_id"], "left")
    general = F.col("supply_type").rlike(r"^\s*일반(?:\s*공급)?\s*$")
    closed = general & (F.coalesce("all_closed", F.lit(False)) | F.coalesce(F.array_contains("closed_units", unit_key(F.col("unit_type"))), F.lit(False)))
    return out.withColumn("closed", closed).withColumn("status", F.when(F.col("closed"), "mismatch").otherwise(F.col("status"))).drop("closed_units", "all_closed")


def summaries(judged: DataFrame) -> DataFrame:
    """One row for each profile, notice, supply, status and set of reasons, with its units; general supply first by `general`."""
    rows = judged.groupBy("profile_id", "notice_id", "supply_type", "status", "reasons").agg(F.sort_array(F.collect_set("unit_type")).alias("units"))
    return rows.withColumn("general", F.col("supply_type").rlike(r"^\s*일반(?:\s*공급)?\s*$"))


def in_order(rows: DataFrame) -> DataFrame:
    """Summaries of each profile and notice with place: general supply first, then others by their place in the notice's inventory (`pos`)."""
    w = Window.partitionBy("profile_id", "notice_id").orderBy(F.col("general").desc(), "pos", "supply_type", "status", F.array_join("units", ","))
    return rows.withColumn("place", F.row_number().over(w))


def shared_reasons(judged: DataFrame) -> DataFrame:
    """profile_id, notice_id, rule_id, result of reasons that two supplies or more have."""
    rows = judged.select("profile_id", "notice_id", "supply_type", F.explode("reasons").alias("r")).select("profile_id", "notice_id", "r.*", "supply_type")
    return rows.groupBy("profile_id", "notice_id", "rule_id", "result").agg(F.count_distinct("supply_type").alias("n_supplies")).filter("n_supplies > 1")


def catalogue(judged: DataFrame, notices: DataFrame) -> DataFrame:
    """profile_id, notice_id, status of all that judged has, and one row without a profile, `unpublished`, for each notice that no rule
    speaks of: it is that for every profile, so it isn't repeated for each."""
    rows = judged.groupBy("profile_id", "notice_id").agg(notice_status(F.col("status")).alias("status")).withColumn("_told", F.lit(True))
    nobody = F.lit(None).cast(judged.schema["profile_id"].dataType).alias("profile_id")
    named = notices.select(nobody, F.col("id").alias("notice_id"), F.lit("unpublished").alias("status"), F.lit(False).alias("_told"))
    # Both stand in one table, as a join of notices with the judged ones would have these judged twice.
    told = F.max("_told").over(Window.partitionBy("notice_id")) & F.col("notice_id").isNotNull()
    out = rows.unionByName(named).withColumn("_any", told)
    return out.filter(F.col("_told") | ~F.col("_any")).drop("_told", "_any")


def brief(reasons: Column, most: int = 3) -> Column:
    """Up to three reasons: one that fails, one that passes, one to review, then others in order."""
    first = lambda kind: F.slice(F.filter(reasons, lambda r: r["result"] == kind), 1, 1)
    lead = F.concat(first("fail"), first("pass"), first("review"))
    return F.slice(F.concat(lead, F.array_except(reasons, lead)), 1, most)


def compared(status: Column, reasons: Column) -> Column:
    """struct<code, n> of what a supply's line says: its status where that is decided, else how many conditions wait for an answer
    (missing), else how many hold (passed), else none. reasons: array<struct<rule_id, result, missing>>, each counted once."""
    count = lambda test: F.size(F.filter(F.array_distinct(reasons), test))
    missing, passed = count(lambda r: F.coalesce(r["missing"], F.lit(False))), count(lambda r: r["result"] == "pass")
    said = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("int").alias("n"))
    decided = F.when(status == "mismatch", said("mismatch", F.lit(None))).when(status == "possible", said("possible", F.lit(None)))
    return F.coalesce(decided, F.when(missing > 0, said("missing", missing)).when(passed > 0, said("passed", passed)).otherwise(said("none", F.lit(None))))


def questions(rule_nodes: DataFrame) -> DataFrame:
    """field, facts, n_rules: the answers that a catalogue's rules (rows of rules.nodes) ask of a profile, at any depth."""
    kinds = rule_nodes.groupBy("kind").agg(F.count_distinct("rule_id").alias("n"))
    known = rule_nodes.sparkSession.createDataFrame([(k, f, g) for k, (f, g) in sorted(QUESTIONS.items())], "kind string, field string, facts string")
    return kinds.join(known, "kind").groupBy("field", "facts").agg(F.sum("n").alias("n_rules"))


def opportunities(methods: DataFrame, scores: DataFrame) -> DataFrame:
    """methods (notice_id, unit_type, supply_type, method, ratio, area, official), scores (notice_id, unit_type, area, minimum, average)
    -> one row for each notice, supply, method, ratio and area with its units; supplies are never merged.

    The benchmark scores of the units are given where they agree, else null.
    """
    rows = methods.filter("official").withColumn("_key", unit_key(F.col("unit_type"))).join(scores.withColumn("_key", unit_key(F.col("unit_type"))).drop("unit_type"), ["notice_id", "_key", "area"], "left")
    groups = rows.groupBy("notice_id", "supply_type", "method", "ratio", "area")
    return groups.agg(F.sort_array(F.collect_set("unit_type")).alias("units"), agreed(F.col("minimum")).alias("minimum"), agreed(F.col("average")).alias("average"))


def polled_rules(prior: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rules of notices after a poll (notice_id, kind, metadata, document_hash, verification, original_date, rule) from prior and incoming.

    A poll replaces metadata of the kinds that it sends; what it doesn't send stays, and so does every rule that is no
    metadata and official metadata of a document, unless the poll brings a document's rule of that kind. The original
    announcement date is the earliest that either knew.
    """
    sent = incoming.groupBy("notice_id", "kind").agg(F.bool_or(F.col("document_hash").isNotNull()).alias("_document"), F.min("original_date").alias("_new"))
    rows = prior.join(sent, ["notice_id", "kind"], "left")
    by_document = F.col("document_hash").isNotNull() & (F.col("verification") == "official") & ~F.coalesce("_document", F.lit(False))
    stay = rows.filter(~F.col("metadata") | F.col("_document").isNull() | by_document).drop("_document", "_new")
    before = prior.groupBy("notice_id", "kind").agg(F.min("original_date").alias("_old"))
    new = incoming.join(before, ["notice_id", "kind"], "left").withColumn("original_date", F.least("original_date", "_old")).drop("_old")
    return stay.unionByName(new)
