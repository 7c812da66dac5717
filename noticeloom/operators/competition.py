"""Competition results: which units are closed to whom, and what that leaves possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import compact, unit_key
from noticeloom.operators.history import fresh

# Fixed value: the wording that closes the first rank of every area.
FIRST_CLOSED = "1순위마감(청약접수종료)"


def usable_rows(rows: DataFrame, now: Column, live: bool) -> DataFrame:
    """Official local rows of the first rank and general supply with a source and a time: in live views at most six hours old."""
    held = (
        (F.col("rank") == 1) & (F.col("residence_area") == "local") & (F.col("supply_type") == "general") & (F.col("verification") == "official")
        & F.col("evidence_url").isNotNull() & (F.col("observed_at") <= now + F.expr("INTERVAL 60 SECONDS"))
    )
    if live:
        held = held & (F.col("observed_at") >= now - F.expr("INTERVAL 6 HOURS"))
    return rows.filter(held).withColumn("unit", unit_key(F.col("unit_type")))


def closures(rows: DataFrame, allocations: DataFrame, now: Column, live: bool = True) -> DataFrame:
    """notice_id, unit, proof: local_first_closed where a row says so; all_local_first where the first rank closed, with counts that
    bear it out, and an official allocation (notice_id, unit or null, percent) gives all of the supply to locals first.
    A high rate alone proves nothing."""
    rows = usable_rows(rows, now, live)
    full = (F.col("result_status") == "first_closed") & (compact(F.col("result_text")) == FIRST_CLOSED) & (F.col("supply_count") > 0) & (F.col("application_count") >= F.col("supply_count"))
    units = rows.groupBy("notice_id", "unit").agg(F.bool_or(F.col("result_status") == "local_first_closed").alias("one"), F.bool_or(F.coalesce(full, F.lit(False))).alias("two"))
    whole = allocations.filter("percent = 100").select("notice_id", unit_key(F.col("unit")).alias("_unit")).distinct()
    any_unit = whole.filter("_unit IS NULL").select("notice_id", F.lit(True).alias("all_units"))
    out = units.join(whole.filter("_unit IS NOT NULL").select("notice_id", F.col("_unit").alias("unit"), F.lit(True).alias("own")), ["notice_id", "unit"], "left").join(any_unit, "notice_id", "left")
    proof = F.when(F.col("one"), "local_first_closed").when(F.col("two") & (F.coalesce("own", F.lit(False)) | F.coalesce("all_units", F.lit(False))), "all_local_first")
    return out.select("notice_id", "unit", proof.alias("proof")).filter("proof IS NOT NULL")


def decisions(applicants: DataFrame, units: DataFrame, closed: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """applicants (profile_id, notice_id, area, rank), units (notice_id, unit_type), closures, states (notice_id, status, complete, ...)
    -> profile_id, notice_id, closed_units, all_closed: units are closed to first-rank applicants of other areas alone, and all
    of them only while the state is fresh, ok and complete and every unit listed is closed."""
    listed = units.select("notice_id", unit_key(F.col("unit_type")).alias("unit")).distinct().join(closed, ["notice_id", "unit"], "left")
    per_notice = listed.groupBy("notice_id").agg(F.sort_array(F.collect_list(F.when(F.col("proof").isNotNull(), F.col("unit")))).alias("closed"), F.bool_and(F.col("proof").isNotNull()).alias("every"))
    good = fresh(F.col("status"), F.col("proof_invalidated"), F.col("attempted_at"), F.col("succeeded_at"), now) & (F.col("status") == "ok") & F.col("complete")
    rows = applicants.join(per_notice, "notice_id", "left").join(states, "notice_id", "left")
    bound = F.coalesce((F.col("area") == "other") & (F.col("rank") == "first"), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "profile_id", "notice_id", F.when(bound, F.coalesce("closed", none)).otherwise(none).alias("closed_units"),
        F.coalesce(bound & F.col("every") & good, F.lit(False)).alias("all_closed"),
    )


def rank_months(regulated: Column, weakened: Column, capital: Column) -> Column:
    """Months of an account that the first rank takes: regulated areas 24, weakened 1, the capital region 12, others 6."""
    return F.when(regulated, 24).when(weakened, 1).when(regulated.isNull() | weakened.isNull(), None).when(capital, 12).when(~capital, 6)


def first_rank(results: DataFrame) -> DataFrame:
    """results (profile_id, notice_id, kind, result, covered) of first-rank rules -> rank: first only if all pass, duration, money and
    account rules are among them and the notice's rules cover all; else unknown. Nobody is told to be of the second rank."""
    groups = (("subscription_months", "private_rank_months", "national_rank_months"), ("deposit_min_krw", "recognized_payments_min", "recognized_amount_min_krw"), ("account_type",))
    has = F.lit(True)
    for kinds in groups:
        has = has & F.bool_or(F.col("kind").isin(*kinds))
    sure = (F.count(F.when(F.col("result") != "pass", 1)) == 0) & has & F.bool_and(F.coalesce("covered", F.lit(False)))
    return results.groupBy("profile_id", "notice_id").agg(F.when(sure, "first").otherwise("unknown").alias("rank"))


def combinations(notices: DataFrame, offered: DataFrame, scopes: DataFrame) -> DataFrame:
    """notice_id, supply_type, unit_type to judge: the official inventory where it is known (also where it is empty), else what rules and
    results mention (scopes: notice_id, supply_type, unit_type); a null unit is the whole notice."""
    known = offered.filter("offered IS NOT NULL")
    listed = known.select("notice_id", F.explode("offered").alias("o")).select("notice_id", "o.supply_type", "o.unit_type")
    rest = scopes.join(known, "notice_id", "left_anti").join(notices.select(F.col("id").alias("notice_id")), "notice_id", "left_semi")
    return listed.unionByName(rest.select("notice_id", "supply_type", "unit_type").distinct())
