"""One public row for each canonical notice from the rows of its duplicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.operators.consensus import best_row
from noticeloom.operators.entities import current
from noticeloom.operators.windows import in_window, page


def positions(members: DataFrame) -> DataFrame:
    """Members of a canonical notice in order: the canonical row first, then duplicates by source and id."""
    w = Window.partitionBy("canonical_id").orderBy(F.col("id") != F.col("canonical_id"), "source", "id")
    return members.withColumn("member", F.row_number().over(w))


def merged_events(members: DataFrame, events: DataFrame) -> DataFrame:
    """canonical_id, events: distinct events of all members, the first wins, by start, kind and label."""
    columns = ["kind", "label", "start_date", "end_date", "audience"]
    rows = events.join(members.select(F.col("id").alias("notice_id"), "canonical_id", "member"), "notice_id")
    rows = best_row(rows, ["canonical_id", *columns], F.col("member"), F.col("pos"))
    own = F.struct("start_date", "kind", "label", "end_date", "audience")
    return rows.groupBy("canonical_id").agg(F.sort_array(F.collect_list(own)).alias("events"))


def merged_prices(members: DataFrame, prices: DataFrame) -> DataFrame:
    """canonical_id, prices: one for each unit, area, kind and amount; an official one beats others, else the first; a missing and a zero amount sort first."""
    columns = ["unit_type", "area_sqm", "price_kind", "amount_krw", "monthly_krw", "basis_label"]
    rows = prices.join(members.select(F.col("id").alias("notice_id"), "canonical_id", "member"), "notice_id")
    rows = best_row(rows, ["canonical_id", *columns], (F.col("verification") == "official").desc_nulls_last(), F.col("member"), F.col("pos"))
    amount = F.coalesce(F.nullif("amount_krw", F.lit(0).cast("long")), F.lit(-1).cast("long"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("unit_type"), F.col("price_kind"), amount.alias("order"), F.struct(*columns, "verification").alias("price"))))
    return rows.groupBy("canonical_id").agg(F.transform(listed, lambda x: x["price"]).alias("prices"))


def merged_rules(members: DataFrame, rules: DataFrame) -> DataFrame:
    """canonical_id, rules: distinct canonical JSON in the order of members and rules."""
    rows = rules.join(members.select(F.col("id").alias("notice_id"), "canonical_id", "member"), "notice_id").withColumn("rule", F.to_json(F.try_parse_json("rule")))
    rows = best_row(rows.filter("rule IS NOT NULL"), ["canonical_id", "rule"], F.col("member"), F.col("pos"))
    listed = F.sort_array(F.collect_list(F.struct("member", "pos", "rule")))
    return rows.groupBy("canonical_id").agg(F.transform(listed, lambda x: x["rule"]).alias("rules"))


def merged_competition(members: DataFrame, states: DataFrame, results: DataFrame) -> DataFrame:
    """canonical_id, competition (the chosen member's state), competitions, proof_invalidated (of any member).

    The member is one that has rows, then the latest attempt, then the first: a newer attempt without rows hides nothing.
    """
    rows = results.groupBy("notice_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in results.columns if c != "notice_id"]))).alias("competitions"))
    own = states.join(rows, "notice_id", "left").join(members.select(F.col("id").alias("notice_id"), "canonical_id", "member"), "notice_id")
    bad = own.groupBy("canonical_id").agg(F.bool_or(F.coalesce("proof_invalidated", F.lit(False))).alias("proof_invalidated"), F.max("succeeded_at").alias("last_success"))
    first = best_row(own, ["canonical_id"], F.col("competitions").isNull(), F.col("attempted_at").desc_nulls_last(), F.col("member"))
    return first.select("canonical_id", F.struct("status", "attempted_at", "succeeded_at", "complete").alias("competition"), "competitions").join(bad, "canonical_id")


def public(notices: DataFrame, events: DataFrame, prices: DataFrame, rules: DataFrame) -> DataFrame:
    """Current canonical notices with what all members know of them.

    price_cap_status: the first yes or no of members in order, else the canonical row's.
    """
    members = positions(current(notices))
    cap = F.min(F.when(F.col("price_cap_status").isin("yes", "no"), F.struct("member", "price_cap_status")))["price_cap_status"]
    caps = members.groupBy("canonical_id").agg(cap.alias("_cap"), F.max("last_seen_at").alias("_seen"))
    out = members.filter("id = canonical_id").join(caps, "canonical_id").withColumn("price_cap_status", F.coalesce("_cap", "price_cap_status")).withColumn("last_seen_at", F.col("_seen")).drop("_cap", "_seen", "member")
    for part in (merged_events(members, events), merged_prices(members, prices), merged_rules(members, rules)):
        out = out.join(part, "canonical_id", "left")
    return out


def listing(
    notices: DataFrame, events: DataFrame, prices: DataFrame, rules: DataFrame, first: date | None = None, last: date | None = None, application_only: bool = False,
    category: str | None = None, exclude_rental: bool = False, cap_only: bool = False, number: int = 1, size: int = 20,
) -> DataFrame:
    """A page of the public list. The window is applied to merged notices, since a duplicate's event brings its canonical
    notice in; category, rentals and cap are filters of the canonical row after that, before counting and paging."""
    rows = public(notices, events, prices, rules)
    merged = rows.select(F.col("canonical_id").alias("notice_id"), F.explode("events").alias("e")).select("notice_id", "e.*")
    rows = in_window(rows, merged, first, last, application_only)
    for wanted, test in ((category is not None, F.col("category") == category), (exclude_rental, F.col("category") != "public_rental"), (cap_only, F.col("price_cap_status") == "yes")):
        rows = rows.filter(test) if wanted else rows
    return page(rows, number, size, F.col("sort_date").asc_nulls_last(), F.col("title"), F.col("id"))


def detail(notices: DataFrame, events: DataFrame, prices: DataFrame, rules: DataFrame, identity) -> DataFrame:
    """The canonical notice of any member's id."""
    own = notices.filter(F.col("id") == identity).select(F.coalesce("duplicate_of_id", "id").alias("canonical_id"))
    return public(notices, events, prices, rules).join(own, "canonical_id", "left_semi")


def offered(rules: DataFrame) -> DataFrame:
    """rules (notice_id, pos, supply_type, unit_type, count, official) -> notice_id, offered: first row of each pair with a positive
    count; no candidate at all is null (unknown), candidates without a positive count are an empty array (none on offer)."""
    first = best_row(rules.filter("official AND count > 0"), ["notice_id", "supply_type", "unit_type"], F.col("pos"))
    pairs = first.groupBy("notice_id").agg(F.sort_array(F.collect_list(F.struct("pos", "supply_type", "unit_type", "count"))).alias("offered"))
    known = rules.groupBy("notice_id").agg(F.bool_or("official").alias("_known"))
    empty: Column = F.expr("cast(array() as array<struct<pos:int,supply_type:string,unit_type:string,count:bigint>>)")
    return known.join(pairs, "notice_id", "left").select("notice_id", F.when(F.col("_known"), F.coalesce("offered", empty)).alias("offered"))
