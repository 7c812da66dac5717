"""Facts as of each rule's own day: what an applicant's answers of today, changes and former answers tell of it.

An applicant's row holds today's facts (leaves.FACTS) and, as arrays beside them, what is known of other days; each node of
a rule looks its day up there, so that two rules of a notice may see two states of one applicant without a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import criterion_day
from noticeloom.operators.leaves import FACTS, TESTS

# The group of facts that a kind of condition asks, and the facts of a group. Kinds that aren't here ask facts
# that carry their own day.
GROUPS = {
    "homeless": "ownership", "ownership_count_max": "ownership", "household_head": "household_head", "citizenship": "citizenship",
    "dual_income": "income", "monthly_income_max_krw": "income", "income_max_krw": "income", "assets_max_krw": "assets", "real_estate_assets_max_krw": "assets",
    "tax_years_min": "income_tax", "deposit_min_krw": "bank_private", "recognized_payments_min": "bank_national", "recognized_amount_min_krw": "bank_national",
    "marital_status": "marital", "marriage_months_max": "marital", "children_min": "children", "newborn_children_min": "children",
    "employed": "employment", "relocated_worker": "employment", "parent_support_months_min": "parent_support",
}
FACTS_OF = {
    "ownership": ("homeless", "homes"), "household_head": ("household_head",), "citizenship": ("citizenship",), "income": ("dual_income", "monthly_income", "income"),
    "assets": ("assets", "real_estate"), "income_tax": ("tax_years",), "bank_private": ("deposit", "account_type"), "bank_national": ("payments", "recognized_amount", "account_type"),
    "marital": ("marital_status", "married_on"), "children": ("children", "expected_children"), "employment": ("employed", "relocated_worker"), "parent_support": ("parents_since",),
}
#: An applicant's history. A snapshot has the former values of the facts that `held` names; a change tells that a group never
#: changed or since when it is as it is; an observation is an answer of former forms: for a day, others confirmed alike, and since then.
SNAPSHOTS = "array<struct<group:string,day:date,held:array<string>,facts:struct<" + ",".join(f"{x}:{FACTS[x]}" for x in sorted({f for fs in FACTS_OF.values() for f in fs})) + ">>>"
CHANGES = "array<struct<group:string,mode:string,day:date>>"
OBSERVATIONS = "array<struct<group:string,day:date,alike:array<date>,since:boolean>>"


def with_history(applicants: DataFrame) -> DataFrame:
    """applicants with fact_snapshots, fact_changes and fact_observations, empty where they have none."""
    kinds = {"fact_snapshots": SNAPSHOTS, "fact_changes": CHANGES, "fact_observations": OBSERVATIONS}
    return applicants.withColumns({c: F.coalesce(F.col(c).cast(k) if c in applicants.columns else F.lit(None).cast(k), F.expr(f"cast(array() as {k})")) for c, k in kinds.items()})


def _of(array: str, group: str | Column, also: Callable | None = None) -> Column:
    """The first entry of a group in an array of the applicant's, or null."""
    return F.get(F.filter(array, lambda x: (x["group"] == group) & (also(x) if also else F.lit(True))), F.lit(0))


def _snapshot(group: str | Column, when: Column) -> Column:
    return _of("fact_snapshots", group, lambda x: (x["day"] == when) & (F.size(x["held"]) > 0))


def source_at(group: str | Column, when: Column, today: Column) -> Column:
    """What tells the group's facts of a day: current, snapshot, unchanged, observed or unknown."""
    snapshot = _snapshot(group, when)
    change, seen = _of("fact_changes", group), _of("fact_observations", group)
    unchanged = (change["mode"] == "never_changed") | ((change["mode"] == "known") & (change["day"] <= when) & (change["day"] <= today))
    alike = (seen["day"] == when) | F.array_contains(seen["alike"], when) | (seen["since"] & (seen["day"] <= when))
    return (
        F.when(when.isNull(), "unknown").when(when >= today, "current").when(snapshot.isNotNull(), "snapshot")
        .when(F.coalesce(unchanged, F.lit(False)), "unchanged").when(change.isNull() & F.coalesce(alike, F.lit(False)), "observed").otherwise("unknown")
    )


def dated(today: Column, tests: dict[str, Callable] = TESTS) -> tuple[dict[str, Callable], list]:
    """tests and context for rules.evaluate: conditions ask facts as of each rule's day.

    A node first finds what tells the facts of its kind's group (told, with the snapshot). A test finds those that it asks by it: null
    if nothing tells them, today's where a snapshot doesn't hold a fact.
    """
    group_of = F.create_map(*[F.lit(x) for pair in sorted(GROUPS.items()) for x in pair])

    def look_up(n: Column) -> tuple[Column, Column]:
        group = group_of[n["kind"]]
        return source_at(group, n["judge_day"], today), _snapshot(group, n["judge_day"])

    def value(rule: dict[str, Column], name: str) -> Column:
        former = (rule["told"] == "snapshot") & F.array_contains(rule["snapshot"]["held"], name)
        return F.when(former, rule["snapshot"]["facts"][name]).when(rule["told"] != "unknown", F.col(name))

    def at(kind: str, test: Callable) -> Callable:
        if kind not in GROUPS:
            return test
        own = FACTS_OF[GROUPS[kind]]
        return lambda rule: test(rule | {"facts": lambda name: value(rule, name) if name in own else F.col(name)})

    return {kind: at(kind, test) for kind, test in tests.items()}, [(("told", "snapshot"), look_up)]


def dated_nodes(rule_nodes: DataFrame, rules: DataFrame, notices: DataFrame, today: Column) -> DataFrame:
    """rule_nodes with judge_day, the day on which each node is judged by its basis and its notice; null if none is told.

    rules (rule_id, notice_id); notices (notice_id, announced, original, contract, method, method_day: the days that bases of
    rules speak of). Rules and notices are joined, applicants aren't.
    """
    rows = rule_nodes.join(rules.select("rule_id", "notice_id"), "rule_id").join(notices.select("notice_id", "announced", "original", "contract", "method", "method_day"), "notice_id")
    when = criterion_day(*[F.col(x) for x in ("criterion_basis", "criterion_date", "contract", "original", "method", "method_day", "announced")], today)
    return rows.select(*rule_nodes.columns, when.alias("judge_day"))


def history_days(nodes: DataFrame, today: Column) -> DataFrame:
    """dated_nodes -> group, day: former days of which official rules ask a group of facts."""
    group = F.create_map(*[F.lit(x) for pair in sorted(GROUPS.items()) for x in pair])
    rows = nodes.filter((F.col("verification") == "official") & (F.col("judge_day") < today)).select(group[F.col("kind")].alias("group"), F.col("judge_day").alias("day"))
    return rows.filter(F.col("group").isNotNull()).distinct()


def history_questions(applicants: DataFrame, keys: list[str], days: DataFrame, today: Column) -> DataFrame:
    """keys x groups that a rule asks of a former day of which the applicant's history tells nothing: group, facts, days.

    days: rows of history_days, a row for each group and day of the catalogue; they go to applicants as one array.
    """
    facts = F.create_map(*[x for g, fs in sorted(FACTS_OF.items()) for x in (F.lit(g), F.array(*map(F.lit, fs)))])
    asked = days.groupBy("group").agg(F.sort_array(F.collect_set("day")).alias("days")).agg(F.array_sort(F.collect_list(F.struct("group", "days")))).scalar()
    rows = applicants.withColumn("_asked", asked).select(*keys, "fact_snapshots", "fact_changes", "fact_observations", F.inline("_asked"))
    open_days = F.filter("days", lambda x: source_at(F.col("group"), x, today) == "unknown")
    return rows.select(*keys, "group", facts[F.col("group")].alias("facts"), open_days.alias("days")).filter(F.size("days") > 0)
