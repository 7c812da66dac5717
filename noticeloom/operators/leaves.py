"""What the kinds of conditions ask: for each a test of a rule's fields and an applicant's columns, for rules.evaluate.

Applicants' rows hold the facts that TESTS name, as dates, numbers and flags, and judged_on, the day for rules that name
none. A missing fact, and a fact of a later day than its rule's, are unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.dates import age_at, full_months, strict_date
from noticeloom.operators.rules import compare

# The operator of kinds that tell none, and the ages and months that are counted.
LEAST, MOST = ">=", "<="
NEWBORN_MONTHS = 24


def fact(rule: dict, name: str) -> Column:
    """An applicant's fact; timeline.dated puts the one of the rule's day in its place."""
    return rule["facts"](name) if "facts" in rule else F.col(name)


def day(rule: dict[str, Column]) -> Column:
    """The day on which a rule is judged: of dated nodes theirs, else the one that it names, else the applicant's row's."""
    return rule["judge_day"] if "judge_day" in rule else F.coalesce(strict_date(rule["criterion_date"]), F.col("judged_on"))


def limit(value: Column, rule: dict[str, Column], operator: str) -> Column:
    return compare(value.cast("double"), F.coalesce(rule["operator"], F.lit(operator)), rule["value_number"])


def number(name: str, operator: str) -> Callable:
    """A number against the rule's."""
    return lambda rule: limit(fact(rule, name), rule, operator)


def flag(name: str, when: bool = True) -> Callable:
    """A yes or no against the rule's value, which is `when` where the rule tells none."""
    return lambda rule: fact(rule, name) == F.coalesce(rule["value_text"].try_cast("boolean"), F.lit(when))


def months(name: str, operator: str) -> Callable:
    """Whole months from a day to the rule's."""
    return lambda rule: limit(full_months(fact(rule, name), day(rule)), rule, operator)


def years(name: str, operator: str) -> Callable:
    """Full years of age at the rule's day."""
    return lambda rule: limit(age_at(fact(rule, name), day(rule)), rule, operator)


def choice(name: str) -> Callable:
    """One of the rule's values, which a comma separates."""
    return lambda rule: F.array_contains(F.transform(F.split(rule["value_text"], ","), lambda x: F.trim(x)), fact(rule, name))


def children_born(rule: dict[str, Column]) -> Column:
    """How many children were born by the rule's day; expected ones count where the family has said so."""
    children = fact(rule, "children")
    born = F.size(F.filter(children, lambda b: b <= day(rule)))
    return F.when(children.isNotNull(), born + F.coalesce(fact(rule, "expected_children"), F.lit(0)))


def newborns(rule: dict[str, Column]) -> Column:
    """How many of the children are under two years old at the rule's day."""
    children = fact(rule, "children")
    young = F.size(F.filter(children, lambda b: (b <= day(rule)) & (F.add_months(b, NEWBORN_MONTHS) > day(rule))))
    return F.when(children.isNotNull(), young + F.coalesce(fact(rule, "expected_children"), F.lit(0)))


def resident(rule: dict[str, Column]) -> Column:
    """Whether the home is in the rule's region (in_region: array of regions that it is in) since so many months."""
    inside = F.array_contains("in_region", rule["value_text"])
    return F.when(F.col("moved_in") <= day(rule), inside)


TESTS: dict[str, Callable] = {
    "age_min": years("birth", LEAST), "age_max": years("birth", MOST), "parent_age_min": years("parent_birth", LEAST), "household_min": number("household_size", LEAST),
    "homeless": flag("homeless"), "household_head": flag("household_head"), "never_owned_home": flag("never_owned"), "employed": flag("employed"), "citizenship": choice("citizenship"),
    "ownership_count_max": number("homes", MOST), "previous_winning": flag("previous_winning", False), "special_winning": flag("special_winning", False), "dual_income": flag("dual_income"),
    "account_type": choice("account_type"), "subscription_months": months("account_since", LEAST), "deposit_min_krw": number("deposit", LEAST), "recognized_payments_min": number("payments", LEAST),
    "recognized_amount_min_krw": number("recognized_amount", LEAST), "monthly_income_max_krw": number("monthly_income", MOST), "income_max_krw": number("income", MOST), "assets_max_krw": number("assets", MOST),
    "real_estate_assets_max_krw": number("real_estate", MOST), "tax_years_min": number("tax_years", LEAST), "marital_status": choice("marital_status"), "marriage_months_max": months("married_on", MOST),
    "children_min": lambda rule: limit(children_born(rule), rule, LEAST), "newborn_children_min": lambda rule: limit(newborns(rule), rule, LEAST), "parent_support_months_min": months("parents_since", LEAST),
    "residence_months": months("moved_in", LEAST), "residence_region": resident, "relocated_worker": flag("relocated_worker"), "recommendation": choice("recommendation"),
}
#: The columns of an applicant and their types; a caller gives those that it has.
FACTS = {
    "birth": "date", "parent_birth": "date", "household_size": "int", "homeless": "boolean", "household_head": "boolean", "never_owned": "boolean", "employed": "boolean", "citizenship": "string", "homes": "int",
    "previous_winning": "boolean", "special_winning": "boolean", "dual_income": "boolean", "account_type": "string", "account_since": "date", "deposit": "long", "payments": "int", "recognized_amount": "long", "monthly_income": "long",
    "income": "long", "assets": "long", "real_estate": "long", "tax_years": "int", "marital_status": "string", "married_on": "date", "children": "array<date>", "expected_children": "int", "parents_since": "date",
    "moved_in": "date", "in_region": "array<string>", "relocated_worker": "boolean", "recommendation": "string", "judged_on": "date",
}


def with_facts(applicants):
    """applicants with every column of FACTS, null where they have none."""
    return applicants.withColumns({c: (F.col(c) if c in applicants.columns else F.lit(None)).cast(kind) for c, kind in FACTS.items()})
