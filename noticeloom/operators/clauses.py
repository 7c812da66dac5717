"""Clauses of documents: sections by headings, and table-driven rules with their evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.text import normal


def sections(pages: DataFrame, heading: str, keys: list[str], text: str = "text", page: str = "page") -> DataFrame:
    """pages -> keys, page, line, text, section: each line with the last heading before it; null before the first.

    heading: a pattern of whole lines; its first group is the section's name, an empty name closes the section.
    """
    rows = pages.select(*keys, F.col(page).alias("page"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    name = F.when(F.col("text").rlike(heading), F.regexp_extract("text", heading, 1))
    w = Window.partitionBy(*keys).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.nullif(F.last(name, ignorenulls=True).over(w), F.lit("")))


@dataclass(frozen=True)
class Clause:
    """A pattern that gives a rule: its kind, the section it holds in (null: any), and the group with the value."""

    kind: str
    pattern: str
    group: int = 1
    section: str | None = None
    operator: str = ">="
    value: str = "long"


# Wordings of conditions in published notices.
CLAUSES = (
    Clause("residence_months", r"(?:거주기간|거주)[^0-9\n]{0,12}(\d{1,3})\s*개월\s*이상"),
    Clause("subscription_months", r"(?:가입기간|가입)[^0-9\n]{0,12}(\d{1,3})\s*개월\s*(?:이상|경과)"),
    Clause("recognized_payments_min", r"납입(?:인정)?횟수[^0-9\n]{0,8}(\d{1,3})\s*회\s*이상"),
    Clause("children_min", r"(?:미성년\s*자녀|자녀)[^0-9\n]{0,8}(\d{1,2})\s*명\s*이상"),
    Clause("marriage_months_max", r"혼인기간[^0-9\n]{0,8}(\d{1,2})\s*년\s*이내", operator="<="),
    Clause("parent_support_months_min", r"직계존속[^\n]{0,30}?(\d)\s*년\s*이상"),
    Clause("household_head", r"(세대주)(?:인|로서|에\s*한|일\s*것)", operator="==", value="flag"),
    Clause("homeless", r"(무주택\s*세대(?:구성원|주))", operator="==", value="flag"),
    Clause("age_min", r"만\s*(\d{2})\s*세\s*이상(?!의\s*직계)"),
    Clause("newborn_children_min", r"(2세\s*미만)[^\n]{0,60}?자녀", value="flag"),
    Clause("parent_age_min", r"(\d{2})\s*세\s*이상의\s*직계존속"),
    Clause("tax_years_min", r"(\d)\s*년\s*이상\s*소득세"),
    Clause("ownership_count_max", r"(2주택)\s*이상을\s*소유한\s*세대에\s*속하지\s*않을", operator="<=", value="flag"),
    Clause("previous_winning_years", r"과거\s*(\d)\s*년\s*이내\s*당첨된\s*[^\n]{0,12}세대에\s*속하지\s*않을"),
    Clause("never_owned_home", r"(세대구성원)[^\n]{0,60}?과거[^\n]{0,60}?주택[^\n]{0,40}?소유[^\n]{0,20}?(?:않|없|아니)", operator="==", value="flag"),
    Clause("account_not_required", r"(청약통장)[^\n]{0,40}?(?:무관|관계\s*없이|필요하지\s*않)", operator="==", value="flag"),
    Clause("young_children_min", r"만\s*\d{1,2}\s*세\s*미만의\s*자녀\s*(\d)\s*명\s*이상"),
    Clause("military_service_years", r"(\d{1,2})\s*년\s*이상\s*장기복무"),
)
MONTHS_OF_YEARS = ("marriage_months_max", "parent_support_months_min")


def extract(lines: DataFrame, clauses: tuple[Clause, ...] = CLAUSES) -> DataFrame:
    """lines (..., section, text) with rules: array<struct<kind, operator, value, evidence>> of the clauses that a line has."""
    found: list[Column] = []
    for c in clauses:
        got = F.regexp_extract("text", c.pattern, c.group)
        value = F.lit(1).cast("long") if c.value == "flag" else got.try_cast("long") * (12 if c.kind in MONTHS_OF_YEARS else 1)
        held = (got != "") & (F.lit(True) if c.section is None else F.col("section") == c.section)
        found.append(F.when(held, F.struct(F.lit(c.kind).alias("kind"), F.lit(c.operator).alias("operator"), value.alias("value"), F.trim("text").alias("evidence"))))
    return lines.withColumn("rules", F.array_compact(F.array(*found)))


# What a document's heading calls its method, as criterion days and cut-off days know them.
HEADINGS = {
    "officetel": r"오피스텔\s*분양\s*(?:광고|공고)", "cancelled_resupply": r"(?:불법행위|계약\s*취소(?:\s*주택)?)\s*재공급\s*입주자\s*모집\s*공고", "unranked_after": r"무순위\s*\(?\s*사후\s*\)?\s*입주자\s*모집\s*공고",
    "optional_supply": r"임의\s*공급\s*(?:입주자\s*)?모집\s*공고", "first_come": r"선착순\s*(?:동[·ㆍ]?호\s*지정|계약|일반\s*매각)|\(선착순",
}


def application_method(pages: DataFrame, key: str, heading_chars: int = 1100) -> DataFrame:
    """key -> method of each document: what the heading of the first of two pages that names one calls it, else unknown.

    A document isn't ranked by its heading: feeds tell that. Of two methods in one heading the first of HEADINGS counts.
    """
    head, method = normal(F.substring("text", 1, heading_chars)), F.lit(None).cast("string")
    for name, pattern in reversed(HEADINGS.items()):
        method = F.when(head.rlike(pattern), name).otherwise(method)
    rows = pages.select(key, "page", F.when(F.col("page") <= 2, method).alias("method"))
    return rows.groupBy(key).agg(F.coalesce(F.min_by("method", F.when(F.col("method").isNotNull(), F.col("page"))), F.lit("unknown")).alias("method"))


def contract_schedule(text: Column) -> Column:
    """struct<basis, start, end> of a contract clause: a day, a range, or first-come from a day; null where none or two differ."""
    day = r"(20\d{2})[.년]\s*(\d{1,2})[.월]\s*(\d{1,2})"
    one = lambda x, a: F.concat_ws("-", F.regexp_extract(x, day, a), F.lpad(F.regexp_extract(x, day, a + 1), 2, "0"), F.lpad(F.regexp_extract(x, day, a + 2), 2, "0")).try_cast("date")
    clause = F.regexp_extract(text, r"계약(?:체결)?\s*(?:기간|일정|일)[^\n0-9]{0,10}([^\n]{0,60})", 1)
    days = F.filter(F.transform(F.regexp_extract_all(clause, F.lit(day), F.lit(0)), lambda x: one(x, 1)), lambda d: d.isNotNull())
    ongoing = clause.rlike(r"부터\s*(?:상시|선착순|계속)")
    first, last = F.try_element_at(days, F.lit(1)), F.try_element_at(days, F.lit(2))
    basis = F.when(ongoing, "ongoing").when(last.isNull(), "fixed").otherwise("range")
    return F.when(first.isNotNull() & (last.isNull() | (first <= last)) & (F.size(days) <= 2), F.struct(basis.alias("basis"), first.alias("start"), last.alias("end")))
