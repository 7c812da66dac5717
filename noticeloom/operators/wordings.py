"""Conditions whose wording goes over lines: found in a section's joined text, with page, line and span, and their exemptions.

A section's lines are joined by spaces; an index tells for each offset its page and line. The text falls into clauses at
the marks that open one. A wording is looked for in a clause, so it never runs into the next; of a wording that holds another
one inside its span the outer counts, and an exemption speaks of the conditions of its clause.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.arrays import inlined
from noticeloom.functions.text import normal

#: What opens a clause.
MARKS = "■①②③④⑤⑥⑦⑧⑨•"


@dataclass(frozen=True)
class Wording:
    """A pattern over joined lines that gives a condition.

    group: that of the value (0: none, the value is 1); scale: what the value is multiplied by; section: a pattern of the
    section's name; over: kinds that are left out where their span lies within this one's; needs: words that every match has, each
    one of several (a|b): a clause without them isn't searched.
    """

    kind: str
    pattern: str
    group: int = 0
    operator: str = "=="
    scale: int = 1
    section: str | None = None
    over: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Exemption:
    """A pattern that frees of conditions of some kinds in its clause."""

    kind: str
    pattern: str
    of: tuple[str, ...]
    needs: tuple[str, ...] = ()


# Wordings of conditions and of exemptions in published notices.
WORDINGS = (
    Wording("adult_or_minor_head", r"만\s*(\d{2})\s*세\s*이상인\s*분\s*또는\s*세대주인\s*미성년자(?:\s*\([^)]*\))?", 1, ">=", over=("age_min", "household_head", "domestic_adult"), needs=("미성년자",)),
    Wording("domestic_adult", r"(?:국내|대한민국|전국)[^0-9]{0,180}?(?:만\s*)?(\d{2})\s*세\s*이상[^0-9]{0,100}?(?:성년자|인\s*자|무주택\s*세대)", 1, ">=", over=("age_min",), needs=("국", "이상")),
    Wording("age_min", r"만\s*(\d{2})\s*세\s*이상(?!의\s*직계)(?:의\s*성년자|인\s*자|인\s*분|이면)?", 1, ">=", needs=("만", "이상")),
    Wording("nationwide_residence", r"입주자\s*모집\s*공고일\s*현재\s*전국에\s*거주하는\s*무주택\s*세대\s*구성원", over=("residence_region", "homeless"), needs=("전국에",)),
    Wording("residence_region", r"입주자\s*모집\s*공고일\s*현재.{0,260}?거주", needs=("공고일", "거주")),
    Wording("residence_months", r"(\d{1,3})\s*개월\s*이상\s*(?:계속\s*)?(?:하여\s*)?거주", 1, ">=", needs=("개월", "거주")),
    Wording("region_unrestricted", r"거주\s*지(?:역)?.{0,240}?(?:불문|무관|관계\s*없이)", over=("residence_region",), needs=("거주", "불문|무관|관계")),
    Wording("homeless", r"무주택\s*세대\s*(?:구성원|주)", needs=("무주택",)),
    Wording("ownership_unrestricted", r"주택\s*소유\s*여부.{0,180}?(?:불문|관계\s*없이)", over=("homeless",), needs=("소유", "여부")),
    Wording("household_head", r"세대주(?:인|로서|에\s*한|일\s*것)", needs=("세대주",)),
    Wording("account_not_required", r"(?:입주자\s*저축|청약\s*(?:저축|통장)).{0,420}?(?:불문|관계\s*없이|무관|불요)", over=("subscription_months",), needs=("저축|통장", "불문|관계|무관|불요")),
    Wording("subscription_months", r"(?:청약\s*통장\s*가입\s*기간|청약\s*(?:예금|부금|종합저축)).{0,100}?(\d{1,3})\s*개월(?:이)?\s*(?:경과|이상)", 1, ">=", needs=("청약", "개월")),
    Wording("never_owned_home", r"세대\s*구성원.{0,180}?과거.{0,120}?주택.{0,90}?소유", section="생애최초", needs=("과거", "소유")),
    Wording("tax_years_min", r"(\d{1,2})\s*년\s*이상\s*소득세", 1, ">=", needs=("소득세",)),
    Wording("newborn_children_min", r"2세\s*미만.{0,120}?자녀(?:\s*\([^)]*\))?", section="신생아|신혼", needs=("2세", "자녀")),
    Wording("children_min", r"미성년\s*(?:인\s*)?자녀.{0,30}?(\d{1,2})\s*명\s*이상", 1, ">=", needs=("미성년", "자녀")),
    Wording("marriage_months_max", r"혼인\s*기간.{0,40}?(\d{1,2})\s*년\s*이내", 1, "<=", 12, needs=("혼인", "기간")),
    Wording("parent_support_months_min", r"직계\s*존속.{0,60}?(\d{1,2})\s*년\s*이상\s*(?:계속\s*)?(?:하여\s*)?부양", 1, ">=", 12, needs=("존속", "부양")),
    Wording("citizenship", r"외국인(?:의\s*경우|은)?.{0,60}?불가(?:능)?", needs=("외국인", "불가")),
    Wording("previous_winning_years", r"과거\s*(\d{1,2})\s*년\s*이내.{0,40}?당첨.{0,60}?(?:않|없|아니)", 1, needs=("과거", "당첨")),
)
EXEMPTIONS = (
    Exemption("planned_household", r"예비\s*신혼부부", ("homeless",), needs=("예비",)),
    Exemption("birth_relief", r"(?:출산|혼인)\s*특례", ("homeless", "never_owned_home", "previous_winning_years"), needs=("특례",)),
    Exemption("spouse_before_marriage", r"혼인\s*신고.{0,40}?(?:전|이전)", ("never_owned_home", "homeless"), needs=("혼인", "신고")),
    Exemption("long_service", r"\d{1,2}\s*년\s*이상\s*장기\s*복무", ("residence_region", "residence_months"), needs=("장기", "복무")),
    Exemption("tax_relief", r"세액\s*공제|납부\s*의무", ("tax_years_min",), needs=("공제|의무",)),
    Exemption("pregnancy", r"태아|임신|입양", ("newborn_children_min", "children_min"), needs=("태아|임신|입양",)),
)
SPAN = "struct<kind:string,start:int,end:int>"


def section_texts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, section, page, line, text) -> keys, section, text, places: array<struct<start, page, line>>.

    Lines stand in order with white space as one space; empty ones are left out. Lines without a section make one of their own.
    """
    rows = lines.filter(F.col("text").rlike(r"(?U)\S")).withColumn("text", normal(F.col("text")))
    w = Window.partitionBy(*keys, "section").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))
    whole = F.array_sort(F.collect_list(F.struct("start", "page", "line", "text")))
    rows = rows.groupBy(*keys, "section").agg(whole.alias("_lines"))
    return rows.select(
        *keys, "section", F.array_join(F.transform("_lines", lambda x: x["text"]), " ").alias("text"),
        F.transform("_lines", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"), x["line"].alias("line"))).alias("places"),
    )


def clauses(text: Column) -> Column:
    """array<struct<start, text>>: the clauses of a text and their offsets."""
    parts = F.split(text, f"(?=[{MARKS}])")
    empty = F.expr("cast(struct(0, array()) as struct<at:int,out:array<struct<start:int,text:string>>>)")
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("text")))).alias("out"))
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(~text.rlike(f"[{MARKS}]"), whole).otherwise(F.aggregate(parts, empty, step, lambda acc: acc["out"]))


def conditions(lines: DataFrame, keys: list[str], wordings: tuple[Wording, ...] = WORDINGS, exemptions: tuple[Exemption, ...] = EXEMPTIONS) -> DataFrame:
    """lines (keys, section, page, line, text) -> keys, section, kind, operator, value, page, line, start, end, evidence, exemptions.

    start, end: offsets in the section's joined text, the end exclusive; page, line: where the span begins. exemptions: array<
    struct<kind, start, end>> of the same clause that speak of the kind. A wording counts once a clause.
    """
    rows = inlined(section_texts(lines, keys), [*keys, "section", "places"], clauses(F.col("text")))
    rows = rows.withColumnRenamed("start", "_at").withColumn("text", F.col("text"))

    def span(w: Wording | Exemption) -> tuple[Column, Column, Column]:
        place = F.regexp_instr("text", F.lit(w.pattern))
        for words in w.needs:
            place = F.when(functools.reduce(operator.or_, [F.contains("text", F.lit(x)) for x in words.split("|")]), place).otherwise(0)
        return place, F.col("_at") + place - 1, F.length(F.regexp_extract("text", w.pattern, 0))

    freed = []
    for e in exemptions:
        place, start, size = span(e)
        freed.append(F.when(place > 0, F.struct(F.lit(e.kind).alias("kind"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"), F.array(*map(F.lit, e.of)).alias("of"))))
    found = []
    for w in wordings:
        place, start, size = span(w)
        held = (place > 0) & (F.coalesce(F.col("section").rlike(w.section), F.lit(False)) if w.section else F.lit(True))
        value = F.regexp_extract("text", w.pattern, w.group).try_cast("long") * w.scale if w.group else F.lit(1).cast("long")
        found.append(F.when(held, F.struct(
            F.lit(w.kind).alias("kind"), F.lit(w.operator).alias("operator"), value.alias("value"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"),
            F.regexp_extract("text", w.pattern, 0).alias("evidence"), F.array(*map(F.lit, w.over)).cast("array<string>").alias("over"),
        )))
    # _found has nulls: what array_compact is given is evaluated without generated code. Beside one the code is made in small methods;
    # a single one of all wordings would be too long to be compiled.
    rows = rows.withColumns({"_found": F.array(*found), "_freed": F.array_compact(F.array(*freed))})
    within = lambda x: F.exists("_found", lambda y: F.array_contains(y["over"], x["kind"]) & (y["start"] <= x["start"]) & (y["end"] >= x["end"]))
    rows = inlined(rows, [*keys, "section", "places", "_freed"], F.filter("_found", lambda x: x.isNotNull() & ~F.coalesce(within(x), F.lit(False))))
    rows = rows.withColumn("_place", F.element_at(F.filter("places", lambda p: p["start"] <= F.col("start")), -1))
    place = F.col("_place")
    own = F.transform(F.filter("_freed", lambda e: F.array_contains(e["of"], F.col("kind"))), lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end")))
    return rows.select(*keys, "section", "kind", "operator", "value", place["page"].alias("page"), place["line"].alias("line"), "start", "end", "evidence", own.alias("exemptions"))
