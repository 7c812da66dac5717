"""What screens say: names of sources, categories, candidates, contract days, selection orders and quotas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.text import public_url, unit_key, url_host

# Names of sources and hosts, categories, areas, and the wordings of screens.
SOURCES = {
    "cheongyak_home": "청약홈", "myhome": "마이홈", "myhome_sale": "마이홈 공공분양", "lh": "LH", "ih": "iH", "sh": "SH", "gh": "GH", "cheongyak_competition": "청약홈 경쟁률", "official_conditions": "공고문 조건",
}
HOSTS = {"applyhome": "청약홈", "myhome": "마이홈", "lh.or.kr": "LH", "ih.co.kr": "iH", "i-sh.co.kr": "SH", "gh.or.kr": "GH"}
CATEGORIES = {
    "rent": ("private_rental", "public_rental", "rental", "rent", "myhome_rental"), "public": ("public_sale", "public_housing", "myhome_sale"),
    "private": ("apt", "urban", "unsold", "optional_supply", "officetel", "living_accommodation"),
}
CATEGORY_WORDS = {"rent": r"(?i)임대|rent|행복주택|국민주택", "public": r"(?i)공공분양|신혼희망|뉴홈", "private": r"(?i)민간|APT|아파트|분양|무순위|취소후"}
AREAS = {"local": "해당지역", "other_gyeonggi": "기타경기", "other": "기타지역", "local_and_other_gyeonggi": "경기도"}
RESULTS = {"local_first_closed": "해당지역 1순위 마감", "first_closed": "1순위 마감", "open": "접수 중"}
CANDIDATES = {
    "unrestricted": "신청지역 제한 없음 · 접수일 후보", "area": " 접수일 후보", "priority": "지역 우선순위 충족 후보", "no_priority": "지역 우선순위 미충족 · 접수일 확인", "open_priority": "지역 우선순위·접수일 확인 필요",
    "period": "거주기간 충족 후보", "open_period": "지역 일치 · 기간 확인 필요",
}
CONTRACTS = {
    "unknown": "공식 계약일을 확인하지 못해 계약일 기준 조건은 보류합니다.", "fixed": "공식 계약일 %s 기준으로 비교합니다.", "later": " 현재 입력이 유지될 때의 판정입니다.", "from": "공식 계약 일정 %s부터", "upto": " %s까지",
    "today": " · 오늘 계약한다면 (%s) 기준입니다.", "none": "현재 진행 중인 공식 계약 일정이 없어 계약일 기준 조건은 보류합니다.", "span": "공식 계약기간 %s", "start": " · 시작일 %s에 현재 입력이 유지될 때의 판정입니다.",
    "over": " 종료 · 실제 계약일이 없어 계약일 기준 조건은 보류합니다.", "no_end": "종료일 미공개",
}
ORDERS = {"basic": "기본 선정 순서: ", "plain": "선정 순서: "}
QUOTAS = {
    "shares": "%s로 배정합니다. ", "untold": "공식 지역별 배정 물량이 있습니다. ", "local": "경기도 배정에서는 해당지역을 먼저 선정합니다. ", "advance": "앞선 배정의 낙첨자는 다음 지역 배정에 다시 포함됩니다. ",
    "source": "배정 단계와 잔여물량 이동은 원문 기준입니다.",
}
UNTOLD_CLOSING = "마감 여부 미공개"
UNTIL = r"(?:별도\s*(?:공지|공고)(?:\s*시)?까지|(?:잔여\s*세대\s*)?(?:소진|마감)\s*(?:시)?까지)"


def named(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def source_name(source: Column, evidence_url: Column) -> Column:
    """The name of the host of the evidence, where it has a URL, else that of the source; unknown ones as they are."""
    host, out = url_host(public_url(evidence_url)), F.regexp_replace(url_host(public_url(evidence_url)), r"^www\.", "")
    for part, name in reversed(HOSTS.items()):
        out = F.when(host.contains(part), name).otherwise(out)
    return F.coalesce(out, named(SOURCES, source), source)


def category_group(category: Column) -> Column:
    """rent, public, private or other, by code, then by words."""
    code, out = F.lower(category), F.lit("other")
    for group, words in reversed(CATEGORY_WORDS.items()):
        out = F.when(category.rlike(words), group).otherwise(out)
    for group, codes in reversed(CATEGORIES.items()):
        out = F.when(code.isin(*codes), group).otherwise(out)
    return out


def row_label(status: Column, text: Column) -> Column:
    """What a result row says of its closing."""
    return F.coalesce(named(RESULTS, status), F.nullif(text, F.lit("")), F.lit(UNTOLD_CLOSING))


def application_fee(rules: Column, unit: Column) -> Column:
    """The fee of the first official rule that names the unit; rules: array<struct<kind, verification, units: array<struct<unit_type,
    application_fee_krw>>>>. A rule whose first such unit has no fee, or a negative one, is passed over."""
    fees = F.transform(
        F.filter(rules, lambda r: (r["kind"] == "supply_financial_terms") & (r["verification"] == "official")),
        lambda r: F.try_element_at(F.filter(r["units"], lambda u: unit_key(u["unit_type"]) == unit_key(unit)), F.lit(1))["application_fee_krw"],
    )
    return F.try_element_at(F.filter(fees, lambda f: f >= 0), F.lit(1))


def candidate_label(unrestricted: Column, area: Column, has_priority: Column, priority: Column, period: Column) -> Column:
    """What a card says of a candidate; priority, period: whether durations are met, null untold."""
    by_priority = F.when(priority, CANDIDATES["priority"]).when(~priority, CANDIDATES["no_priority"]).otherwise(CANDIDATES["open_priority"])
    return (
        F.when(F.coalesce(unrestricted, F.lit(False)), CANDIDATES["unrestricted"]).when(area.isin("other", "other_gyeonggi"), F.concat(named(AREAS, area), F.lit(CANDIDATES["area"])))
        .when(has_priority, by_priority).when(period, CANDIDATES["period"]).otherwise(CANDIDATES["open_period"])
    )


def contract_note(used: Column, status: Column, official: Column, start: Column, end: Column, evidence: Column, today: Column) -> Column:
    """What a card says of contract-day conditions, or null where no condition uses the contract's day."""
    say = lambda key, *xs: F.format_string(CONTRACTS[key], *[x.cast("string") for x in xs])
    span = say("span", F.when(end.isNull() | (start == end), start.cast("string")).otherwise(F.concat_ws(" – ", start.cast("string"), end.cast("string"))))
    until = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(evidence, F.lit("")), UNTIL, 0), F.lit("")), F.lit(CONTRACTS["no_end"]))
    unknown = ~F.coalesce(official, F.lit(False)) | start.isNull() | F.coalesce(status == "unknown", F.lit(True))
    closing = F.when(end.isNotNull(), say("upto", end)).otherwise(F.concat(F.lit(" "), until))
    ongoing = F.when((start <= today) & F.coalesce(today <= end, F.lit(True)), F.concat(say("from", start), closing, say("today", today))).otherwise(CONTRACTS["none"])
    ranged = F.when(today < start, F.concat(span, say("start", start))).when(today <= end, F.concat(span, say("today", today))).otherwise(F.concat(span, F.lit(CONTRACTS["over"])))
    fixed = F.concat(say("fixed", start), F.when(start > today, CONTRACTS["later"]).otherwise(""))
    return F.when(F.coalesce(used, F.lit(False)), F.when(unknown, CONTRACTS["unknown"]).when(status == "fixed", fixed).when(status == "ongoing", ongoing).otherwise(ranged))


def selection_order(stages: Column, has_exceptions: Column) -> Column:
    """The order in which applicants are chosen, as a sentence; empty where none is told."""
    named_stages = F.filter(stages, lambda s: F.trim(s) != "")
    head = F.when(has_exceptions, ORDERS["basic"]).otherwise(ORDERS["plain"])
    return F.when(F.size(named_stages) > 0, F.concat(head, F.array_join(named_stages, " → "), F.lit(". "))).otherwise("")


def quota_detail(shares: Column, local_first: Column, advance: Column, order: Column) -> Column:
    """How a supply is shared among areas (array<struct<residence_area, percent, label>>), as sentences."""
    listed = F.array_join(F.transform(shares, lambda s: F.concat(F.coalesce(F.nullif(s["label"], F.lit("")), named(AREAS, s["residence_area"]), s["residence_area"]), F.lit(" "), s["percent"].cast("string"), F.lit("%"))), " · ")
    told = F.when(F.size(shares) > 0, F.format_string(QUOTAS["shares"], listed)).otherwise(QUOTAS["untold"])
    more = [F.when(F.coalesce(x, F.lit(False)), QUOTAS[key]).otherwise("") for key, x in (("local", local_first), ("advance", advance))]
    return F.concat(told, *more, order, F.lit(QUOTAS["source"]))
