"""Documents of notices: cut-off days, scopes, the best attachment, stages, patches of current rows, and when to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.dates import date_token
from noticeloom.functions.text import compact, normal
from noticeloom.operators.consensus import best_row
from noticeloom.operators.dealing import dealt
from noticeloom.operators.flat_tables import DAY as FLAT_DAY
from noticeloom.operators.flat_tables import PERIOD, agreed_value, once, paired, period

# Wordings of cut-off days, whole provinces of sentences, the pages that are looked at, waits after a reading.
DAY = r"(20\d{2})[.년\-/]\s*(\d{1,2})[.월\-/]\s*(\d{1,2})"
METHODS = {"unranked_after": r"무순위\s*\(?사후\)?", "optional_supply": r"임의\s*공급", "cancelled_resupply": r"(?:불법행위\s*재공급|계약\s*취소(?:\s*주택)?\s*재공급)"}
OWN_ROUND = rf"본\s*주택의\s*(?:\d+\s*회차|회차)\s*입주자모집공고일은\s*(?:\d+\s*)?{DAY}"
ANNOUNCED = rf"(?:(?:이\s*주택의|본\s*주택의)\s*(?:최초\s*)?입주자모집공고일[은는]\s*|분양광고일\s*\(){DAY}"
SCHEDULE = r"구분\s*최초[^■]{0,400}"
COLUMNS = {"original": "최초", "unranked_after": r"무순위\s*\(?사후\)?", "optional_supply": r"임의\s*공급", "cancelled_resupply": r"재공급"}
STEPS = {"announced": r"(?:입주자)?\s*모집\s*공고", "received": r"(?:청약|신청)\s*접수|접수일", "drawn": r"당첨자\s*발표", "papers": r"서류\s*(?:접수|제출)", "contract": r"계약\s*(?:체결|기간|일)"}
PAGES, TABLE_PAGES = 8, 3
WHOLE_PROVINCES = ("서울특별시", "인천광역시", "경기도", "부산광역시", "대구광역시", "대전광역시", "울산광역시", "세종특별자치시", "강원특별자치도", "충청북도", "충청남도", "전북특별자치도", "경상북도", "경상남도", "제주특별자치도")
WAITS = {"quota": "24 hours", "deferred": "3 hours"}
PARSER = "official_document_parser"
UNVERIFIED = ("ai_unverified", "auto_unverified")
MESSAGES = {
    "attachment_not_found": "공식 공고 페이지에서 모집공고문 첨부를 찾지 못했습니다.", "document_download_failed": "공식 모집공고문 파일을 내려받지 못했습니다.", "document_decode_failed": "공고문 파일의 텍스트를 읽지 못했습니다.",
    "document_no_text": "공고문에 읽을 수 있는 텍스트가 없습니다. 스캔 여부를 확인해야 합니다.", "document_read": "공고문 텍스트를 로컬에서 읽었습니다.", "conditions_parsed": "공식 신청 조건을 비교 가능한 항목으로 읽었습니다.",
    "parser_failed": "공고문 조건을 해석하는 과정에서 오류가 발생했습니다.",
}


def _found(text: Column, pattern: str) -> Column:
    """The day that the last three groups of a pattern tell in a text, or null."""
    match = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    day = F.try_element_at(F.regexp_extract_all(match, F.lit(DAY), F.lit(0)), F.lit(-1))
    part = lambda i: F.regexp_extract(day, DAY, i)
    return F.when(match.isNotNull(), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date"))


def cutoffs(pages: DataFrame, method: str, of: DataFrame | None = None) -> DataFrame:
    """pages (notice_id, page, text, `method`) -> notice_id, day, page: the cut-off day that a document states, of its first PAGES pages.

    Of special methods only their own announcement's day counts, in a sentence or else in a schedule table of the first
    TABLE_PAGES pages whose labels stand before its dates (none if two tables differ); else the day of the own round, then that of the
    announcement. The earliest page that states a day of the calendar counts; documents without one have no row.
    of: the notices, by whose number rows are dealt to tasks (see dealt); without them Spark's own number of tasks holds.
    """
    text = normal(F.col("text"))
    special = F.lit(None).cast("date")
    for name, words in METHODS.items():
        pattern = rf"(?:본\s*(?:주택의\s*)?)?{words}\s*입주자\s*모집공고일[은는]\s*(?:\([^)]{{0,3}}\)\s*)?{DAY}"
        special = F.when(F.col(method) == name, _found(text, pattern)).otherwise(special)
    plain = ~F.coalesce(F.col(method).isin(*METHODS), F.lit(False))
    own, announced = _found(text, OWN_ROUND), _found(text, ANNOUNCED)
    table = paired(F.nullif(F.regexp_extract(text, SCHEDULE, 0), F.lit("")), COLUMNS, FLAT_DAY)
    listed = F.when((F.col("page") <= TABLE_PAGES) & ~plain, once(F.try_element_at(table, F.col(method)), date_token))
    days = F.array(*[F.struct(F.lit(i).alias("rank"), d.alias("day")) for i, d in enumerate((special, listed, F.when(plain, own), F.when(plain, announced)))])
    # Only pages that tell a day are dealt, and each notice is grouped once in its task.
    rows = pages.filter(F.col("page") <= PAGES).select("notice_id", "page", F.inline(F.filter(days, lambda x: x["day"].isNotNull())))
    rank, day = F.col("rank"), F.col("day")
    first = [F.min(F.when(rank == i, F.struct("page", "day"))).alias(f"_{i}") for i in range(4)]
    agreed_day = F.min(F.when(rank == 1, day)) == F.max(F.when(rank == 1, day))
    found = (rows if of is None else dealt(rows, "notice_id", of=of)).groupBy("notice_id").agg(*first, agreed_day.alias("_agreed"))
    chosen = F.coalesce("_0", F.when(F.col("_agreed"), F.col("_1")), "_2", "_3")
    return found.select("notice_id", chosen.alias("x")).filter("x IS NOT NULL").select("notice_id", "x.day", "x.page")


def contract_tables(pages: DataFrame) -> DataFrame:
    """pages (notice_id, page, text) -> notice_id, basis, start, end: the contract's day or range of a schedule table whose steps stand
    before their dates. A notice whose tables differ, or that has none, has no row."""
    table = paired(F.nullif(F.regexp_extract(normal(F.col("text")), r"구분[^■]{0,600}", 0), F.lit("")), STEPS, PERIOD)
    rows = pages.select("notice_id", period(F.try_element_at(table, F.lit("contract"))).alias("p"))
    rows = rows.groupBy("notice_id").agg(agreed_value(F.collect_set("p")).alias("p")).filter("p IS NOT NULL")
    return rows.select("notice_id", F.when(F.col("p.start") == F.col("p.end"), "fixed").otherwise("range").alias("basis"), "p.start", "p.end")


def province_scopes(sentence: Column) -> Column:
    """The whole provinces whose residents a sentence names, in a fixed order; empty where a part of one is named.

    Each province must be followed by a word of residence, or stand in a group of the capital region that names no more.
    """
    plain = compact(sentence)
    names = F.filter(F.array(*map(F.lit, WHOLE_PROVINCES)), lambda n: plain.contains(n))
    group = F.nullif(F.regexp_extract(plain, r"수도권[\[(]([^\])]+)[\])](?:에|에서)?거주", 1), F.lit(""))
    parts = F.split(group, r"[·,ㆍ」]|및")
    grouped = F.filter(names, lambda n: F.array_contains(parts, n))
    none = F.filter(names, lambda _: F.lit(False))
    resident = lambda n: plain.contains(F.concat(n, F.lit("거주"))) | plain.contains(F.concat(n, F.lit("에거주"))) | plain.contains(F.concat(n, F.lit("에서거주")))
    return F.when(group.isNotNull(), F.when((F.size(grouped) == F.size(names)) & (F.size(names) > 0), names).otherwise(none)).when(F.forall(names, resident), names).otherwise(none)


def best_attachment(attachments: DataFrame) -> DataFrame:
    """attachments (notice_id, pos, n_conditions, readable, ...) -> the one of each notice with the most conditions, else one that can be
    read, else the first; ties: the first."""
    score = F.when(F.col("n_conditions") > 0, 100 + F.col("n_conditions")).when(F.col("readable"), 10).otherwise(0)
    return best_row(attachments.withColumn("score", score), ["notice_id"], F.col("score").desc(), F.col("pos"))


def stages(attachments: DataFrame) -> DataFrame:
    """attachments (notice_id, pos, downloaded, decoded, n_chars, n_conditions, failed) -> notice_id, pos, stage, code, status, message: what
    happened to each, the stages in order up to the one that failed."""
    def row(stage: str, code: str, status: str) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(MESSAGES[code]).alias("message"))

    none = F.filter(F.array(row("read", "document_read", "ok")), lambda _: F.lit(False))
    end = (
        F.when(~F.col("downloaded"), F.array(row("download", "document_download_failed", "error"))).when(~F.col("decoded"), F.array(row("read", "document_decode_failed", "error")))
        .when(F.col("n_chars") == 0, F.array(row("read", "document_no_text", "error"))).when(F.col("failed"), F.array(row("read", "document_read", "ok"), row("interpretation", "parser_failed", "error")))
        .when(F.col("n_conditions") > 0, F.array(row("read", "document_read", "ok"), row("interpretation", "conditions_parsed", "ok"))).otherwise(F.array(row("read", "document_read", "ok")))
    )
    return attachments.select("notice_id", "pos", F.inline(F.coalesce(end, none)))


def identity(url: Column, announced: Column, housing: Column, original: Column) -> Column:
    """struct by which a reading is recognised as one of the notice as it was: a change of amounts or receptions doesn't matter."""
    return F.struct(url.alias("url"), announced.alias("announced"), housing.alias("housing"), F.coalesce(original, announced).alias("original"))


def patched(current: DataFrame, read: DataFrame) -> DataFrame:
    """current (notice_id, document_hash, rules, prices), read (notice_id, document_hash, rules, prices, stale) -> current rows with the
    output of readings applied: outcome applied, stale or none.

    rules: array<struct<source, verification, kind, content>>, prices: array<struct<unit_type, verification, amount_krw>>. A stale reading changes
    nothing. Else its rules replace those of earlier readings (if it has more than diagnostics), diagnostics are always
    replaced, and after a change of the document rules and prices that nobody verified go. Official prices that were
    read replace those of their units.
    """
    r = read.select("notice_id", F.struct("document_hash", "rules", "prices", "stale").alias("_r"))
    rows = current.join(r, "notice_id", "left")
    digest = F.coalesce("_r.document_hash", "document_hash")
    # Columns of their own: within a lambda a name of the select below would stand for its new value.
    rows = rows.withColumns({"_changed": F.coalesce(digest != F.col("document_hash"), F.lit(False)), "_parsed": F.exists("_r.rules", lambda x: x["kind"] != "document_diagnostics")})
    changed, parsed = F.col("_changed"), F.col("_parsed")
    doubtful = lambda x: F.coalesce(x["verification"].isin(*UNVERIFIED), F.lit(False))
    of_parser = lambda x: F.coalesce(x["source"] == PARSER, F.lit(False))
    kept = F.filter("rules", lambda x: ~(parsed & of_parser(x)) & (x["kind"] != "document_diagnostics") & ~(changed & (of_parser(x) | doubtful(x))))
    official = F.filter("_r.prices", lambda p: p["verification"] == "official")
    units = F.transform(official, lambda p: p["unit_type"])
    prices = F.filter("prices", lambda p: ~(changed & doubtful(p)) & ~F.array_contains(units, p["unit_type"]))
    outcome = F.when(F.col("_r").isNull(), "none").when(F.coalesce("_r.stale", F.lit(False)), "stale").otherwise("applied")
    applied = outcome == "applied"
    return rows.select(
        "notice_id", F.when(applied, digest).otherwise(F.col("document_hash")).alias("document_hash"), F.when(applied, F.concat(kept, F.array_distinct("_r.rules"))).otherwise(F.col("rules")).alias("rules"),
        F.when(applied, F.concat(prices, official)).otherwise(F.col("prices")).alias("prices"), outcome.alias("outcome"),
    )


def reading_states(states: DataFrame | None, readings: DataFrame) -> DataFrame:
    """states (source, external_id, audited_on, deferred_until) or None, readings (source, external_id, status, stale, at) -> next states.

    The last reading of a key counts: a stale one is to be repeated at once, a deferred one after 3 hours, one over quota
    after 24, and any other is done for the day.
    """
    keys = ["source", "external_id"]
    last = readings.groupBy(*keys).agg(F.max_by(F.struct("status", "stale", "at"), F.struct("at", "status")).alias("r"))
    wait = F.lit(None).cast("timestamp")
    for status, period in WAITS.items():
        wait = F.when(F.col("r.status") == status, F.col("r.at") + F.expr(f"INTERVAL {period}")).otherwise(wait)
    new = last.select(*keys, F.struct(F.when(~F.col("r.stale"), F.col("r.at").cast("date")).alias("audited_on"), F.when(~F.col("r.stale"), wait).alias("deferred_until")).alias("n"))
    if states is None:
        return new.select(*keys, "n.*")
    rows = states.join(new, keys, "full_outer")
    return rows.select(*keys, *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("audited_on", "deferred_until")])


def due_readings(notices: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Notices (source, external_id, changed, ...) whose document is to be read: new or changed ones, those not read today, and those
    whose wait is over."""
    rows = notices.join(states, ["source", "external_id"], "left")
    waiting = F.coalesce(F.col("deferred_until") > now, F.lit(False))
    done = F.coalesce(F.col("audited_on") == now.cast("date"), F.lit(False)) & F.col("deferred_until").isNull()
    return rows.filter(F.col("changed") | (~waiting & ~done)).select(*notices.columns)


def cleaned_candidates(prices: DataFrame) -> DataFrame:
    """Prices that a model has read (unit_type, price_kind, amount_krw, monthly_krw: texts as given; basis_label, evidence_text) -> those
    that can be kept for review: of a known kind, whole and not negative, with what the kind needs and with evidence.

    Sales have no monthly rent; a deposit with one is a deposit with rent.
    """
    number = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.col(c).try_cast("long"))
    sound = lambda c: F.col(c).isNull() | number(c).isNotNull()
    kind, amount, monthly = F.lower("price_kind"), number("amount_krw"), number("monthly_krw")
    sale, evidence = kind.startswith("sale"), F.trim("evidence_text")
    needed = F.when(kind == "deposit_monthly", amount.isNotNull() | monthly.isNotNull()).otherwise(amount.isNotNull())
    rows = prices.filter(kind.isin("sale_max", "sale_total", "deposit", "deposit_monthly") & sound("amount_krw") & sound("monthly_krw") & needed & (evidence != ""))
    return rows.select(
        *[c for c in prices.columns if c not in ("unit_type", "price_kind", "amount_krw", "monthly_krw", "basis_label", "evidence_text")], F.substring(F.coalesce("unit_type", F.lit("미상")), 1, 100).alias("unit_type"),
        F.when((kind == "deposit") & monthly.isNotNull(), "deposit_monthly").otherwise(kind).alias("price_kind"), amount.alias("amount_krw"), F.when(~sale, monthly).alias("monthly_krw"),
        F.substring(F.coalesce("basis_label", F.lit("공고문 자동 추출")), 1, 120).alias("basis_label"), F.lit("auto_unverified").alias("verification"), F.substring(evidence, 1, 600).alias("evidence_text"),
    )
