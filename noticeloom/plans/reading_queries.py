"""Documents: wordings over lines with their spans, method, cut-off and criterion day in a row, one whole reading."""

from datetime import datetime

from pyspark.sql import functions as F

from noticeloom.functions.dates import criterion_day
from noticeloom.operators import clauses, documents
from noticeloom.operators.reading import read_notices
from noticeloom.operators.wordings import conditions
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table

#: Sections of documents as lines of pages, and what they say: kind, value, the words, and the exemptions of the clause.
SAID = (
    ("신혼부부", ((1, "■ 입주자모집공고일 현재 경기도에"), (1, "거주하는 무주택세대"), (2, "구성원으로서 (예비신혼부부는"), (2, "혼인으로 구성될 세대) 신청 가능")),
     (("residence_region", 1, "입주자모집공고일 현재 경기도에 거주", ()), ("homeless", 1, "무주택세대 구성원", (("planned_household", "예비신혼부부"),)))),
    ("생애최초", ((3, "① 세대구성원 모두 과거 주택을"), (3, "소유한 사실이 없는 분 (혼인신고일"), (3, "이전 배우자의 주택은 제외)"), (4, "② 5년 이상"), (4, "소득세를 납부한 분으로 세액공제로"), (4, "납부할 세액이 없는 경우 포함")),
     (("never_owned_home", 1, "세대구성원 모두 과거 주택을 소유", (("spouse_before_marriage", "혼인신고일 이전"),)), ("tax_years_min", 5, "5년 이상 소득세", (("tax_relief", "세액공제"),)))),
    ("일반", ((1, "만 19세 이상인 분 또는"), (1, "세대주인 미성년자 (자녀를 양육하는"), (1, "경우) 신청 가능하며"), (1, "■ 외국인은 청약이"), (2, "불가하고 청약통장 가입여부와"), (2, "관계없이 신청")),
     (("adult_or_minor_head", 19, "만 19세 이상인 분 또는 세대주인 미성년자 (자녀를 양육하는 경우)", ()), ("citizenship", 1, "외국인은 청약이 불가", ()), ("account_not_required", 1, "청약통장 가입여부와 관계없이", ()))),
    ("일반", ((2, "■ 대한민국에 거주하는 만"), (2, "19세 이상인 자로서 거주지역에"), (3, "관계없이 신청하며 주택소유여부를"), (3, "불문합니다 무주택세대구성원이"), (3, "아니어도 됩니다")),
     (("domestic_adult", 19, "대한민국에 거주하는 만 19세 이상인 자", ()), ("region_unrestricted", 1, "거주지역에 관계없이", ()), ("ownership_unrestricted", 1, "주택소유여부를 불문", ()), ("homeless", 1, "무주택세대구성원", ()))),
    ("신생아", ((1, "① 2세 미만(2세가 되는 날을 포함)의"), (1, "자녀(태아를 포함)가 있는 분"), (1, "② 미성년인 자녀가"), (2, "3명 이상이고 혼인기간이"), (2, "7년 이내인 분")),
     (("newborn_children_min", 1, "2세 미만(2세가 되는 날을 포함)의 자녀(태아를 포함)", (("pregnancy", "태아"),)), ("children_min", 3, "미성년인 자녀가 3명 이상", ()), ("marriage_months_max", 84, "혼인기간이 7년 이내", ()))),
    ("노부모", ((5, "■ 65세 이상의 직계존속을"), (5, "3년 이상 계속하여"), (5, "부양하고 입주자모집공고일 현재"), (6, "서울특별시에 2년 이상"), (6, "거주(10년 이상 장기복무 군인 제외)하며"), (6, "과거 5년 이내 당첨된 자의"), (6, "세대에 속하지 않을 것")),
     (("parent_support_months_min", 36, "직계존속을 3년 이상 계속하여 부양", ()), ("residence_region", 1, "입주자모집공고일 현재 서울특별시에 2년 이상 거주", (("long_service", "10년 이상 장기복무"),)), ("previous_winning_years", 5, "과거 5년 이내 당첨된 자의 세대에 속하지 않", ()))),
    ("일반", ((1, "■ 입주자모집공고일 현재 전국에"), (1, "거주하는   무주택세대구성원"), (1, ""), (1, "■ 청약예금에 가입하여"), (2, "24개월 이상 경과하고 12개월 이상"), (2, "계속하여 거주한 분")),
     (("nationwide_residence", 1, "입주자모집공고일 현재 전국에 거주하는 무주택세대구성원", ()), ("subscription_months", 24, "청약예금에 가입하여 24개월 이상", ()), ("residence_months", 12, "12개월 이상 계속하여 거주", ()))),
)


def _expected() -> str:
    """The rows of SAID in SQL: spans are where the words stand in the joined lines."""
    rows = []
    for k, (section, lines, said) in enumerate(SAID):
        places, text = [], ""
        for i, (page, line) in enumerate(lines):
            line = " ".join(line.split())
            if line:
                places.append((len(text), page, i))
                text += line + " "
        for kind, value, words, freed in said:
            start = text.index(words)
            _, page, line = [p for p in places if p[0] <= start][-1]
            free = ",".join(f"{e}:{text.index(w)}:{text.index(w) + len(w)}" for e, w in freed)
            rows.append(f"({k}, '{section}', '{kind}', {value}, {page}, {line}, {start}, {start + len(words)}, '{free}')")
    return ", ".join(rows)


@query(f"""SELECT o_orderkey AS notice_id, section, kind, CAST(value AS BIGINT) AS value, CAST(page + o_custkey % 3 AS INTEGER) AS page, line, start, "end", exemptions
FROM orders JOIN (VALUES {_expected()}) AS v(k, section, kind, value, page, line, start, "end", exemptions) ON v.k = o_orderkey % {len(SAID)}""")
def wording_spans(spark, d):
    """Twenty wordings that go over lines and pages, with page, line, span and exemptions."""
    lines = F.array(*[F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("page"), F.lit(i).alias("line"), F.lit(t).alias("text")) for i, (p, t) in enumerate(ls)]) for s, ls, _ in SAID])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("notice_id"), (F.col("o_custkey") % 3).alias("more"), F.inline(F.element_at(lines, (F.col("o_orderkey") % len(SAID) + 1).cast("int"))))
    found = conditions(rows.withColumn("page", (F.col("page") + F.col("more")).cast("int")), ["notice_id"])
    free = F.array_join(F.transform("exemptions", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select("notice_id", "section", "kind", "value", "page", "line", "start", "end", free.alias("exemptions"))


SHIFT = 10_227  # days from the tables' years to this one's


@query("""WITH o AS (SELECT o_orderkey AS notice_id, o_orderkey % 5 AS k, o_custkey % 5 AS c, CAST(o_orderdate AS DATE) AS d FROM orders),
m AS (SELECT *, CASE k WHEN 0 THEN 'unranked_after' WHEN 1 THEN 'officetel' WHEN 2 THEN 'unknown' WHEN 3 THEN 'optional_supply' ELSE 'cancelled_resupply' END AS method, CASE k WHEN 0 THEN CASE WHEN c < 4 THEN d + 1 END WHEN 1 THEN d WHEN 2 THEN d WHEN 4 THEN d + 3 END AS cutoff FROM o)
SELECT notice_id, method, CAST(cutoff AS DATE) AS cutoff, CAST(CASE WHEN k = 3 OR (k = 0 AND c = 4) THEN d - 30 ELSE cutoff END AS DATE) AS criterion, CASE WHEN k % 2 = 0 AND c > 0 THEN CASE WHEN k = 2 THEN 'fixed' ELSE 'range' END END AS basis,
  CASE WHEN k % 2 = 0 AND c > 0 THEN CAST(d + 20 AS DATE) END AS contract_start, CASE WHEN k % 2 = 0 AND c > 0 THEN CAST(CASE WHEN k = 2 THEN d + 20 ELSE d + 23 END AS DATE) END AS contract_end FROM m""")
def method_cutoff_criterion(spark, d):
    """Method by heading, cut-off day by the method, the day on which rules are judged, and the contract's days, of flattened tables too.

    A fifth of the unranked documents hold two tables that differ, and so do a fifth of the contracts.
    """
    k, c, day = F.col("o_orderkey") % 5, F.col("o_custkey") % 5, F.date_add(F.col("o_orderdate").cast("date"), SHIFT)
    at = lambda n, form="yyyy.MM.dd": F.date_format(F.date_add(day, n), form)
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    schedule = lambda n: said("안내 ■ 구분 최초\n무순위 사후 입주자모집공고일 일정 (월) (화) ", at(n - 20), " ", at(n), " ", at(n + 9))
    first = (
        F.when(k == 0, "무순위(사후)\n입주자 모집공고").when(k == 1, said("오피스텔 분양공고 분양광고일 (", at(0, "yyyy/MM/dd"), ")")).when(k == 2, "OO 아파트 입주자모집공고 (선착순 계약은 따로 안내)".replace("(선착순 계약", "(추후 계약"))
        .when(k == 3, "임의공급 입주자 모집공고").otherwise("계약취소 주택 재공급 입주자모집공고")
    )
    second = F.when(k == 0, schedule(1)).when(k.isin(2, 3), said("이 주택의 최초 입주자모집공고일은 ", at(0, "yyyy년 M월 d일"))).when(k == 4, said("계약취소 주택 재공급 입주자모집공고일은 ", at(3))).otherwise("선착순 계약")
    third = F.when((k == 0) & (c == 4), schedule(2)).otherwise("유의사항")
    end = F.when(k == 2, F.lit("")).otherwise(said(" ~ ", at(23, "yyyy.M.d"), "(수)"))
    steps = lambda n: said("■ 구분 모집공고 청약접수 당첨자 발표\n계약체결 일정 ", at(0), " ", at(5), "(월) ~ ", at(6, "yyyy.M.d"), " ", at(9), " ", at(20 + n), F.when(F.lit(n) == 0, end).otherwise(F.lit("")), " 장소 현장")
    fourth, fifth = F.when(k % 2 == 0, steps(0)).otherwise("끝"), F.when((k % 2 == 0) & (c == 0), steps(1)).otherwise("끝")
    pages = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("notice_id"), F.date_sub(day, 30).alias("announced"), F.posexplode(F.array(first, second, third, fourth, fifth)).alias("page", "text")
    ).withColumn("page", F.col("page") + 1)
    # A row for each notice packs well, so Spark would take such tables for small ones and send them through the driver.
    methods = clauses.application_method(pages, "notice_id").hint("merge")
    cut = documents.cutoffs(pages.join(methods, "notice_id"), "method").select("notice_id", F.col("day").alias("cutoff")).hint("merge")
    rows = pages.select("notice_id", "announced").distinct().join(methods, "notice_id").join(cut, "notice_id", "left").join(documents.contract_tables(pages).hint("merge"), "notice_id", "left")
    ranked, none = F.col("method") == "unknown", F.lit(None)
    when = criterion_day(none.cast("string"), none.cast("string"), F.col("start"), F.when(ranked, F.col("cutoff")), F.col("method"), F.when(~ranked, F.col("cutoff")), F.col("announced"), F.lit(None).cast("date"))
    back = lambda x: F.date_sub(x, SHIFT)
    return rows.select("notice_id", "method", back("cutoff").alias("cutoff"), back(when).alias("criterion"), "basis", back("start").alias("contract_start"), back("end").alias("contract_end"))


AT = datetime(2026, 1, 5, 9, 0)


@query("""WITH o AS (SELECT o_orderkey AS n, o_orderkey % 6 AS k, o_custkey AS c, CASE WHEN o_orderkey % 6 = 3 THEN 0 WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS best, o_custkey % 7 = 0 AS stale FROM orders),
a AS (SELECT o.*, pos, CASE WHEN pos = 0 THEN CASE k WHEN 0 THEN 'download:document_download_failed' WHEN 1 THEN 'read:document_decode_failed' WHEN 2 THEN 'read:document_read' WHEN 3 THEN 'read:document_read,interpretation:conditions_parsed' WHEN 4 THEN 'read:document_no_text' ELSE 'read:document_read,interpretation:parser_failed' END
  WHEN pos = best THEN 'read:document_read,interpretation:conditions_parsed' ELSE 'read:document_read' END AS told FROM o, (VALUES (0), (1), (2)) AS p(pos) WHERE pos <= best),
t AS (SELECT n, string_agg(pos || '=' || told, ' ' ORDER BY pos) AS diagnostics FROM a GROUP BY n)
SELECT o.n AS notice_id, CASE WHEN stale THEN 'stale' ELSE 'applied' END AS outcome, CASE WHEN stale THEN 'old' ELSE 'h' || best END AS document_hash,
  CASE WHEN stale THEN 'age_min,homeless' ELSE CASE best WHEN 0 THEN 'document_diagnostics,homeless,tax_years_min' WHEN 1 THEN 'children_min,document_diagnostics,homeless,marriage_months_max' ELSE 'document_diagnostics,homeless,residence_months' END END AS kinds, diagnostics,
  CASE WHEN NOT stale THEN DATE '2026-01-05' END AS audited_on, CASE WHEN NOT stale AND o.n % 11 = 0 THEN TIMESTAMP '2026-01-05 12:00:00' WHEN NOT stale AND o.n % 11 = 1 THEN TIMESTAMP '2026-01-06 09:00:00' END AS deferred_until FROM o JOIN t USING (n)""")
def notice_readings(spark, d):
    """Landed attachments in; patched rows, diagnostics and the next reading out."""
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    page = lambda *xs: F.array(F.struct(F.lit(1).alias("page"), F.lit("\n".join(xs)).alias("text")))
    nothing, silent = F.array().cast("array<struct<page:int,text:string>>"), page("안내문", "연락처")
    good = (page("[생애최초]", "5년 이상", "소득세를 납부한 분"), page("[다자녀]", "미성년 자녀가 2명", "이상이고 혼인기간", "7년 이내"), page("12개월 이상", "거주한 분"))
    row = lambda pos, downloaded, decoded, failed, pages: F.struct(F.lit(pos).alias("pos"), F.lit(f"h{pos}").alias("document_hash"), downloaded.alias("downloaded"), decoded.alias("decoded"), failed.alias("failed"), pages.alias("pages"))
    yes, no = F.lit(True), F.lit(False)
    listed = F.array(
        row(0, k != 0, ~k.isin(0, 1), k == 5, F.when(k.isin(0, 1), nothing).when(k == 3, good[0]).when(k == 4, page(" ")).when(k == 5, good[1]).otherwise(silent)),
        row(1, yes, yes, no, F.when(c % 2 == 0, good[1]).otherwise(silent)), row(2, yes, yes, no, good[2]),
    )
    url = lambda x: documents.identity(x, F.col("o_orderdate").cast("date"), F.lit("private"), F.lit(None).cast("date"))
    orders = table(spark, d, "orders")
    deferral = F.when(F.col("o_orderkey") % 11 == 0, "deferred").when(F.col("o_orderkey") % 11 == 1, "quota")
    attachments = orders.select(F.col("o_orderkey").alias("notice_id"), F.lit("s").alias("source"), F.col("o_orderkey").alias("external_id"), deferral.alias("deferral"), url(F.when(c % 7 == 0, "before").otherwise("now")).alias("seen"), F.inline(listed))
    rule = lambda source, kind: F.struct(F.lit(source).alias("source"), F.lit("official").alias("verification"), F.lit(kind).alias("kind"), F.lit("{}").alias("content"))
    current = orders.select(
        F.col("o_orderkey").alias("notice_id"), F.lit("old").alias("document_hash"), F.array(rule("feed", "homeless"), rule(documents.PARSER, "age_min")).alias("rules"),
        F.array().cast("array<struct<unit_type:string,verification:string,amount_krw:long>>").alias("prices"), url(F.lit("now")).alias("identity"),
    )
    rows, told, states = read_notices(attachments, current, None, F.lit(AT))
    told = told.groupBy("notice_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("stage") == "interpretation", 1).otherwise(0).alias("i"), F.concat_ws(":", "stage", "code").alias("t")))), lambda x: x["t"]), ",").alias("t"))
    told = told.groupBy("notice_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("=", F.col("pos").cast("string"), "t").alias("t")))), lambda x: x["t"]), " ").alias("diagnostics"))
    kinds = F.array_join(F.array_sort(F.transform("rules", lambda r: r["kind"])), ",")
    out = rows.select("notice_id", "outcome", "document_hash", kinds.alias("kinds")).join(told, "notice_id")
    return out.join(states.withColumnRenamed("external_id", "notice_id").drop("source"), "notice_id")
