"""Feeds as notices."""

from datetime import date

from pyspark.sql import functions as F

from noticeloom.sources.boards import link_corrections
from noticeloom.sources.feeds import NOTICE, board, capital_region, competition_rows, ih, lh, myhome, reb, reb_prices, reb_supplies, schedule, union, with_prices
from noticeloom.sources.reb_metadata import reb_with_rules


def frame(spark, *rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_reb(spark):
    details = frame(
        spark,
        {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "1", "HOUSE_NM": "가", "RCRIT_PBLANC_DE": "2026-01-02", "PARCPRC_ULS_AT": "Y", "SPSPLY_RCEPT_BGNDE": "20260110", "GNRL_RNK1_CRSPAREA_RCPTDE": "2026-01-11", "GNRL_RNK1_CRSPAREA_ENDDE": "2026-01-09", "CNTRCT_CNCLS_BGNDE": "2026-02-01"},
        {"HOUSE_MANAGE_NO": "2", "PBLANC_NO": "2", "HOUSE_NM": "나", "SUBSCRPT_RCEPT_BGNDE": "2026.03.01", "SEARCH_HOUSE_SECD": "0303"}, {"HOUSE_MANAGE_NO": "3", "PBLANC_NO": "3", "HOUSE_NM": "-"},
    )
    got = {r.external_id: r for r in reb(details, "op", "urban").collect()}
    assert set(got) == {"op:1:1", "op:2:2"} and got["op:2:2"].category == "private_rental" and got["op:2:2"].price_cap_status == "not_applicable"
    assert [(e.kind, str(e.start_date), e.end_date) for e in got["op:1:1"].events] == [("special", "2026-01-10", None), ("first_priority", "2026-01-11", None), ("contract", "2026-02-01", None)]
    assert [e.label for e in got["op:2:2"].events] == ["청약 접수"] and got["op:1:1"].price_cap_status == "yes"
    models = frame(spark, {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "1", "HOUSE_TY": "084.9A", "SUPLY_AMOUNT": "50,000", "EXCLUSE_AR": "84.9", "SUPLY_HSHLDCO": "3", "NWWDS_HSHLDCO": "0", "MNYCH_HSHLDCO": "x"}, {"HOUSE_MANAGE_NO": "2", "PBLANC_NO": "2", "TP": "B", "GP": "1", "SUPLY_AMOUNT": "100"}, {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "1", "HOUSE_TY": "C", "SUPLY_AMOUNT": "0"})
    assert sorted((r.unit_type, r.price_kind, r.amount_krw or -1) for r in reb_prices(details, models, "urban").collect()) == [("084.9A", "sale_max", 500_000_000), ("1 B", "deposit", -1), ("C", "sale_max", -1)]
    assert [(r.unit_type, r.supply_type, r.supply_count) for r in reb_supplies(details, models, "urban").collect()] == [("084.9A", "일반공급", 3)]


def test_feeds_go_into_the_store(spark):
    """Rows of every feed pass the store's checks and are stored, prices and all; a second poll changes nothing."""
    from noticeloom.operators.store import checked, upsert

    details = frame(spark, {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "1", "HOUSE_NM": "가", "RCRIT_PBLANC_DE": "2026-01-02", "SUBSCRPT_AREA_CODE": "100", "NSPRC_NM": "시행", "HMPG_ADRES": "https://h.example"})
    models = frame(spark, {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "1", "HOUSE_TY": "84A", "GP": "84A", "LTTOT_TOP_AMOUNT": "50,000", "SUPLY_AR": "112.5", "NEWBORN_HSHLDCO": "5", "TRANSR_INSTT_ENFSN_HSHLDCO": "7"})
    apt = with_prices(reb(details, "op", "apt"), reb_prices(details, models, "apt"))
    assert [(p.unit_type, p.area_sqm, p.amount_krw, p.verification) for p in apt.first().prices] == [("84A", 112.5, 500_000_000, "official")]
    assert (apt.first().provider, apt.first().region_code, apt.first().official_url, apt.first().price_cap_status) == ("시행", "100", "https://h.example", "unknown")
    assert sorted((r.supply_type, r.supply_count) for r in reb_supplies(details, models, "apt").collect()) == [("신생아 특별공급", 5), ("이전기관종사자 특별공급", 7)]
    others = [lh(frame(spark, {"PAN_NM": "행복", "PAN_ID": "7"}), "05"), ih(frame(spark, {"sj": "주택", "link": "https://x/1"})), myhome(frame(spark, {"pblancId": "5", "pblancNm": "다"}))]
    good, bad = checked(union(apt, *others))
    assert good.count() == 4 and bad.count() == 0
    now = F.lit("2026-01-03 00:00:00").cast("timestamp")
    state, revisions = upsert(None, good, now)
    assert revisions.count() == 4 and {r.source for r in state.collect()} == {"cheongyak_home", "lh", "ih", "myhome"}
    assert upsert(state, good, now)[1].count() == 0
    told, _ = checked(reb_with_rules(details, "op", "apt"))
    after, more = upsert(state, told, now)
    assert more.count() == 1 and len(after.filter("source = 'cheongyak_home'").first().rules) == 2
    assert after.filter("source = 'cheongyak_home'").first().prices  # the poll without prices keeps them
    assert upsert(after, good, now)[1].count() == 0  # and the one without rules keeps these


def test_others_and_union(spark):
    a = lh(frame(spark, {"PAN_NM": "행복", "DTL_URL": "https://x/?PAN_ID=77&aisTpCd=42", "UPP_AIS_TP_CD": "39", "PAN_NT_ST_DT": "2026.01.05"}), "05")
    b = ih(frame(spark, {"sj": "토지 공급", "link": "https://x/1"}, {"sj": "토지 위 주택", "link": "https://x/2", "seNm": "분양"}))
    c = myhome(frame(spark, {"pblancId": "5", "houseSn": "1", "pblancNm": "다", "beginDe": "20260101", "endDe": "20260103", "beforePblancId": "4"}))
    rows = union(a, b, c).collect()
    assert tuple(rows[0].asDict()) == NOTICE
    assert [(r.source, r.external_id[:4], r.category) for r in rows] == [("lh", "77", "public_rental"), ("ih", rows[1].external_id[:4], "public_sale"), ("myhome", "5:1", "public_sale")]
    assert rows[2].correction_of_external_id == "4"


def test_boards(spark):
    cell = "struct<class:string,text:string,hrefs:array<string>>"
    row = lambda title, day, href: [("", "1", []), ("", "주택", []), ("", title, [href]), ("", "", []), ("", day, [])]
    rows = spark.createDataFrame([(row("임대주택 입주자 모집", "26.01.05", "?articleNo=9"), "https://g.kr/b?x=1"), (row("행사", "26.01.05", "/a"), "https://g.kr/b"), ([("", "x", [])], "https://g.kr/b")], f"cells array<{cell}>, base_url string")
    got = board(rows, "gh", "GH", "경기도", 2, 4, "입주자|청약").collect()
    assert [(r.external_id, r.official_url, r.announcement_date, r.category) for r in got] == [("9", "https://g.kr/b?articleNo=9", date(2026, 1, 5), "public_rental")]


def test_corrections(spark):
    rows = spark.createDataFrame(
        [("gh", "1", "가 모집", date(2026, 1, 1)), ("gh", "2", "가 모집", date(2026, 1, 3)), ("gh", "3", "[정정] 가 모집", date(2026, 1, 5)), ("gh", "4", "(수정공고)가 모집", date(2026, 1, 1)), ("sh", "5", "[정정] 가 모집", date(2026, 1, 9))],
        "source string, external_id string, title string, announcement_date date",
    ).withColumn("category", F.lit("other")).withColumn("correction_of_external_id", F.lit(None).cast("string"))
    assert {r.external_id: r.correction_of_external_id for r in link_corrections(rows).collect()} == {"1": None, "2": None, "3": "2", "4": None, "5": None}


def test_results_and_regions(spark):
    rows = frame(spark, {"HOUSE_TY": " 084A ", "SUBSCRPT_RANK_CODE": "1", "RESIDE_SECD": "1", "REQ_CNT": "1,200", "SUPLY_HSHLDCO": "10", "CMPET_RATE": "(△3)"}, {"HOUSE_TY": "-"}, {"HOUSE_TY": "B", "SUBSCRPT_RANK_CODE": "7"})
    got = competition_rows(rows, "x").collect()
    assert [(r.unit_type, r.rank, r.residence_area, r.supply_count, r.application_count, r.competition_rate) for r in got] == [("084A", 1, "local", 10, 1200, "(△3)"), ("B", None, "unknown", None, None, "-")]
    names = spark.createDataFrame([("서울특별시 강남구",), ("부산",), ("어디",), (None,)], "n string")
    assert [r.c for r in names.select(capital_region(F.col("n")).alias("c")).collect()] == [True, False, None, None]
    day = spark.range(1).select(schedule(F.lit("2026년 1월 2일 ~ 2026년 1월 5일")).alias("s")).first().s
    assert (day.start_date, day.end_date) == (date(2026, 1, 2), date(2026, 1, 5))
