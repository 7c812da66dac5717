"""Merged notices, households, homes, regions, closures."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeloom.operators.competition import closures, combinations, decisions, first_rank, rank_months
from noticeloom.operators.merged import detail, listing, merged_competition, offered, positions, public
from noticeloom.operators.people import counts_as_home, homeless, households, region_match


def notices(spark):
    rows = [(1, "s", "a", None, None, None, "T1", "apt", "unknown", date(2026, 1, 1)), (2, "t", "b", 1, None, None, "T1", "apt", "yes", date(2026, 1, 1)), (3, "s", "c", None, None, None, "T3", "public_rental", "no", date(2026, 1, 2)), (4, "s", "d", None, 5, None, "T4", "apt", "no", date(2026, 1, 3)), (5, "s", "e", None, None, None, "T5", "apt", "no", date(2026, 1, 3))]
    return spark.createDataFrame(rows, "id int, source string, external_id string, duplicate_of_id int, correction_of_id int, correction_of_external_id string, title string, category string, price_cap_status string, announcement_date date").withColumn("last_seen_at", F.lit(datetime(2026, 1, 1)))


def test_merge_and_list(spark):
    events = spark.createDataFrame([(1, 0, "general", "접수", date(2026, 5, 1), None, None), (2, 0, "general", "접수", date(2026, 5, 1), None, None), (2, 1, "general", "접수", date(2026, 6, 1), None, None)], "notice_id int, pos int, kind string, label string, start_date date, end_date date, audience string")
    prices = spark.createDataFrame([(1, 0, "A", 84.0, "sale", 5, None, None, "ai_unverified"), (2, 0, "A", 84.0, "sale", 5, None, None, "official"), (1, 1, "A", 84.0, "sale", 0, None, None, "official"), (1, 2, "A", 84.0, "deposit", 9, None, None, "official")], "notice_id int, pos int, unit_type string, area_sqm double, price_kind string, amount_krw long, monthly_krw long, basis_label string, verification string")
    rules = spark.createDataFrame([(1, 0, '{"b":1,"a":2}'), (2, 0, '{"a":2, "b":1}'), (2, 1, '{"c":3}'), (1, 1, "x")], "notice_id int, pos int, rule string")
    args = (notices(spark), events, prices, rules)
    got = {r.id: r for r in public(*args).collect()}
    assert set(got) == {1, 3, 4}  # 5 is corrected by 4
    one = got[1]
    assert one.price_cap_status == "yes" and [str(e.start_date) for e in one.events] == ["2026-05-01", "2026-06-01"]
    assert [(p.price_kind, p.amount_krw, p.verification) for p in one.prices] == [("deposit", 9, "official"), ("sale", 0, "official"), ("sale", 5, "official")]
    assert one.rules == ['{"a":2,"b":1}', '{"c":3}'] and got[3].events is None
    page = listing(*args, first=date(2026, 6, 1), last=date(2026, 6, 30)).collect()
    assert [(r.id, str(r.sort_date), r.total) for r in page] == [(1, "2026-06-01", 1)]  # by its duplicate's event
    assert [r.id for r in listing(*args, exclude_rental=True).collect()] == [4, 1] and [r.id for r in listing(*args, cap_only=True).collect()] == [1]
    assert [r.id for r in detail(*args, 2).collect()] == [1]


def test_saved_results_are_not_hidden(spark):
    members = positions(notices(spark).withColumn("canonical_id", F.coalesce("duplicate_of_id", "id")))
    states = spark.createDataFrame([(1, "ok", datetime(2026, 1, 1), datetime(2026, 1, 1), True, False), (2, "pending", datetime(2026, 1, 9), None, False, True)], "notice_id int, status string, attempted_at timestamp, succeeded_at timestamp, complete boolean, proof_invalidated boolean")
    results = spark.createDataFrame([(1, "A", 3)], "notice_id int, unit_type string, supply_count int")
    row = merged_competition(members, states, results).filter("canonical_id = 1").first()
    assert row.competition.status == "ok" and len(row.competitions) == 1 and row.proof_invalidated


def test_inventory_null_and_empty(spark):
    rules = spark.createDataFrame([(1, 0, "일반", "A", 5, True), (1, 1, "일반", "A", 7, True), (2, 0, "일반", "A", 0, True), (3, 0, "일반", "A", 5, False)], "notice_id int, pos int, supply_type string, unit_type string, count long, official boolean")
    got = {r.notice_id: r.offered for r in offered(rules).collect()}
    assert [(x["supply_type"], x["count"]) for x in got[1]] == [("일반", 5)] and got[2] == [] and got[3] is None
    scopes = spark.createDataFrame([(1, "특별", None), (2, "특별", None), (3, "특별", None), (3, "특별", None)], "notice_id int, supply_type string, unit_type string")
    pairs = combinations(notices(spark), offered(rules), scopes).collect()
    assert sorted((r.notice_id, r.supply_type, r.unit_type) for r in pairs) == [(1, "일반", "A"), (3, "특별", None)]


def test_households(spark):
    profiles = spark.createDataFrame([("a", True, True, True, True), ("b", True, False, None, True), ("c", True, True, None, True), ("d", True, False, None, False), ("e", True, None, None, True)], "profile_id string, on_register boolean, has_spouse boolean, same_register boolean, roster_complete boolean")
    members = spark.createDataFrame([("a", "1", "spouse", "separate"), ("a", "2", "child", "applicant"), ("a", "3", "sibling", "applicant"), ("a", "4", "spouse_child", "spouse"), ("a", "5", "parent", "separate"), ("b", "1", "spouse_parent", "applicant"), ("c", "1", "spouse", "applicant"), ("c", "2", "spouse_child", "spouse")], "profile_id string, member_id string, relation string, register string")
    assert {r.profile_id: r["size"] for r in households(members, profiles).collect()} == {"a": 4, "b": None, "c": None, "d": None, "e": None}


def test_homes(spark):
    flags = ("capital rural_detached lived_and_moved first_domicile_inherited inherited_share developer sale_completed dormitory policy_home only_home ascendant gone_or_other_use unauthorised_old lawful_evidence "
             "residual_right_first auction_of_own_rental first_home_2024 public_rental elder_supply").split()
    plain = {f: False for f in flags} | {"kind": "apartment", "relation": "applicant", "acquired_by": "purchase", "acquired_on": date(2020, 1, 1), "disposed_on": None, "area_sqm": 84.0, "price_krw": 400_000_000, "age_years": 5, "owner_birth": date(1990, 1, 1), "noticed_on": None, "corrected_on": None, "tenant_months": 0, "today": date(2026, 12, 1)}
    cases = [({}, True), ({"kind": "officetel"}, False), ({"kind": None}, None), ({"acquired_on": date(2026, 8, 1)}, False), ({"disposed_on": date(2026, 1, 1)}, False), ({"only_home": True, "area_sqm": 18.0}, False),
             ({"only_home": True, "area_sqm": 59.0, "price_krw": 90_000_000}, False), ({"only_home": True, "area_sqm": 59.0, "price_krw": None}, None), ({"only_home": True, "area_sqm": 59.0, "price_krw": 90_000_000, "public_rental": True}, True),
             ({"ascendant": True, "owner_birth": date(1950, 1, 1)}, False), ({"ascendant": True, "owner_birth": date(1950, 1, 1), "elder_supply": True}, True), ({"dormitory": None}, None)]
    types = ", ".join(f"{k} {'boolean' if k in flags else 'date' if k.endswith('_on') or k in ('owner_birth', 'today') else 'double' if k == 'area_sqm' else 'long' if k in ('price_krw', 'age_years', 'tenant_months') else 'string'}" for k in plain)
    rows = spark.createDataFrame([(str(i), *{**plain, **c}.values()) for i, (c, _) in enumerate(cases)], f"profile_id string, {types}")
    home = {k: F.col(k) for k in plain}
    counted = counts_as_home(home, F.lit("2026-07-01").cast("date"))
    assert [r.c for r in rows.orderBy(F.col("profile_id").cast("int")).select(counted.alias("c")).collect()] == [w for _, w in cases]
    people = rows.select("profile_id").unionByName(spark.createDataFrame([("none",)], "profile_id string"))
    got = {r.profile_id: r.homeless for r in homeless(rows, people, counted).collect()}
    assert got["none"] is True and got["0"] is False and got["2"] is None and got["1"] is True


def test_regions(spark):
    day = lambda x: None if x is None else date.fromisoformat(x)
    cases = [(("11", "11680", None, None, "11", "11680", None, None), True), (("11", "11680", None, None, "26", None, None, None), False), (("41", None, None, None, "41", "41110", None, None), None), (("41", "41111", "41110", None, "41", "41110", None, None), True),
             (("41", "41110", None, None, "41", "41111", "41110", None), None), (("41", "41590", None, "2026-05-01", "41", "41110", None, None), None), (("11", None, None, None, "11", None, None, None), True), ((None, None, None, None, "11", None, None, None), None)]
    rows = spark.createDataFrame([(i, *c[:3], day(c[3]), *c[4:7], day(c[7])) for i, (c, _) in enumerate(cases)], "i int, hp string, h string, hpar string, hs date, tp string, t string, tpar string, ts date")
    match = region_match(*[F.col(x) for x in ("hp", "h", "hpar", "hs", "tp", "t", "tpar", "ts")], F.lit(date(2026, 1, 1)))
    assert [r.m for r in rows.orderBy("i").select(match.alias("m")).collect()] == [w for _, w in cases]


def test_closures_and_decisions(spark):
    now = F.lit(datetime(2026, 1, 5, 12))
    at, old = datetime(2026, 1, 5, 11), datetime(2026, 1, 5, 1)
    kind = "notice_id int, unit_type string, rank int, residence_area string, supply_type string, verification string, evidence_url string, observed_at timestamp, result_status string, result_text string, supply_count long, application_count long"
    base = (1, "local", "general", "official", "u")
    rows = spark.createDataFrame([
        (1, "A", *base, at, "local_first_closed", None, 1, 1), (1, "B.", *base, at, "first_closed", "1순위 마감(청약접수종료)", 5, 9), (1, "C", *base, at, "first_closed", "1순위 마감(청약접수종료)", 5, 4),
        (2, "A", *base, old, "local_first_closed", None, 1, 1), (3, "A", *base, at, "unknown", "9999.9", 1, 9999)], kind)
    full = spark.createDataFrame([(1, None, 100)], "notice_id int, unit string, percent int")
    closed = closures(rows, full, now)
    assert sorted((r.notice_id, r.unit, r.proof) for r in closed.collect()) == [(1, "A", "local_first_closed"), (1, "B", "all_local_first")]
    assert closures(rows, full, now, live=False).count() == 3 and closures(rows, full.limit(0), now).count() == 1
    units = spark.createDataFrame([(1, "A"), (1, "b")], "notice_id int, unit_type string")
    states = spark.createDataFrame([(1, "ok", True, False, at, at)], "notice_id int, status string, complete boolean, proof_invalidated boolean, attempted_at timestamp, succeeded_at timestamp")
    people = spark.createDataFrame([("x", 1, "other", "first"), ("y", 1, "local", "first"), ("z", 1, "other", "unknown")], "profile_id string, notice_id int, area string, rank string")
    got = {r.profile_id: (r.closed_units, r.all_closed) for r in decisions(people, units, closed, states, now).collect()}
    assert got == {"x": (["A", "B"], True), "y": ([], False), "z": ([], False)}


def test_ranks(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    got = spark.range(1).select(*[rank_months(*x).alias(str(i)) for i, x in enumerate([(t, f, t), (f, t, t), (f, f, t), (f, f, f), (f, f, n), (n, f, t)])]).first()
    assert tuple(got) == (24, 1, 12, 6, None, None)
    rows = [("a", 1, k, "pass", True) for k in ("subscription_months", "deposit_min_krw", "account_type")] + [("b", 1, "account_type", "pass", True)] + [("c", 1, k, "pass" if k != "account_type" else "review", True) for k in ("subscription_months", "deposit_min_krw", "account_type")]
    out = first_rank(spark.createDataFrame(rows, "profile_id string, notice_id int, kind string, result string, covered boolean")).collect()
    assert {r.profile_id: r["rank"] for r in out} == {"a": "first", "b": "unknown", "c": "unknown"}
