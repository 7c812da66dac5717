"""Table functions over HTML and documents; clauses."""

import io
import zipfile

from pyspark.sql import functions as F

from noticeloom.operators.clauses import application_method, contract_schedule, extract, sections
from noticeloom.sources.html import html_links, html_tables, hwpx_pages, pushed_objects, table_named

PAGE = """<table><tbody><tr class="x"><td>1<td class="t"><a href="/v?id=7">제목 &amp; 끝</a></td></tr><tr></tr></tbody></table>
<table id="compitTbl"><tr data-ty="084A"><td class="cpHouseTy">084A</td><td><table><tr><td>inner</td></tr></table>out</td></tr></table>"""


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tables(spark):
    got = first(spark, html_tables(F.lit(PAGE)))
    assert [(t.id, t.depth, t.closed, len(t.rows)) for t in got] == [(None, 1, True, 1), ("compitTbl", 1, True, 1), (None, 2, True, 1)]
    row = got[0].rows[0]
    assert row.attrs == {"class": "x"} and [c.text for c in row.cells] == ["1", "제목 & 끝"] and row.cells[1].hrefs == ["/v?id=7"]
    only = first(spark, table_named(html_tables(F.lit(PAGE)), "compitTbl"))
    assert only.rows[0].attrs == {"data-ty": "084A"} and [c.text for c in only.rows[0].cells] == ["084A", "out"]
    assert first(spark, table_named(html_tables(F.lit("<table><tr><td><table id='compitTbl'></table></table>")), "compitTbl")) is None  # within another
    assert first(spark, html_tables(F.lit(None).cast("string"))) == [] and not first(spark, html_tables(F.lit("<table><tr><td>x")))[0].closed


def test_links_and_scripts(spark):
    got = first(spark, html_links(F.lit('<a href="b?x=1">B <b>c</b></a><a>no</a><a href="http://h/z">z'), F.lit("https://h.org/a/")))
    assert [(r.href, r.label) for r in got] == [("https://h.org/a/b?x=1", "B c"), ("http://h/z", "z")]
    items = first(spark, pushed_objects(F.lit("""houseList.push({a:"1", 'b':'x y', c: 3}); suplyList.push({a:"2"});""")))
    assert [(r.name, r.item) for r in items] == [("houseList", {"a": "1", "b": "x y", "c": "3"}), ("suplyList", {"a": "2"})]


def test_hwpx(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in (10, 2):
            z.writestr(f"Contents/section{n}.xml", f"<s xmlns:h='u'><h:p><h:t>page {n}</h:t></h:p></s>")
        z.writestr("Contents/section11.xml", f"<s xmlns:h='u'><h:p><h:t>{'x' * 3_000_000}</h:t></h:p></s>")
    pages = first(spark, hwpx_pages(F.lit(bytearray(out.getvalue()))))
    assert pages[:2] == ["page 2", "page 10"] and len(pages[2]) == 3_000_000
    assert first(spark, hwpx_pages(F.lit(bytearray(b"no")))) == []


def test_clauses(spark):
    text = "머리\n[일반공급]\n거주기간 24개월 이상인 세대주로서 무주택세대구성원\n[특별공급]\n혼인기간 7년 이내, 자녀 2명 이상\n계약기간 : 2026.01.05 ~ 2026.01.07"
    pages = spark.createDataFrame([(1, 1, text)], "doc int, page int, text string")
    lines = extract(sections(pages, r"^\[(.+)\]$", ["doc"]))
    got = sorted((r.section or "", r.x.kind, r.x.value) for r in lines.select("section", F.explode("rules").alias("x")).collect())
    assert got == sorted([("일반공급", "residence_months", 24), ("일반공급", "household_head", 1), ("일반공급", "homeless", 1), ("특별공급", "marriage_months_max", 84), ("특별공급", "children_min", 2)])
    schedule = pages.select(contract_schedule(F.col("text")).alias("s")).first().s
    assert (schedule.basis, str(schedule.start), str(schedule.end)) == ("range", "2026-01-05", "2026-01-07")
    heads = spark.createDataFrame([(1, 1, "무순위 입주자 모집공고"), (2, 2, "입주자모집공고"), (3, 3, "선착순")], "doc int, page int, text string")
    assert {r.doc: r.method for r in application_method(heads, "doc").collect()} == {1: "unknown", 2: "unknown", 3: "unknown"}


def test_plain_pages_are_read_as_by_the_parser():
    import random

    from noticeloom.sources.html import TABLE, Tables, _plain, read_tables, table_arrays, tables_of

    def parsed(page):
        parser = Tables()
        parser.feed(page)
        parser.close()
        for x in parser.path:
            x.end_row()
        return [{"id": x.id, "depth": x.depth, "closed": x.closed, "rows": x.rows} for x in parser.found]

    plain = ["<table>", "<table id=t>", "</table>", "<tr data-ty='a b' X=\"Q\">", "<TR>", "</tr>", "<td>", "<td class=x>", "</td>", "<th checked>", "text ", "\n\t x", "<a href='u'>", "</a>", "</TBODY>", "<br>"]
    other = ["&amp;", "<br/>", "<!-- c -->", "<script>", "</script>", "<td class=a/>", "< td>", "<", "</td >", "<td class='a' class=b>", "<title>", "</>", "<td a= 'b'>", "<p.x>"]
    chance = random.Random(1)
    pages = ["".join(chance.choice(plain if chance.random() < 0.97 else other) for _ in range(chance.randint(0, 25))) for _ in range(3000)]
    assert [tables_of(x) for x in pages] == [parsed(x) for x in pages]
    assert any(_plain(x, {}) is None for x in pages) and any(_plain(x, {}) for x in pages)
    arrays = table_arrays([read_tables(x, {}) for x in pages])
    assert arrays.type.value_type == TABLE and arrays.to_pylist() == __import__("pyarrow").array([parsed(x) for x in pages], arrays.type).to_pylist()


def test_named_tables_of_many_pages_are_read_as_one_by_one(monkeypatch):
    import random

    import pyarrow as pa

    from noticeloom.sources import html

    plain = ["<table>", "</table>", "<tr data-ty='a b' X=\"Q\">", '<TR data-ty="7" x=\'"\'>', "</tr>", "<td>", "<td class=x>", '<td class="a b" id="t">', "</td>", "<th checked>", "text ", "\n\t x", "<b>", "한　글", "<a href='u'>", "</TBODY>", "<br>"]
    other = ["&amp;", "<br/>", "<!-- c -->", "<script>", "<td class=a/>", "< td>", "<", ">", "</td >", "<td class='a' class=b>", "</>", "<td a= 'b'>", "<>"]
    chance = random.Random(2)
    draw = lambda share: ["<table id=t>" * chance.randint(0, 1) + "".join(chance.choice(plain if chance.random() < share else other) for _ in range(chance.randint(0, 30))) for _ in range(2000)]
    for pages in (draw(0.98), ["", "x", "</table>", "<table id=t>", "&"], [""], []):
        got = html.named_tables(pa.array(pages, pa.string()), "t", ("data-ty", "x"))
        assert got.to_pylist() == [html._slow(x, "t", ("data-ty", "x")) for x in pages]
        assert got.slice(3, 2).equals(html.named_tables(pa.array(pages, pa.string()).slice(3, 2), "t", ("data-ty", "x")))
    monkeypatch.setattr(html, "read_tables", None)  # plain pages aren't read one by one
    assert html.named_tables(pa.array(["<table id=t><tr><td>1<td>a<b> b</b></table>", "<table id=t><tr x='1'><td class=\"c\">"]), "t", ("x",)).to_pylist() == [
        {"closed": True, "rows": [{"attrs": [None], "classes": ["", ""], "texts": ["1", "a b"]}]}, {"closed": False, "rows": [{"attrs": ["1"], "classes": ["c"], "texts": [""]}]}]


def test_result_pages_are_dealt_once_and_send_no_nested_cells(spark):
    from noticeloom.plans.catalogue import QUERIES

    for name in ("popup_checks", "popup_rows", "popup_scores", "popup_completeness"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan and "hrefs" not in plan


def test_complete_units(spark):
    from noticeloom.sources.popups import complete

    rows = [("84.A", 1, "local"), ("84a", 1, "other"), ("59", 1, "local"), ("59", 2, "other")]
    kind = "array<struct<unit_type:string,rank:int,residence_area:string>>"
    frame = spark.createDataFrame([(0, rows[:2], ["84A"]), (1, rows, ["84A", "59"]), (2, [*rows, ("59", 1, "other_gyeonggi")], ["8 4A", "59", ""]), (3, rows[:2], ["84A", "59"]), (4, rows[:2], []), (5, None, ["84A"]), (6, rows[:2], None), (7, [(None, 1, "local"), (None, 1, "other")], [None])], f"id int, r {kind}, e array<string>")
    assert [r.c for r in frame.select("id", complete(F.col("r"), F.col("e")).alias("c")).orderBy("id").collect()] == [True, False, True, False, False, False, False, False]


def test_whole_numbers(spark):
    from noticeloom.functions.text import integer

    texts = ["1,200", "0", "007", "12.0", "12.5", "", None, "-3", " 7 ", "1 2", "9" * 18, "9" * 19, "9" * 20, "x", "１", "5\n"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", integer(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [1200, 0, 7, 12, None, None, None, None, 7, None, 10**18 - 1, None, None, None, None, 5]
