"""Documents' links and files, deposits by region, lines of supplies, audits and cleared proofs."""

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from noticeloom.operators import store
from noticeloom.operators.evaluation import compared
from noticeloom.operators.lookups import deposit_required
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table
from noticeloom.session import ensure_checkpoint_dir
from noticeloom.sources import html


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 4 AS k, CAST(o_orderkey AS VARCHAR) AS t FROM orders)
SELECT page_id, CASE k WHEN 3 THEN '' ELSE 'https://files.apply.example/' || t || '.pdf' || CASE k WHEN 0 THEN '' WHEN 1 THEN ',https://apply.example/download?id=' || t ELSE ',https://apply.example/b.hwp' END END AS links FROM o""")
def notice_documents(spark, d):
    """Links to documents on trusted hosts: by name, by label and target; repeats, other papers and other hosts go."""
    k, t = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    body = said(
        '<a href="https://files.apply.example/', t, '.pdf">문서</a><a href="https://files.apply.example/', t, '.pdf">다시</a><a href="https://apply.example.evil.example/x.pdf">모집공고</a><a href="/a.hwp">위임장</a>',
        F.when(k == 1, said('<a href="/download?id=', t, '">모집공고문</a><a href="/view?id=1">모집공고문</a>')).otherwise(""), F.when(k == 2, '<a href="/b.hwp">분양신청서 공고</a><a href="mailto:x@y.z">공고문 file</a>').otherwise(""),
    )
    base = F.when(k == 3, "https://other.example/list").otherwise("https://apply.example/list")
    links = html.document_links(body, base, ("apply.example",))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.array_join(links, ",").alias("links"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '이름 ' || c_name || chr(10) || '주소 ' || c_nationkey || '|' || c_mktsegment END AS pages FROM customer""")
def zipped_documents(spark, d):
    """Word-processor files as zipped sections, one for each customer, read in the sections' numeric order; a fifth is no such file."""

    def files(batches):
        for batch in batches:
            out = []
            for name, nation, segment, number in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 0)), strict=True):
                whole = io.BytesIO()
                with zipfile.ZipFile(whole, "w") as z:
                    z.writestr("Contents/section10.xml", f"<s xmlns:h='u'><h:p><h:t>{segment}</h:t></h:p></s>")
                    z.writestr("Contents/section2.xml", f"<s xmlns:h='u'><h:p><h:run><h:t>이름 </h:t></h:run><h:t>{name}</h:t></h:p><h:p/><h:p><h:t>주소 {nation}</h:t></h:p></s>")
                out.append(b"%PDF-1.7" if number % 5 == 0 else whole.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment").mapInArrow(files, "doc_id long, content binary")
    return rows.select("doc_id", F.array_join(html.hwpx_pages(F.col("content")), "|").alias("pages"))


TIERS = {"seoul_busan": [(85, 300), (102, 600), (None, 1500)], "other_metropolitan": [(85, 250), (102, 400), (None, 1000)], "other": [(85, 200), (102, 300), (None, 500)]}


@query("""WITH c AS (SELECT c_custkey AS profile_id, CASE c_nationkey % 5 WHEN 0 THEN '11' WHEN 1 THEN '28' WHEN 2 THEN '41' WHEN 3 THEN '99' END AS region, c_custkey % 4 AS k FROM customer)
SELECT profile_id, CAST(CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN NULL ELSE CASE region WHEN '11' THEN CASE k WHEN 0 THEN 300 ELSE 1500 END WHEN '28' THEN CASE k WHEN 0 THEN 250 ELSE 1000 END WHEN '41' THEN CASE k WHEN 0 THEN 200 ELSE 500 END END END AS BIGINT) AS required FROM c""")
def deposits_by_region(spark, d):
    """Tiers by area and region: two areas of one tier, one of the last, two of different tiers, and one that isn't known."""
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey") % 5
    areas = F.when(k == 0, F.array(F.lit(59.9), F.lit(85.0))).when(k == 1, F.array(F.lit(102.1))).when(k == 2, F.array(F.lit(84.0), F.lit(101.0))).otherwise(F.array(F.lit(84.0), F.lit(None).cast("double")))
    region = F.when(n == 0, "11").when(n == 1, "28").when(n == 2, "41").when(n == 3, "99")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), deposit_required(areas, region, TIERS).alias("required"))


@query("""WITH l AS (SELECT l_orderkey AS n, CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'pass' ELSE 'review' END AS result, l_suppkey % 3 = 0 AND l_returnflag = 'N' AS missing, l_suppkey % 10 AS rule FROM lineitem),
r AS (SELECT DISTINCT n, rule, result, missing FROM l), s AS (SELECT n, bool_or(result = 'fail') AND n % 3 = 0 AS mismatch, n % 3 = 1 AND bool_and(result = 'pass') AS possible, count(*) FILTER (WHERE missing) AS m, count(*) FILTER (WHERE result = 'pass') AS p FROM r GROUP BY n)
SELECT n AS notice_id, CASE WHEN mismatch THEN 'mismatch' WHEN possible THEN 'possible' WHEN m > 0 THEN 'missing' WHEN p > 0 THEN 'passed' ELSE 'none' END AS code, CAST(CASE WHEN mismatch OR possible THEN NULL WHEN m > 0 THEN m WHEN p > 0 THEN p END AS INTEGER) AS n FROM s""")
def compared_conditions(spark, d):
    """What the line of a supply says: decided, so many answers missing, so many conditions that hold."""
    flag = F.col("l_returnflag")
    result = F.when(flag == "R", "fail").when(flag == "A", "pass").otherwise("review")
    reason = F.struct((F.col("l_suppkey") % 10).alias("rule_id"), result.alias("result"), ((F.col("l_suppkey") % 3 == 0) & (flag == "N")).alias("missing"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.collect_list(reason).alias("reasons"))
    k = F.col("notice_id") % 3
    mismatch, possible = F.exists("reasons", lambda r: r["result"] == "fail") & (k == 0), (k == 1) & F.forall("reasons", lambda r: r["result"] == "pass")
    return rows.select("notice_id", compared(F.when(mismatch, "mismatch").when(possible, "possible").otherwise("review"), F.col("reasons")).alias("c")).select("notice_id", "c.*")


@query("""SELECT o_orderpriority AS source, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'stale' ELSE 'none' END AS outcome, count(*) AS n FROM orders GROUP BY 1, 2""")
def audit_summary(spark, d):
    """An audit is written as JSON and its summary read back."""
    outcome = F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "O", "stale").otherwise("none")
    folder = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    store.audit(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), outcome.alias("outcome")), folder)
    return spark.read.schema("source string, outcome string, count long").json(f"{folder}/summary").withColumnRenamed("count", "n")


@query("""SELECT o_orderkey AS id, o_orderkey % 2 = 0 AND NOT (o_custkey % 3 = 0 AND o_orderkey % 5 > 0) AS proof_invalidated FROM orders""")
def cleared_proofs(spark, d):
    """Proofs that a correction made invalid hold again after a result that was accepted; stale and failed ones clear nothing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders")
    states = orders.select(k.alias("notice_id"), F.lit(2).alias("version"))
    rows = F.when(k % 5 > 0, F.array(F.lit("row")))
    results = orders.select(k.alias("notice_id"), F.when(c % 3 == 1, 1).otherwise(2).alias("expected_version"), F.when(c % 3 == 2, F.lit(None).cast("array<string>")).otherwise(rows).alias("rows"), F.lit(True).alias("complete"), F.lit(None).cast("timestamp").alias("attempted_at"))
    return store.after_results(orders.select(k.alias("id"), (k % 2 == 0).alias("proof_invalidated")), store.competition_result(states, results)).select("id", "proof_invalidated")
