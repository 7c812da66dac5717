"""Boards of landed pages, and statuses of sources over polls."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeloom.operators.statuses import updated, with_missing
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table
from noticeloom.sources.boards import collected, scanned

FIRST, LAST, MOST = date(1998, 1, 1), date(1998, 3, 1), 8
BOARDS = [("b0", "gh", True), ("b1", "gh", False), ("b2", "lh", False), ("b3", "sh", False), ("b4", "sh", False)]
EARLIER, NOW = datetime(1998, 4, 1, 6), datetime(1998, 4, 1, 9)
ROWS_SQL = """WITH r AS (SELECT o_orderkey AS id, 'b' || (o_orderkey % 5) AS board, CAST((o_orderkey // 5) % 8 + 1 AS INTEGER) AS page, CAST(DATE '1998-01-01' + CAST(o_custkey % 100 AS INTEGER) AS DATE) AS day, o_custkey AS c FROM orders),
kept AS (SELECT CASE board WHEN 'b1' THEN 'gh' ELSE 'sh' END AS source, board, page, id, day FROM r WHERE day <= DATE '1998-03-01' AND ((board = 'b1' AND page < 6) OR (board = 'b3' AND page < 5) OR (board = 'b4' AND (page < 3 OR (page = 3 AND c % 2 = 0)))))"""


def pages(spark, d):
    """Five boards of eight pages: b0 never ends, b1's sixth page says what the second does, b2's fourth failed, b3's fifth is empty, and half of
    b4's third is too old."""
    key = F.col("o_orderkey")
    board, page = F.concat(F.lit("b"), (key % 5).cast("string")), (F.floor(key / 5) % 8 + 1).cast("int")
    old = (key % 5 == 4) & (page == 3) & (F.col("o_custkey") % 2 == 1)
    day = F.when(old, F.lit(date(1995, 1, 1))).otherwise(F.date_add(F.lit(FIRST), (F.col("o_custkey") % 100).cast("int")))
    rows = table(spark, d, "orders").select(board.alias("board"), page.alias("page"), F.struct(key.cast("string").alias("title"), day.alias("day"), key.alias("id")).alias("row"))
    again = rows.filter((F.col("board") == "b1") & (F.col("page") == 2)).withColumn("page", F.lit(6))
    rows = rows.filter(~((F.col("board") == "b1") & (F.col("page") == 6))).unionByName(again)
    whole = rows.groupBy("board", "page").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    at = lambda b, p: (F.col("board") == b) & (F.col("page") == p)
    return whole.select("board", "page", at("b2", 4).alias("failed"), F.when(~at("b2", 4) & ~at("b3", 5), F.col("rows")).alias("rows"))


def _collected(spark, d):
    rows, outcomes = scanned(pages(spark, d), FIRST, MOST)
    boards = spark.createDataFrame(BOARDS, "board string, source string, optional boolean")
    return collected(rows, outcomes, boards, F.col("day").between(F.lit(FIRST), F.lit(LAST)), F.lit(NOW))


@query(f"{ROWS_SQL} SELECT * FROM kept")
def board_scans(spark, d):
    """Rows of boards' pages up to a repeated, an empty or a too old one; an optional board that failed only takes its own rows away."""
    rows, _ = _collected(spark, d)
    return rows.select("source", "board", "page", "id", "day")


@query(f"""{ROWS_SQL}, n AS (SELECT source, count(*) AS n FROM kept GROUP BY source), before AS (SELECT count(*) AS n FROM orders)
SELECT 'gh' AS source, 'partial' AS status, 'b0:limit' AS message, TIMESTAMP '1998-04-01 09:00:00' AS last_attempt_at, TIMESTAMP '1998-04-01 09:00:00' AS last_success_at, (SELECT n FROM n WHERE source = 'gh') AS record_count
UNION ALL SELECT 'sh', 'ok', NULL, TIMESTAMP '1998-04-01 09:00:00', TIMESTAMP '1998-04-01 09:00:00', (SELECT n FROM n WHERE source = 'sh')
UNION ALL SELECT 'lh', 'error', 'b2:failed', TIMESTAMP '1998-04-01 09:00:00', TIMESTAMP '1998-04-01 06:00:00', n FROM before
UNION ALL SELECT 'reb', 'error', 'nothing landed', TIMESTAMP '1998-04-01 09:00:00', NULL, NULL""")
def source_statuses(spark, d):
    """Two polls: what the second leaves of the first one's success, with an error for a source of which nothing landed."""
    first = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("record_count"))
    earlier = first.select(F.explode(F.array(F.lit("lh"), F.lit("gh"))).alias("source"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message"), "record_count", F.lit(EARLIER).alias("at"))
    _, polls = _collected(spark, d)
    return updated(updated(None, earlier), with_missing(polls, ["gh", "lh", "reb"], F.lit(NOW)))
