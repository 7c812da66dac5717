"""Pages, documents, URLs, JSON fields and key functions."""

from pyspark.sql import functions as F

from noticeloom.functions.text import canonical_unit, decimal_number, integer, manwon_to_krw, unit_key, url_host, yes_no
from noticeloom.operators.clauses import sections
from noticeloom.plans.registry import query
from noticeloom.plans.tables import table
from noticeloom.sources.html import html_links as links_of


@query(r"""SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS n FROM pages""".replace("AS h,", "AS hrefs,"))
def html_links(spark, d):
    hrefs = F.transform("links", lambda x: x["href"])
    rows = table(spark, d, "pages").select("page_id", links_of(F.col("html"), F.lit(None).cast("string")).alias("links"))
    return rows.select("page_id", hrefs.alias("hrefs"), F.size("links").cast("long").alias("n"))


@query(r"""WITH found AS (SELECT page_id, regexp_extract_all(html, '<li>(?:<a[^>]*>)?([^<]*)', 1) AS items FROM pages)
SELECT page_id, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS position, unnest(items) AS item FROM found""")
def html_items(spark, d):
    items = F.regexp_extract_all("html", F.lit("<li>(?:<a[^>]*>)?([^<]*)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(items).alias("position", "item"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) = 'example.com' OR lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) LIKE '%.example.com' AS trusted FROM pages""")
def url_parts(spark, d):
    from noticeloom.functions.text import trusted_url

    return table(spark, d, "pages").select("page_id", url_host(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"), trusted_url(F.col("url"), ("example.com",)).alias("trusted"))


HEADING = r"^(\S{1,4})\.$"


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
marked AS (SELECT *, count(CASE WHEN regexp_matches(text, '^([^ \t\n\f\r]{1,4})\.$') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS grp FROM lines)
SELECT doc_id, section, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
  SELECT *, first_value(CASE WHEN regexp_matches(text, '^([^ \t\n\f\r]{1,4})\.$') THEN left(text, length(text) - 1) END) OVER (PARTITION BY doc_id, grp ORDER BY line) AS section FROM marked) AS x
GROUP BY doc_id, section, grp HAVING section IS NOT NULL""")
def text_section_segmentation(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents").withColumn("page", F.lit(1))
    lines = sections(docs, HEADING, ["doc_id"])
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("grp", F.count(F.when(F.col("text").rlike(HEADING), 1)).over(w)).filter("section IS NOT NULL")
    return lines.groupBy("doc_id", "section", "grp").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars")).drop("grp")




@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def json_variant_fields(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), F.to_json(v).alias("canonical"))


@query(r"""SELECT p_partkey, upper(regexp_replace(p_name || '.' || p_brand, '[.\s]', '', 'g')) AS unit, lpad(CAST(p_size + 50 AS VARCHAR), 3, '0') || '.' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || 'A' AS canonical,
  CASE upper(trim(substr(p_type, 1, 1))) WHEN 'Y' THEN TRUE WHEN 'N' THEN FALSE END AS flag FROM part""")
def string_keys(spark, d):
    shown = F.format_string("%02d.%04dA m", F.col("p_size") + 50, F.col("p_partkey") % 10000)
    return table(spark, d, "part").select("p_partkey", unit_key(F.concat_ws(".", "p_name", "p_brand")).alias("unit"), canonical_unit(shown).alias("canonical"), yes_no(F.substring("p_type", 1, 1)).alias("flag"))


@query("""SELECT p_partkey, CAST(p_size AS DECIMAL(38,6)) AS size, CASE WHEN p_partkey % 10 = 0 THEN p_partkey // 10 END AS tens, CAST(p_size AS BIGINT) * 10000 AS won FROM part""")
def lenient_numbers(spark, d):
    tenth = F.concat((F.col("p_partkey") / 10).cast("decimal(12,1)").cast("string"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", decimal_number(F.concat(F.lit(" "), F.format_number("p_size", 0))).alias("size"), integer(tenth).alias("tens"), manwon_to_krw(F.col("p_size").cast("string")).alias("won"))
