"""Mixing sources to target weights, by DataFrame functions alone.

Targets of sources come from water filling. A source takes as many complete epochs as its target holds; the rest is
an Efraimidis-Spirakis sample: each document draws an exponential key whose rate is its quality weight, and the
smallest keys are taken until their sizes reach the rest. Keys are counted in bins, which are split again until few
rows are left where a source's budget ends: only these are sorted, whatever the source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.session import ensure_checkpoint_dir

# What separates words, and the weights that sources get in turn.
WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
ROWS_A_BIN = 5_000
BINS = 4096
FEW_SOURCES = 100_000
#: The order in which a source's rows are taken: by key; equal keys by size, text, and a number of the row's own.
ORDER = ("key", "size", "content", "row")


def quality_weight(text: Column, size: Column) -> Column:
    """1, or 0.5 where a text's characters a word are unusually many (over 12), as in tables, codes and noise."""
    return F.when(F.length(text) > 12 * size, 0.5).otherwise(1.0)


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, quality: Column | None) -> DataFrame:
    """docs with mix_source, mix_size and the mix_ columns of ORDER, written to the checkpoint folder.

    mix_key is the exponential key -ln(u) / weight, u from a hash of the id (null: of the text).
    """
    text = F.col(text_col).cast("string")
    named = F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(named, F.lit(f"/{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    docs = docs.withColumn("mix_size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    weight = quality if quality is not None else quality_weight(F.coalesce(text, F.lit("")), F.col("mix_size"))
    docs = docs.withColumn("mix_source", F.col(source_col).cast("string")).withColumn("mix_key", -F.log(u) / weight)
    return docs.withColumn("mix_content", F.xxhash64(text).cast("double")).withColumn("mix_row", F.monotonically_increasing_id().cast("double"))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) -> with target. A row for each source; the windows see these rows alone.

    The total is share of all sizes, dealt by weights that sources get in turn by code point, null last; a target
    stops at most times its source's size and the excess is dealt again, until none is above.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    shared = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared)).select("source", "source_size", "target")


def few(rows: DataFrame) -> DataFrame:
    """Rows of one for each source: sent to every executor up to FEW_SOURCES of them, else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW_SOURCES else rows


def inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of each span: those whose values of ORDER lie between its arrays lo and hi."""
    spans = spans.withColumnRenamed("source", "span_source")
    near = [F.col(c).cast("double").between(F.col("lo")[i], F.col("hi")[i]) for i, c in enumerate(ORDER)]
    return rows.join(few(spans), rows["source"].eqNullSafe(spans["span_source"])).filter(near[0] & near[1] & near[2] & near[3]).drop("span_source")


def ends(*names: str) -> list[Column]:
    return [F.array(*(f(c).cast("double") for c in ORDER)).alias(n) for f, n in zip((F.min, F.max), names, strict=True)]


def narrowed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each span the bin in which its budget ends: BINS equal ranges of the first column of ORDER that isn't constant."""
    place = F.lit(0)
    for i in reversed(range(len(ORDER))):
        share = (F.col(ORDER[i]) - F.col("lo")[i]) / (F.col("hi")[i] - F.col("lo")[i])
        place = F.when(F.col("lo")[i] < F.col("hi")[i], F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(place)
    bins = inside(rows, spans).groupBy("source", place.alias("bin")).agg(
        F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"), *ends("lo", "hi")
    )
    bins = bins.withColumn("upto", F.col("before") + F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))).filter(F.col("upto") > F.col("rest"))
    cut = bins.groupBy("source").agg(F.min(F.struct("bin", "rest", (F.col("upto") - F.col("bin_size")).alias("before"), "n", "lo", "hi")).alias("c"))
    return cut.select("source", "c.rest", "c.before", "c.n", "c.lo", "c.hi")


def source_cuts(rows: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """rows (source, size, and ORDER) -> for each source source_size, target, epochs, and where its sample ends (lo, last).

    The span in which a source's budget ends is narrowed, all sources at once, until ROWS_A_BIN rows are left in it,
    whatever the weights and however many keys are equal: rows of equal keys, sizes and texts are told apart by a
    number of their own.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), *ends("lo", "hi")).checkpoint()
    sources = source_targets(sums.select("source", "source_size"), cycle, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0)
    sources = sources.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).checkpoint()
    spans = sums.join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).filter("rest > 0 and rest < source_size")
    spans = spans.select("source", "rest", F.lit(0).cast("long").alias("before"), "n", "lo", "hi").checkpoint()
    wide = (F.col("n") > ROWS_A_BIN) & (F.col("lo") != F.col("hi"))
    while not (todo := spans.filter(wide)).isEmpty():
        spans = spans.filter(~wide).unionByName(narrowed(rows, todo)).checkpoint()
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    last = inside(rows, spans).withColumn("upto", upto).filter(
        (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")))
    )
    last = last.groupBy("source").agg(F.max(F.array(*(F.col(c).cast("double") for c in ORDER))).alias("last"))
    spans = spans.select(F.col("source").alias("s"), "lo").join(last.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    out = sources.join(spans, F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "lo", "last").checkpoint()


def mix(
    docs: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0, seed: int = 7, quality: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs -> doc_id, source, size, source_size, target, copies, taken, for every document.

    size: words of the text (null: 0). copies: complete epochs of the source and 1 more where the document is in
    the sample; taken: copies times size. A source's taken words come nearest its target that whole documents in the
    order of keys allow. Null source: a source of its own, the last. Null id: keyed by its text. Rows equal in id and
    size share a key; as many of them are taken as the target needs. Reruns agree. Empty table: no rows. quality: a
    positive weight for each document, instead of quality_weight. Other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = sized(docs, seed, id_col, text_col, source_col, quality)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), *mix_columns()).checkpoint()
    return taken(rows, source_cuts(rows, cycle, share, most)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix_columns() -> list[Column]:
    return [F.col(f"mix_{c}").alias(c) for c in ("source", *ORDER)]


def taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source and ORDER, ...) with the source's figures, copies and taken."""
    out = rows.join(few(cuts), rows["source"].eqNullSafe(cuts["cut_source"]))
    own = F.array(*(F.col(c).cast("double") for c in ORDER))
    more = F.coalesce(F.when(F.col("last").isNotNull(), own <= F.col("last")).otherwise(own < F.col("lo")), F.lit(False))
    out = out.withColumn("copies", F.col("epochs") + F.when(more, 1).otherwise(0))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents that the mix takes: their columns (doc_id, text, source among them), mix_size, mix_copies and mix_taken.

    Columns of docs whose names begin with mix_ give way. The documents are written to the checkpoint folder once.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    names = [c for c in docs.columns if not c.startswith("mix_")]
    rows = sized(docs.select(*(F.col(f"`{c}`") for c in names)), seed, "doc_id", "text", "source", None)
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), *mix_columns()).checkpoint()
    out = taken(rows, source_cuts(rows.drop("doc"), cycle, share, most)).filter(F.col("copies") > 0)
    return out.select("doc.*", F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies"), F.col("taken").alias("mix_taken"))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(rows: str) -> str:
    """DuckDB SQL for mix over rows (doc_id, text, source), a table or a query in parentheses."""
    return rf"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '') || '/7'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM {rows} AS input
), keyed AS (
  SELECT doc_id, source, size, -ln(u) / (CASE WHEN length(coalesce(text, '')) > 12 * size THEN 0.5 ELSE 1.0 END) AS key FROM sized
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS cap FROM per_source
), leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap
    ELSE weight * (SELECT level FROM leveled AS l WHERE level * weight < cap ORDER BY cap / weight, source IS NULL, source LIMIT 1) END AS target FROM leveled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS epochs FROM targets
), running AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed AS k JOIN budgets AS b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto <= rest OR upto - rest < rest - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running"""


OP2_SQL = mix_sql("documents")
