"""One reading of notices' documents: from landed attachments to patched rows, diagnostics and the next reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.operators.clauses import sections
from noticeloom.operators.documents import PARSER, best_attachment, patched, reading_states, stages
from noticeloom.operators.wordings import conditions

HEADING = r"^\s*\[(.+)\]\s*$"
PRICES = "array<struct<unit_type:string,verification:string,amount_krw:long>>"
DONE = "done"


def attachment_rules(attachments: DataFrame, heading: str = HEADING) -> DataFrame:
    """attachments (notice_id, pos, pages: array<struct<page, text>>, ...) -> notice_id, pos, found: the conditions of each that has any."""
    pages = attachments.select("notice_id", "pos", F.inline("pages"))
    rows = conditions(sections(pages, heading, ["notice_id", "pos"]), ["notice_id", "pos"])
    content = F.to_json(F.struct("section", "operator", "value", "page", "line", "start", "end", "exemptions", "evidence"))
    rule = F.struct(F.lit(PARSER).alias("source"), F.lit("official").alias("verification"), "kind", content.alias("content"))
    return rows.groupBy("notice_id", "pos").agg(F.array_sort(F.collect_list(rule)).alias("found"))


def tried(attachments: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """The attachments that a reading looks at, with found and n_conditions: in order, up to the first that has conditions, `most` at most."""
    rows = attachments.join(rules, ["notice_id", "pos"], "left")
    usable = F.col("downloaded") & F.col("decoded") & ~F.col("failed")
    rows = rows.withColumn("n_conditions", F.when(usable, F.coalesce(F.size("found"), F.lit(0))).otherwise(0))
    listed = rows.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n_conditions"))).alias("x"))  # a notice has a few
    first = listed.select("notice_id", F.get(F.filter("x", lambda a: a["n_conditions"] > 0), F.lit(0))["pos"].alias("_stop"), F.get(F.transform("x", lambda a: a["pos"]), F.lit(most - 1)).alias("_last"))
    rows = rows.join(first, "notice_id")
    return rows.filter(F.coalesce(F.col("pos") <= F.col("_stop"), F.lit(True)) & F.coalesce(F.col("pos") <= F.col("_last"), F.lit(True))).drop("_stop", "_last")


def read_notices(attachments: DataFrame, current: DataFrame, states: DataFrame | None, at: Column, most: int = 5, heading: str = HEADING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patched rows, diagnostics, next states) of a reading.

    attachments (notice_id, source, external_id, pos, document_hash, downloaded, decoded, failed, deferral, pages, seen): landed files
    in the order in which a page lists them; deferral: why the landing job gave up for now (quota, deferred), seen: the
    documents.identity of the notice when the files were fetched. current (notice_id, document_hash, rules, prices, identity):
    the notices as they are. states: see reading_states.
    Attachments are tried in order up to the first with conditions; the best of those tried is taken: the most
    conditions, else one that can be read. What was tried is told as diagnostics, which the patched row holds as a rule too. A
    reading of a notice that has changed meanwhile is stale: it changes nothing and is repeated.
    """
    rows = tried(attachments, attachment_rules(attachments, heading), most)
    rows = rows.withColumn("n_chars", F.aggregate(F.coalesce("pages", F.array().cast("array<struct<page:int,text:string>>")), F.lit(0), lambda n, p: n + F.length(F.trim(p["text"]))))
    diagnostics = stages(rows)
    told = diagnostics.groupBy("notice_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("stage") == "interpretation", 1).otherwise(0).alias("step"), "stage", "code", "status")))).alias("_told"))
    best = best_attachment(rows.withColumn("readable", F.col("downloaded") & F.col("decoded") & (F.col("n_chars") > 0)))
    best = best.join(told, "notice_id").join(current.select("notice_id", F.col("identity").alias("_now")), "notice_id", "left")
    note = F.struct(F.lit(PARSER).alias("source"), F.lit("official").alias("verification"), F.lit("document_diagnostics").alias("kind"), F.col("_told").alias("content"))
    found = F.when(F.col("n_conditions") > 0, F.col("found")).otherwise(F.filter(F.array(note), lambda _: F.lit(False)))
    stale = ~F.col("seen").eqNullSafe(F.col("_now"))
    read = best.select("notice_id", F.when(F.col("n_chars") > 0, F.col("document_hash")).alias("document_hash"), F.concat(found, F.array(note)).alias("rules"), F.array().cast(PRICES).alias("prices"), stale.alias("stale"))
    readings = best.select("source", "external_id", F.coalesce("deferral", F.lit(DONE)).alias("status"), stale.alias("stale"), at.alias("at"))
    return patched(current, read), diagnostics, reading_states(states, readings)
