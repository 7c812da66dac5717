"""The versioned store of notices: diff of a batch against the current rows, revisions, child changes, statuses.

The store is three tables that a caller keeps: current rows, revisions, source states. Functions return the next state
of a table from the state before and a batch; a stream's foreachBatch writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeloom.functions.text import clipped, fingerprint

# What a notice may say of the price cap, and kinds of prices.
CAP_STATUSES = ("yes", "no", "unknown", "not_applicable")
PRICE_KINDS = ("sale", "sale_max", "sale_total", "deposit", "rent", "deposit_monthly")
VERIFICATIONS = ("official", "ai_unverified", "unknown")
KEY = ("source", "external_id")
LIMITS = {"title": 500, "provider": 160, "category": 80, "address": 500, "region_name": 120}
EVENT = "array<struct<kind:string,label:string,start_date:date,end_date:date,audience:string>>"
PRICE = "array<struct<unit_type:string,area_sqm:double,price_kind:string,amount_krw:bigint,monthly_krw:bigint,verification:string,document_hash:string>>"
PAYLOAD = f"""source string, external_id string, provider string, title string, category string, address string, region_code string, region_name string,
announcement_date date, official_url string, document_hash string, price_cap_status string, correction_of_external_id string, events {EVENT}, prices {PRICE}, rules array<string>, landed_at timestamp"""


def checked(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A batch of PAYLOAD rows -> (normal rows, rejected rows with `error`).

    Strings are trimmed and cut. Events without a start and prices without a unit are left out; an end before the
    start is no end. Rejected: no source, external id or title, an unknown price-cap status or price kind, negative money.
    """
    rows = batch.select(*[clipped(F.col(c), LIMITS[c]).alias(c) if c in LIMITS else F.col(c) for c in batch.columns])
    events = F.transform(F.filter("events", lambda e: e["start_date"].isNotNull()), lambda e: e.withField("end_date", F.when(e["end_date"] >= e["start_date"], e["end_date"])))
    rows = rows.withColumn("events", F.array_distinct(events)).withColumn("prices", F.filter("prices", lambda p: F.coalesce(F.trim(p["unit_type"]), F.lit("")) != ""))
    error = (
        F.when(F.coalesce("source", F.lit("")) == "", "source is missing").when(F.coalesce("external_id", F.lit("")) == "", "external_id is missing")
        .when(F.col("title").isNull(), "title is missing").when(~F.coalesce("price_cap_status", F.lit("unknown")).isin(*CAP_STATUSES), "price_cap_status is unknown")
        .when(F.exists("prices", lambda p: ~F.coalesce(p["price_kind"].isin(*PRICE_KINDS), F.lit(False))), "a price kind is unknown")
        .when(F.exists("prices", lambda p: F.coalesce((p["amount_krw"] < 0) | (p["monthly_krw"] < 0), F.lit(False))), "money is negative")
    )
    rows = rows.withColumn("error", error)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL")


def content(columns: list[str]) -> Column:
    """Canonical JSON of a row, null fields included, sets in a fixed order."""
    parts = [F.array_sort(c).alias(c) if c in ("events", "prices", "rules") else F.col(c) for c in columns]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def upsert(current: DataFrame | None, batch: DataFrame, seen_at: Column) -> tuple[DataFrame, DataFrame]:
    """(current rows or None, checked rows) -> (next current rows, new revisions).

    The last row of a key in a batch counts: by landed_at, where the batch has it, then by content. A null keeps what was known, an
    empty array of prices or rules too. An equal hash only moves last_seen_at; another makes version + 1 and a revision, and
    invalidates competition proofs if dates, events, units or a known document changed. The original
    announcement date never moves later. One full outer join on the key.
    """
    fields = [c for c in batch.columns if c not in (*KEY, "landed_at")]
    landed = [F.col("landed_at")] if "landed_at" in batch.columns else []
    given = batch.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct(*landed, content([*KEY, *fields]).alias("content"))).alias("new"))
    if current is None:
        current = batch.sparkSession.createDataFrame([], given.select(*KEY, "new.*").schema).withColumns({
            "version": F.lit(0), "content_hash": F.lit(None).cast("string"), "fingerprint": F.lit(None).cast("string"), "first_seen_at": F.lit(None).cast("timestamp"),
            "last_seen_at": F.lit(None).cast("timestamp"), "original_date": F.lit(None).cast("date"), "proof_invalidated": F.lit(None).cast("boolean"),
        })
    old = current.select(*KEY, F.struct(*[c for c in current.columns if c not in KEY]).alias("old"))
    rows = old.join(given, list(KEY), "full_outer")

    def merged(c: str) -> Column:
        new = F.when(F.size(f"new.{c}") > 0, F.col(f"new.{c}")) if c in ("prices", "rules") else F.col(f"new.{c}")
        return F.coalesce(new, F.col(f"old.{c}")).alias(c)

    original = F.least("old.original_date", "old.announcement_date", "new.announcement_date")
    rows = rows.select(*KEY, *[merged(c) for c in fields], "old", F.col("new").isNotNull().alias("seen"), original.alias("original_date"))
    rows = rows.withColumn("content_hash", F.sha2(F.concat_ws("|", content([*KEY, *fields]), F.col("original_date").cast("string")), 256))
    changed = F.col("seen") & ~F.col("content_hash").eqNullSafe(F.col("old.content_hash"))
    units = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda p: p["unit_type"])))
    moved = ~F.col("announcement_date").eqNullSafe(F.col("old.announcement_date")) | ~F.array_sort("events").eqNullSafe(F.array_sort("old.events")) | ~units(F.col("prices")).eqNullSafe(units(F.col("old.prices")))
    moved = moved | (F.col("old.document_hash").isNotNull() & ~F.col("document_hash").eqNullSafe(F.col("old.document_hash")))
    out = rows.select(
        *KEY, *fields, F.when(changed, F.coalesce("old.version", F.lit(0)) + 1).otherwise(F.col("old.version")).alias("version"),
        F.when(F.col("seen"), F.col("content_hash")).otherwise(F.col("old.content_hash")).alias("content_hash"),
        fingerprint(F.col("title"), F.col("address"), F.col("announcement_date")).alias("fingerprint"),
        F.coalesce("old.first_seen_at", seen_at).alias("first_seen_at"), F.when(F.col("seen"), seen_at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"), "original_date",
        F.when(changed & F.coalesce(F.col("old.version") > 0, F.lit(False)) & moved, True).otherwise(F.coalesce("old.proof_invalidated", F.lit(False))).alias("proof_invalidated"),
        changed.alias("_changed"),
    )
    revisions = out.filter("_changed").select(*KEY, "version", "content_hash", content([*KEY, *fields]).alias("payload"), F.col("last_seen_at").alias("seen_at"))
    return out.drop("_changed"), revisions


def duplicates(current: DataFrame) -> DataFrame:
    """current rows -> with canonical (struct<first_seen_at, source, external_id>) of the same fingerprint, else of the same URL.

    The first seen of a fingerprint is canonical whatever the order of arrival; rows of one source aren't duplicates of
    each other, so a source's own rows keep themselves unless another source's is first.
    """
    own = F.struct("first_seen_at", *KEY)

    def first(column: str) -> DataFrame:
        return current.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(own).alias(f"_{column}"))

    out = current.join(first("fingerprint"), "fingerprint", "left").join(first("official_url"), "official_url", "left")
    pick = lambda c: F.when(F.col(f"{c}.source") != F.col("source"), F.col(c))
    return out.withColumn("canonical", F.coalesce(pick("_fingerprint"), pick("_official_url"), own)).drop("_fingerprint", "_official_url")


def competition_result(states: DataFrame, results: DataFrame) -> DataFrame:
    """states (notice_id, version), results (notice_id, expected_version, rows, complete, attempted_at) -> outcome for each result.

    stale: another version is current; failed: no rows, earlier rows stay but aren't complete; else accepted.
    """
    rows = results.join(states.select("notice_id", "version"), "notice_id", "left")
    outcome = F.when(~F.col("version").eqNullSafe(F.col("expected_version")), "stale").when(F.col("rows").isNull(), "failed").otherwise("accepted")
    return rows.withColumn("outcome", outcome).withColumn("complete", F.coalesce(F.col("complete") & (F.col("outcome") == "accepted"), F.lit(False)))


def after_results(current: DataFrame, outcomes: DataFrame) -> DataFrame:
    """current rows (id, proof_invalidated, ...) with proof_invalidated false again where a result (notice_id, outcome) was accepted."""
    good = outcomes.filter("outcome = 'accepted'").select(F.col("notice_id").alias("id"), F.lit(True).alias("_good")).distinct()
    return current.join(good, "id", "left").withColumn("proof_invalidated", F.col("proof_invalidated") & F.col("_good").isNull()).drop("_good")


def snapshots(log: DataFrame, keys: list[str], order: list[str], payload: Column) -> DataFrame:
    """A log without snapshots that equal the key's last one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumn("_hash", F.sha2(payload, 256)).withColumn("_before", F.lag("_hash").over(w))
    return rows.filter(~F.col("_hash").eqNullSafe(F.col("_before"))).withColumnRenamed("_hash", "content_hash").drop("_before")


def conformed(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows of an older table as the schema has them: columns that it added are null, others are cast, and those it doesn't know stay behind."""
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def audit(outcomes: DataFrame, folder: str) -> None:
    """Write the outcomes of a run (source, outcome, ...) as JSON: all rows, and their counts by source and outcome beside them."""
    outcomes.write.mode("overwrite").json(f"{folder}/rows")
    outcomes.groupBy("source", "outcome").count().coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
