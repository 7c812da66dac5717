"""Entity resolution: clusters of one fingerprint, references by id or by unique prefix, supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import ensure_checkpoint_dir


def clusters(rows: DataFrame, fingerprint: str, identity: str) -> DataFrame:
    """rows -> identity, canonical_id (the smallest of the fingerprint), members. A null fingerprint is its own cluster.

    The choice doesn't depend on the order of arrival. Groups are aggregated before the join, so that a frequent
    fingerprint costs a row for each task.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.select(identity, fingerprint).checkpoint()  # computed once: it is grouped and joined
    known = rows.filter(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.min(identity).alias("canonical_id"), F.count(F.lit(1)).alias("members"))
    out = rows.join(known, fingerprint, "left")
    return out.select(identity, F.coalesce("canonical_id", identity).alias("canonical_id"), F.coalesce("members", F.lit(1).cast("long")).alias("members"))


def prefix_references(rows: DataFrame, ref: str, targets: DataFrame, key: str, separator: str = ":") -> DataFrame:
    """rows with `resolved`: the target key that begins with ref and the separator, if exactly one does, else null.

    Each key is exploded to its prefixes at separators, which makes the prefix join an equi-join.
    """
    parts = F.split(key, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    found = targets.filter(F.size(parts) > 1).select(F.explode(prefixes).alias("_prefix"), F.col(key).alias("_key"))
    found = found.groupBy("_prefix").agg(F.min("_key").alias("resolved"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(found, F.col(ref) == F.col("_prefix"), "left").drop("_prefix")


def exact_references(rows: DataFrame) -> DataFrame:
    """rows (id, source, external_id, correction_of_external_id) with correction_of_id: an exact external id of the source, else
    the only one that begins with it and ':'; never the row itself. Run again, it resolves references that came early."""
    named = rows.select(F.col("source").alias("_source"), F.col("external_id").alias("_external"), F.col("id").alias("_id"))
    named = named.groupBy("_source", "_external").agg(F.min("_id").alias("_id"))
    out = rows.join(named, (F.col("source") == F.col("_source")) & (F.col("correction_of_external_id") == F.col("_external")) & (F.col("id") != F.col("_id")), "left")
    full = F.concat_ws("\u0001", "source", "external_id")
    by_prefix = prefix_references(
        rows.filter(F.col("correction_of_external_id").isNotNull()).select("id", F.concat_ws("\u0001", "source", "correction_of_external_id").alias("_ref")),
        "_ref", rows.select(full.alias("_full")), "_full",
    ).select(F.col("id").alias("_row"), F.col("resolved"))
    keyed = rows.select(full.alias("_full"), F.col("id").alias("_prefix_id")).groupBy("_full").agg(F.min("_prefix_id").alias("_prefix_id"))
    by_prefix = by_prefix.join(keyed, F.col("resolved") == F.col("_full"), "left").select("_row", "_prefix_id")
    out = out.join(by_prefix, F.col("id") == F.col("_row"), "left")
    return out.withColumn("correction_of_id", F.coalesce("_id", F.when(F.col("_prefix_id") != F.col("id"), F.col("_prefix_id")))).drop("_source", "_external", "_id", "_row", "_prefix_id")


def current(rows: DataFrame) -> DataFrame:
    """rows (id, source, external_id, duplicate_of_id, correction_of_id, correction_of_external_id) -> those of canonical notices
    that no correction replaces, with canonical_id. A correction hides its predecessor's whole group."""
    rows = rows.withColumn("canonical_id", F.coalesce("duplicate_of_id", "id"))
    hidden = rows.filter(F.col("correction_of_id").isNotNull()).select(F.col("correction_of_id").alias("id"))
    gone = rows.join(hidden, "id", "left_semi").select("canonical_id").distinct()
    refs = rows.filter(F.col("correction_of_external_id").isNotNull()).select("source", F.col("correction_of_external_id").alias("external_id"))
    named = rows.filter(F.col("id") == F.col("canonical_id")).join(refs, ["source", "external_id"], "left_semi").select("canonical_id")
    return rows.join(gone.unionByName(named).distinct(), "canonical_id", "left_anti")
