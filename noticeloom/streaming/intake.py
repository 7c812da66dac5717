"""Micro-batches of landed notices into the versioned store: replayed batches change nothing.

The store keeps current rows in buckets of keys. A batch reads and writes the buckets of its own keys alone; a small
manifest for each batch names the folder in which each bucket stands.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeloom.operators.statuses import STATE, counted, updated, with_missing
from noticeloom.operators.store import KEY, PAYLOAD, checked, upsert
from noticeloom.session import delete_folder

BUCKETS = 256


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON rows of PAYLOAD that a landing job puts into a folder."""
    return spark.readStream.schema(PAYLOAD).json(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, store: str, batch_id: int) -> dict[int, int]:
    """For each bucket the batch that wrote it last, after batch_id; BUCKETS entries at most. Raises where that batch wrote none."""
    path = f"{store}/manifest/{batch_id}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"the store has no state after batch {batch_id}: {path}")
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(path).collect()}


def _rows(spark: SparkSession, store: str, folders: dict[int, int]) -> DataFrame | None:
    paths = [f"{store}/current/{batch}/bucket={b}" for b, batch in sorted(folders.items())]
    return spark.read.parquet(*paths) if paths else None


def write_batch(store: str, batch: DataFrame, batch_id: int, seen_at: datetime | None = None, sources: Sequence[str] = ()) -> None:
    """Apply one batch: the next rows of the buckets that it touches, its revisions and rejects, statuses of sources, and the manifest.

    sources: those that a batch should bring; one of which nothing landed has a status of its own, an error, and the others go on.

    seen_at: the time of the batch, by default the greatest landed_at of its rows; without either it raises, as logic
    never reads a clock. Everything goes to folders named by the batch's id, in overwrite mode, and comes from the state
    after the id before, which must be there. So a batch that is run again after a failure writes the same again.
    """
    spark = batch.sparkSession
    if seen_at is None:
        seen_at = batch.agg(F.max("landed_at")).first()[0]
        if seen_at is None and not batch.isEmpty():
            raise ValueError("a batch needs seen_at or rows with landed_at")
    before = manifest(spark, store, batch_id - 1) if batch_id else {}
    rows, rejected = checked(batch)
    touched = [r["b"] for r in rows.select(bucket().alias("b")).distinct().collect()]  # BUCKETS at most
    state, revisions = upsert(_rows(spark, store, {b: before[b] for b in touched if b in before}), rows, F.lit(seen_at))
    state.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/current/{batch_id}")
    revisions.write.mode("overwrite").parquet(f"{store}/revisions/{batch_id}")
    rejected.write.mode("overwrite").parquet(f"{store}/rejected/{batch_id}")
    known = _statuses(spark, store, batch_id - 1)
    polls = with_missing(counted(rows, rejected, F.lit(seen_at).cast("timestamp")), list(sources), F.lit(seen_at).cast("timestamp")) if seen_at else None
    told = updated(known, polls) if polls is not None else known if known is not None else spark.createDataFrame([], STATE)
    told.write.mode("overwrite").parquet(f"{store}/status/{batch_id}")
    after = before | dict.fromkeys(touched, batch_id)
    spark.createDataFrame(sorted(after.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{batch_id}")


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True, period: str = "3 hours", sources: Sequence[str] = ()) -> StreamingQuery:
    """Run the intake: what is there (once), or every period. Sources that land nothing are told in the statuses."""
    stream = landed(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write_batch(store, df, i, sources=sources))
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=period)).start()


def current(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """The current rows after a batch; without any, an empty table of the same columns."""
    rows = _rows(spark, store, manifest(spark, store, batch_id))
    if rows is not None:
        return rows
    none = checked(spark.createDataFrame([], PAYLOAD))[0]
    return upsert(None, none, F.lit(None).cast("timestamp"))[0]


def _statuses(spark: SparkSession, store: str, batch_id: int) -> DataFrame | None:
    path = f"{store}/status/{batch_id}"
    return spark.read.schema(STATE).parquet(path) if batch_id >= 0 and _exists(spark, path) else None


def statuses(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """Statuses of sources after a batch: rows of statuses.STATE."""
    found = _statuses(spark, store, batch_id)
    return found if found is not None else spark.createDataFrame([], STATE)


def vacuum(spark: SparkSession, store: str, batch_id: int, keep: int = 3) -> int:
    """Delete bucket folders that no manifest of the last `keep` batches up to batch_id names, and older manifests; how many went.

    Batches before those can't be replayed any more. Revisions and rejects stay.
    """
    first = max(0, batch_id - keep + 1)
    named = {(batch, b) for i in range(first, batch_id + 1) if _exists(spark, f"{store}/manifest/{i}") for b, batch in manifest(spark, store, i).items()}
    gone = 0
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/current")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for batch in range(batch_id + 1):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/current/{batch}")
        for entry in files.listStatus(place) if files.exists(place) else ():
            name = entry.getPath().getName()
            if name.startswith("bucket=") and (batch, int(name.removeprefix("bucket="))) not in named:
                delete_folder(spark, f"{store}/current/{batch}/{name}")
                gone += 1
        if batch < first:
            delete_folder(spark, f"{store}/manifest/{batch}")
    return gone


def revisions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/revisions/*")
