"""Importance resampling of raw text towards target text, by hashed n-gram models and Gumbel top-k.

Words and pairs of words are hashed to buckets; a bucket's share in target text over its share in raw text is its
importance. A document's weight is the product over its n-grams; the k largest of log weight plus Gumbel noise
are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import U, Words, chunks, text_bytes, windows
from noticeloom.session import ensure_checkpoint_dir

BUCKETS = 10_000
BINS = 4096
COUNTS = "part int, raw binary, target binary"


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbouring words of a row."""
    words = Words(data, at)
    hashes = words.hashes(lower=True, bare=True)
    row = np.repeat(np.arange(len(words.count)), words.count)
    pair = np.flatnonzero(row[1:] == row[:-1])
    codes = np.r_[hashes, windows(hashes, 2)[pair]]
    return np.r_[row, row[pair]], (codes % U(BUCKETS)).astype(np.int64)


def log_ratios(docs: DataFrame, target: DataFrame, target_rows: int, id_col: str, text_col: str) -> np.ndarray:
    """For each bucket the log of its share in target text over its share in all text, with one added to each count."""
    chosen = target.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(target_rows)
    chosen = F.broadcast(chosen.withColumn("wanted", F.lit(True)))  # target_rows rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id", "left")

    def count(batches):
        raw, wanted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            flag = np.array(batch.column(1).fill_null(False).to_pylist(), dtype=bool)
            for lo, hi in chunks(at):
                row, bucket = ngrams(data, at[lo : hi + 1])
                raw += np.bincount(bucket, minlength=BUCKETS)
                wanted += np.bincount(bucket[flag[lo:hi][row]], minlength=BUCKETS)
        parts = 10
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(parts), pa.int32()), "raw": pa.array([x.tobytes() for x in raw.reshape(parts, -1)], pa.binary()),
            "target": pa.array([x.tobytes() for x in wanted.reshape(parts, -1)], pa.binary()),
        })

    def add(key, table):
        total = [np.sum([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()], axis=0).tobytes() for c in ("raw", "target")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "raw": pa.array([total[0]], pa.binary()), "target": pa.array([total[1]], pa.binary())})

    got = sorted(rows.select("text", "wanted").mapInArrow(count, COUNTS).groupBy("part").applyInArrow(add, COUNTS).collect(), key=lambda r: r["part"])
    if not got:
        return np.zeros(BUCKETS)
    raw, wanted = (np.concatenate([np.frombuffer(r[c], np.int64) for r in got]) for c in ("raw", "target"))
    if not wanted.sum():
        return np.zeros(BUCKETS)
    return np.log((wanted + 1) / (wanted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def largest(rows: DataFrame, k: int) -> float | None:
    """The k-th largest value of rows.key (None: k is 0 or there are fewer): counts in bins, over narrower ranges."""
    seen = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n")).first()
    if k <= 0 or k > seen["n"]:
        return None
    lo, hi = seen["lo"], seen["hi"]
    while True:
        inside = rows.filter(F.col("key").between(lo, hi))
        width = (hi - lo) / BINS
        if width <= 0 or lo + width <= lo:
            return lo
        place = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).cast("int")
        bins = {r["b"]: r for r in inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b]["n"]:
                break
            k -= bins[b]["n"]
        if bins[b]["n"] <= BINS:
            got = inside.filter(place == b).select("key").collect()
            return sorted((r["key"] for r in got), reverse=True)[k - 1]
        lo, hi = bins[b]["lo"], bins[b]["hi"]


def importance_sample(docs: DataFrame, target: DataFrame, fraction: float = 0.9, target_rows: int = 20_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...), target (doc_id, ...: documents of target quality) -> doc_id, log_weight, key, kept.

    kept: the key is among the round(fraction * rows) largest; equal keys at the end are kept together. key:
    log_weight plus Gumbel noise from a hash of the id and text, so reruns agree. The raw model counts all texts, the
    target model those of at most target_rows ids of target (the smallest hashes). Without target text, or for
    texts without words, log_weight is 0. Null text counts as empty; null ids take part as raw text. One row for
    each row of docs. Empty table: no rows. Other columns aren't read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    ratio = log_ratios(docs, target, target_rows, id_col, text_col)

    def score(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            total = np.zeros(batch.num_rows)
            for lo, hi in chunks(at):
                row, bucket = ngrams(data, at[lo : hi + 1])
                total[lo:hi] = np.bincount(row, weights=ratio[bucket], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], names=["doc_id", "noise", "log_weight"])

    ids = F.col(id_col).cast("long")
    noise = F.xxhash64(ids, F.col(text_col).cast("string"), F.lit(seed))
    rows = docs.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"), noise.alias("noise"))
    rows = rows.mapInArrow(score, "doc_id long, noise long, log_weight double")
    u = (F.shiftrightunsigned("noise", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = rows.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("key")).checkpoint()
    n = rows.count()
    least = largest(rows, round(fraction * n))
    return rows.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)


def op1_importance_resampling(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1"))
