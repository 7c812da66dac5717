"""Removal of long passages that an earlier document has already (difference-cover anchors).

Two windows of 50 words that are equal may start at any two offsets. Anchors are hashed only at positions whose
remainder modulo 31 is in a difference cover; for any two offsets some shift below 31 brings both to such a
position, so the two windows share an anchor of 20 words there. Blocks exchange anchors, extend those that two
documents share to the windows around them, exchange these, and mark the words of windows that a smaller id has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.blocks import BLOCK_BYTES, PACKED, answer, blocked, received, runs, send, to_blocks, to_buckets
from noticeloom.llm.textkit import U, Words, chunks, covered, text_bytes, windows

# A perfect difference set; every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _windows(table: pa.Table, width: int, anchor: int | None):
    """For rows in chunks: the rows' range, words, window hashes of whole rows, each window's row, its place in the row."""
    data, at = text_bytes(table.column("text"))
    for lo, hi in chunks(at):
        words = Words(data, at[lo : hi + 1])
        hashes = words.hashes()
        got = windows(hashes, anchor or width)
        row = np.repeat(np.arange(hi - lo), words.count)
        place = np.arange(len(row)) - words.first[row]
        fits = place + (anchor or width) <= words.count[row]
        yield lo, hi, words, hashes, got, row, place, fits


def _anchors(table: pa.Table, window: int):
    """Anchors at cover positions of rows with a window at least."""
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    for lo, hi, words, hashes, got, row, place, fits in _windows(table, window, window - PERIOD + 1):
        at = np.flatnonzero(fits & cover[place % PERIOD] & (words.count[row] >= window))
        yield lo, hi, words, hashes, row, place, at, got[at] & ~U(1)


def substring_dedup(docs: DataFrame, window: int = 50, block_bytes: int = BLOCK_BYTES, fanout: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_text.

    Every word that lies in a window of `window` (over 31) consecutive words whose word sequence also starts in a
    document with a smaller doc_id is removed; windows are those of the input. Words are kept unchanged, joined by
    one space. Null text: no words. Null doc_id: as 2 ** 63 - 1, the largest id. Equal ids: neither is smaller, both stay.
    Fewer words than a window: nothing is removed. Empty table: no rows. Other columns are not read. Equality of
    windows is equality of 64-bit hashes. A block holds about block_bytes of text, or one longer document. fanout: see blocks.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD}")
    texts, n = blocked(docs, block_bytes)

    def shared_keys(key, table):
        found = [(h, row[at] + lo) for lo, _, _, _, row, _, at, h in _anchors(table, window)]
        keys = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
        rows = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        at, size = runs(keys)
        many = rows[at] != rows[at + size - 1]
        return send(key[0].as_py(), keys[at] | many.astype(np.uint64), None, n, fanout)

    def shared(key, table):
        blocks, keys, _ = received(table)
        many, keys = (keys & U(1)).astype(bool), keys & ~U(1)
        at, size = runs(keys)
        hit = np.repeat((size > 1) | np.logical_or.reduceat(many, at), size) if len(at) else np.zeros(0, bool)
        return answer(blocks[hit], keys[hit], None, n, fanout)

    def window_keys(key, left, right):
        anchors, ids = received(right)[1], np.array(left.column("id").to_pylist(), dtype=np.int64)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, words, hashes, row, place, at, h in _anchors(left, window) if len(anchors) else ():
            near = np.zeros(len(row) + 1, dtype=np.int64)
            hit = at[anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h]
            np.add.at(near, hit - np.minimum(PERIOD - 1, place[hit]), 1)
            np.add.at(near, hit + 1, -1)
            start = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (place + window <= words.count[row]))
            keys.append(windows(hashes, window)[start])
            owners.append(ids[row[start] + lo])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owners, keys))
        at, _ = runs(keys[order])
        return send(key[0].as_py(), keys[order][at], owners[order][at], n, fanout)

    def smallest(key, table):
        blocks, keys, ids = received(table)
        at, size = runs(keys)
        least = np.repeat(np.minimum.reduceat(ids, at), size) if len(at) else ids
        hit = ids > least
        return answer(blocks[hit], keys[hit], least[hit], n, fanout)

    def removed(key, left, right):
        _, keys, least = received(right)
        ids = np.array(left.column("id").to_pylist(), dtype=np.int64)
        found = list(_windows(left, window, None))
        own = np.concatenate([x[4][np.flatnonzero(x[7])] for x in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([ids[x[5][np.flatnonzero(x[7])] + x[0]] for x in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((owner, own))
        at, size = runs(own[order])
        first = np.empty(len(own), dtype=np.int64)
        first[order] = np.repeat(owner[order][at], size)
        if len(keys):
            to = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            first = np.where(keys[to] == own, np.minimum(first, least[to]), first)
        gone, done, kept, n_words, n_removed = first < owner, 0, [], [], []
        for _, _, words, _, _, row, _, fits in found:
            start = np.flatnonzero(fits)
            hit = np.zeros(len(row), dtype=bool)
            hit[start] = gone[done : done + len(start)]
            done += len(start)
            drop = covered(hit, window, len(row))
            n_words += words.count.tolist()
            whole = words.data.tobytes()
            for i in range(len(words.count)):
                stay = ~drop[words.first[i] : words.first[i + 1]]
                parts = whole[words.at[i] : words.at[i + 1]].split()
                n_removed.append(len(stay) - int(stay.sum()))
                kept.append(b" ".join([x for x, y in zip(parts, stay.tolist(), strict=True) if y] if n_removed[-1] else parts))
        return pa.table({
            "doc_id": left.column("id_given"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    own = texts.groupBy("block")
    anchors = to_buckets(own.applyInArrow(shared_keys, PACKED), n, fanout).applyInArrow(shared, PACKED)
    exact = to_buckets(own.cogroup(to_blocks(anchors, n, fanout)).applyInArrow(window_keys, PACKED), n, fanout).applyInArrow(smallest, PACKED)
    return own.cogroup(to_blocks(exact, n, fanout)).applyInArrow(removed, RESULT)


#: The same in DuckDB: every window of every document, by 128-bit hashes.
OP5_SQL = r"""WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5_number(array_to_string(w[i:i + 49], ' ')))) AS h FROM words WHERE len(w) >= 50
), starts AS (
  SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS gone FROM windows
), marked AS (
  SELECT doc_id, i, max(CASE WHEN gone THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM starts
), gone AS (
  SELECT doc_id, i FROM marked WHERE last > i - 50
  UNION SELECT doc_id, i + k FROM (SELECT doc_id, max(i) AS i, max(last) AS last FROM marked GROUP BY doc_id) AS e, unnest(range(1, 50)) AS u(k) WHERE last > i + k - 50
), placed AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, d.w, coalesce(p.places, []) AS places FROM words AS d LEFT JOIN placed AS p ON p.doc_id = d.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i))), ' ')) AS kept_sha256 FROM kept"""


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
