"""Texts dealt into blocks of bounded size, and keys exchanged between blocks.

Operators that look for equal content in the whole corpus work block by block. A block sends each of its keys
once, however many of its documents have the key, to the bucket of that key; buckets answer to blocks. So a key
that a third of all documents share costs its bucket a row for each block, not for each document.

A sender packs its keys into at most FANOUT rows. Where there are more destinations than that, a second step splits
what came together for a range of them, so that rows grow with the keys and not with senders times destinations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from noticeloom.llm.textkit import U

NO_ID = (1 << 63) - 1
BLOCK_BYTES = 8 << 20
FANOUT = 2048
SPLIT_BYTES = 32 << 20
#: dest: a bucket or block, or a range of them; blocks: the block of each key, or null where all are of `block`.
PACKED = "dest int, block int, blocks binary, keys binary, ids binary"


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (block, id, id_given, text) and the number of blocks. A null id counts as the largest; equal rows stay.

    A row's block is told by id and text together, so rows without an id, or with the same one, are dealt out too; only
    rows equal in both share a block.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    count = max(1, math.ceil(max(size["b"] or 0, 64 * size["n"]) / block_bytes))
    identity, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.pmod(F.xxhash64(identity, text), F.lit(count)).cast("int").alias("block"),
        F.coalesce(identity, F.lit(NO_ID)).alias("id"),
        identity.alias("id_given"),
        text.alias("text"),
    ), count


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: equal ranges of keys, in order."""
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _pack(dest: np.ndarray, block: int | None, blocks: np.ndarray | None, keys: np.ndarray, ids: np.ndarray | None) -> pa.Table:
    """A row of PACKED for each destination; dest is in ascending order."""
    at, size = runs(dest)
    spans = list(zip(at.tolist(), (at + size).tolist(), strict=True))
    cells = lambda x, kind: pa.array([None if x is None else x[i:j].astype(kind, copy=False).tobytes() for i, j in spans], pa.binary())
    return pa.table({
        "dest": pa.array(dest[at], pa.int32()), "block": pa.array([block] * len(spans), pa.int32()),
        "blocks": cells(blocks, np.int32), "keys": cells(keys, np.uint64), "ids": cells(ids, np.int64),
    })


def send(block: int, keys: np.ndarray, ids: np.ndarray | None, buckets: int, fanout: int | None = None) -> pa.Table:
    """Rows of PACKED for keys in ascending order, to buckets or, where these are more than fanout, to ranges of them."""
    return _pack(_coarse(bucket_of(keys, buckets), buckets, fanout), block, None, keys, ids)


def answer(blocks: np.ndarray, keys: np.ndarray, ids: np.ndarray | None, n_blocks: int, fanout: int | None = None) -> pa.Table:
    """Rows of PACKED: each block's keys, to blocks or, where these are more than fanout, to ranges of them."""
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    named = blocks if n_blocks > (fanout or FANOUT) else None  # else dest is the block
    return _pack(_coarse(blocks, n_blocks, fanout), None, named, keys[order], None if ids is None else ids[order])


def _coarse(dest: np.ndarray, n: int, fanout: int | None) -> np.ndarray:
    most = fanout or FANOUT
    return dest if n <= most else dest * most // n


def to_buckets(rows: DataFrame, buckets: int, fanout: int | None = None) -> GroupedData:
    """What blocks have sent, grouped by bucket."""
    return _arrived(rows, buckets, fanout, lambda blocks, keys: bucket_of(keys, buckets), True).groupBy("dest")


def to_blocks(rows: DataFrame, n_blocks: int, fanout: int | None = None, waves: int = 1, wave: int = 0) -> GroupedData:
    """What buckets have answered, grouped by block; of several waves the blocks of one (block modulo waves)."""
    rows = _arrived(rows, n_blocks, fanout, lambda blocks, keys: blocks, False)
    return (rows if waves == 1 else rows.filter(F.pmod("dest", F.lit(waves)) == wave)).groupBy("dest")


def _arrived(rows: DataFrame, n: int, fanout: int | None, place, named: bool) -> DataFrame:
    """rows with dest a single destination: where it is a range, its rows are gathered to SPLIT_BYTES and split."""
    if n <= (fanout or FANOUT):
        return rows

    def split(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SPLIT_BYTES:
                yield from part(held)
                held, size = [], 0
        if held:
            yield from part(held)

    def part(held):
        blocks, keys, ids = received(pa.Table.from_batches(held), by_key=False)
        dest = place(blocks, keys)
        order = np.argsort(dest, kind="stable")
        yield from _pack(dest[order], None, blocks[order] if named else None, keys[order], None if ids is None else ids[order]).to_batches()

    return rows.repartition("dest").sortWithinPartitions("dest").mapInArrow(split, PACKED)


def received(table: pa.Table, by_key: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, keys and ids (None where none were sent) that rows of PACKED hold; by key, unless told otherwise."""
    cells = table.column("keys").to_pylist()
    flat = lambda x, kind: np.concatenate([np.frombuffer(c, kind) for c in x]) if x else np.zeros(0, kind)
    keys = flat(cells, np.uint64)
    given = zip(table.column("block").to_pylist(), table.column("blocks").to_pylist(), cells, strict=True)
    blocks = [np.full(len(c) // 8, -1 if b is None else b, np.int64) if x is None else np.frombuffer(x, np.int32).astype(np.int64) for b, x, c in given]
    blocks = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    sent = [x for x in table.column("ids").to_pylist() if x is not None]
    ids = flat(sent, np.int64) if sent or not cells else None
    if not by_key:
        return blocks, keys, ids
    order = np.argsort(keys, kind="stable")
    return blocks[order], keys[order], None if ids is None else ids[order]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal runs."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return at, np.diff(np.r_[at, len(keys)])
