"""Ranked lexical search over a forward index in blocks of documents, pruned by the blocks' maxima of terms.

1. One scan makes the index: a block is a run of documents, for each term its documents with their counts, and the front of
   the term: those pairs (count, length) that no other document of the block beats. A term's part of a score grows with its
   count and falls with the length, so whatever the corpus' figures turn out to be, its maximum is in the front.
2. Figures of all documents (N, L, df) are added up from the index.
3. A block's bound for an item is the sum of its terms' maxima. Of each item's blocks with the highest bounds documents are
   scored first; the k-th best score is the item's threshold.
4. A task takes the blocks of a batch by descending bound and scores those whose bound is not below the threshold, which rises
   with what it finds.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.textkit import LOWER, Words, chunks, range_hashes, text_bytes
from noticeloom.session import ensure_checkpoint_dir

BREAKS = np.ones(256, dtype=bool)  # bytes outside terms: all ASCII but digits and letters
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ITEM_BYTES = 4 << 20
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
SEEDS = 4
SLICES = 16
INDEX = "block long, docs long, with_terms long, terms long, ids binary, no_id binary, sizes binary, at_term binary, term binary, doc binary, tf binary, front_term binary, front_tf binary, front_size binary"
FOUND = "item int, doc_id long, score long"


def terms_of(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of each term of rows lo..hi."""
    words = Words(data, at[lo : hi + 1], BREAKS)
    return np.repeat(np.arange(hi - lo), words.count), range_hashes(LOWER[words.data], words.start, words.end)


class Items:
    """Items of a search as arrays: distinct terms by their hashes, and for each term the items that hold it."""

    def __init__(self, texts: list[str | None]):
        data, at = text_bytes(pa.array(texts, pa.string()))
        row, code = terms_of(data, at, 0, len(texts)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.codes, term = np.unique(code, return_inverse=True)
        pair = np.unique(term.astype(np.int64) * max(1, len(texts)) + row)
        self.item, term = pair % max(1, len(texts)), pair // max(1, len(texts))
        self.at = np.searchsorted(term, np.arange(len(self.codes) + 1))
        self.count = len(texts)

    def terms(self, code: np.ndarray) -> np.ndarray:
        """The number of each term, -1 if no item holds it."""
        if not len(self.codes):
            return np.full(len(code), -1)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[place] == code, place, -1)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in term, item) for each item of each term."""
        size = self.at[term + 1] - self.at[term]
        first = np.r_[0, np.cumsum(size)[:-1]] if len(term) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(term)), size), self.item[np.repeat(self.at[term] - first, size) + np.arange(size.sum())]


class Corpus:
    """Figures of all documents, and a term's part of a score by them."""

    def __init__(self, documents: int, terms: int, df: np.ndarray):
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)

    def lengths(self, size: np.ndarray) -> np.ndarray:
        """m of each length, in Python's integers: 90 * n * N may pass 64 bits."""
        own, back = np.unique(size, return_inverse=True)
        return np.array([10 + 90 * n * self.documents // max(1, self.terms) for n in own.tolist()], dtype=np.int64)[back]

    def part(self, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _index(docs: DataFrame, items: Items, block_docs: int) -> DataFrame:
    """The forward index: rows of INDEX. Terms that no item holds are counted, not kept."""

    def block(number: int, held: list) -> pa.RecordBatch:
        ids, no_id, sizes = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        start = np.cumsum([0, *(len(x[0]) for x in held)])
        doc = np.concatenate([x[3] + s for x, s in zip(held, start, strict=False)])
        term, tf = (np.concatenate(x) for x in list(zip(*held, strict=True))[4:])
        order = np.lexsort((-tf, sizes[doc], term))
        doc, term, tf = doc[order], term[order], tf[order]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(term)]))
        high = np.maximum.accumulate(tf + group * (1 << 40)) - group * (1 << 40)  # the highest count among documents as short
        front = np.ones(len(term), dtype=bool)
        front[1:] = (group[1:] != group[:-1]) | (tf[1:] > high[:-1])
        cell = lambda x, kind=np.int32: pa.array([x.astype(kind).tobytes()], pa.binary())
        numbers = [pa.array([x], pa.int64()) for x in (number, len(ids), int((sizes > 0).sum()), int(sizes.sum()))]
        cells = [cell(ids, np.int64), cell(no_id, bool), cell(sizes, np.int64), cell(at, np.int64), cell(term[at]), cell(doc), cell(tf), cell(term[front]), cell(tf[front]), cell(sizes[doc[front]], np.int64)]
        return pa.RecordBatch.from_arrays([*numbers, *cells], names=[x.split()[0] for x in INDEX.split(", ")])

    def make(batches):
        from pyspark import TaskContext

        number, held, documents, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            ids = np.array(batch.column(0).fill_null(0).to_pylist(), dtype=np.int64)
            no_id = np.array(batch.column(0).is_null().to_pylist(), dtype=bool)
            for first, last in chunks(at):
                for lo in range(first, last, block_docs):
                    hi = min(lo + block_docs, last)
                    row, code = terms_of(data, at, lo, hi)
                    term = items.terms(code)
                    pair, tf = np.unique(row[term >= 0] * max(1, len(items.codes)) + term[term >= 0], return_counts=True)
                    held.append((ids[lo:hi], no_id[lo:hi], np.bincount(row, minlength=hi - lo), pair // max(1, len(items.codes)), pair % max(1, len(items.codes)), tf))
                    documents, size = documents + hi - lo, size + int(at[hi] - at[lo])
                    if documents >= block_docs or size >= BLOCK_BYTES:
                        yield block(number, held)
                        number, held, documents, size = number + 1, [], 0, 0
        if held:
            yield block(number, held)

    return docs.mapInArrow(make, INDEX)


class Block:
    """A row of the index, read."""

    def __init__(self, row: dict):
        cell = lambda name, kind=np.int32: np.frombuffer(row[name], kind)
        self.row, self.number = cell, row["block"]
        self.front = cell("front_term"), cell("front_tf"), cell("front_size", np.int64)

    def bounds(self, items: Items, corpus: Corpus) -> np.ndarray:
        """For each item the sum of its terms' maxima."""
        term, tf, size = self.front
        out = np.zeros(items.count, np.int64)
        if len(term):
            part = corpus.part(term, tf, corpus.lengths(size))
            at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            best = np.maximum.reduceat(part, at)
            place, item = items.spread(term[at])
            np.add.at(out, item, best[place])
        return out

    def best(self, items: Items, corpus: Corpus, wanted: np.ndarray, k: int) -> list[tuple[int, list]]:
        """For each wanted item the (score, -id or None, id) of its k best documents, in descending order."""
        cell = self.row
        at, term, doc, tf = cell("at_term", np.int64), cell("term"), cell("doc"), cell("tf")
        ids, no_id, sizes = cell("ids", np.int64), cell("no_id", bool), cell("sizes", np.int64)
        is_wanted = np.zeros(items.count, dtype=bool)
        is_wanted[wanted] = True
        place, item = items.spread(term)
        place, item = place[is_wanted[item]], item[is_wanted[item]]
        part = corpus.part(np.repeat(term, np.diff(np.r_[at, len(doc)])), tf, corpus.lengths(sizes)[doc])
        number = np.cumsum(is_wanted) - 1
        total = np.zeros((len(wanted), len(ids)), np.int64)
        ends = np.r_[at, len(doc)]
        for p, i in zip(place.tolist(), number[item].tolist(), strict=True):  # a term's documents are told once each
            own = slice(ends[p], ends[p + 1])
            total[i, doc[own]] += part[own]
        out = []
        for i, scores in zip(wanted.tolist(), total, strict=True):
            if len(scores) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                some = np.flatnonzero((scores >= max(1, least)))
            else:
                some = np.flatnonzero(scores > 0)
            some = some[np.lexsort((ids[some], no_id[some], -scores[some]))][:k]
            out.append((i, [(int(scores[d]), 0 if no_id[d] else 1, 0 if no_id[d] else -int(ids[d])) for d in some.tolist()]))
        return out


def _search(rows: DataFrame, items: Items, corpus: Corpus, least: np.ndarray, k: int) -> DataFrame:
    """The k best documents of each item in each task's blocks, as far as their scores aren't below least; rows of FOUND."""

    def run(batches):
        bar = least.copy()
        held: list[list] = [[] for _ in range(items.count)]
        for batch in batches:
            blocks = [Block(r) for r in batch.to_pylist()]
            bounds = [b.bounds(items, corpus) for b in blocks]
            for i in sorted(range(len(blocks)), key=lambda i: -int(bounds[i].max(initial=0))):
                wanted = np.flatnonzero((bounds[i] >= bar) & (bounds[i] > 0))
                for item, found in blocks[i].best(items, corpus, wanted, k) if len(wanted) else ():
                    for x in found:
                        if len(held[item]) < k:
                            heapq.heappush(held[item], x)
                        else:
                            heapq.heappushpop(held[item], x)
                    if len(held[item]) == k:
                        bar[item] = max(bar[item], held[item][0][0])
        flat = [(item, None if not given else -minus, score) for item, found in enumerate(held) for score, given, minus in found]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _document_counts(index: DataFrame, terms: int) -> np.ndarray:
    """The documents that hold each term: tasks add up their blocks, in SLICES rows each."""
    kind = "slice int, counts binary"
    width = -(-max(1, terms) // SLICES)

    def count(batches):
        total = np.zeros(width * SLICES, np.int64)
        for batch in batches:
            for at, term, doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at, n = np.frombuffer(at, np.int64), len(doc) // 4
                total[np.frombuffer(term, np.int32)] += np.diff(np.r_[at, n])
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([x.tobytes() for x in total.reshape(SLICES, -1)], pa.binary())})

    def add(key, table):
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = index.select("at_term", "term", "doc").mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect()
    total = np.zeros(width * SLICES, np.int64)
    for r in rows:
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return total[:terms]


def _search_items(docs: DataFrame, texts: list[str | None], k: int, block_docs: int) -> DataFrame:
    items = Items(texts)
    index = _index(docs, items, block_docs).checkpoint()
    seen = index.agg(F.sum("with_terms").alias("n"), F.sum("terms").alias("l")).first()
    corpus = Corpus(seen["n"] or 0, seen["l"] or 0, _document_counts(index, len(items.codes)))

    def bounds(batches):
        kept: list[list] = [[] for _ in range(items.count)]
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for item, bound in enumerate(b.bounds(items, corpus).tolist()):
                    if bound:
                        (heapq.heappush if len(kept[item]) < SEEDS else heapq.heappushpop)(kept[item], (bound, b.number))
        flat = [(item, n, bound) for item, some in enumerate(kept) for bound, n in some]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    # The blocks with the highest bounds of each item, SEEDS an item: their k-th best score is a threshold for all others.
    seeds = _top(index.select("block", "front_term", "front_tf", "front_size").mapInArrow(bounds, FOUND), SEEDS).select(F.col("doc_id").alias("block")).distinct()
    first = _search(index.join(F.broadcast(seeds), "block", "left_semi"), items, corpus, np.zeros(items.count, np.int64), k)
    least = np.zeros(items.count, np.int64)
    for r in _top(first, k).filter(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    return _top(_search(index, items, corpus, least, k), k)


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 10, block_docs: int = BLOCK_DOCS, item_bytes: int = ITEM_BYTES, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """docs (doc_id, text, ...), queries (item_id, text, ...) -> item_id, rank, doc_id, score: each item's k best documents.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, in whole texts; null has none. N documents
    have terms, L in all; a term of df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms
    that holds it tf times gets w * (10^9 * tf div (1000 * tf + 8m)), m = 10 + 90 * n * N div L, for each distinct term of the
    item. Scores above 0 count; equal scores stand by doc_id, null last. Each row of docs is a document of its own and each
    row of queries an item of its own, also where ids repeat or are null. Terms are compared as 64-bit hashes.
    Items are taken in blocks of item_bytes of text, a pass over docs each. No documents or no items: no rows. Other
    columns aren't read.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    queries = queries.select(F.col(query_id).cast("long").alias("item_id"), F.col(query_text).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = queries.agg(F.sum(size.cast("long"))).first()[0] or 0
    parts, out = max(1, -(-total // item_bytes)), None
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for number in range(parts):  # an item's equal rows share a block, however many they are
        rows = queries.filter(part == number).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")).collect()
        named = spark.createDataFrame([(i, r["item_id"], r["times"]) for i, r in enumerate(rows)], "item int, item_id long, times long")
        got = _search_items(docs, [r["text"] for r in rows], k, block_docs).join(F.broadcast(named), "item")
        got = got.select("item_id", "rank", "doc_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")
        out = got if out is None else out.unionByName(got)
    return out


#: The same in DuckDB, term by term.
OP13_SQL = r"""WITH words AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), figures AS (
  SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0
), counts AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM words) GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, figures GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT a.item_id, x.doc_id, x.d, CAST(sum(g.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * len(x.w) * f.n) // f.l)))) AS BIGINT) AS score
  FROM asked AS a JOIN counts AS c ON c.term = a.term JOIN weights AS g ON g.term = a.term JOIN words AS x ON x.d = c.d, figures AS f GROUP BY a.item_id, x.doc_id, x.d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return lexical_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
