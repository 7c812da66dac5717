"""Phrases whose words come together more often than their parts would: packed n-grams of dictionary ids, sorted and counted.

1. One scan numbers the words of each block of documents and writes the block's words with their counts, and its texts as
   sequences of these numbers, to the checkpoint folder.
2. Words that are frequent enough in all blocks make the dictionary, and get ids. Ids go back to blocks as pairs of numbers.
3. A block's n-grams within pieces, which other words break too, become binary keys of fixed width. A block sorts its own by
   radix and counts runs, so that a phrase is sent once a block, and deals them to ranges of keys.
4. A range sorts what it gets by radix and counts runs. The ranges are made from the words' counts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.session import ensure_checkpoint_dir, tidy

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")
LOWER = {65 + i: 97 + i for i in range(26)}
BLOCK_CHARS = 12 << 20
RANGE_ROWS = 4_000_000
BINS = 4096
SALTS = 64
PART = 1 << 17
UNKNOWN_LANG = "und"
#: A word of a block (lang, word, n times, number), or its texts as numbers, 0 between pieces (numbers).
ENCODED = "block long, lang string, word string, n long, number int, numbers binary"
RUNS = "part int, keys binary"
COUNTED = "a int, b int, c int, f long"


class Numbers(dict):
    """The numbers of a language's words in a block, from 1 in the order they come; breaks are 0."""

    def __init__(self, words: list[tuple[str, str]], lang: str):
        super().__init__(dict.fromkeys(BREAKS, 0))
        self.words, self.lang = words, lang

    def __missing__(self, word: str) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return self[word]


def packed(columns: list[np.ndarray]) -> bytes:
    """Arrays of 32 bits, byte by byte of equal weight, compressed."""
    return zlib.compress(np.stack(columns).astype("<u4").view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1).tobytes(), 1)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n arrays that packed() got."""
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(n, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0]


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of binary keys, rows of 16-bit digits: by the last digit first, each pass in linear time."""
    order = np.arange(len(keys))
    for digit in range(keys.shape[1] - 1, -1, -1):
        column = keys[:, digit].astype(np.uint16)
        if len(column) and (column != column[0]).any():
            order = order[np.argsort(column[order], kind="stable")]
    return order


def run_lengths(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids: n-grams as rows of ids, 0 behind the last; the distinct ones in ascending order and the sums of their counts."""
    if not len(ids):
        return ids, counts
    keys = np.ascontiguousarray(ids, dtype=">u4")  # 12 bytes a key, whose order as bytes is that of the ids
    order = radix_order(keys.view(">u2"))
    ids, counts = ids[order], counts[order]
    at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    return ids[at], np.add.reduceat(counts, at)


def ngrams(ids: np.ndarray) -> np.ndarray:
    """Pairs and triples of neighbouring ids that no 0 breaks."""
    pair = (ids[:-1] > 0) & (ids[1:] > 0)
    two = np.flatnonzero(pair)
    three = np.flatnonzero(pair[:-1] & pair[1:])
    out = np.zeros((len(two) + len(three), 3), dtype=np.uint32)
    out[: len(two), 0], out[: len(two), 1] = ids[two], ids[two + 1]
    out[len(two) :] = np.stack([ids[three], ids[three + 1], ids[three + 2]], axis=1)
    return out


def splitters(marks: list[tuple[int, float]], rows: float, most: float, depth: int = 3) -> list[tuple[int, ...]]:
    """Keys at which ranges begin, so that none is expected to get more than `most` of `rows` rows.

    marks: (first id, share of all words) of ranges of ids in ascending order, a frequent word a range of its own. A range of
    ids that has too much is split by the next id of the key, as if words came independently.
    """
    out, held = [], 0.0
    for first, share in marks:
        own = rows * share
        if own > most and depth > 1:
            out.append((first, *[0] * (depth - 1)))
            out += [(first, *rest) for rest in splitters(marks, own, most, depth - 1)]
            held = most  # what follows begins a range
        elif held + own > most:
            out.append((first, *[0] * (depth - 1)))
            held = own
        else:
            held += own
    return out


def _encode(docs: DataFrame, block_chars: int) -> DataFrame:
    """Rows of ENCODED for blocks of consecutive rows of docs (lang, text)."""

    def encode(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        words: list[tuple[str, str]] = []
        langs: dict[str, Numbers] = {}
        held, size = [np.zeros(1, np.uint32)], 0

        def flush():
            numbers = np.concatenate(held)
            n = np.bincount(numbers, minlength=len(words) + 1)[1:]
            lang, word = zip(*words, strict=True) if words else ((), ())
            null = lambda kind, k: pa.nulls(k, kind)
            k = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(range(1, k + 1), pa.int32()), null(pa.binary(), k)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), null(pa.string(), 1), null(pa.string(), 1), null(pa.int64(), 1), null(pa.int32(), 1), pa.array([packed([numbers])], pa.binary())], names=names)

        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").translate(LOWER)
                own = langs.get(lang)
                if own is None:
                    own = langs[lang] = Numbers(words, lang)
                every = None if len(text) < 1 << 20 else (m.group() for m in TOKEN.finditer(text))
                while part := TOKEN.findall(text) if every is None else list(islice(every, PART)):
                    held.append(np.fromiter(map(own.__getitem__, part), np.uint32, len(part)))
                    if every is None:
                        break
                held.append(np.zeros(1, np.uint32))
                size += len(text)
                if size >= block_chars:
                    yield from flush()
                    block, size = block + 1, 0
                    words, langs, held = [], {}, [np.zeros(1, np.uint32)]
        if len(held) > 1:
            yield from flush()

    return docs.mapInArrow(encode, ENCODED)


def _dictionary(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words that come `least` times or more; id: from 1 without gaps. A checkpoint."""
    rows = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    rows = rows.select("lang", "word", "f", F.monotonically_increasing_id().alias("m")).checkpoint()
    part = F.shiftright("m", 33).cast("int").alias("part")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    first, starts = 1, []
    for p, n in sizes:
        starts.append((p, first))
        first += n
    if first > 1 << 31:
        raise ValueError("keys have 31 bits for a word")
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long")
    number = (F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id")
    return rows.withColumn("part", F.shiftright("m", 33).cast("int")).join(F.broadcast(starts), "part").select("lang", "word", "f", number)


def _marks(dictionary: DataFrame) -> tuple[list[tuple[int, float]], int]:
    """Ranges of ids with their shares of all words, a word with more than a share of 1 / BINS a range of its own; all words."""
    seen = dictionary.agg(F.sum("f").alias("n"), F.max("id").alias("ids")).first()
    total, ids = seen["n"] or 0, seen["ids"] or 0
    width = max(1, -(-ids // BINS))
    bins = {r["b"] * width: r["f"] for r in dictionary.groupBy(F.floor(F.col("id") / width).alias("b")).agg(F.sum("f").alias("f")).collect()}
    for r in dictionary.filter(F.col("f") > total / BINS).select("id", "f").collect():  # BINS at most
        own = r["id"] // width * width
        bins[own] = bins.get(own, 0) - (r["f"] if own != r["id"] else 0)
        if own != r["id"]:
            bins[r["id"]] = r["f"]
            if r["id"] + 1 < own + width:
                bins.setdefault(r["id"] + 1, 0)
    return [(i, max(0, f) / total) for i, f in sorted(bins.items())], total


def _counts(encoded: DataFrame, links: DataFrame, begins: list[tuple[int, ...]], least: int) -> DataFrame:
    """Rows of COUNTED for pairs (c: 0) and triples that come `least` times or more."""
    edges = np.array(begins, dtype=np.uint32).reshape(-1, 3)
    edges = np.ascontiguousarray(edges, dtype=">u4").view("S12").ravel()

    def of_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts, cells = [], []
        for data in left.column("numbers").to_pylist():
            numbers = unpacked(data, 1)[0]
            known = np.zeros(int(numbers.max(initial=0)) + 1, dtype=np.uint32)
            known[right.column("number").to_numpy()] = right.column("id").to_numpy()
            ids = ngrams(known[numbers])
            ids, n = run_lengths(ids, np.ones(len(ids), np.int64))
            cut = np.r_[0, np.searchsorted(np.ascontiguousarray(ids, dtype=">u4").view("S12").ravel(), edges), len(ids)] if len(ids) else [0]
            for part, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if i < j:
                    parts.append(part)
                    cells.append(packed([ids[i:j, 0] - np.r_[np.uint32(0), ids[i : j - 1, 0]], ids[i:j, 1], ids[i:j, 2], n[i:j]]))
        return pa.table({"part": pa.array(parts, pa.int32()), "keys": pa.array(cells, pa.binary())})

    def of_range(rows: pa.Table) -> pa.Table:
        got = [unpacked(x, 4) for x in rows.column("keys").to_pylist()]
        ids = np.concatenate([np.stack([np.cumsum(x[0], dtype=np.uint32), x[1], x[2]], axis=1) for x in got])
        ids, n = run_lengths(ids, np.concatenate([x[3] for x in got]).astype(np.int64))
        ids, n = ids[n >= least], n[n >= least]
        return pa.table({"a": pa.array(ids[:, 0], pa.int32()), "b": pa.array(ids[:, 1], pa.int32()), "c": pa.array(ids[:, 2], pa.int32()), "f": pa.array(n, pa.int64())})

    runs = encoded.groupBy("block").cogroup(links.groupBy("of_block")).applyInArrow(of_block, RUNS)
    return runs.groupBy("part").applyInArrow(of_range, COUNTED)


def _cut(l_col: str, r_col: str):
    """A cut's score, in decimals: the products may pass 64 bits."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('f')} * {wide('f')})) div ({wide(l_col)} * {wide(r_col)})")


def phrases(docs: DataFrame, least: int = 10, top: int = 2000, inside_percent: int = 50, block_chars: int = BLOCK_CHARS, range_rows: int = RANGE_ROWS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs (lang, text, ...) -> lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two or three words.

    A-Z are lower-cased, texts fall into pieces at [.,;:!?\\n-\\r] and these into words at spaces and tabs; null text is
    empty, a null lang `und`. f: a phrase's occurrences within pieces; n: all words of the language. Phrases with
    a = f >= least count. Cut behind the first word or the second, a phrase's score is floor(10^6 * a * a / (l * r)), l and r
    the f of both parts; the cut with the lowest score counts, the first of equal ones. A pair that stands in a triple with
    100 * f(triple) >= inside_percent * a is left out. Order: score and a descending, phrase in byte order. Rows that are equal
    count as often as they come. Words, counts and products are exact. Empty table: no rows. Other columns aren't read.
    block_chars: text of a block, a longer document is one of its own; range_rows: n-grams that one task sorts, as far as
    their words' counts tell.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with tidy(spark):
        _encode(rows, block_chars).write.parquet(folder)
        encoded = spark.read.parquet(folder)
        words = encoded.filter(F.col("numbers").isNull()).select("block", "lang", "word", "n", "number")
        totals = words.groupBy("lang").agg(F.sum("n").alias("n")).checkpoint()
        dictionary = _dictionary(words, least).checkpoint()
        marks, total = _marks(dictionary)
        links = words.join(dictionary, ["lang", "word"]).select(F.col("block").alias("of_block"), "number", "id")
        texts = encoded.filter(F.col("numbers").isNotNull()).select("block", "numbers")
        counted = _counts(texts, links, splitters(marks, 2.0 * total, float(range_rows)), least).checkpoint()
    return _ranked(counted, dictionary, totals, top, inside_percent)


def _ranked(counted: DataFrame, dictionary: DataFrame, totals: DataFrame, top: int, inside_percent: int) -> DataFrame:
    pairs, triples = counted.filter("c = 0").select("a", "b", "f"), counted.filter("c > 0")
    longer = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f"))
    longer = longer.groupBy("a", "b").agg(F.max("f").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").filter(F.lit(100) * F.coalesce("longer", F.lit(0)) < F.lit(inside_percent) * F.col("f"))
    two = two.select("a", "b", F.lit(0).alias("c"), "f", F.lit(None).cast("long").alias("f_ab"), F.lit(None).cast("long").alias("f_bc"))
    three = triples.join(pairs.withColumnRenamed("f", "f_ab"), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])
    rows = two.unionByName(three.select("a", "b", "c", "f", "f_ab", "f_bc"))
    for name in "abc":  # few of the corpus' n-grams are frequent; words come by a join of any size
        own = dictionary.select(F.col("id").alias(name), F.col("word").alias(f"word_{name}"), F.col("f").alias(f"f_{name}"), *(["lang"] if name == "a" else []))
        rows = rows.join(own, name, "left")
    is_two = F.col("c") == 0
    rows = rows.select("lang", F.col("f"), F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), "f_a", F.when(is_two, F.col("f_b")).otherwise(F.col("f_bc")).alias("rest"), "f_ab", "f_c")
    first, second = _cut("f_a", "rest"), _cut("f_ab", "f_c")
    rows = rows.withColumn("first", first).withColumn("second", F.when(F.col("f_ab").isNotNull(), second))
    later = F.col("second") < F.col("first")
    rows = rows.select(
        "lang", "phrase", F.col("f").alias("a"), F.when(later, F.col("f_ab")).otherwise(F.col("f_a")).alias("l"),
        F.when(later, F.col("f_c")).otherwise(F.col("rest")).alias("r"), F.when(later, F.col("second")).otherwise(F.col("first")).alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")  # a language that has most phrases is ranked in parts first
    rows = rows.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB.
OP12_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM lists, (SELECT unnest([1, 2, 3]) AS k)
), counts AS (
  SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), longer AS (
  SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM counts WHERE k = 3 AND f >= 10 UNION ALL SELECT lang, g[2:3], f FROM counts WHERE k = 3 AND f >= 10) GROUP BY lang, g
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.k, x.f AS l, y.f AS r, CAST(1000000 * c.f::HUGEINT * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM counts AS c JOIN counts AS x ON x.lang = c.lang AND x.k < c.k AND x.g = c.g[1:x.k] JOIN counts AS y ON y.lang = c.lang AND y.k = c.k - x.k AND y.g = c.g[x.k + 1:c.k]
  LEFT JOIN longer AS z ON z.lang = c.lang AND z.g = c.g AND c.k = 2 WHERE c.k > 1 AND c.f >= 10 AND (z.f IS NULL OR 100 * z.f < 50 * c.f)
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, x.k) = 1
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM cuts
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
