"""Benchmark decontamination by spaced seeds.

A seed is a window of words of which a fixed mask reads some and ignores the others, so that a substituted word spoils
fewer seeds than it would of contiguous ones. Seeds of the benchmark are joined with those of each document, and each
hit's diagonal is verified: the best stretch of it, with substitutions, must hold enough matching words.

The masks lose nothing: a stretch whose every beginning has more than three matches a substitution and that holds as
many matches as its item needs has a seed without a substitution (the tests prove it by walking all such stretches).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import U, Words, chunks, joined, mix, text_bytes
from noticeloom.session import ensure_checkpoint_dir

# The mask for items that need LONG_NEED matching words or more, and the one for those that need fewer.
LONG_MASK, SHORT_MASK, LONG_NEED = "111011", "1011", 6
MISMATCH = 3
LEAST_NEED = 4
TABLE_BITS = 20
FILTER_BITS = 26
SLICES = 32
SLICE_BLOCKS = 4
SHORT_ITEM = 256
TOGETHER = 1024
PAIRS = 1 << 20
HITS = "doc_id long, item_id long, n_matched long, n_item_words long, doc_start long, doc_end long"


def need_of(n_words: int, least: int, share: float) -> int:
    """How many matching words make an overlap with an item of n_words."""
    return max(LEAST_NEED, min(least, int(np.ceil(share * n_words))))


def mask_of(need: int) -> str:
    return LONG_MASK if need >= LONG_NEED else SHORT_MASK


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the words that the mask reads, for each window of its length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, U(int(mask, 2)))
    for i, read in enumerate(mask):
        if read == "1":
            total = joined(total, hashes[i : i + n])
    return mix(total)


def word_hashes(words: Words) -> np.ndarray:
    return words.hashes(lower=True, bare=True)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Matches, first and end place of the stretch with the most of (matches - 3 x others)."""
    total = np.r_[0, np.cumsum(np.where(same, 1, -MISMATCH))]
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), start, end


def verify(hashes: np.ndarray, word: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The best stretch of a text and an item whose first word lies at the text's place `shift`, places in the text."""
    lo, hi = max(0, shift), min(len(hashes), shift + len(word))
    if hi <= lo:
        return 0, 0, 0
    n, start, end = best_stretch(hashes[lo:hi] == word[lo - shift : hi - shift])
    return n, lo + start, lo + end


def shifts(positions: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """The distinct differences of two lists of places below reach, in time and memory that don't take all pairs at once."""
    if len(positions) * len(places) <= PAIRS:
        return np.unique(positions[:, None] - places[None, :])
    few, many = sorted((positions, places), key=len)
    mark = np.zeros(2 * reach + 1, dtype=bool)
    for x in few.tolist():
        mark[(many - x if many is positions else x - many) + reach] = True
    return np.flatnonzero(mark) - reach


class Benchmark:
    """Items' word hashes and, for each mask, their distinct seeds in order, with the items and places of each."""

    def __init__(self, ids: list[int], texts: list[str], least: int, share: float):
        data, at = text_bytes(pa.array(texts, pa.string()))
        words = Words(data, at)
        hashes = word_hashes(words)
        self.ids = ids
        self.words = [hashes[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        self.need = [need_of(len(w), least, share) for w in self.words]
        self.hashes, self.first, self.size = hashes, np.asarray(words.first, dtype=np.int64), np.diff(words.first).astype(np.int64)
        self.masks = []
        for mask in (LONG_MASK, SHORT_MASK):
            mine = [i for i, w in enumerate(self.words) if len(w) >= len(mask) and mask_of(self.need[i]) == mask]
            if mine:
                found = [seeds(self.words[i], mask) for i in mine]
                value = np.concatenate(found)
                item, place = np.repeat(mine, [len(x) for x in found]), np.concatenate([np.arange(len(x)) for x in found])
                order = np.lexsort((place, item, value))
                first = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
                self.masks.append((mask, value[order][first], np.r_[first, len(value)], item[order], place[order]))

    def tables(self) -> list[np.ndarray]:
        """For each mask which high bits of seeds occur."""
        out = []
        for _, value, *_ in self.masks:
            out.append(np.zeros(1 << TABLE_BITS, dtype=bool))
            out[-1][(value >> U(64 - TABLE_BITS)).astype(np.int64)] = True
        return out

    def diagonals(self, hashes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Distinct (item, place of the item's first word) of all seeds that hit, by item, then place."""
        longest = max(map(len, self.words), default=0)
        reach, out = len(hashes) + longest, [np.zeros(0, np.int64)]
        for (mask, value, first, item, place), seen in zip(self.masks, tables, strict=True):
            own = seeds(hashes, mask)
            at = np.flatnonzero(seen[(own >> U(64 - TABLE_BITS)).astype(np.int64)])
            which = np.minimum(np.searchsorted(value, own[at]), len(value) - 1)
            hit = value[which] == own[at]
            at, which = at[hit], which[hit]
            order = np.argsort(which, kind="stable")
            at, which = at[order], which[order]
            times = first[which + 1] - first[which]
            start = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, int)
            many = np.diff(np.r_[start, len(which)])
            heavy = many * times[start] > PAIRS >> 4
            plain = ~np.repeat(heavy, many)
            edge = np.searchsorted(np.cumsum(np.where(plain, times, 0)), np.arange(PAIRS, int(times[plain].sum()) + PAIRS, PAIRS))
            lo = 0
            for hi in [*(edge[:-1] + 1).tolist(), len(at)] if len(at) else []:
                a, w, t = at[lo:hi][plain[lo:hi]], which[lo:hi][plain[lo:hi]], times[lo:hi][plain[lo:hi]]
                to = np.repeat(first[w] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(t.sum()) if len(a) else np.zeros(0, np.int64)
                out.append(np.unique(item[to] << 32 | (np.repeat(a, t) - place[to] + longest)))
                lo = hi
            for s, m in zip(start[heavy].tolist(), many[heavy].tolist(), strict=True):
                held = slice(first[which[s]], first[which[s] + 1])
                items, begins = np.unique(item[held], return_index=True)
                for i, b, e in zip(items.tolist(), begins.tolist(), [*begins[1:].tolist(), held.stop - held.start], strict=True):
                    out.append(i << 32 | (shifts(at[s : s + m], place[held][b:e], reach) + longest))
        key = np.unique(np.concatenate(out))
        return np.stack([key >> 32, (key & 0xFFFFFFFF) - longest], axis=1)


    def promising(self, hashes: np.ndarray, diagonals: np.ndarray):
        """The diagonals, in order, but those of items of SHORT_ITEM words or fewer with less equal words than the item needs.

        Many short items that share a phrase with a text are left out here together, not one by one.
        """
        need = np.array(self.need, dtype=np.int64)
        size = np.where(self.size > SHORT_ITEM, 0, self.size)[diagonals[:, 0]]
        for lo in range(0, len(diagonals), TOGETHER):
            (item, shift), n = diagonals[lo : lo + TOGETHER].T, size[lo : lo + TOGETHER]
            before = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(before, n)
            at = place + np.repeat(shift, n)
            inside = (at >= 0) & (at < len(hashes))
            same = np.zeros(len(at) + 1, dtype=np.int64)
            same[1:][inside] = hashes[at[inside]] == self.hashes[(place + np.repeat(self.first[item], n))[inside]]
            same = np.cumsum(same)
            yield from diagonals[lo : lo + TOGETHER][(n == 0) | (same[before + n] - same[before] >= need[item])].tolist()


def better(got: tuple[int, int, int], held: tuple[int, int, int] | None, need: int) -> bool:
    """Whether a stretch counts and has more matches than the held one, or as many and begins earlier."""
    return got[0] >= need and (held is None or (-got[0], got[1]) < (-held[0], held[1]))


def _hits(column, bench: Benchmark, tables: list[np.ndarray], any_item: bool = False):
    """(row, item, matches, start, end): the best stretch of each row and item that has enough matches.

    any_item: one item a row is enough.
    """
    data, at = text_bytes(column)
    for lo, hi in chunks(at):
        words = Words(data, at[lo : hi + 1])
        hashes = word_hashes(words)
        best: dict = {}
        for item, shift in bench.promising(hashes, bench.diagonals(hashes, tables)):
            # A diagonal may run over the end of a text: it is verified in each row that it touches.
            word = bench.words[item]
            first, last = np.searchsorted(words.first, [max(shift, 0), max(shift + len(word) - 1, 0)], side="right") - 1
            for row in range(int(first), min(int(last), hi - lo - 1) + 1):
                start, name = int(words.first[row]), row if any_item else (row, item)
                held = best.get(name)
                if held and (any_item or held[1][0] == len(word)):  # diagonals come in order: no later one is better
                    continue
                got = verify(hashes[start : words.first[row + 1]], word, shift - start)
                if better(got, held and held[1], bench.need[item]):
                    best[name] = item, got
        for name, (item, got) in sorted(best.items()):
            yield lo + (name if any_item else name[0]), item, *got


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())


def _small(items: DataFrame, block_bytes: int, least: int, share: float) -> Benchmark | None:
    """The benchmark as an object for every task, or None where its texts are over block_bytes."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return None
    rows = items.orderBy("id", "text").collect()
    return Benchmark([r["id"] for r in rows], [r["text"] for r in rows], least, share)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.7, block_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, item_id, n_matched, n_item_words, doc_start, doc_end.

    A row for each document and item that overlap: the best stretch on one diagonal (matches less three times the
    substitutions) holds `least` matching words, or `share` of the item's if that is fewer (4 at least); words are
    compared with A-Z lower-cased and without punctuation at their ends, as 64-bit hashes. Of several such diagonals the
    one with the most matches is told, then the first. doc_start, doc_end: word places. Items of fewer than 4 words
    and null texts match nothing; null ids stay null; repeated rows give repeated hits. Empty tables: no rows. Other
    columns aren't read. A benchmark of up to block_bytes is sent to every task; of a larger one, documents
    are sent to the parts that share a seed with them.
    """
    items = _items(benchmark, item_id, item_text)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = _small(items, block_bytes, least, share)
    if bench is None:
        hits, keyed_items = _joined_hits(source, items, block_bytes, least, share)
        named = source.select(_key("doc_id", "text").alias("doc_key"), "doc_id")
        return hits.join(keyed_items.select("item_key", F.col("id").alias("item_id")), "item_key").join(named, "doc_key").select(*(x.split()[0] for x in HITS.split(", ")))

    def find(batches):
        tables = bench.tables()
        for batch in batches:
            got = list(_hits(batch.column(1), bench, tables))
            ids = batch.column(0).to_pylist() if got else []
            columns = [[ids[r] for r, *_ in got], [bench.ids[i] for _, i, *_ in got], [n for _, _, n, _, _ in got], [len(bench.words[i]) for _, i, *_ in got], [a for *_, a, _ in got], [b for *_, b in got]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in HITS.split(", ")])

    return source.mapInArrow(find, HITS)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.7, block_bytes: int = 8 << 20,
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """docs without the documents that overlap an item as benchmark_hits has it; their columns stay as they are."""
    items = _items(benchmark, item_id, item_text)
    bench = _small(items, block_bytes, least, share)
    if bench is None:
        source = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        gone = _joined_hits(source, items, block_bytes, least, share, any_item=True)[0].select("doc_key").distinct()
        return docs.join(gone, _key(F.lit(0).cast("long"), F.col(text_col).cast("string")) == gone["doc_key"], "left_anti")
    place = docs.columns.index(text_col)

    def clean(batches):
        tables = bench.tables()
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            stay[[r for r, *_ in _hits(batch.column(place), bench, tables, any_item=True)]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(clean, docs.schema)


def _key(*columns):
    return F.xxhash64(*columns)


def _joined_hits(docs: DataFrame, items: DataFrame, block_bytes: int, least: int, share: float, any_item: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_key, item_key, n_matched, n_item_words, doc_start, doc_end) and (item_key, id): documents meet parts of the benchmark.

    docs (doc_id, text), items (id, text): the keys are hashes of both columns, so equal rows are compared once. Items
    are dealt into parts of about block_bytes. Blocks of documents ask which parts have their seeds, once for each seed
    that passes a bitmap of fixed size, and a document goes to those parts, whatever the number of items there that
    share a phrase with it. A part's documents are dealt into slices, each of which is compared as if the part were
    the benchmark. any_item: one item a document is enough.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    keyed = items.select(_key("id", "text").alias("item_key"), "id", "text").checkpoint()
    parts = max(1, -(-(keyed.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // block_bytes))
    once = keyed.dropDuplicates(["item_key"]).select(F.pmod("item_key", F.lit(parts)).cast("int").alias("part"), "item_key", "text")

    def item_seeds(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            part, value = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for lo, hi in chunks(at):
                words = Words(data, at[lo : hi + 1])
                hashes = word_hashes(words)
                for i, n in enumerate(words.count.tolist()):
                    own = np.unique(seeds(hashes[words.first[i] : words.first[i + 1]], mask_of(need_of(n, least, share))))
                    value.append(own)
                    part.append(np.full(len(own), batch.column(0)[lo + i].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value).view(np.int64)), pa.array(np.concatenate(part))], names=["seed", "part"])

    wanted = once.select("part", "text").mapInArrow(item_seeds, "seed long, part int").distinct()
    wanted = wanted.groupBy("seed").agg(F.collect_list("part").alias("parts")).checkpoint()

    def bits(batches):
        mark = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            mark[(batch.column(0).to_numpy().view(np.uint64) >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        packed = np.packbits(mark).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], names=["slice", "marks"])

    def merged(key, table):
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("marks").to_pylist()], axis=0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([whole.tobytes()], pa.binary())})

    got = wanted.select("seed").mapInArrow(bits, "slice int, marks binary").groupBy("slice").applyInArrow(merged, "slice int, marks binary").collect()
    marks = b"".join(r["marks"] for r in sorted(got, key=lambda r: r["slice"])) or bytes(1 << FILTER_BITS >> 3)  # 2 ** FILTER_BITS bits, whatever the benchmark

    def probed(column):
        """(row, seed) arrays of a column's seeds that the bitmap has; one that runs on into the next row is told too."""
        packed = np.frombuffer(marks, np.uint8)
        data, at = text_bytes(column)
        for lo, hi in chunks(at):
            words = Words(data, at[lo : hi + 1])
            hashes = word_hashes(words)
            for mask in (LONG_MASK, SHORT_MASK):
                own = seeds(hashes, mask)
                slot = (own >> U(64 - FILTER_BITS)).astype(np.int64)
                place = np.flatnonzero(packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                yield lo + np.searchsorted(words.first, place, side="right") - 1, own[place]

    def near(batches):
        for batch in batches:
            stay = np.zeros(batch.num_rows, dtype=bool)
            for row, _ in probed(batch.column(1)):
                stay[row] = True
            yield batch.filter(pa.array(stay))

    def asked(key, table):
        value = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for _, x in probed(table.column("text")))]))
        return pa.table({"block": pa.array(np.full(len(value), key[0].as_py(), np.int32)), "seed": pa.array(value.view(np.int64))})

    def sent(key, left, right):
        """left's rows with the parts that have one of their seeds."""
        value = right.column("seed").to_numpy().view(np.uint64)
        order = np.argsort(value)
        value = value[order]
        lists = right.column("parts").combine_chunks()
        begin, held = lists.offsets.to_numpy()[:-1][order], lists.values.to_numpy()
        size = np.diff(lists.offsets.to_numpy())[order]
        to = [np.zeros(0, np.int64)]
        for row, own in probed(left.column("text")) if len(value) else ():
            at = np.minimum(np.searchsorted(value, own), len(value) - 1)
            hit = np.unique(np.stack([row, at], axis=1)[value[at] == own], axis=0)
            n = size[hit[:, 1]]
            place = np.repeat(begin[hit[:, 1]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            to.append(np.unique(np.repeat(hit[:, 0], n) * parts + held[place]))
        to = np.unique(np.concatenate(to))
        edge = np.searchsorted(to // parts, np.arange(left.num_rows + 1))
        cells = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(to % parts, pa.int32()))
        return pa.table({"doc_key": left.column("doc_key"), "text": left.column("text"), "parts": cells})

    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    texts = docs.select(_key("doc_id", "text").alias("doc_key"), "text").filter(F.col("text").isNotNull())
    own = texts.mapInArrow(near, "doc_key long, text string").dropDuplicates(["doc_key"]).withColumn("block", F.pmod("doc_key", F.lit(n_blocks)).cast("int")).groupBy("block")
    answers = own.applyInArrow(asked, "block int, seed long").join(wanted, "seed").groupBy("block")
    routed = own.cogroup(answers).applyInArrow(sent, "doc_key long, text string, parts array<int>").checkpoint()
    routed = routed.select("doc_key", "text", F.explode("parts").alias("part"))
    slices = routed.groupBy("part").agg(F.ceil(F.sum(F.octet_length("text") + 16) / (SLICE_BLOCKS * block_bytes)).cast("int").alias("slices"))
    slices = F.broadcast(slices.checkpoint())  # two numbers a part of the benchmark
    left = routed.join(slices, "part").withColumn("slice", F.pmod("doc_key", "slices").cast("int"))
    right = once.join(slices, "part").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def compared(key, left, right):
        bench = Benchmark(right.column("item_key").to_pylist(), right.column("text").to_pylist(), least, share)
        got = list(_hits(left.column("text"), bench, bench.tables(), any_item)) if left.num_rows and right.num_rows else []
        docs = left.column("doc_key").to_pylist() if got else []
        columns = [[docs[r] for r, *_ in got], [bench.ids[i] for _, i, *_ in got], [n for _, _, n, _, _ in got], [len(bench.words[i]) for _, i, *_ in got], [a for *_, a, _ in got], [b for *_, b in got]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_key", "item_key", "n_matched", "n_item_words", "doc_start", "doc_end"])

    hits = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(compared, HITS.replace("doc_id", "doc_key").replace("item_id", "item_key"))
    return hits, keyed.select("item_key", "id")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.withColumn("contaminated", F.lit(True))
