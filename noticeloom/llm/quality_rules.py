"""Quality rules: counts of a text, and its divergence from references of its language.

A document's histogram of character classes and its histogram of common words are compared with those of each
reference language by the Jensen-Shannon distance; short texts are not judged by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import SPACE, U, Words, chunks, covered, joined, range_hashes, text_bytes, windows

# Symbols that the counts look for, and the classes of bytes; a byte of no class continues a code point.
SYMBOLS = b"#*$%&|<>"
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    b".,;:", b"!?", b"'\"()-", SYMBOLS, b"/\\_=+@~^`[]{}",
)
CLASS = np.full(256, len(CLASSES) + 2, dtype=np.int64)
for number, members in enumerate(CLASSES):
    CLASS[list(members)] = number
CLASS[:128][CLASS[:128] > len(CLASSES)] = len(CLASSES)  # control characters
CLASS[0xC0:] = len(CLASSES) + 1  # a code point above ASCII begins
N_CLASS = len(CLASSES) + 2
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True
SLOTS, COMMON = 1 << 14, 64
REFERENCE = "lang string, n long, classes binary, words binary"
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, nearest string, kept boolean"
)


def histograms(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each row its counts by class; for each word its slot."""
    rows = len(words.at) - 1
    kind = CLASS[words.data]
    row = np.repeat(np.arange(rows), np.diff(words.at))
    seen = kind < N_CLASS
    classes = np.bincount(row[seen] * N_CLASS + kind[seen], minlength=rows * N_CLASS).reshape(rows, N_CLASS)
    return classes, (words.hashes(lower=True) >> U(50)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of rows of counts p from one histogram q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame, languages: tuple[str, ...], lang_col: str, text_col: str) -> list[tuple]:
    """(language, class counts, word slot counts) over all documents of each language named that pass the base rules."""

    def count(batches):
        totals = {x: (np.zeros(N_CLASS, np.int64), np.zeros(SLOTS, np.int64), [0]) for x in languages}
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi in chunks(at):
                words = Words(data, at[lo : hi + 1])
                classes, slots = histograms(data, words)
                row = np.repeat(np.arange(hi - lo), words.count)
                sound = ~base_failed(words, window_repeats(words, words.hashes(), 5))
                for name, (by_class, by_slot, n) in totals.items():
                    own = (langs[lo:hi] == name) & sound
                    by_class += classes[own].sum(axis=0)
                    by_slot += np.bincount(slots[own[row]], minlength=SLOTS)
                    n[0] += int(own.sum())
        held = [(k, v) for k, v in totals.items() if v[2][0]]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k for k, _ in held], pa.string()), "n": pa.array([v[2][0] for _, v in held], pa.int64()),
            "classes": pa.array([v[0].tobytes() for _, v in held], pa.binary()), "words": pa.array([v[1].tobytes() for _, v in held], pa.binary()),
        })

    def add(key, table):
        total = [np.sum([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()], axis=0) for c in ("classes", "words")]
        n = sum(table.column("n").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "n": pa.array([n], pa.int64()), "classes": pa.array([total[0].tobytes()], pa.binary()), "words": pa.array([total[1].tobytes()], pa.binary())})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(count, REFERENCE).groupBy("lang").applyInArrow(add, REFERENCE).collect()  # a row for each language named at most
    return [(r["lang"], np.frombuffer(r["classes"], np.int64), np.frombuffer(r["words"], np.int64)) for r in sorted(rows, key=lambda r: r["lang"])]


def line_repeats(words: Words) -> np.ndarray:
    """For each row the number of \\n-split lines with a word that are equal to an earlier line of the row."""
    rows, n = len(words.at) - 1, len(words.data)
    out = np.zeros(rows, dtype=np.int64)
    if not n or not len(words.start):
        return out
    start = np.union1d(words.at[:-1][words.at[:-1] < n], np.flatnonzero(words.data == 10) + 1)
    start = start[start < n]
    end = np.r_[start[1:], n]
    row = np.searchsorted(words.at, start, side="right") - 1
    end = end - (words.data[end - 1] == 10)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[filled], end[filled], row[filled]
    value = joined(range_hashes(words.data, start, end), row.astype(np.uint64))  # equal for equal lines of one row
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    return np.bincount(row[order][1:][same], minlength=rows)


def window_repeats(words: Words, hashes: np.ndarray, width: int) -> np.ndarray:
    """For each row the number of words in windows of width words found twice or more in the row."""
    row = np.repeat(np.arange(len(words.count)), words.count)
    place = np.arange(len(row)) - words.first[row]
    at = np.flatnonzero(place + width <= words.count[row])
    value = joined(windows(hashes, width)[at], row[at].astype(np.uint64))  # equal for equal windows of one row
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(row), dtype=bool)
    hit[at[twice]] = True
    return np.bincount(row[covered(hit, width, len(row))], minlength=len(words.count))


def base_failed(words: Words, repeats: np.ndarray) -> np.ndarray:
    """Whether a row has fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (words.count < 10) | (100 * repeats > 20 * words.count)


def quality_rules(
    docs: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr"), min_words: int = 50, most_class: float = 0.25, most_word: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> the counts, the two distances, the nearest reference and kept.

    References are counted over all documents whose lang is in languages and that pass the base rules, so that
    junk of repeated text, however much there is, sets no standard; a document is compared with all of them
    and judged by the nearest (ties: the first by name). kept: false where base_failed; else true for texts of
    fewer than min_words words, or where no reference has a text; else whether class_distance <= most_class and
    word_distance <= most_word. Null text: no words, so base_failed. Null lang: compared like any other, counted in
    no reference. One row for each row of docs. Empty table: no rows. Columns other than the three are not read.
    Equality of lines and windows is equality of 64-bit hashes.
    """
    known = references(docs, languages, lang_col, text_col)
    common = [np.argsort(-w, kind="stable")[:COMMON] for _, _, w in known]
    slot_of = np.full((len(known), SLOTS), COMMON, dtype=np.int64)
    for i, slots in enumerate(common):
        slot_of[i, slots] = np.arange(COMMON)
    held = [np.bincount(slot_of[i], weights=w, minlength=COMMON + 1) for i, (_, _, w) in enumerate(known)]
    names = [x for x, _, _ in known]

    def judge(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for lo, hi in chunks(at):
                words = Words(data, at[lo : hi + 1])
                rows, n_words = hi - lo, words.count
                classes, slots = histograms(data, words)
                row = np.repeat(np.arange(rows), n_words)
                starts = (words.data & 0xC0) != 0x80
                sums = np.r_[0, np.cumsum(starts & ~SPACE[words.data])]
                chars = sums[words.at[1:]] - sums[words.at[:-1]]
                sums = np.r_[0, np.cumsum(IS_SYMBOL[words.data])]
                symbols = sums[words.at[1:]] - sums[words.at[:-1]]
                repeats = window_repeats(words, words.hashes(), 5)
                failed = base_failed(words, repeats)
                best, by_class, by_word = np.full(rows, -1), np.full(rows, np.inf), np.full(rows, np.inf)
                for i, (_, ref, _) in enumerate(known):
                    near = distance(classes.astype(float), ref.astype(float))
                    own = np.bincount(row * (COMMON + 1) + slot_of[i][slots], minlength=rows * (COMMON + 1)).reshape(rows, COMMON + 1)
                    far = distance(own.astype(float), held[i])
                    closer = near + far < by_class + by_word
                    best[closer], by_class[closer], by_word[closer] = i, near[closer], far[closer]
                judged = (n_words >= min_words) & (best >= 0)
                kept = ~failed & (~judged | ((by_class <= most_class) & (by_word <= most_word)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, line_repeats(words), repeats)),
                        pa.array(failed), pa.array(by_class, mask=best < 0), pa.array(by_word, mask=best < 0),
                        pa.array([names[i] if i >= 0 else None for i in best.tolist()], pa.string()), pa.array(kept),
                    ],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, RESULT)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
