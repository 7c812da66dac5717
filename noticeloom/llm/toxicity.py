"""Toxicity: a logistic classifier of hashed features, regularised by counterfactual identity swaps.

Features of a text are the hashes of its distinct words and of their first 4, 5 and 6 bytes. Training minimises the
log loss plus a penalty on the squared difference of scores between a labelled sentence and the same sentence with
its identity terms swapped for others of their group, plus an L1 term that leaves few features. Where a labelled text
has no identity term, one of each pair of a group is put into a sentence of it. Every pair of terms is compared by itself too,
and the penalty rises until no swap changes a log-odds by more than SWAP_BOUND: terms share prefixes and slots of features
with the words of the texts, whether or not a text has the term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import FIRST, LOWER, U, Words, chunks, joined, lanes_of, mix, range_hashes, text_bytes, without_punctuation

# Groups of identity terms; a counterfactual takes the next term of the same group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("lesbian", "gay", "bisexual", "straight", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("juden", "christen", "muslime"), ("juifs", "chrétiens", "musulmans"), ("judíos", "cristianos", "musulmanes"),
)
NEXT = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}
TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, NEXT), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
SENTENCE = re.compile(r"[^.!?\n]+")
PAIRS = [(term, other) for term, other in NEXT.items()]
BITS = 18
SWAP_BOUND = 0.05
RAISES = 8
PREFIXES = (4, 5, 6)
# Capitals of the Latin-1 letters are the lower-case ones less 32, in UTF-8 too: C3 80..9E and C3 A0..BE.
FIT = "weights binary, intercept double, rows long, pairs long"


def swapped(sentence: str) -> str:
    """The sentence with each identity term replaced by the next of its group; the case of the first letter stays."""

    def other(m: re.Match) -> str:
        new = NEXT[m[0].lower()]
        return new.capitalize() if m[0][:1].isupper() else new

    return TERM.sub(other, sentence)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with capitals of ASCII and Latin-1 letters in lower case."""
    out = LOWER[data]
    after = np.r_[False, data[:-1] == 0xC3] if len(data) else np.zeros(0, bool)
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def feature_chunks(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, features): the distinct features of each row, by row, in pieces of rows; a long row is a piece of its own."""
    data, at = text_bytes(column)
    for lo, hi in chunks(at):
        words = Words(data, at[lo : hi + 1])
        text = lowered(words.data)
        row = np.repeat(np.arange(lo, hi), words.count) << BITS
        start, end = without_punctuation(text, words.start, words.end)
        keys = [row | slot(range_hashes(text, start, end))]
        begin = lanes_of(text)[start]
        for length in PREFIXES:
            use = end - start >= length
            keys.append(row[use] | slot(joined(np.full(1, U(length)), begin[use] & FIRST[length])))
        key = np.concatenate(keys)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        yield (key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32)


def slot(code: np.ndarray) -> np.ndarray:
    """The feature of a hash."""
    return (mix(code) >> U(64 - BITS)).astype(np.int64)


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """feature_chunks, whole."""
    found = list(feature_chunks(column))
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(r for r, _ in found)]), np.concatenate([none, *(c for _, c in found)])


def sums(column, w: np.ndarray) -> np.ndarray:
    """For each row the sum of its features' weights."""
    out = np.zeros(len(column))
    for row, feature in feature_chunks(column):
        if len(row):
            lo, hi = int(row[0]), int(row[-1]) + 1
            out[lo:hi] += np.bincount(row - lo, weights=w[feature], minlength=hi - lo)
    return out


def counterfactuals(text: str, turn: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Pairs of sentences of a text: with their identity terms and these swapped; and, in a text that has none, its
    middle sentence with a term put in the middle and with the term that takes its place, the turn's pair of PAIRS."""
    swaps = [(x, y) for x in (m[0] for m in SENTENCE.finditer(text)) if (y := swapped(x)) != x]
    if swaps:
        return swaps, []
    words = text.split()
    lo = max(0, len(words) // 2 - 10)
    left, right = " ".join(words[lo : lo + 10]), " ".join(words[lo + 10 : lo + 20])
    one, other = PAIRS[turn % len(PAIRS)]
    return [], [(f"{left} {one} {right}", f"{left} {other} {right}")]


class Rows:
    """A sparse binary matrix: features of rows, by row."""

    def __init__(self, cells: list[np.ndarray]):
        self.n = len(cells)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in cells])
        self.column = np.concatenate(cells) if cells else np.zeros(0, np.int32)

    def only(self, chosen: np.ndarray) -> None:
        stay = chosen[self.column]
        self.row, self.column = self.row[stay], self.column[stay]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=size)


def cells_of(texts: list[str]) -> list[np.ndarray]:
    """The features of each text."""
    row, column = features(pa.array(texts, pa.string()))
    return np.split(column, np.searchsorted(row, np.arange(1, len(texts)))) if texts else []


def examples(texts: list[str], turns: list[int]) -> tuple[list[np.ndarray], list[list[np.ndarray]], list[list[np.ndarray]]]:
    """Of each text its features, and where the two sentences of its pairs of both kinds differ: twice the pairs' cells."""
    found = [counterfactuals(t, k) for t, k in zip(texts, turns, strict=True)]
    kinds = []
    for kind in (0, 1):
        flat = cells_of([x for f in found for pair in f[kind] for x in pair])
        at, out = 0, []
        for f in found:
            own = []
            for _ in f[kind]:
                one, two = flat[at], flat[at + 1]
                own += [np.setdiff1d(one, two), np.setdiff1d(two, one)]  # what both have makes no difference
                at += 2
            out.append(own)
        kinds.append(out)
    return cells_of(texts), *kinds


def train(texts: list[str], labels: np.ndarray, swap_weight: float, l1: float, steps: int) -> tuple[np.ndarray, float, int]:
    """fit of texts: weights, intercept and the number of pairs."""
    cells, swaps, insertions = examples(texts, list(range(len(texts))))
    return fit(cells, [x for y in swaps for x in y], [x for y in insertions for x in y], labels, swap_weight, l1, steps)


def term_cells() -> list[np.ndarray]:
    """For each of PAIRS the features that only the one term has, then those that only the other has."""
    own = cells_of([x for pair in PAIRS for x in pair])
    return [y for one, two in zip(own[::2], own[1::2], strict=True) for y in (np.setdiff1d(one, two), np.setdiff1d(two, one))]


def largest_swap(weights: np.ndarray) -> float:
    """The most that a swap of a term for the next of its group changes a log-odds."""
    cells = term_cells()
    return max(abs(weights[one].sum() - weights[two].sum()) for one, two in zip(cells[::2], cells[1::2], strict=True))


def fit(cells: list[np.ndarray], swaps: list[np.ndarray], insertions: list[np.ndarray], labels: np.ndarray, swap_weight: float, l1: float, steps: int) -> tuple[np.ndarray, float, int]:
    """Weights, intercept and the number of pairs: accelerated proximal gradient from zero.

    swaps, insertions: for each pair the features that only the one sentence has, then those that only the other has;
    the penalty is the mean of squared differences over each kind, and over the pairs of terms alone. It is raised
    fourfold, RAISES times at most, until largest_swap is within SWAP_BOUND (swap_weight 0: no penalty, no bound). Features
    of a pair that any row has take part, and those of five rows at least whose shares in the two labels differ by three
    standard errors. What no row has stays 0, and so pulls the term that it is compared with towards 0. Features are scaled by the root of how many rows have them, so that one step size fits all.
    """
    terms = term_cells()
    kinds = (swaps, insertions, terms)
    data, one, two = Rows(cells), Rows([x for k in kinds for x in k[::2]]), Rows([x for k in kinds for x in k[1::2]])
    counts = [len(k) // 2 for k in kinds]
    size, n = 1 << BITS, max(1, data.n)
    share = max(1, labels.sum()), max(1, (1 - labels).sum())
    weight = np.where(labels == 1, n / (2 * share[0]), n / (2 * share[1])) / n
    with_one, with_any = data.back(labels, size), np.bincount(data.column, minlength=size)
    pooled = with_any / n * (1 - with_any / n)
    error = np.sqrt(pooled * (1 / share[0] + 1 / share[1]))
    chosen = (np.abs(with_one / share[0] - (with_any - with_one) / share[1]) > 3 * error) & (with_any >= 5)
    chosen[one.column] = chosen[two.column] = True
    chosen &= with_any > 0
    for x in (data, one, two):
        x.only(chosen)
    scale = 1 / np.sqrt(np.maximum(1, with_any))
    for raised in range(RAISES + 1):
        pull = np.repeat([2 * swap_weight * 4.0**raised / max(1, c) for c in counts], counts)
        w, b = _descend(data, one, two, pull, labels, weight, scale, l1, steps)
        drift = np.abs(one.dot(w) - two.dot(w))[len(pull) - counts[2] :]
        if not swap_weight or drift.max(initial=0) <= SWAP_BOUND:
            break
    return w, b, sum(counts[:2])


def _descend(data: Rows, one: Rows, two: Rows, pull: np.ndarray, labels: np.ndarray, weight: np.ndarray, scale: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, float]:
    size = len(scale)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        g = weight * (1 / (1 + np.exp(-np.clip(data.dot(w * scale) + b, -40, 40))) - labels)
        drift = (one.dot(w * scale) - two.dot(w * scale)) * pull
        return (data.back(g, size) + one.back(drift, size) - two.back(drift, size)) * scale, float(g.sum())

    w = y = np.zeros(size)
    b = c = 0.0
    probe = np.ones(size) / np.sqrt(size)
    for _ in range(8):  # the largest curvature, by power iteration on the squared data term
        z = data.dot(probe * scale)
        drift = (one.dot(probe * scale) - two.dot(probe * scale)) * pull
        image = (data.back(weight * z / 4, size) + one.back(drift, size) - two.back(drift, size)) * scale
        top = float(np.sqrt((image**2).sum()))
        probe = image / max(top, 1e-12)
    rate, momentum = 1 / max(1.2 * top, 1e-6), 1.0
    for _ in range(steps):
        g, gb = gradient(y, c)
        new = y - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        next_b = c - 1.0 * gb
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (momentum - 1) / following
        y, c = new + ahead * (new - w), next_b + ahead * (next_b - b)
        w, b, momentum = new, next_b, following
    return w * scale, b


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, swap_weight: float = 1.0, l1: float = 4e-5, steps: int = 250,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> tuple[np.ndarray, float]:
    """Weights and intercept from at most sample_rows labelled documents, half of each label where there are enough.

    The sample is the smallest hashes of doc_id per label, so that reruns agree; the caller leaves held-out rows out
    of labels. Null ids, ids with both labels, labels other than 0 and 1 and null texts don't take part. Without rows
    the weights are 0. Features are made where the texts lie: one task fits the model to at most sample_rows sets of
    at most 2 ** BITS features.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter(F.col("label") == F.col("most")).drop("most")
    half = [known.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2) for v in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # sample_rows rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").filter(F.col("text").isNotNull())
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    binary = pa.list_(pa.binary())

    def prepare(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            cells, *kinds = examples(batch.column("text").to_pylist(), ids)
            packed = [pa.array([[x.tobytes() for x in own] for own in kind], binary) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x.tobytes() for x in cells], pa.binary()), *packed], names=["id", "label", "cells", "swaps", "insertions"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        read = lambda x: [np.frombuffer(c, np.int32) for c in x]
        pairs = [read(x for own in table.column(c).to_pylist() for x in own) for c in ("swaps", "insertions")]
        w, b, n = fit(read(table.column("cells").to_pylist()), *pairs, np.array(table.column("label").to_pylist(), dtype=float), swap_weight, l1, steps)
        return pa.table({"weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "intercept": [b], "rows": pa.array([table.num_rows], pa.int64()), "pairs": pa.array([n], pa.int64())})

    rows = rows.select("id", "label", "text").mapInArrow(prepare, "id long, label int, cells binary, swaps array<binary>, insertions array<binary>")
    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, FIT).collect()
    if not got:
        return np.zeros(1 << BITS), 0.0
    return np.frombuffer(got[0]["weights"], np.float32).astype(float), got[0]["intercept"]


def toxicity_scores(docs: DataFrame, weights: np.ndarray, intercept: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score. Null texts score as empty ones: by the intercept alone."""
    held = np.flatnonzero(weights)
    value = weights[held]

    def score(batches):
        w = np.zeros(1 << BITS)
        w[held] = value
        for batch in batches:
            z = sums(batch.column(1), w) + intercept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...) -> doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; held_out: that remainder is 0
    (null ids: false). Only texts are scored. predicted: 1 where score >= 0.5. One row for each row of docs,
    null or repeated ids included. Empty tables: no rows, or scores of 0.5. Other columns aren't read.
    """
    weights, intercept = fit_toxicity(docs, labels.filter(~held_out()), **options)
    out = toxicity_scores(docs, weights, intercept)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those whose score is 0.5 or more; their columns stay as they are. Labels are learned as in toxicity."""
    weights, intercept = fit_toxicity(docs, labels.filter(~held_out()), text_col=text_col, **options)
    held, place = np.flatnonzero(weights), docs.columns.index(text_col)
    value = weights[held]

    def keep(batches):
        w = np.zeros(1 << BITS)
        w[held] = value
        for batch in batches:
            yield batch.filter(pa.array(sums(batch.column(place), w) + intercept < 0))

    return docs.mapInArrow(keep, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
