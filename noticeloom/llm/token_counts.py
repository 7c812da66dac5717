"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import chunks

# The vocabulary's pattern of pre-tokens, with white space spelled out as Unicode has it.
SPACES = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
NONE = np.iinfo(np.int32).max
CACHE = 200_000
RESULT = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    rest = iter(range(256, 512))
    return [names.get(b) or chr(next(rest)) for b in range(256)]


class Merges:
    """Merge rules as arrays: sorted pair keys, their ranks, and the symbol that each rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        self.special = [x["content"] for x in model["added_tokens"] if x["special"]]
        self.first = np.array([vocabulary[x] for x in byte_symbols()], dtype=np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols of each non-empty word that survive: all words' lowest-rank pairs merge at once, round by round."""
        size = np.array([len(x) for x in words], dtype=np.int64)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        result = np.zeros(len(words), dtype=np.int64)
        rank = self._pairs(symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(owner)])
            least = np.minimum.reduceat(rank, start)
            over = least == NONE
            if over.any():
                result[owner[start[over]]] = length[over]
                stay = np.repeat(~over, length)
                symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
                least, length = least[~over], length[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])  # pairs that overlap: every other one, from the left
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            at = np.unique(np.r_[at, at[at > 0] - 1])
            rank[at] = self._pairs(symbol, owner, at)
        return result

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at the places; the last symbol of a word begins none."""
        out = np.full(len(at), NONE, dtype=np.int32)
        inner = np.flatnonzero(at + 1 < len(symbol))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.ranks(symbol[at[inner]], symbol[at[inner] + 1])
        return out


class Counter:
    """Tokens of texts, with the counts of recent pre-tokens kept."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = [x for x in tokens if x not in self.known]
        if new:
            self.known.update(zip(new, self.merges.count([x.encode() for x in new]).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        out, found, seen = [], [], set()
        for text in texts:
            pieces = self.special.split(text) if self.special and any(x in text for x in self.merges.special) else [text]
            total = len(pieces) - 1
            own: list[str] = []
            for piece in pieces:
                if len(piece) < 1 << 20:
                    own += self.pattern.findall(piece)
                    continue
                every = (m.group() for m in self.pattern.finditer(piece))
                while part := list(islice(every, 1 << 17)):
                    self.learn(set(part))
                    total += sum(map(self.known.__getitem__, part))
            found.append((total, own))
            seen.update(own)
        self.learn(seen)
        for total, own in found:
            out.append(total + sum(map(self.known.__getitem__, own)))
        return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_tokens, by the byte-level BPE file at `vocabulary`.

    The driver reads the file; executors get its merges. No begin or end tokens; a special token's string inside a
    text counts as that one token. Null text counts as empty: 0 and 0. One row for each row of docs, null or
    repeated ids included. Empty table: no rows. Other columns are not read.
    """
    merges = Merges(vocabulary)

    def count(batches):
        counter = Counter(merges)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes = np.array(pc.binary_length(texts).to_pylist(), dtype=np.int64)
            at = np.r_[0, np.cumsum(sizes)]
            tokens: list[int] = []
            for lo, hi in chunks(at):
                tokens += counter.counts(texts.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, RESULT)


def op6_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
