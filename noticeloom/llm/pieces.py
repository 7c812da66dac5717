"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary goes on behind a white space marker, so a text falls into chunks, each a run of markers and the word
behind it, that are segmented apart from each other. A task keeps a table of the chunks that it has met: each new one is
segmented once, and a text's ids are the table's ids of its chunks, put together by position.
"""

from __future__ import annotations

import heapq
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.textkit import chunks

MARK = "▁"
NONE = np.iinfo(np.int64).max
SHORT = 48  # symbols of a chunk that takes part in the rounds
TABLE_ROWS, TABLE_CHARS = 400_000, 16 << 20
PART = 1 << 17
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model's file


class Vocabulary:
    """Pieces of a model file as arrays: the symbol of each character, and what each pair of symbols makes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        trainer, normalizer = model.trainer_spec, model.normalizer_spec
        pieces = [(x.piece, x.score, x.type) for x in model.pieces]
        known = (trainer.model_type == trainer.BPE, trainer.byte_fallback, not trainer.treat_whitespace_as_suffix, not normalizer.precompiled_charsmap,
                 normalizer.add_dummy_prefix, not normalizer.remove_extra_whitespaces, normalizer.escape_whitespaces, {k for *_, k in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE})
        if not all(known):
            raise ValueError("only models of pair merges with byte fallback, a marker before the text and no other change of it are supported")
        if any(MARK in x.lstrip(MARK) for x, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece goes on behind a marker, so chunks can't be segmented apart")
        normal = {x: i for i, (x, _, kind) in enumerate(pieces) if kind == NORMAL}
        inner = {c for x in normal if len(x) > 1 for c in x}
        self.size = len(pieces)
        single = {c: normal[c] for c in normal if len(c) == 1}
        self.extra = np.array(sorted(ord(c) for c in inner - single.keys()), dtype=np.int64)  # characters of longer pieces alone
        symbol = single | {chr(c): self.size + i for i, c in enumerate(self.extra.tolist())}
        self.chars = np.array(sorted(map(ord, symbol)), dtype=np.int64)
        self.symbols = np.array([symbol[chr(c)] for c in self.chars.tolist()], dtype=np.int64)
        symbol |= normal
        order = {s: i for i, s in enumerate(sorted({-score for _, score, kind in pieces if kind == NORMAL}))}
        pairs = {}
        for x, i in normal.items():
            for k in range(1, len(x)):
                if x[:k] in symbol and x[k:] in symbol:
                    pairs[symbol[x[:k]] << 20 | symbol[x[k:]]] = (order[-pieces[i][1]], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank, self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64).reshape(-1, 2).T
        self.bytes = np.full(256, -1, dtype=np.int64)
        for i, (x, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(x[3:5], 16)] = i
        said = [x.replace(MARK, " ").encode() if kind == NORMAL else bytes([int(x[3:5], 16)]) if kind == BYTE else trainer.unk_surface.encode() if kind == UNKNOWN else b"" for x, _, kind in pieces]
        self.said_at = np.r_[0, np.cumsum([len(x) for x in said])]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.silent = np.array([kind == CONTROL for *_, kind in pieces])
        self.marked = np.array([kind == NORMAL and x.startswith(MARK) for x, _, kind in pieces])
        alone = "".join(re.escape(chr(c)) for c in (*range(32), 127) if chr(c) not in inner)
        stop = MARK + alone
        self.chunk = rf"{MARK}+[^{stop}]*|[^{stop}]+" + (f"|[{alone}]" if alone else "")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols (NONE: they make no piece) and the piece."""
        key = left << 20 | right  # negative if a symbol is
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.made[at]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one after the other, and how many each has."""
        sizes = np.array([len(x) for x in words], dtype=np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        symbol = np.where(self.chars[at] == code, self.symbols[at], -1 - code)
        begin = np.r_[0, np.cumsum(sizes)]
        long = np.flatnonzero(sizes > SHORT)
        own = {i: self._by_heap(symbol[begin[i] : begin[i + 1]]) for i in long.tolist()}
        short = np.repeat(sizes <= SHORT, sizes)
        merged, counts = self._by_rounds(symbol[short], np.where(sizes > SHORT, 0, sizes))
        if own:
            counts[long] = [len(x) for x in own.values()]
            whole = np.empty(counts.sum(), dtype=np.int64)
            is_long = np.zeros(len(words), dtype=bool)
            is_long[long] = True
            place = np.repeat(is_long, counts)
            whole[~place] = merged
            whole[place] = np.concatenate(list(own.values()))
            merged = whole
        return self._with_bytes(merged, counts)

    def _by_rounds(self, symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges in every word the leftmost of its pairs with the best rank."""
        counts = sizes.copy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_owner, done_symbol = [], []
        rank, made = self._ranks(symbol, owner, np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(owner)])
            best = np.minimum.reduceat(rank, start)
            over = best == NONE
            if over.any():
                stay = np.repeat(~over, length)
                done_owner.append(owner[~stay])
                done_symbol.append(symbol[~stay])
                symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
                best, length = best[~over], length[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]  # the first of each word
            symbol[hit] = made[hit]
            counts[owner[hit]] -= 1
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # one symbol before each has gone
            symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
            at = np.r_[at, at[at > 0] - 1]
            rank[at], made[at] = self._ranks(symbol, owner, at)
        if not done_owner:
            return symbol, counts
        order = np.argsort(np.concatenate(done_owner), kind="stable")
        return np.concatenate(done_symbol)[order], counts

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at the places; a word's last symbol begins none."""
        right = np.minimum(at + 1, len(symbol) - 1)
        rank, made = self.pair(symbol[at], symbol[right])
        return np.where((at + 1 < len(symbol)) & (owner[at] == owner[right]), rank, NONE), made

    def _by_heap(self, symbol: np.ndarray) -> np.ndarray:
        """A long word: pairs wait in a heap by rank, then place."""
        n, of = len(symbol), symbol.tolist()
        rank, made = self.pair(symbol[:-1], symbol[1:])
        heap = [(r, i, of[i], of[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        seen: dict[int, tuple[int, int] | None] = {}

        def meet(i: int, j: int) -> None:
            key = of[i] << 20 | of[j]
            if key not in seen:
                at = int(np.searchsorted(self.keys, key))
                seen[key] = (int(self.rank[at]), int(self.made[at])) if at < len(self.keys) and self.keys[at] == key else None
            if seen[key]:
                heapq.heappush(heap, (seen[key][0], i, of[i], of[j], seen[key][1]))

        gone = [False] * n
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or of[i] != left or of[j] != right:
                continue
            of[i], gone[j], after[i] = piece, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                meet(i, after[j])
            if before[i] >= 0:
                meet(before[i], i)
        return np.array([s for s, x in zip(of, gone, strict=True) if not x], dtype=np.int64)

    def _with_bytes(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the pieces of their bytes."""
        bare = (symbol < 0) | (symbol >= self.size)
        if not bare.any():
            return symbol, counts
        own = symbol[bare]
        code = np.where(own < 0, -1 - own, np.r_[self.extra, 0][np.clip(own - self.size, 0, len(self.extra))])
        size = np.ones(len(symbol), dtype=np.int64)
        size[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(symbol, size)
        data = code.astype("<u4").tobytes().decode("utf-32-le").encode()
        out[np.repeat(bare, size)] = self.bytes[np.frombuffer(data, np.uint8)]
        return out, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)

    def text(self, ids: np.ndarray) -> str:
        """The text of ids: one marker before it is left out, bytes that are no UTF-8 are replaced one by one.

        Ids of control pieces say nothing, but bytes around them don't make one character.
        """
        out, marked = [], True
        for own in np.split(ids, np.flatnonzero(self.silent[ids])) if self.silent[ids].any() else [ids]:
            own = own[~self.silent[own]]
            size = self.said_at[own + 1] - self.said_at[own]
            first = np.r_[0, np.cumsum(size)[:-1]] if len(own) else np.zeros(0, np.int64)
            data = self.said[np.repeat(self.said_at[own] - first, size) + np.arange(size.sum())].tobytes()
            if len(own) and marked and not any(out):
                data, marked = data[1:] if self.marked[own[0]] else data, not self.marked[own[0]]
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [data[: e.start].decode(), "\ufffd"]
                    data = data[e.start + 1 :]
        return "".join(out)


class Table:
    """The chunks met so far and their ids; it is begun anew when it has grown to its bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.chunk = vocabulary, re.compile(vocabulary.chunk)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        new = [x for x in set(words) if x not in self.row]
        if new and (len(self.row) + len(new) > TABLE_ROWS or self.chars > TABLE_CHARS):
            self._clear()
            new = list(set(words))
        if new:
            ids, counts = self.vocabulary.segment(new)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            self.at = np.r_[self.at, self.at[-1] + np.cumsum(counts)]
            self.ids = np.r_[self.ids, ids.astype(np.int32)]
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has."""
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            text = MARK + text.replace(" ", MARK)
            every = None if len(text) < 1 << 20 else (m.group() for m in self.chunk.finditer(text))
            while part := self.chunk.findall(text) if every is None else list(islice(every, PART)):
                held += part
                owner.append((i, len(part)))
                size += len(part)
                if size >= PART:
                    self._join(held, owner, out, counts)
                    held, owner, size = [], [], 0
                if every is None:
                    break
        self._join(held, owner, out, counts)
        return np.concatenate(out), counts

    def _join(self, words: list[str], owner: list[tuple[int, int]], out: list[np.ndarray], counts: np.ndarray) -> None:
        if not words:
            return
        row = self.rows(words)
        size = self.at[row + 1] - self.at[row]
        first = np.r_[0, np.cumsum(size)[:-1]]
        out.append(self.ids[np.repeat(self.at[row] - first, size) + np.arange(size.sum())])
        texts, parts = np.array(owner).T
        np.add.at(counts, np.repeat(texts, parts), size)


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, ids (array<int>) by the SentencePiece file at `model`, without begin or end ids.

    The driver reads the file. Null and empty texts have no ids. One row for each row of docs, null or repeated ids
    included; empty table: no rows; other columns are not read. A model whose pieces go on behind a marker, or of
    another kind than merged pairs with byte fallback, raises ValueError.
    """
    vocabulary = Vocabulary(model)

    def encode(batches):
        table = Table(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            at = np.r_[0, np.cumsum(np.array(pc.binary_length(texts).to_pylist(), dtype=np.int64))]
            for lo, hi in chunks(at, 1 << 20):
                ids, counts = table.encode(texts.slice(lo, hi - lo).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def piece_texts(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """tokens (doc_id, ids, ...) -> doc_id, ids, decoded: the text of the ids, by the SentencePiece file at `model`.

    Null or no ids: the empty text, and ids as they are. Null ids in an array are left out; ids outside the vocabulary raise
    IndexError. One row for each row; empty table: no rows.
    """
    vocabulary = Vocabulary(model)

    def decode(batches):
        for batch in batches:
            column = batch.column(1)
            size = np.array(pc.list_value_length(column).fill_null(0).to_pylist(), dtype=np.int64)
            flat = pc.list_flatten(column)
            missing = np.array(flat.is_null().to_pylist(), dtype=bool) if flat.null_count else None
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= vocabulary.size):
                raise IndexError("an id is outside the vocabulary")
            at = np.r_[0, np.cumsum(size)]
            own = lambda i: flat[at[i] : at[i + 1]] if missing is None else flat[at[i] : at[i + 1]][~missing[at[i] : at[i + 1]]]
            decoded = pa.array([vocabulary.text(own(i)) for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, decoded], names=["doc_id", "ids", "decoded"])

    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_texts(piece_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
