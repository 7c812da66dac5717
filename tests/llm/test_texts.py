"""Pieces, phrases and lexical search against a library, plain counting and exhaustive scores."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
EXTRA = ", item_id long, rank int, score long, ids string, decoded string, block long, word string, n long, number int, phrase string, a int, f long, term string, item int, times long"


def with_clashes(spark, rows):
    """doc_id, text, lang with columns whose names the operators use inside."""
    extra = (1, 2, 3, "i", "d", 4, "w", 5, 6, "p", 7, 8, "t", 9, 10)
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string" + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    some = [f"w{i}" for i in range(60)] + ["ÉCOLE", "straße", "字", "x\x00y", "Ab", "aB"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\xa0"]) for _ in range(rng.choice([3, 20, 80]))) for _ in range(120)]
    texts += ["over and over again. " * 30, "Over AND over, again", "same same same same same " * 5, None, "", " \n\t ", "▁ marks▁in ▁▁text", "one", "z" * 30_000, "long  text\n" * 20_000]
    out = [(i, t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts)]
    return [*out, (3, texts[3], "de"), (3, texts[3], "de"), (None, texts[5], None), (None, texts[5], None), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return with_clashes(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return with_clashes(spark, [])


# 11: pieces


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


def test_pieces_of_rows(docs, rows, model, library, empty):
    from noticeloom.llm.pieces import piece_ids, piece_texts

    got = piece_texts(piece_ids(docs, model), model)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert piece_texts(piece_ids(empty, model), model).count() == 0


def test_segments_as_the_library(model, library, monkeypatch):
    from noticeloom.llm import pieces

    vocabulary, rng = pieces.Vocabulary(model), random.Random(3)
    letters = list(" ▁\n\t\r;){}aeiothésABCз字ꙮ\x00<>0xA1 ")
    known = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(150))) for _ in range(2000)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(40))).replace("▁", rng.choice([" ", "▁", ""])) for _ in range(2000)]
    texts += ["<s>", "<unk>", "</s><0x0A>", "a" * 5000, " " * 1000, "ab" * 4000 + " " + "é" * 999, ""]
    for rows_held, part in ((pieces.TABLE_ROWS, pieces.PART), (50, 64)):  # a table that is begun anew, texts taken in parts
        monkeypatch.setattr(pieces, "TABLE_ROWS", rows_held)
        monkeypatch.setattr(pieces, "PART", part)
        ids, counts = pieces.Table(vocabulary).encode(texts)
        at = [0, *counts.cumsum().tolist()]
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == library.encode(texts)


def test_decodes_any_ids(spark, model, library):
    from noticeloom.llm.pieces import piece_texts

    rng = random.Random(5)
    kinds = (lambda: rng.randrange(library.get_piece_size()), lambda: rng.randrange(3, 259), lambda: rng.randrange(3), lambda: rng.choice([28705, 259]))
    lists = [[rng.choice(kinds)() for _ in range(rng.randrange(9))] for _ in range(3000)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None), (-2, [None, 264, None])], "doc_id long, ids array<int>")
    got = {r.doc_id: (r.ids, r.decoded) for r in piece_texts(frame, model).collect()}
    assert got.pop(-1) == (None, "")
    assert got.pop(-2) == ([None, 264, None], library.decode([264]))
    assert got == {i: (x, library.decode(x)) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="outside the vocabulary"):
        piece_texts(spark.createDataFrame([(1, [32000])], "doc_id long, ids array<int>"), model).collect()


def test_other_kinds_of_models_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2

    from noticeloom.llm.pieces import Vocabulary

    for change in ("across", "suffix"):
        with open(model, "rb") as f:
            own = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if change == "across":
            own.pieces[400].piece = "of▁the"
        else:
            own.trainer_spec.treat_whitespace_as_suffix = True
        path = tmp_path / f"{change}.model"
        path.write_bytes(own.SerializeToString())
        with pytest.raises(ValueError, match="marker"):
            Vocabulary(str(path))


def test_op11_digests(spark, library):
    from noticeloom.llm.pieces import op11_sentencepiece

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in op11_sentencepiece(spark, sf).collect()} == want


# 12: phrases


def brute_phrases(rows, least, top, inside):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    longer, out = Counter(), defaultdict(list)
    for (lang, g), a in f.items():
        if len(g) == 3 and a >= least:
            for s in (g[:2], g[1:]):
                longer[lang, s] = max(longer[lang, s], a)
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and not (longer[lang, g] and len(g) == 2 and 100 * longer[lang, g] >= inside * a):
            score, k = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("options", [{}, {"least": 2, "top": 40, "block_chars": 500, "range_rows": 50}, {"least": 3, "top": 7, "inside_percent": 90, "block_chars": 20_000, "range_rows": 1}])
def test_phrases(docs, rows, options):
    from noticeloom.llm.phrases import phrases

    got = phrases(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, options.get("least", 10), options.get("top", 2000), options.get("inside_percent", 50))
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_phrases_without_words(spark, empty):
    from noticeloom.llm.phrases import phrases

    assert phrases(empty).count() == 0
    assert phrases(with_clashes(spark, [(1, None, None), (2, " .", "en"), (3, "a b", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    from noticeloom.llm.phrases import _cut

    rng = random.Random(1)
    rows = [(a, a + rng.randrange(10**13), a + rng.randrange(10**13)) for a in (rng.randrange(1, 10**14) for _ in range(200))]
    got = spark.createDataFrame(rows, "f long, l long, r long").select("*", _cut("l", "r").alias("score")).collect()
    assert all(x.score == 10**6 * x.f * x.f // (x.l * x.r) for x in got)


def test_radix_order_and_ranges():
    import numpy as np

    from noticeloom.llm.phrases import ngrams, packed, run_lengths, splitters, unpacked

    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 31, (5000, 3), dtype=np.uint32)
    ids[2000:4000, :2] = [7, 1 << 30]
    ids[4000:] = ids[:1000]
    own, n = run_lengths(ids, np.arange(5000))
    want = Counter()
    for row, k in zip(ids.tolist(), range(5000), strict=True):
        want[tuple(row)] += k
    assert list(zip(map(tuple, own.tolist()), n.tolist(), strict=True)) == sorted(want.items())
    back = unpacked(packed([own[:, 0], own[:, 2]]), 2)
    assert (back == np.stack([own[:, 0], own[:, 2]])).all()
    assert ngrams(np.array([0, 1, 2, 3, 0, 4, 5, 0], np.uint32)).tolist() == [[1, 2, 0], [2, 3, 0], [4, 5, 0], [1, 2, 3]]
    marks = [(0, 0.1), (5, 0.5), (6, 0.1), (9, 0.3)]  # word 5 is half of all
    begins = splitters(marks, 1000.0, 100.0)
    assert begins == sorted(set(begins))
    assert {(5, 0, 0), (5, 5, 0), (6, 0, 0), (9, 5, 0)} <= set(begins)
    assert (5, 5, 5) in begins
    assert splitters(marks, 1000.0, 2000.0) == []


# 13: lexical search


def brute_search(rows, items, k):
    found = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for i, t, *_ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        scores = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(9)
    texts = [t for _, t, _ in rows if t and len(t) < 2000]
    some = [(j, " ".join(rng.choice(texts).split()[:12])) for j in range(25)]
    return [*some, (7, "W1 w2 ÉCOLE"), (7, "W1 w2 ÉCOLE"), (None, "over, and OVER w3"), (90, None), (91, ""), (92, "nowhere_found §"), (93, "w1")]


@pytest.mark.parametrize("options", [{}, {"block_docs": 4}, {"block_docs": 7, "k": 3, "item_bytes": 400}])
def test_lexical_search(spark, docs, rows, items, options):
    from noticeloom.llm.lexical_search import lexical_search

    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, rank long")
    got = lexical_search(docs, queries, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_search(rows, items, options.get("k", 10))


def test_lexical_search_of_nothing(spark, docs, empty):
    from noticeloom.llm.lexical_search import lexical_search

    queries = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search(empty, queries).count() == 0
    assert lexical_search(docs, queries.limit(0)).count() == 0
    assert lexical_search(docs.withColumn("text", F.lit("..")), queries).count() == 0


def test_bounds_hold_and_prune(rows):
    import numpy as np
    import pyarrow as pa

    from noticeloom.llm.lexical_search import Block, Corpus, Items, _index

    class Frame:  # the index's function, called as a task would
        def mapInArrow(self, make, kind):
            return make

    items = Items(["w1 w2 w3", "over again", "w59"])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
    import pyspark

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 2

    held, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        blocks = [Block(r) for b in _index(Frame(), items, 8)([batch]) for r in b.to_pylist()]
    finally:
        pyspark.TaskContext = held
    corpus, tight = Corpus(120, 5000, np.array([40] * len(items.codes))), 0
    for b in blocks:
        bounds = b.bounds(items, corpus)
        best = {i: found[0][0] if found else 0 for i, found in b.best(items, corpus, np.arange(items.count), 3)}
        assert all(best[i] <= bounds[i] for i in range(items.count))
        tight += sum(best[i] == bounds[i] for i in range(items.count))
    assert tight
    assert len({b.number for b in blocks}) == len(blocks) > 10
