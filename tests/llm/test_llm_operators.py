"""The ten operators against brute force, and on rows with nulls, empty and very long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, block int, tokens string, mix_size string, key double, spans string, score double, gone_id long, component_id long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def messy():
    """Rows (doc_id, text, lang, source, n_chars) with every kind of trouble."""
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 5, 9, 60, 120, 300)]
    passage = prose(rng, 70, 10**6)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(10, base[4], "de", None, None), (11, base[4].upper(), None, "s1", 0), (12, base[5] + " tail one", "en", "s1", 1), (13, "x " + base[5], "en", "s1", 1)]
    rows += [(20, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "en", "s2", 1), (21, passage, "en", "s2", 1), (22, prose(rng, 33) + "\n" + passage, "fr", "s2", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "", 0), (32, " \n\t ", "en", "s1", 4), (33, "one", "en", "s1", 3), (34, "é" * 3 + " ß　字 \x85 x", "fr", "s1", 9)]
    rows += [(40, base[3], "en", "s0", 1), (40, base[3], "en", "s0", 1), (None, base[3], "en", "s0", 1), (None, None, None, None, None)]
    rows += [(50, "long " * 60_000, "en", "s1", 1), (51, "z" * 300_000, "en", "s1", 1), (-5, base[2], "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, messy):
    return spark.createDataFrame([(*r, 1, 2, "t", "m", 1.0, "s", 0.1, 3, 4) for r in messy], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark, messy):
    passage = next(t for i, t, *_ in messy if i == 21)
    own = words(passage)
    changed = [w if i % 9 else "changed" for i, w in enumerate(own[:40])]
    return spark.createDataFrame([(1, " ".join(own[5:45]), "x"), (2, " ".join(changed), "x"), (3, None, None), (4, "", "x"), (5, "two words", "x"), (None, "alpha beta gamma delta epsilon", "x")], "item_id long, text string, doc_id string")


# 4 and 5: joins of documents


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        out.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_components(rows):
    sets = [(i, s) for i, s in sets_of(rows) if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                x, y = find(sets[a][0]), find(sets[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("options", [{}, {"block_bytes": 5_000, "part_rows": 2}, {"block_bytes": 30_000, "fanout": 3}])
def test_ngram_join(spark, docs, messy, options):
    from noticeloom.llm.ngram_join import ngram_join

    want = brute_components(messy)
    got = ngram_join(docs, **options).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == sorted((i is None, i or 0, len(s), None if i is None else want[i]) for i, s in sets_of(messy))


def near_copies(rng, n):
    """Families whose members differ a little, so that links form chains, and documents that share passages only."""
    shared, rows = prose(rng, 60, 10**6).split(" "), []
    for f in range(4):
        text = prose(rng, 80, 10**6).split(" ")
        for _ in range(n):
            text = list(text)
            text[rng.randrange(len(text))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(text), None, None, None))
    rows += [(1000 + i, " ".join(shared[: 40 + i] + prose(rng, 60, 10**6).split(" ")), None, None, None) for i in range(15)]
    rng.shuffle(rows)
    return rows


def test_ngram_join_in_parts_keeps_chains(spark):
    from noticeloom.llm.ngram_join import ngram_join

    rows = near_copies(random.Random(8), 30)
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = brute_components(rows)
    for options in ({}, {"part_rows": 5, "block_bytes": 20_000}):
        assert {r.doc_id: r.component_id for r in ngram_join(frame, **options).collect()} == want


@pytest.mark.parametrize("part_range", [1, 7, 512])
def test_ngram_join_of_a_leader_in_many_parts(spark, monkeypatch, part_range):
    """About 200 parts of one leader: copies, chains and documents that share the leader's passage alone."""
    from noticeloom.llm import ngram_join as module

    rng = random.Random(15)
    base = prose(rng, 60, 10**6).split(" ")
    rows, text = [], base
    for i in range(200):
        if i % 20 == 0:
            text = base[:45] + prose(rng, 15, 10**6).split(" ")
        text = list(text)
        text[rng.randrange(45, 60)] = f"new{i}"
        rows.append((i, " ".join(text), None, None, None))
    rows += [(1000 + i, " ".join(base[:30] + prose(rng, 40, 10**6).split(" ")), None, None, None) for i in range(200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    monkeypatch.setattr(module, "PART_RANGE", part_range)
    assert {r.doc_id: r.component_id for r in module.ngram_join(frame, part_rows=2).collect()} == brute_components(rows)


def test_ngram_join_writes_leaders_before_texts_are_dealt(spark, docs, monkeypatch):
    from noticeloom.llm import ngram_join as module

    plans, to_blocks = [], module.to_blocks
    monkeypatch.setattr(module, "to_blocks", lambda rows, *more: plans.append(rows._jdf.queryExecution().toString()) or to_blocks(rows, *more))
    module.ngram_join(docs)
    assert len(plans) == 1 and "Exchange" not in plans[0]


@pytest.mark.parametrize("fanout", [None, 3])
def test_ngram_join_deals_texts_in_waves(spark, docs, monkeypatch, fanout):
    from noticeloom.llm import ngram_join as module

    want, calls, to_blocks = {tuple(r) for r in module.ngram_join(docs).collect()}, [], module.to_blocks
    monkeypatch.setattr(module, "WAVE_BLOCKS", 2)
    monkeypatch.setattr(module, "to_blocks", lambda rows, *more: calls.append(more) or to_blocks(rows, *more))
    got = module.ngram_join(docs, block_bytes=20_000, fanout=fanout)
    assert {tuple(r) for r in got.collect()} == want and [x[2:] for x in calls] == [(4, i) for i in range(4)]


def test_ngram_join_of_the_largest_id(spark):
    from noticeloom.llm.ngram_join import ngram_join

    last, text = 2**63 - 1, prose(random.Random(16), 30, 10**6)
    rows = [(last, text), (None, text), (last - 1, text + " tail"), (None, text), (last, "alone"), (-(2**63), "first")]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(last, last - 1), (None, None), (last - 1, last - 1), (None, None), (last, last - 1), (-(2**63), -(2**63))]
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, want))
    alone = ngram_join(spark.createDataFrame([(last, text), (None, text)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in alone} == {(last, last), (None, None)}


def test_one_of_each_group(spark, docs, messy, empty):
    from noticeloom.llm.ngram_join import one_of_each_group

    want = brute_components(messy)
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(i) for i, *_ in messy if i is None or want[i] == i)
    assert one_of_each_group(empty).count() == 0


def test_components_of_chains(spark):
    from noticeloom.llm.components import components

    links = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (3, None), (1, 2), (2, 1), (200, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 200: 5, 5: 5}


def test_components_of_hubs(spark, monkeypatch):
    """Ids with many links, smallest, largest and in between, are dealt to parts; the components stay the same."""
    from noticeloom.llm import components as parts

    monkeypatch.setattr(parts, "HUB_LINKS", 3)
    rng = random.Random(23)
    links = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(100, 150)] + [(300, rng.randrange(200, 400)) for _ in range(80)] + [(59, 100)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    alone = {x for x in parent if not any(x in pair for pair in links if pair[0] != pair[1])}
    got = {r.id: r.component for r in parts.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x not in alone}


def brute_dedup(rows, width=50):
    first, out = {}, []
    big = 1 << 63
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, big), big if i is None else i)
    for i, t, *_ in rows:
        w = words(t)
        drop = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (big if i is None else i):
                drop[j : j + width] = [True] * width
        out.append((str(i), len(w), sum(drop), " ".join(x for x, y in zip(w, drop, strict=True) if not y)))
    return sorted(out)


@pytest.mark.parametrize(("size", "fanout"), [(8 << 20, None), (3_000, None), (30_000, 4)])
def test_substring_dedup(spark, docs, messy, size, fanout):
    from noticeloom.llm.substring_dedup import substring_dedup

    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, block_bytes=size, fanout=fanout).collect())
    assert got == brute_dedup(messy)


def test_cover_is_a_difference_cover():
    from noticeloom.llm.substring_dedup import COVER, PERIOD

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup_at_every_offset(spark):
    from noticeloom.llm.substring_dedup import substring_dedup

    rng = random.Random(2)
    passage = prose(rng, 50, 10**6).replace(",\n", "").replace(".", "")
    rows = [(i, prose(rng, i, 10**6) + " " + passage + " " + prose(rng, 5, 10**6), None, None, None) for i in range(1, 63)]
    rows += [(100, " ".join(passage.split(" ")[:49]), None, None, None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame, block_bytes=2_000).collect())
    assert got == brute_dedup(rows) and sum(r[2] for r in got) == 61 * 50


def test_blocks_of_rows_without_ids_of_their_own(spark):
    """Rows with a null id, and rows with one repeated id, are dealt to many blocks; results stay those of brute force."""
    from noticeloom.llm.blocks import blocked
    from noticeloom.llm.ngram_join import ngram_join
    from noticeloom.llm.substring_dedup import substring_dedup

    rng = random.Random(16)
    passage = prose(rng, 60, 10**6)
    rows = [((None, 7, 100 + i)[i % 3], prose(rng, 30, 10**6) + (" " + passage if i % 4 == 0 else ""), None, None, None) for i in range(180)]
    rows += [(7, rows[5][1] + " tail", None, None, None), (None, rows[2][1], None, None, None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    size = sum(len(r[1]) for r in rows)
    texts, count = blocked(frame, size // 20)
    assert count > 15 and texts.count() == len(rows)
    assert max(r["count"] for r in texts.groupBy("block").count().collect()) < len(rows) / 5
    want = brute_components(rows)
    got = ngram_join(frame, block_bytes=size // 6).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), len(s), str(None if i is None else want[i])) for i, s in sets_of(rows))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame, block_bytes=size // 6).collect())
    assert got == brute_dedup(rows)


def test_rows_that_a_block_sends_are_bounded():
    """With 200,000 blocks a block packs its keys into FANOUT rows at most, and so does a bucket its answers."""
    import numpy as np

    from noticeloom.llm.blocks import FANOUT, answer, bucket_of, received, send

    rng = np.random.default_rng(1)
    keys, n = np.sort(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)), 200_000
    sent = send(7, keys, np.arange(100_000), n)
    assert sent.num_rows <= FANOUT and sum(map(len, sent.column("keys").to_pylist())) == 800_000
    blocks, got, ids = received(sent)
    assert (got == keys).all() and (ids == np.arange(100_000)).all() and (blocks == 7).all()
    assert (np.diff(bucket_of(keys, n)) >= 0).all() and bucket_of(keys, n).max() < n
    to = rng.integers(0, n, 100_000)
    back = answer(to, keys, None, n)
    assert back.num_rows <= FANOUT
    blocks, got, ids = received(back)
    assert ids is None and (got == keys).all() and (blocks == to).all()


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_confuse_are_told_apart(spark, n):
    """Thue-Morse words and their complements, as words, as runs of words and as lines."""
    from noticeloom.llm.ngram_join import ngram_join
    from noticeloom.llm.quality_rules import quality_rules
    from noticeloom.llm.substring_dedup import substring_dedup

    one, other = thue_morse(n)
    rows = [(1, one, None, None, None), (2, other, None, None, None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join(frame).collect()} == {1: 1, 2: 2}
    shared = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{shared} {one}", None, None, None), (2, f"{shared} {other}", None, None, None), (3, " ".join(one), None, None, None), (4, " ".join(other), None, None, None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(frame).collect())
    assert got == brute_dedup(rows) and got[1][2] == 0
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in ngram_join(frame).collect()} == want
    lines = spark.createDataFrame([(1, f"{one}\n{other}\n{one}", "en")], "doc_id long, text string, lang string")
    assert quality_rules(lines).first().n_dup_lines == 1


# 6, 7, 9, 3: row by row


def test_token_counts(spark, docs, messy, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from noticeloom.llm.token_counts import Counter as Tokens
    from noticeloom.llm.token_counts import Merges, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library_count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs, path).collect())
    assert got == sorted((str(i), len((t or "").encode()), library_count(t)) for i, t, *_ in messy)
    assert token_counts(empty, path).count() == 0
    rng, counter = random.Random(3), Tokens(Merges(path))
    letters = "aaab 'sztrld<|>\n\r\t\x0b\x1c\x1f\x85\xa0　​123٣½éß字😀.,!?-_"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(["<|endoftext|>", " the", "'ll", "aaaa"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert counter.counts(texts) == [library_count(t) for t in texts]


def test_quality_rules(spark, docs, messy, empty):
    from noticeloom.llm.quality_rules import quality_rules

    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
    want = []
    for i, t, *_ in messy:
        t = t or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = [False] * len(w)
        for j in range(len(w) - 4):
            if runs[tuple(w[j : j + 5])] > 1:
                hit[j : j + 5] = [True] * 5
        want.append((str(i), len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)))
    assert got == sorted(want)
    assert quality_rules(empty).count() == 0



def test_quality_rules_tell_noise_from_prose(spark):
    from noticeloom.llm.quality_rules import quality_rules

    rng = random.Random(6)
    common = "the of and to in is that it was for on are with as his they be at one have this from".split()
    clean = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}er" for _ in range(400)), "en") for i in range(60)]
    noise = [(100 + i, " ".join(f"{rng.randrange(10**6)}|#{rng.randrange(10**4)}" for _ in range(200)), "en") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(5))


def test_secret_scan(spark, docs, messy, empty):
    from noticeloom.llm.secret_scan import guess_cost, secret_scan, secret_spans

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(9)
    parts = ["password=", "TOKEN : '", "api_key=", "secret\":\"", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "x", " ", "=", ":", "changeme", "0f" * 9, "é", "ſecret=abcdefghijklmn", "AKIAABCDEFGHIJKLMN"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        found = [x for x in secret_spans(text, 12)[0] if x[2] != "guess"]
        assert found == [(a, b, ("assign", "access", "hex")[k]) for a, k, b in sorted(base)], text
    spans = lambda t: [t[a:b] for a, b, k in secret_spans(t, 12)[0] if k == "guess"]
    assert spans("my pwd: hT7!kqZ2@x and") == ["hT7!kqZ2@x"] and spans("my pwd: changeme and password: qwertyuiop") == []
    assert guess_cost("") == 0 and guess_cost("P@ssw0rd") < 3 and guess_cost("aaaaaaaaaaaaaaaa") < 3 and guess_cost("20240131") < 6 and guess_cost("xK9#mQ2$vL") > 15
    got = secret_scan(docs).collect()
    assert len(got) == len(messy) and all(r.spans is not None for r in got)
    assert secret_scan(empty).count() == 0


def test_quality_distances_against_brute_force(spark):
    """Both distances, the nearest reference and the verdict, from counts of plain strings; repeated junk sets no standard."""
    from noticeloom.llm.quality_rules import COMMON, quality_rules

    rng = random.Random(19)
    names = {"en": "the of and to in that is was for it with as".split(), "de": "der die und das nicht ist ein zu den mit von für".split()}
    rows = []
    for i in range(90):
        lang = ("en", "de", None)[i % 3]
        own = names[lang or "en"] if i % 10 else ["#|", "99", "ZZ", "=="]
        rows.append((i, " ".join(rng.choice(own) + rng.choice(["", "", ",", ".", "\n", "é"]) for _ in range(rng.choice([5, 20, 60, 200]))), lang))
    rows += [(100 + i, "buy now cheap pills " * 200, "en") for i in range(40)]

    def kind(c):
        groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".,;:", "!?", "'\"()-", "#*$%&|<>", "/\\_=+@~^`[]{}"]
        return next((j for j, g in enumerate(groups) if c in g), 11 if ord(c) < 128 else 12)

    def failed(text):
        w = words(text)
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {k for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        return len(w) < 10 or 100 * len(hit) > 20 * len(w)

    def far(p, q):
        total = lambda x: sum(x.values())
        half = 0
        for k in {*p, *q}:
            a, b = p[k] / total(p) if p else 0, q[k] / total(q)
            half += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x)
        return math.sqrt(max(0, half / 2))

    lower = lambda t: words(t.translate(LOWER))
    known = {}
    for lang in ("de", "en"):
        texts = [t for _, t, x in rows if x == lang and not failed(t)]
        counts = Counter(w for t in texts for w in lower(t))
        common = {w for w, _ in counts.most_common(COMMON)}
        assert len(counts) <= COMMON  # so that ties at the end of the common words don't matter here
        known[lang] = Counter(kind(c) for t in texts for c in t), Counter({w: n for w, n in counts.items() if w in common}), common
    for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=("de", "en")).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        classes, by = Counter(map(kind, text)), {}
        for lang, (ref, counts, common) in known.items():
            by[lang] = far(classes, ref), far(Counter(w if w in common else None for w in lower(text)), counts)
        best = min(by, key=lambda x: sum(by[x]))
        assert r.nearest == best and (r.class_distance, r.word_distance) == pytest.approx(by[best])
        judged = len(words(text)) >= 50
        assert r.kept == (not failed(text) and (not judged or (by[best][0] <= 0.25 and by[best][1] <= 0.5)))


def exhaustive_cost(value, rank):
    """The least cost over all ways to cut the value into spans, each costed by itself."""
    from functools import lru_cache

    from noticeloom.llm.secret_scan import DATE, PLACE, PLAIN, _alphabet

    each = _alphabet(value)

    def span(part):
        low, costs = part.lower(), []
        if len(part) == 1:
            costs.append(each)
        for word in (low, low.translate(PLAIN)):
            if len(part) > 2 and word in rank:
                costs.append(math.log10(rank[low if low in rank else word] * (1 if part.islower() and part.isalpha() else 4) + 1))
        if DATE.fullmatch(part):
            costs.append(math.log10(200 * (366 if len(part) > 4 else 1)))
        for unit in range(1, 9):
            if len(part) >= 3 and len(part) % unit == 0 and len(part) >= 2 * unit and part == part[:unit] * (len(part) // unit):
                costs.append(unit * each + math.log10(len(part) // unit))
        keys = [PLACE.get(c) for c in low]
        if len(part) > 2 and None not in keys:
            steps = [(c - a, d - b) for (a, b), (c, d) in zip(keys, keys[1:], strict=False)]
            if all(max(abs(x), abs(y)) == 1 for x, y in steps):
                turns = sum(x != y for x, y in zip(steps, steps[1:], strict=False))
                costs.append(math.log10(47) + math.log10(len(part)) + turns * math.log10(4))
        return min(costs, default=math.inf)

    @lru_cache(None)
    def least(j):
        return 0.0 if j == 0 else min(least(i) + span(value[i:j]) for i in range(j))

    return least(len(value))


def test_guess_cost_is_the_cheapest_segmentation():
    from noticeloom.llm.secret_scan import guess_cost, ranked

    rng, rank = random.Random(17), ranked(["battery", "horse", "correct"])
    parts = ["password", "P4ss", "horse", "Battery", "2024", "20240131", "31/01/2024", "qwe", "qwer", "qaz", "qwsx", "zxcvfr", "aaa", "abab", "a", "7", "#", "Zz", "xyzxyz", "1234567812345678"]
    for _ in range(1500):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))[:26]
        assert guess_cost(value, rank) == pytest.approx(exhaustive_cost(value, rank)), value


def test_words_of_the_documents_lower_costs(spark):
    """A passphrase of words that the documents use often is cheap beside one of random letters; the table is bounded."""
    from noticeloom.llm.secret_scan import frequent_words, guess_cost, ranked, secret_scan

    rows = [(i, "The battery, staple (of) a Correct horse. x1 zz abcdé") for i in range(9)] + [(20, None), (21, ""), (22, "staple staple"), (23, "my pwd: correcthorsebattery and pwd: qxzvkjwpylmrtnbcdghs")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert frequent_words(frame, 4, "text") == ["staple", "abcdé", "battery", "correct"] and frequent_words(frame.limit(0), 3, "text") == []
    rank = ranked(frequent_words(frame, 20, "text"))
    assert guess_cost("abcdé", rank) < 2 < guess_cost("abcdé")  # words of other languages are words too
    assert guess_cost("correcthorsebattery", rank) < 7 < 20 < guess_cost("qxzvkjwpylmrtnbcdghs", rank)
    got = [r for r in secret_scan(frame).collect() if r.doc_id == 23][0]
    text = rows[-1][1]
    assert [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in got.spans.split(","))] == ["qxzvkjwpylmrtnbcdghs"]


def test_secret_scan_of_long_values():
    """Values and separators of any length: the span covers the whole value, and what comes after it is still scanned."""
    from noticeloom.llm.secret_scan import guess_cost, secret_spans

    rng = random.Random(15)
    letters = "ghijkmnpqrstuvwxyzGHJKLMNPQRSTUVWXYZ23456789+/_-"
    found = lambda t: [(t[a:b], k) for a, b, k in secret_spans(t, 12)[0]]
    for n in (128, 129, 200, 1000, 5000):
        value = "eyJ" + "".join(rng.choice(letters) for _ in range(n - 3))
        assert found(f"Authorization: Bearer {value} end") == [(value, "guess")]
        assert guess_cost(value) > 1.2 * n
    for blanks in (1, 8, 9, 60):
        assert found("pwd" + " " * blanks + ": " + " " * blanks + "x!7#kqZ2@x next") == [("x!7#kqZ2@x", "guess")]
    blob = '"token":"' + "xK9#mQ2$vL," * 30 + "0123456789abcdef" + ',"pwd":"hT7!kqZ2@x"' * 2  # a base match within a value's run
    assert found(blob) == [("xK9#mQ2$vL," * 29 + "xK9#mQ2$vL", "guess"), ("0123456789abcdef", "hex"), ("hT7!kqZ2@x", "guess"), ("hT7!kqZ2@x", "guess")]  # each to its closing quote
    assert found('password=ABCDEFGHIJKLMN,"pwd":"hT7!kqZ2@x"') == [("password=ABCDEFGHIJKLMN", "assign"), ("hT7!kqZ2@x", "guess")]
    # costs are those of the whole value, and repeats and walks of any length stay cheap
    assert guess_cost("z" * 100_000) == pytest.approx(math.log10(26) + 5) and guess_cost("ab" * 50_000) == pytest.approx(2 * math.log10(26) + math.log10(50_000))
    assert guess_cost("qw" * 20_000) < 8 and found("pwd: " + "_" * 20_000) == []


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, docs, messy, empty):
    from noticeloom.llm.pii import joined, pii_spans, redacted

    rng = random.Random(5)
    parts = ["a@b.c", "x.y@z-1.com.d", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (415) 555-2671", "+12", " ", "@", ".", "-", "1", "é", "字", "call 415-555-2671", "Mr. John Smith", "SSN: 123-45-6789"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["1" * 20_000, "a." * 9_000 + "@", "1 " * 9_000, "a@b" + ".c" * 9_000, "\x01a@b.c\x02 1.2.3.4\x01\x02\x03+1 (415) 555-2671", "\x01", "\x02" * 3, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_spans(frame).select("doc_id", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect():
        assert r.b == plain_pii(texts[r.doc_id] or ""), texts[r.doc_id]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert pii_spans(docs).count() == len(messy) and pii_spans(empty).count() == 0
    out = redacted(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[len(texts) - 1] is None and all(not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]", t) for t in got.values() if t)
    assert redacted(spark.createDataFrame([(1, "to a@b.org from 10.0.0.1")], "doc_id long, text string")).first().text == "to <email> from <ip>"
    assert redacted(docs).count() == len(messy) and redacted(empty).count() == 0


def test_pii_of_texts_with_many_matches(spark):
    from noticeloom.llm.pii import BASE, pii_spans

    rng = random.Random(6)
    parts = ["from 1.2.3.4 ", "SSN: 123-45-6789 ", "a@b.org", "Dr. Anna Smith ", "call 415-555-2671 ", "+1 (415) 555-2671", "word ", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 40, 255, 256, 257, 700, 3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_spans(frame).collect():
        base = [(x.start, x.end) for x in r.base]
        assert ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.base) == plain_pii(texts[r.doc_id])
        assert [(x.start, x.rank) for x in r.spans] == sorted((x.start, x.rank) for x in r.spans)
        more = [x for x in r.spans if x.rank >= len(BASE)]
        assert [x for x in r.spans if x.rank < len(BASE)] == r.base and (len(texts[r.doc_id]) < 5000 or more)
        assert not any(a < x.end and x.start < b for x in more for a, b in base)


def test_pii_of_ibans(spark):
    """IBANs of each length, compact and in groups, are found and redacted whole, and no word or amount after them is."""
    from noticeloom.llm.pii import pii_spans, redacted

    numbers = ["NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "MK07250120000058984", "AT611904300234573201", "CH9300762011623852957", "DE89370400440532013000",
               "GB29NWBK60161331926819", "AE070331234567890123456", "ES9121000418450200051332", "PT50000201231234567890154", "IS140159260076545510730339", "FR1420041010050500013M02606",
               "IT60X0542811101000000123456", "PL61109010140000071219812874", "BR9700360305000010009795493P1", "MU17BOMM0101101030300200000MUR", "MT84MALT011000012345MTLCAST001S",
               "SC18SSCB11010000000000001497USD", "LC55HEMM000100010012001200023015", "ZZ12ABCD5678EFGH1234JKLM5678NPQR1", "ZZ12ABCD5678EFGH1234JKLM5678NPQR12", "GB12ABCD12AB34CD56EF78"]
    grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in numbers]
    texts = [f"IBAN: {x}{after}" for x in (*numbers, *grouped) for after in ("", " for us", ", thanks", " EUR", " OK")]
    texts += [f"IBAN: {x} 250 EUR" for x in grouped if len(x.replace(" ", "")) % 4 or x[:2] in ("ES", "PL")]
    lengths = {len(x) for x in numbers}
    assert lengths >= {15, *range(18, 32), 16, 32}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wholly = {x for x in (*numbers, *grouped)}
    for r in pii_spans(frame).collect():
        got = [texts[r.doc_id][x.start : x.end] for x in r.spans if x.kind == "iban"]
        if not r.base:
            assert len(got) == 1 and got[0] in wholly, texts[r.doc_id]
    bases = {r.doc_id for r in pii_spans(frame).collect() if r.base}
    for r in redacted(frame).collect():
        if r.doc_id not in bases:
            text = next(texts[r.doc_id].replace(x, "<iban>") for x in sorted(wholly, key=len, reverse=True) if x in texts[r.doc_id])
            assert r.text == text
    assert len(bases) < len(texts) / 4  # a few hold digits that pass as a card's
    few = spark.createDataFrame([(i, f"IBAN: {x}") for i, x in enumerate(["GB12ABCD12AB34CD56EF78", "GB12 ABCD 12AB 34CD 56EF 78"])], "doc_id long, text string")
    assert [r.text for r in redacted(few).orderBy("doc_id").collect()] == ["IBAN: <iban>"] * 2  # no three digits in a row


def test_redaction_is_that_of_the_spans(spark):
    """Every span is replaced where it lies, overlapping ones as one, in texts of no, few and many spans."""
    from noticeloom.llm.pii import pii_spans, redacted

    rng = random.Random(21)
    parts = ["a@b.c", "u@1.2.3.4", "1.2.3.4", "4111111111111111", "+1 (415) 555-2671", "+4111 1111 1111 1111", " ", "é", "字", "call 415-555-2671", "Mr. John Smith", "SSN: 123-45-6789", "reach jo (at) web dot de", "\U0001f600", "x" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in [*range(300), 255, 256, 257, 600, 2000]] + [None, ""]
    texts += ["Dr. " + "A" + "b" * 3000 + " visits", "l" * 3000 + "[at]" + "d" * 200 + "[dot]" + "o" * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for r in pii_spans(frame).collect():
        text, merged = texts[r.doc_id], []
        for x in r.spans:
            if merged and x.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x.end)
            else:
                merged.append([x.start, x.end, x.kind])
        for a, b, kind in reversed(merged):
            text = text[:a] + f"<{kind}>" + text[b:]
        want[r.doc_id] = text
    assert {r.doc_id: r.text for r in redacted(frame).collect()} == want
    assert want[len(texts) - 2] == "<person> visits" and want[len(texts) - 1] == "<mailto>"


def test_em_finds_the_unreliable_labeler():
    from noticeloom.llm.pii import reliabilities

    rng, seen = random.Random(1), Counter()
    for _ in range(4000):
        true = 1 if rng.random() < 0.6 else -1
        seen[tuple(true if rng.random() < r else -true for r in (0.9, 0.85, 0.9, 0.5, 0.8))] += 1
    right, _ = reliabilities(dict(seen))
    assert right[3] < 0.6 and min(right[0], right[1], right[2]) > 0.8


# 1, 2: samples


def test_importance_sample(spark, docs, messy, labels, empty):
    from noticeloom.llm.importance import importance_sample, largest

    rng = random.Random(7)
    keys = [rng.choice([0.5, rng.gauss(0, 1), -1e300, 3.0]) for _ in range(6000)]
    frame = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 1500, 4000, 6000):
        assert largest(frame, k) == sorted(keys, reverse=True)[k - 1]
    assert largest(frame, 0) is None and largest(frame, 6001) is None
    good = [(i, " ".join(rng.choice(["apple", "pear", "plum", "fig"]) for _ in range(50))) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice(["buy", "now", "$$$", "win"]) for _ in range(50))) for i in range(60)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = importance_sample(frame, spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), fraction=0.5).collect()
    assert sorted(r.doc_id for r in out if r.kept) == list(range(60))
    again = importance_sample(docs, labels, fraction=0.5).collect()
    assert len(again) == len(messy) and sorted(map(str, again)) == sorted(map(str, importance_sample(docs, labels, fraction=0.5).collect()))
    assert importance_sample(empty, labels).count() == 0
    assert {r.log_weight for r in importance_sample(docs, labels.limit(0)).collect()} == {0.0}


def test_importance_weights_against_brute_force(spark):
    """Log weights from counts of plain words and pairs of words, and the kept rows from keys sorted on the driver."""
    import pyarrow as pa

    from noticeloom.llm.importance import BUCKETS, importance_sample, ngrams
    from noticeloom.llm.textkit import text_bytes

    rng = random.Random(20)
    rows = [(i if i % 9 else None, prose(rng, rng.choice([0, 1, 2, 30, 80]), 60)) for i in range(200)] + [(7, "ha " * 500), (8, None), (9, "")]
    good = set(range(0, 200, 4))
    slots = {}

    def slot(gram):  # the bucket of a word or pair, asked of the operator's hash alone
        if gram not in slots:
            data, at = text_bytes(pa.array([" ".join(gram)]))
            slots[gram] = int(ngrams(data, at)[1][-1])
        return slots[gram]

    def grams(text):
        w = [x.translate(LOWER).strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or x for x in words(text)]
        return [(x,) for x in w] + list(zip(w, w[1:], strict=False))

    raw, wanted = Counter(), Counter()
    for i, t in rows:
        own = [slot(g) for g in grams(t)]
        raw.update(own)
        if i in good:
            wanted.update(own)
    ratio = lambda b: math.log((wanted[b] + 1) / (sum(wanted.values()) + BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + BUCKETS))
    want = sorted((str(i), sum(ratio(slot(g)) for g in grams(t))) for i, t in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in good], "doc_id long")
    out = importance_sample(frame, target, fraction=0.4).collect()
    got = sorted((str(r.doc_id), r.log_weight) for r in out)
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-8)
    keys = sorted((r.key for r in out), reverse=True)
    assert all(r.kept == (r.key >= keys[round(0.4 * len(out)) - 1]) for r in out)


def test_gumbel_top_k_samples_by_weight(spark):
    """Of documents with one n-gram each, a heavier one is taken first more often, in proportion to its weight."""
    from noticeloom.llm.importance import importance_sample

    rows = [(i, "rare" if i % 2 else "common") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i, t in rows if t == "rare" or i % 6 == 0], "doc_id long")
    out = importance_sample(frame, target, fraction=0.02).collect()
    weight = {t: math.exp(next(r.log_weight for r in out if r.doc_id == i)) for i, t in ((1, "rare"), (0, "common"))}
    share = sum(1 for r in out if r.kept and r.doc_id % 2) / sum(r.kept for r in out)
    assert abs(share - weight["rare"] / (weight["rare"] + weight["common"])) < 0.17


def test_mix(spark, docs, messy, empty):
    import duckdb

    from noticeloom.llm.mixing import mix, mix_sql, mixed_documents

    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "b", "c", "é", None])) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(frame).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    target, names, left, open_ = {}, sorted(size, key=lambda s: (s is None, s or "")), 1.5 * sum(size.values()), None
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_ = set(names)
    while True:  # the rule as it is told: deal, stop what is above, deal the excess again
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in names)
    con = duckdb.connect()
    con.register("rows", frame.toPandas())
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out) == sorted(con.sql(mix_sql("rows")).fetchall())
    assert len(mix(docs).collect()) == len(messy) and mix(empty).count() == 0
    kept = mixed_documents(docs)
    assert kept.columns == [c for c in docs.columns if c != "mix_size"] + ["mix_size", "mix_copies", "mix_taken"]
    assert kept.filter("mix_copies = 0").count() == 0 and mixed_documents(empty).count() == 0


@pytest.mark.parametrize("rows", ["one id", "null ids of one text", "null ids of few texts", "one id of many sizes"])
def test_mix_of_equal_rows(spark, rows, monkeypatch):
    """Rows that share a key are taken one by one: a source comes within a document of its target, in both forms."""
    from noticeloom.llm import mixing

    monkeypatch.setattr(mixing, "ROWS_A_BIN", 16)
    rng = random.Random(3)
    make = {
        "one id": lambda i: (7, "five words of this one"), "null ids of one text": lambda i: (None, "five words of this one"),
        "null ids of few texts": lambda i: (None, f"five words of text {i % 3}"), "one id of many sizes": lambda i: (7, "w " * rng.randint(1, 9)),
    }[rows]
    data = [(*make(i), "b" if i % 4 else "a") for i in range(1000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(frame).collect()
    for name in ("a", "b"):
        own = [r for r in out if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and len({r.copies for r in own}) <= 2
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(tuple, ((r.source, r.size, r.taken) for r in again))) == sorted(map(tuple, ((r.source, r.size, r.taken) for r in out)))
    kept = mixing.mixed_documents(frame).groupBy("source").agg(F.sum("mix_taken").alias("t")).collect()
    assert {r.source: r.t for r in kept} == {x: sum(r.taken for r in out if r.source == x) for x in ("a", "b")}


def test_mix_sorts_few_rows_whatever_the_weights(spark, monkeypatch):
    """With tiny and huge weights the span that is sorted is narrowed to ROWS_A_BIN rows, and the mix stays the same."""
    from noticeloom.llm import mixing

    rows = [(i, f"w{i} " * (1 + i % 7), "s") for i in range(3000)]
    frame = spark.createDataFrame([*rows, (5000, "w " * 9000, "t")], "doc_id long, text string, source string")
    quality = F.when(F.col("doc_id") % 3 == 0, 1e-6).when(F.col("doc_id") % 3 == 1, 1e3).otherwise(0.01)
    want = sorted(map(tuple, mixing.mix(frame, quality=quality).collect()))
    monkeypatch.setattr(mixing, "ROWS_A_BIN", 8)
    sorted_rows, plain = [], mixing.inside

    def counted(rows, spans):
        got = plain(rows, spans)
        sorted_rows.append(max([r["count"] for r in got.groupBy("source").count().collect()], default=0))
        return got

    monkeypatch.setattr(mixing, "inside", counted)
    assert sorted(map(tuple, mixing.mix(frame, quality=quality).collect())) == want
    assert sorted_rows[-1] <= 8


# 8, 10


def test_decontamination(spark, docs, messy, benchmark, empty):
    from noticeloom.llm.decontaminate import benchmark_hits, decontaminate

    hits = {(r.doc_id, r.item_id) for r in benchmark_hits(docs, benchmark).collect()}
    assert hits == {(d, i) for d in (20, 21, 22) for i in (1, 2)}  # item 2 has every ninth word changed
    assert {(r.doc_id, r.item_id) for r in benchmark_hits(docs, benchmark, block_bytes=200).collect()} == hits
    out = decontaminate(docs, benchmark)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, *_ in messy if i not in (20, 21, 22))
    assert decontaminate(docs, benchmark.limit(0)).count() == len(messy) and decontaminate(empty, benchmark).count() == 0 and benchmark_hits(empty, benchmark).count() == 0


def brute_hits(rows, items):
    """(doc, item, matches): every diagonal's best stretch, by Kadane's rule word by word."""
    out = set()
    for d, text in rows:
        for i, item in items:
            need, most = max(4, min(13, math.ceil(0.7 * len(item)))), 0
            for shift in range(1 - len(item), len(text)):
                score = held = top = best = 0
                for p in range(max(0, shift), min(len(text), shift + len(item))):
                    same = text[p] == item[p - shift]
                    score, held = score + (1 if same else -3), held + same
                    if score < 0:
                        score = held = 0
                    if score > top:
                        top, best = score, held
                most = max(most, best)
            if most >= need:
                out.add((d, i, most))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 500])
def test_decontamination_against_brute_force(spark, block_bytes):
    """Items of 6 to 90 words, substitutions up to one in every window of six, texts of repeated words: all hits, and no other."""
    from noticeloom.llm.decontaminate import benchmark_hits, decontaminate

    rng = random.Random(12)
    items = [(i, [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 6, 9, 14, 30, 90]))]) for i in range(30)]
    items += [(30, ["ha"] * 25), (31, ["ha", "ho"] * 20), (32, ["ha"] * 15 + ["tail"] * 3 + ["x1", "x2", "x3"])]
    rows = []
    for d in range(150):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 80))]
        i, item = rng.choice(items)
        part = [w if rng.random() > rng.choice([0, 0.05, 0.1]) else "sub" for w in item[rng.randrange(max(1, len(item) // 2)) :]]
        if d % 5 == 0:
            part = [w if (j + d) % rng.choice([4, 5, 5, 6]) else "sub" for j, w in enumerate(item)]
        at = rng.randint(0, len(text))
        rows.append((d, text[:at] + part + text[at:]))
    rows += [(200, ["ha"] * 300), (201, ["ho", "ha"] * 100), (202, ["ha"] * 12), (203, ["ha"] * 40 + ["tail"] * 9), (204, ["tail"] * 50)]
    want = brute_hits(rows, items)
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in [*rows, rows[0]]], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = benchmark_hits(frame, bench, block_bytes=block_bytes).collect()
    assert sorted({(r.doc_id, r.item_id, r.n_matched) for r in got}) == sorted(want) and len(want) > 100
    assert len(got) == len(want) + sum(d == 0 for d, *_ in want)
    left = sorted(r.doc_id for r in decontaminate(frame, bench, block_bytes=block_bytes).collect())
    assert left == sorted(d for d, _ in [*rows, rows[0]] if d not in {x for x, *_ in want})


def test_decontamination_where_all_share_a_phrase(spark):
    """A phrase in every document and item: a large benchmark gives the hits of a small one, and not by a row a pair."""
    from noticeloom.llm.decontaminate import benchmark_hits, decontaminate

    rng = random.Random(17)
    phrase = " ".join(f"common{i}" for i in range(8))
    items = [(i if i % 50 else None, f"{prose(rng, 12, 10**6)} {phrase} {prose(rng, 20, 10**6)}") for i in range(300)]
    rows = [(d, f"{prose(rng, 15, 10**6)} {phrase} {prose(rng, 30, 10**6)}" + (" " + items[d][1] if d % 10 == 3 else "")) for d in range(300)]
    rows += [(None, items[7][1]), (400, None), (401, ""), rows[3], (403, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (999, None), items[3]], "item_id long, text string")
    told = lambda **options: sorted(str(tuple(r)) for r in benchmark_hits(frame, bench, **options).collect())
    assert told(block_bytes=20_000) == told() and len(told()) == 30 + 1 + 2 + 3
    left = lambda **options: sorted(str(r.doc_id) for r in decontaminate(frame, bench, **options).collect())
    assert left(block_bytes=20_000) == left() and len(left()) == 270 + 2
    assert benchmark_hits(frame.limit(0), bench, block_bytes=20_000).count() == 0


def test_masks_lose_nothing():
    """No stretch that counts avoids its mask: all strings of matches and substitutions that could are walked."""
    from noticeloom.llm.decontaminate import LEAST_NEED, LONG_MASK, LONG_NEED, MISMATCH, SHORT_MASK

    def avoids(mask, need):
        n, reads = len(mask), int(mask, 2)
        todo = [(0, 0, 0, 0, 0)]  # last places, how many, score, greatest score, matches
        seen = set(todo)
        while todo:
            last, size, score, top, matches = todo.pop()
            for same in (1, 0):
                held, long = (last << 1 | same) & ((1 << n) - 1), min(n, size + 1)
                now = score + (1 if same else -MISMATCH)
                if now < 0 or (long == n and held & reads == reads):
                    continue
                state = held, long, min(now, 40), max(top, min(now, 40)), min(need, matches + same)
                if same and now > top and state[4] >= need:
                    return True
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        return False

    assert not avoids(LONG_MASK, LONG_NEED) and not avoids(SHORT_MASK, LEAST_NEED)
    assert avoids(LONG_MASK, LEAST_NEED)


def test_decontamination_of_repeated_words(spark):
    """Time and memory of equal words against an item of the same don't grow with their pairs."""
    import time
    import tracemalloc

    import pyarrow as pa

    from noticeloom.llm.decontaminate import Benchmark, _hits

    bench = Benchmark([1, 2], [" ".join(["ha"] * 2000), " ".join(["ha", "ho"] * 500 + ["x"] * 9)], 13, 0.7)
    tables = bench.tables()
    tracemalloc.start()
    began = time.time()
    got = list(_hits(pa.array([" ".join(["ha"] * 8000), "ha ho " * 3000]), bench, tables))
    assert time.time() - began < 5 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert [x[:3] for x in got] == [(0, 0, 2000), (1, 1, 1000)]


def test_decontamination_of_an_items_tail_at_the_start(spark):
    """The first document of a batch is a short tail of an item: its diagonal begins before the batch and ends in it."""
    from noticeloom.llm.decontaminate import benchmark_hits, decontaminate

    item = [f"tail{i}" for i in range(30)]
    texts = [" ".join([*item[10:], "two", "others"]), "", "next document of seven words goes here", " ".join(item[5:]), "and one more text of eight words follows"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.n_matched, r.doc_start, r.doc_end) for r in benchmark_hits(frame, bench).collect())
    assert got == [(0, 20, 0, 20), (3, 25, 0, 25)]
    assert sorted(r.doc_id for r in decontaminate(frame, bench).collect()) == [1, 2, 4]


def test_toxicity(spark, docs, messy, labels, empty):
    from noticeloom.llm.toxicity import toxicity, without_toxic

    rng = random.Random(13)
    rows = []
    for i in range(1200):
        w = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vilex", "vilexen", "Gronk!", "gronk"]))
        rows.append((i, " ".join(w), int(bad)))
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(frame, marks).collect()}
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == rows[i][2] for i in held) >= 0.98 * len(held)
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(frame, flipped).collect()} == {i: r.score for i, r in got.items()}  # held-out labels teach nothing
    assert sorted(r.doc_id for r in without_toxic(frame, marks).collect()) == sorted(i for i in got if not got[i].predicted)
    assert len(toxicity(docs, labels).collect()) == len(messy) and toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert without_toxic(docs, labels).columns == docs.columns


def test_counterfactual_penalty_lowers_what_identity_terms_add():
    """Where a group's name goes along with the label in training, swapping it moves scores less with the penalty."""
    import numpy as np
    import pyarrow as pa

    from noticeloom.llm.toxicity import features, swapped, train

    assert swapped("Muslim women and the old man, Muslims") == "Christian men and the young woman, Christians"
    rng, texts, marks = random.Random(14), [], []
    for i in range(400):
        w = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(12)]
        if i % 2:
            w[3] = rng.choice(["gronk", "vilex"])
        if rng.random() < (0.8 if i % 2 else 0.1):
            w[7] = "muslim"
        texts.append(" ".join(w))
        marks.append(i % 2)

    def shift(weight):
        w, b, pairs = train(texts, np.array(marks, float), weight, 4e-5, 250)
        row, column = features(pa.array(["they met a muslim neighbour", "they met a christian neighbour", "what a gronk"]))
        z = np.bincount(row, weights=w[column], minlength=3) + b
        assert pairs > 100 and z[2] > 0
        return abs(z[0] - z[1])

    assert shift(1.0) < 0.5 * shift(0.0)


def test_identity_penalty_acts_on_the_driver_tables(spark):
    """Pairs' features are in the fit, change its weights, and no swap of terms moves a log-odds beyond the bound."""
    from noticeloom.llm.toxicity import SWAP_BOUND, fit_toxicity, held_out, largest_swap, term_cells

    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").filter(~held_out())
    with_penalty, without = (fit_toxicity(docs, marks, swap_weight=x)[0] for x in (1.0, 0.0))
    cells = np.unique(np.concatenate(term_cells()))
    assert (with_penalty[cells] != 0).any() and np.abs(with_penalty - without).max() > 0.1
    assert largest_swap(with_penalty) <= SWAP_BOUND < largest_swap(without)


def test_fit_is_the_optimum():
    """Weights against the conditions of the optimum, computed from dense arrays."""
    from noticeloom.llm.toxicity import BITS, fit, term_cells

    rng = np.random.default_rng(4)
    labels = (np.arange(300) % 2).astype(float)
    cells = [np.unique(np.r_[rng.integers(0, 40, 6), 50 + int(y) if rng.random() < 0.8 else 60]).astype(np.int32) for y in labels]
    swaps = [np.array([51], np.int32), np.array([50, 3], np.int32)] * 5
    l1, size = 1e-3, 1 << BITS
    w, b, pairs = fit(cells, swaps, [], labels, 0.5, l1, 4000)
    x = np.zeros((300, 64))
    for i, c in enumerate(cells):
        x[i, c] = 1
    count, n = x.sum(axis=0), 300
    scale = 1 / np.sqrt(np.maximum(1, count))
    share = np.where(labels == 1, n / (2 * labels.sum()), n / (2 * (n - labels.sum()))) / n
    d = np.zeros((5, 64))
    d[:, 51], d[:, [50, 3]] = 1, -1
    grad = (x.T @ (share * (1 / (1 + np.exp(-(x @ w[:64] + b))) - labels)) + 2 * 0.5 / 5 * d.T @ (d @ w[:64])) * scale
    held = np.flatnonzero(w[:64])
    assert pairs == 5 and {50, 51} <= set(held.tolist()) and not w[64:][np.setdiff1d(np.arange(64, size), np.concatenate(term_cells())) - 64].any()
    assert np.abs(grad[held] + l1 * np.sign(w[held])).max() < 1e-5
    assert abs((share * (1 / (1 + np.exp(-(x @ w[:64] + b))) - labels)).sum()) < 1e-5
    assert abs(grad[3]) <= l1 + 1e-5


def test_toxicity_doesnt_accuse_neutral_mentions_of_a_group(spark):
    """The whole operator where a group's name goes along with the label: the penalty evens its terms out."""
    from noticeloom.llm.toxicity import PAIRS, counterfactuals, toxicity

    assert counterfactuals("They met. A muslim spoke.", 0) == ([(" A muslim spoke", " A christian spoke")], [])
    assert counterfactuals("one two", 3)[1][0][0].split() == ["one", "two", PAIRS[3][0]] and len(PAIRS) > 50
    rng, rows = random.Random(18), []
    for i in range(1500):
        w, bad = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(14)], i % 2
        if bad and rng.random() < 0.8:
            w[3] = rng.choice(["gronk", "vilex"])
        if rng.random() < (0.7 if bad else 0.1):
            w[7] = "muslim"
        rows.append((i, " ".join(w), bad))
    rows += [(5000, "a muslim neighbour came by", None), (5001, "a hindu neighbour came by", None), (5002, "what a gronk", None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, bad) for i, _, bad in rows[:1500]] + [(0, 1), (1, 0), (2, 7), (3, None)], "doc_id long, toxic int")

    def scores(weight):
        return {r.doc_id: r.score for r in toxicity(frame, marks, swap_weight=weight).collect() if r.doc_id >= 5000}

    plain, evened = scores(0.0), scores(1.0)
    assert plain[5000] > 0.5 > evened[5000] and abs(evened[5000] - evened[5001]) < 0.5 * abs(plain[5000] - plain[5001]) and evened[5002] > 0.5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        held = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
        assert set(held) <= set(before) and held
        if number < 4:
            assert after.columns == docs.columns
        if name == "ngram_jaccard_join":
            groups = brute_components([(i, t) for i, t in before.items()])
            assert set(held) == {i for i in before if groups[i] == i}
        if name == "pii":
            assert all(plain_pii(t) == "" for t in held.values())
        elif number < 4:
            assert all(before[i] == t for i, t in held.items())
        docs = after
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(held)


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark, labels, benchmark):
    """A folder with the labels and the benchmark of the tests, for the stages of the pipeline."""
    folder = str(tmp_path_factory.mktemp("tables"))
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_on_messy_rows(spark, docs, messy, tables):
    """Nulls, repeats, long texts and columns with clashing names: every stage keeps the columns and gives defined rows."""
    import corpus_pipeline

    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        rows = out.collect()
        assert 0 < len(rows) <= len(messy), name
        if number < 4:
            assert out.columns == docs.columns and {(r.tokens, r.mix_size, r.spans) for r in rows} == {("t", "m", "s")}
        else:
            assert set(docs.columns) - {"mix_size"} < set(out.columns) and {r.mix_copies for r in rows} <= {1, 2}
        if name == "pii":
            assert len(rows) == len(messy) and sum(r.text is None for r in rows) == sum(t is None for _, t, *_ in messy)


def test_pipeline_of_an_empty_table(spark, empty, tables, tmp_path):
    import shutil

    import corpus_pipeline

    folder = str(tmp_path / "tables")
    shutil.copytree(tables, folder)
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_added_spans_against_brute_force(spark):
    """Of the candidates that plain patterns find beside the base spans, every one is kept or left out by its votes alone, and none touches a base span."""
    from noticeloom.llm.pii import BASE, candidate_spans, pii_spans

    rng = random.Random(22)
    parts = ["SSN: 123-45-6789", "000-12-3456", "call 415-555-2671", "ref 115-155-2671", "Mr. John Smith", "Frau Anna", "jo (at) web dot de", "a@b.org", " ", ", ", "1.2.3.4", "é"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {r.doc_id: r.s for r in frame.select("doc_id", candidate_spans(F.col("text")).alias("s")).collect()}
    verdicts = {}
    for r in pii_spans(frame).collect():
        base = [(x.start, x.end) for x in r.base]
        free = [x for x in every[r.doc_id] if x.rank >= len(BASE) and not any(a < x.end and x.start < b for a, b in base)]
        kept = {(x.start, x.end, x.kind) for x in r.spans if x.rank >= len(BASE)}
        assert kept <= {(x.start, x.end, x.kind) for x in free}
        for x in free:
            verdicts.setdefault(x.combo, set()).add((x.start, x.end, x.kind) in kept)
    assert all(len(v) == 1 for v in verdicts.values()) and {True, False} <= set().union(*verdicts.values())
    plain = {"ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "mailto": r"jo \(at\) web dot de"}
    for i, text in enumerate(texts):
        found = {(x.start, x.end) for x in every[i] if x.kind == "ssn"}
        assert found == {(m.start(), m.end()) for m in re.finditer(plain["ssn"], text)}, text


def test_queries_are_registered():
    from noticeloom.llm.catalogue import ORACLES, QUERIES

    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op5_substring_dedup", "op12_phrase_collocations", "op13_lexical_search"])
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    from noticeloom.llm.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_digests(spark):
    """The digest columns of the thin queries are those of the operators' real outputs."""
    from noticeloom.llm.catalogue import QUERIES

    for name in ("op3_pii_weak_supervision", "op5_substring_dedup", "op9_secret_scan"):
        rows = QUERIES[name](spark, SF).collect()
        column = "kept_sha256" if "kept_sha256" in rows[0] else "base_sha256"
        assert all(re.fullmatch("[0-9a-f]{64}", r[column]) for r in rows)
    nothing = [r for r in QUERIES["op9_secret_scan"](spark, SF).collect() if not r.n_assign + r.n_access + r.n_hex]
    assert {r.base_sha256 for r in nothing} == {hashlib.sha256(b"").hexdigest()}


def test_secrets_in_four_languages_and_quotes():
    from noticeloom.llm.secret_scan import guess_cost, secret_spans

    found = lambda t: [t[a:b] for a, b, k in secret_spans(t, 12)[0] if k == "guess"]
    assert found("password is Zk29!zQmäßXw88#pLr and more") == ["Zk29!zQmäßXw88#pLr"]
    assert found("Das Passwort lautet Zk29!zQmXw88. Das Kennwort: qäZ8#kk2Wp!x") == ["Zk29!zQmXw88", "qäZ8#kk2Wp!x"]
    assert found("Le mot de passe est «x9 Kw#2 éé pQ7z», voilà") == ["x9 Kw#2 éé pQ7z"]
    assert found("mot de passe : Zk29!zQmXw88pL") == ["Zk29!zQmXw88pL"]
    assert found("La contraseña es Ñk29!zQmXw88pL; la clave: \"w8 Kq#2 zz pQ7z\"") == ["Ñk29!zQmXw88pL", "w8 Kq#2 zz pQ7z"]
    assert found("password='x9!Kw#2 zz pQ7z'\nnext 'line'") == ["x9!Kw#2 zz pQ7z"]
    assert found("password = 'x9!Kw#2zzpQ7z never closed") == ["x9!Kw#2zzpQ7z"]
    assert found("password: changeme passwort: password contraseña: qwerty12345") == []
    assert guess_cost("İqŞ8ğüÖÇ") > 12 > guess_cost("passwordqwerty")
