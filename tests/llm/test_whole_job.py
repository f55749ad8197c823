"""Cases in which an operator once did less than its whole job."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftpool.llm.packing import _Shard


def plain_bm25(tails, idf, mean, seed):
    out = []
    for j, x in enumerate(tails):
        norm = 1.2 * (0.25 + 0.75 * len(x) / mean)
        tf = {t: x.tolist().count(t) for t in set(tails[seed].tolist())}
        out.append(sum(idf[t] * f * 2.2 / (f + norm) for t, f in tf.items() if f))
    return np.array(out)


def test_neighbours_are_scored_on_all_tokens():
    """Long seeds: the order is that of BM25 over every distinct token, also of those beyond the rarest few."""
    rng = np.random.default_rng(3)
    for n in (60, 700):
        tails = [np.append(rng.zipf(1.3, rng.integers(1, 120)) % 400, 0).astype("<u2") for _ in range(n)]
        # the first tail's rarest 40 tokens occur nowhere else; it shares only its others
        tails[0] = np.concatenate([np.arange(400, 440), tails[1], [0]]).astype("<u2")
        freq = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=440)
        idf, mean = np.log1p((n - freq + 0.5) / (freq + 0.5)), float(np.mean([len(t) for t in tails]))
        shard = _Shard(tails, idf, mean)
        for seed in (0, 5, n - 1):
            used = rng.random(n) < 0.2
            used[seed] = True
            used[1] = seed != 0
            want, got = plain_bm25(tails, idf, mean, seed), list(shard.neighbours(seed, used))
            assert set(got) == {j for j in range(n) if not used[j] and want[j] > 0}
            assert all(want[a] > want[b] or math.isclose(want[a], want[b], rel_tol=1e-9) for a, b in zip(got, got[1:]))
            assert seed or got[0] == 1


def alternatives(tree):
    """Texts that an expression matches, so that each alternative, option and character of a class is in one at least."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "NOT_LITERAL":
            own = ["x"]
        elif name == "ANY":
            own = ["x"]
        elif name == "IN":
            own = [chr(a) for k, a in arg if str(k) == "LITERAL"] or ["7"]
        elif name == "BRANCH":
            own = [x for branch in arg[1] for x in alternatives(branch)]
        elif name == "SUBPATTERN":
            own = alternatives(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            once = alternatives(inner)
            own = [x * low for x in once] if low else ["", *once]
        elif name in ("ASSERT", "ASSERT_NOT"):
            continue
        else:
            raise AssertionError(name)
        out = [a + own[0] for a in out] + [out[0] + b for b in own[1:]] if len(out) * len(own) > 400 else [a + b for a in out for b in own]
    return out


def test_gates_lose_no_text_that_a_rule_matches():
    from re import _parser

    from siftpool.llm.licenses import Scanner

    s = Scanner()
    for r in s.rules:
        seen = 0
        for text in alternatives(_parser.parse(r.pattern.pattern)):
            if r.pattern.search(text):
                seen += 1
                assert all(set(group) & set(text.split()) for group in r.gate), (r, text)
        assert seen, r


def test_license_scan_finds_what_was_gated_out(spark):
    from siftpool.llm.licenses import Scanner, scan_licenses

    texts = {
        1: "It is available under Apache 2.0, too",
        2: "published under GPL version 3",
        3: "code: GPL version 3",
        4: "Unauthorised copying of it is prohibited",
        5: "confidential and confidential",
        6: "No part of this work may be copied",
        7: "x\u00a0gpl version 3",  # one word up to the space
    }
    want = {1: "apache-2.0", 2: "gpl-3.0", 3: "gpl-3.0", 4: "proprietary", 5: "proprietary", 6: "proprietary", 7: ""}
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == want
    s = Scanner()
    every = {w for r in s.rules for group in r.gate for w in group}
    for i, text in texts.items():
        own = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ")
        free = s.detections([w for w in own if w], every)
        assert [(a, b, r.label) for a, b, r in free] == [(x.start, x.end, x.label) for x in got[i].detections]


LITERAL = "<|endoftext|>"


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", " the", " ", "  ", "\n", "é", "　", "1", "'s", "!", "<|", LITERAL, LITERAL]), max_size=12).map("".join)), max_size=6))
def test_ids_are_the_librarys_where_texts_hold_an_added_token(texts):
    """The library alone, as it is by default, gives the ids; the operators' encoder has the same."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from siftpool.llm.registry import vocabulary
    from siftpool.llm.textops import text_bytes
    from siftpool.llm.tokens import encoder

    if not _library:
        _library.append(Tokenizer.from_file(vocabulary()))
    ids, at = encoder(vocabulary()).encode(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [_library[0].encode(t or "", add_special_tokens=False).ids for t in texts]


_library = []


def test_packing_counts_an_added_token_once(spark):
    import zlib

    from siftpool.llm.packing import packed_ids, retrieval_packed
    from siftpool.llm.registry import vocabulary

    df = spark.createDataFrame([(1, f"a {LITERAL} b")], "doc_id bigint, text string")
    ids = [64, 220, 50256, 275, 0]
    (got,) = retrieval_packed(df, vocabulary()).collect()
    assert (got.start, got.length, got.doc_tokens, got.ids_crc32) == (0, 5, 5, zlib.crc32(np.array(ids, "<u4").tobytes()))
    (row,) = packed_ids(df, vocabulary(), size=8).collect()
    assert np.frombuffer(row.input_ids, "<u2").tolist() == [*ids, 0, 0, 0]


def test_pipeline_keeps_a_copy_of_repeated_rows(spark):
    """Texts over the window of 35 words: repeated rows and null ids lose nothing, and a clean second text of an id stays."""
    import corpus_pipeline as p

    def text(word, n=60):
        return " ".join(f"{word}{i}" for i in range(n))

    near = text("c") + " other end"
    rows = [(3, text("a")), (3, text("a")), (3, text("a")), (None, text("b")), (None, text("b")), (4, text("c")), (7, near), (7, text("d")), (None, text("e")), (9, text("e")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(4)
    once = p.written(p.near_dedup(spark, docs, ""), "near_dedup")
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in p.substring_dedup(spark, once, "").collect()), key=str)
    want = [(3, text("a"))] * 3 + [(None, text("b")), (4, text("c")), (7, text("d")), (9, text("e")), (None, None), (None, "")]
    assert got == sorted(((i, t, len(t or "")) for i, t in want), key=str)
    # a passage that two documents share still goes, from a document's repeats too
    shared = text("s", 40)
    rows = [(1, text("f") + " " + shared), (1, text("f") + " " + shared), (2, text("g") + " " + shared)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = sorted((r.doc_id, r.text.strip(), r.n_chars) for r in p.substring_dedup(spark, docs, "").collect())
    assert [x[:2] for x in got] == [(1, text("f")), (1, text("f")), (2, text("g"))]


def test_near_duplicates_of_two_texts_under_one_id(spark):
    """A class is a text's, not an id's: what shares only an id with a copy is in no group of it."""
    from siftpool.llm.neardup import near_duplicates

    def text(word, n=40):
        return " ".join(f"{word}{i}" for i in range(n))

    rows = [(2, text("a")), (4, text("a")), (4, text("b")), (5, text("b") + " end"), (6, text("c")), (6, text("c"))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(2, 36, 2), (4, 36, 2), (4, 36, 4), (5, 37, 4), (6, 36, 6), (6, 36, 6)]


def test_chained_documents_are_compared_within_buckets(spark, monkeypatch):
    """Each text shares about half of its shingles with the next: bands chain them to one group, but comparisons stay within buckets."""
    from siftpool.llm import neardup

    monkeypatch.setattr(neardup, "LEADERS", 4)
    compared = []
    units = neardup._units
    monkeypatch.setattr(neardup, "_units", lambda a, b: (lambda df: compared.append(df) or df)(units(a, b)))
    sizes = {}
    for n in (200, 400):
        rows = [(i, " ".join(f"w{j}" for j in range(20 * i, 20 * i + 64))) for i in range(n)]
        rows += [(n + i, f"start {t} end") for i, t in rows[::40]]
        compared.clear()
        monkeypatch.setattr(neardup, "forget", lambda df: None)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, percent=85).collect()}
        assert got == {i: i for i in range(n)} | {n + i: i for i, _ in rows[:n:40]}
        pairs = [df.groupBy("grp", "lead_block", "block").agg(F.sum(F.col("leads").cast("int")).alias("a"), F.count("*").alias("b")).agg(F.sum(F.expr("a * b"))).first()[0] or 0 for df in compared]
        sizes[n] = sum(pairs)
    assert sizes[400] < 3 * sizes[200]


def test_a_chunks_work_does_not_grow_with_the_buckets():
    """Buckets by leading bits: cuts are as many as the hashes fall in, and each hash is in the bucket of its range."""
    from siftpool.llm import substring

    w = substring._Windows.__new__(substring._Windows)
    w.hashes = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for bits in (0, 1, 7, 20, 40):
        full, cuts = w.cuts(bits)
        assert len(full) <= 5000 and len(cuts) == len(full) + 1 and (np.diff(cuts) > 0).all()
        for b, i, j in zip(full.tolist(), cuts, cuts[1:]):
            assert all(int(h) >> (64 - bits) == b for h in w.hashes[i:j])
    assert [substring._growth(x) for x in (0, 10**9, 10**11, 10**14)] == [1, 1, 2, 16]


def test_license_rules_tell_notices_and_later_versions_apart():
    from siftpool.llm.licenses import Scanner

    s = Scanner()
    every = {w for r in s.rules for group in r.gate for w in group}
    for text, want in {
        "some rights reserved": "some-rights",
        "no rights reserved": "no-rights",
        "all rights reserved": "reserved",
        "gpl 2 or later": "gpl-2.0-or-later",
        "licensed under the gpl v2 or later": "gpl-2.0-or-later",
        "gnu lesser general public license version 2 1 or at your option any later version": "lgpl-2.1-or-later",
        "spdx license identifier gpl 3 0 or later": "gpl-3.0-or-later",
        "mozilla public license 2 0": "mpl-2.0",
    }.items():
        n = len(text.split())
        assert [(a, b, r.label) for a, b, r in s.detections(text.split(), every)] == [(0, n, want)]
    # of two rules for the same words, the first by priority and then by place in the table stays
    labels = [(a, b, r.label) for a, b, r in s.detections("this work is in the public domain".split(), every)]
    assert labels == [(0, 7, "public-domain")]
    assert len({(r.label, r.pattern.pattern) for r in s.rules}) == len(s.rules) > 250


def plain_signature(text):
    """Chunk signatures by the definition, byte by byte."""
    from siftpool.llm.fingerprint import SYMBOLS, WINDOW, _rolling

    raw = text.encode()
    h = [int(_rolling(np.frombuffer(raw[i : i + WINDOW], np.uint8))[0]) for i in range(len(raw) - WINDOW + 1)]
    ones = lambda x: next(i for i in range(33) if not x >> i & 1)
    k = next(e for e in range(33) if sum(ones(x) >= e for x in h) < 64)
    out = []
    for e in (k, k + 1):
        sign, total = "", 0
        for i, x in enumerate(h):
            total += x
            if ones(x) >= e or i == len(h) - 1:
                sign += chr(SYMBOLS[(total * 0x9E3779B97F4A7C15 % 2**64) >> 58])
                total = 0
        out.append(sign)
    return (k, *(x.encode() for x in out))


def test_signatures_by_the_definition():
    import pyarrow as pa

    from siftpool.llm.fingerprint import fingerprints

    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc dé\n"), n)) for n in (7, 8, 40, 300, 3000, 9000)]
    assert fingerprints(pa.array(texts)) == [plain_signature(t) for t in texts]


def test_short_texts_have_fingerprints_of_their_own():
    import pyarrow as pa

    from siftpool.llm.fingerprint import fingerprints, likeness

    texts = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in range(10)]
    found = fingerprints(pa.array([*texts, *texts, "", None]))
    assert len(set(found[:200])) == 200 and found[:200] == found[200:400] and found[400] == found[401]
    assert likeness(found[:199], found[1:200]).mean() < 0.1


def test_words_are_scored_first_then_shorter_grams(spark):
    """The score of each word is that of the word, else the mean of its longest known n-grams, by plain dictionaries over the model's tables."""
    import pyarrow as pa

    from siftpool.llm import language
    from siftpool.llm.textops import text_bytes, window_hashes, word_hashes

    docs = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    model = language.fit_language(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), F.lit(True))
    tables = [dict(zip(model.keys[k].tolist(), model.logs[k].tolist())) for k in range(6)]

    def gram(word, k):
        points, _ = language._grams([word])
        return [int(window_hashes(points[i : i + k], k, 1)[0]) for i in range(len(points) - k + 1)]

    def plain(word):
        buf, offs = text_bytes(pa.array([word]))
        own = int(word_hashes(buf, offs[:-1], offs[1:])[0])
        if own in tables[0]:
            return tables[0][own]
        for k in range(5, 0, -1):
            found = [tables[k][h] for h in gram(word, k) if h in tables[k]]
            if found:
                return np.mean(found, axis=0).tolist()
        return [0.0] * len(model.langs)

    words = ["the", "hund", "catze", "hunde", "undthe", "xq", "mat", "zzkatz"]
    own, keys, _, _ = language._distinct(pa.array([" ".join(words)]))
    assert sorted(own) == sorted(words)
    assert np.allclose(model.word_scores(own, keys), [plain(w) for w in own])
    odd = [(1, "the katze"), (1, "the katze"), (2, None), (3, "12 !"), (4, "cat " * 200_000), (5, "und")]
    got = sorted((r.doc_id, r.lang_pred) for r in language.with_language(spark.createDataFrame(odd, "doc_id bigint, text string"), model).collect())
    assert got[2:] == [(2, "und"), (3, "und"), (4, "en"), (5, "de")] and got[0] == got[1]


def test_a_frequent_language_leaves_room_for_others(spark, monkeypatch):
    from siftpool.llm import language

    monkeypatch.setattr(language, "KEEP", {k: 30 for k in language.KEEP})
    rng = np.random.default_rng(1)
    much = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 40)), "aa") for i in range(300)]
    few = [(1000 + i, " ".join(["pan", "lin", "tor"]), "bb") for i in range(6)]
    model = language.fit_language(spark.createDataFrame(much + few, "doc_id bigint, text string, lang string"), F.lit(True))
    got = language.with_language(spark.createDataFrame([(1, "pan tor lin pan tor lin pan tor lin")], "doc_id bigint, text string"), model).first()
    assert got.lang_pred == "bb"
