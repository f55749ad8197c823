"""Operators on documents against brute force, and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftpool.llm import textops
from siftpool.llm.decontaminate import contained_items, without_items
from siftpool.llm.fingerprint import fingerprint_edits, fingerprints, likeness
from siftpool.llm.language import fit_language, with_language
from siftpool.llm.licenses import BASE, Scanner, scan_licenses
from siftpool.llm.license_rules import rules
from siftpool.llm.neardup import bands_for, near_duplicates, odd_likeness, odd_sketch, samples
from siftpool.llm.substring import repeats_digest, without_repeats
from siftpool.llm.toxicity import Model, fit_toxicity, held_out, with_toxicity

SPACE = r"[^\x20\x09-\x0D]+"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def corpus(seed=1, n=60):
    """Invented texts with copies, near copies, shared passages and odd rows."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeéñ"), rng.integers(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab, rng.integers(5, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab, 60))
    for i in range(0, n, 7):
        texts[i] += "\n" + passage + " tail"
    for i in range(1, n, 9):
        words = texts[(i * 5) % n].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[5].upper(), None, "", " \n\t", "one", "one two", "x" * 70_000 + " y", " ".join(["same"] * 90), "À l'été\x00z " * 5]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t, f"t{i}", -1) for i, t in rows], "doc_id bigint, text string, id string, `grp` int").repartition(5), dict(rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_words_and_hashes():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \n\té\x0b"), rng.integers(0, 40))) for _ in range(300)] + [None, "", "z" * 70_000 + " z"]
    buf, offs = textops.text_bytes(pa.array(texts))
    starts, ends, bounds = textops.words(buf, offs)
    want = [re.findall(SPACE, t or "") for t in texts]
    assert [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for ws in want for w in ws]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    h = textops.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len({w for ws in want for w in ws})
    for k in (1, 3, 5, 35):
        seen = {}
        for i, x in enumerate(textops.window_hashes(h, k).tolist()):
            assert seen.setdefault(x, tuple(h[i : i + k])) == tuple(h[i : i + k])
        assert textops.run_starts(bounds, k).tolist() == [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b - k + 1)]


# --- 1


def repeats(texts, window):
    own = {i: re.findall(SPACE, t or "") for i, t in texts.items()}
    count = Counter(tuple(w[j : j + window]) for w in own.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in own.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out[i] = w, gone
    return out


def test_substring_dedup(docs, none, monkeypatch):
    df, texts = docs
    from siftpool.llm import substring

    for size, bucket in ((4 << 20, 1 << 20), (3000, 500)):  # also with many chunks and buckets
        monkeypatch.setattr(substring, "CHUNK_BYTES", size)
        monkeypatch.setattr(substring, "BUCKET", bucket)
        got = {r.doc_id: r for r in repeats_digest(df).collect()}
        for i, (w, gone) in repeats(texts, 35).items():
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    cut = {r.doc_id: r for r in without_repeats(df, spans="cut").collect()}
    for i, (w, gone) in repeats(texts, 35).items():
        assert re.findall(SPACE, cut[i].text or "") == [x for x, g in zip(w, gone) if not g]
        assert [k for s in cut[i].cut for k in range(s.start, s.end)] == [k for k, g in enumerate(gone) if g]
        assert any(gone) or cut[i].text == texts[i]
    assert cut[0].id == "t0" and repeats_digest(none).count() == 0 and without_repeats(none).columns == none.columns


# --- 8


def test_decontamination(spark, docs, none, monkeypatch):
    df, texts = docs
    pick = [t for t in texts.values() if t and len(t.split()) > 30]
    items = [(k, " ".join(pick[k].split()[4 : 8 + 2 * k])) for k in range(12)] + [(90, None), (91, "..."), (92, "one two"), (93, "not there at all by chance")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    norm = lambda x: re.findall("[0-9a-z\x80-\U0010ffff]+", (x or "").lower())
    want = set()
    for d, t in texts.items():
        have = norm(t)
        for i, q in items:
            q = norm(q)
            k = min(5, len(q))
            grams = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)} if k else set()
            if grams and len(grams & {tuple(have[j : j + k]) for j in range(len(have) - k + 1)}) >= 0.8 * len(grams):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in contained_items(df, bench).collect()}
    assert got == want and len(want) > 12
    kept = without_items(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want} and kept.columns == df.columns
    from siftpool.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in contained_items(df, bench).collect()} == want
    assert contained_items(none, bench).count() == 0 and contained_items(df, bench.limit(0)).count() == 0
    assert without_items(df, bench.limit(0)).count() == df.count()


# --- 10


def linked(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(SPACE, lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    df, texts = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=k, percent=percent).collect()}
    assert got == linked(texts, k, percent)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """More members than leaders, many of them below the threshold to each other, over several blocks."""
    from siftpool.llm import neardup

    monkeypatch.setattr(neardup, "LEADERS", 3)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(4)
    base = [f"w{j}" for j in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            words[j] = f"n{rng.integers(1 << 30)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == linked(texts, 3, 85) and len({c for _, c in got.values()}) > 1


def test_near_duplicates_odd_rows(spark, none):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (7, "A b\tc d"), (8, None), (9, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (7, 4, False), (8, 8, True), (9, 9, True)], key=str)
    assert near_duplicates(none).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    k = bands_for(0.85) * 5
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.8, 0.9, 0.98):
        n = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 4000 - n).astype(np.uint64)])
        apart = np.bitwise_count(odd_sketch(samples(a, k)) ^ odd_sketch(samples(b, k))).sum()
        assert odd_likeness(np.array([apart]), k)[0] == pytest.approx(n / (8000 - n), abs=0.12)


# --- 3


def test_license_scan(spark, docs, none):
    df, texts = docs
    more = {
        1000: "Licensed under the Apache License, Version 2.0. All rights reserved",
        1001: "This is CC BY. cc by-nc 4.0 and CC  BY; GNU General Public License, version 3",
        1002: "Mit der Lizenz. mit license terms: released under the MIT License",
        1003: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        1004: "SPDX-License-Identifier: BSD-3-Clause",
    }
    texts = texts | more
    got = {r.doc_id: r for r in scan_licenses(df.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(j, BASE[p]) for p in BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = {i: set(got[i].labels.split(",")) for i in more}
    assert "apache-2.0" in labels[1000] and {"cc-by", "cc-by-nc-4.0", "gpl-3.0"} <= labels[1001] and labels[1002] == labels[1003] == {"mit"} and "bsd-3" in labels[1004]
    assert len(rules()) > 200 and scan_licenses(none).count() == 0


def test_contained_detections_are_suppressed():
    s = Scanner()
    own = "licensed under the apache license version 2 0 apache license".split()
    got = s.detections(own, {"apache", "license", "licensed"})
    assert [(a, b, r.label) for a, b, r in got] == [(0, 8, "apache-2.0"), (8, 10, "apache")]


# --- 4


def test_marginals_match_forward_backward():
    rng = np.random.default_rng(1)
    m = Model(np.zeros(0, np.uint64), np.zeros(0, np.uint8), rng.normal(size=16), rng.normal(size=(2, 2)), np.zeros(0))
    bounds = np.concatenate(([0], np.cumsum([0, 1, 3, 40, 0, 17, 200, 2])))
    cls = np.where(rng.random(bounds[-1]) < 0.2, rng.integers(1, 16, bounds[-1]), 0).astype(np.uint8)
    got = dict(zip(*m.marginals(cls, bounds)))
    t = np.exp(m.step)
    for a, b in zip(bounds, bounds[1:]):
        own = np.stack([np.ones(b - a), np.exp(m.emit[cls[a:b]])], axis=1)
        fore = [own[0]] if b > a else []
        for k in range(1, b - a):
            fore.append((fore[-1] @ t) * own[k])
            fore[-1] /= fore[-1].sum()
        back = np.ones(2)
        for k in range(b - a - 1, -1, -1):
            if a + k in got:
                p = fore[k] * back
                assert got[a + k] == pytest.approx(p[1] / p.sum(), abs=1e-9)
            back = t @ (own[k] * back)
            back /= back.sum()


def test_toxicity(spark, none):
    rng = np.random.default_rng(5)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["vile", "scummy", "rotten"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(vocab, rng.integers(10, 80)))
        toxic = i % 5 == 0
        for _ in range(rng.integers(2, 6) if toxic else 0):
            words.insert(rng.integers(len(words)), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "Vile and ROTTEN, scummy"), (None, "worda")]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id bigint, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(2000, None), (None, 1)], "doc_id bigint, toxic int")
    model = fit_toxicity(df, lab, ~held_out(F.col("doc_id"), 5, 0))
    out = {r.doc_id: r for r in with_toxicity(df, model, score="p", spans="words").collect()}
    truth = dict(labels)
    assert np.mean([(out[i].p >= 0.5) == truth[i] for i in truth]) > 0.99
    assert out[1002].p > 0.5 and [(s.start, s.end) for s in out[1002].words] == [(0, 4), (9, 15), (17, 23)]
    assert out[1000].p == out[1001].p < 0.5 and out[0].score == 7
    kept = with_toxicity(df, model, score="p", below=0.5)
    assert kept.count() == sum(r.p < 0.5 for r in out.values()) and kept.columns == [*df.columns, "p"]
    assert with_toxicity(none, model).count() == 0
    flat = fit_toxicity(df, lab.limit(0))
    assert {r.p for r in with_toxicity(df, flat, score="p").collect()} == {0.0}


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert spark.createDataFrame([(None,)], "id bigint").select(held_out(F.col("id"), 3, 1).alias("h")).first().h is False


# --- 7


def test_fingerprints(spark, docs, none, monkeypatch):
    df, texts = docs
    from siftpool.llm import fingerprint

    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 9000)  # several ranges of ids
    got = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        x, y = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(x) // 3
        edited = x[: len(x) - n] + y[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and (edited != x or r.near_edited == 1)
    long = [r for i, r in got.items() if len(texts[i] or "") > 300 and "x" * 99 not in texts[i] and "same" not in texts[i]]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert fingerprint_edits(none).count() == 0
    odd = spark.createDataFrame([(None, "last of all"), (3, "b"), (3, "a"), (1, None)], "doc_id bigint, text string")
    assert fingerprint_edits(odd).count() == 4


def test_likeness_is_an_edit_distance():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    from siftpool.llm.fingerprint import _common

    rng = np.random.default_rng(3)
    pairs = [(bytes(rng.choice(list(b"ABCab+"), rng.integers(0, 65)).astype(np.uint8)), bytes(rng.choice(list(b"ABCab+"), rng.integers(0, 65)).astype(np.uint8))) for _ in range(100)]
    assert _common(pairs).tolist() == [common(*p) for p in pairs]
    a, b = fingerprints(pa.array(["some words " * 40 + "and more", ""]))
    assert likeness([a, a, a], [a, b, (a[0] + 5, a[1], a[2])]).tolist() == [1, 0, 0]


# --- 9


def test_language(spark, none):
    rng = np.random.default_rng(6)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ich", "ung"], "cc": ["ñar", "ción", "llo", "ez"]}
    rows = []
    for i in range(600):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 5))) for _ in range(rng.integers(3, 30))), lang))
    rows += [(700, None, "aa"), (701, " 12 .!", "aa"), (702, "kalomitu KALO", None), (703, "schrengung", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_language(df, ~out)
    got = {r.doc_id: r for r in with_language(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:600]]) > 0.98
    assert (got[700].lang_pred, got[701].lang_pred, got[702].lang_pred, got[703].lang_pred) == ("und", "und", "aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert with_language(none, model).count() == 0
    assert {r.lang_pred for r in with_language(df, fit_language(df.limit(0), ~out)).collect()} == {"und"}
