"""Stages of the pipeline against brute force on planted cases; columns of operators 3 and 7 that SQL can say."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from siftpool.llm.registry import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "u") for c in ("ban", "dor", "lix", "mun", "pet", "sar", "tov", "wen")]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def frame(spark, texts):
    """Rows of documents for (id, words)."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in ((i, t if t is None or isinstance(t, str) else " ".join(t)) for i, t in texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def changed(rng, own, places):
    own = list(own)
    for p in places:
        own[p] = f"x{rng.randrange(10**9)}"
    return own


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        own = words(rng, 70)
        texts += [own, own, changed(rng, own, [rng.randrange(70)]), changed(rng, own, [5, 60]), changed(rng, own, range(0, 70, 7)), words(rng, 70)]
        texts.append(changed(rng, texts[-4], [33]))  # near a near copy
    rng.shuffle(texts)
    texts = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, ""), (903, "a b"), (904, "a b")]
    sets = {i: shingles(t or "") for i, t in texts}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((of(i), of(j)))
                root[b] = a
    want = {i for i in sets if of(i) == i}
    assert len(want) < len(sets) - 50
    got = corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == want
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in texts if i in want}


def test_substring_dedup_cuts_passages_and_leaves_the_rest(spark):
    rng = random.Random(2)
    shared = [words(rng, 55) for _ in range(4)]
    texts = []
    for i in range(60):
        own = words(rng, 40 + i)
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own = own[:at] + shared[i % 4] + own[at:]
        if i % 10 == 1:
            own += shared[0][:34]  # a word too short
        texts.append((i, own))
    texts += [(100, words(rng, 3) + shared[1] + shared[1]), (101, []), (102, None)]
    seen = {}
    for _, t in texts:
        for p in range(len(t or []) - 34):
            seen[tuple(t[p : p + 35])] = seen.get(tuple(t[p : p + 35]), 0) + 1
    want = {}
    for i, t in texts:
        gone = {q for p in range(len(t or []) - 34) if seen[tuple(t[p : p + 35])] > 1 for q in range(p, p + 35)}
        want[i] = None if t is None else [w for q, w in enumerate(t) if q not in gone]
    got = corpus_pipeline.substring_dedup(spark, frame(spark, texts), "").collect()
    assert {r.doc_id: None if r.text is None else r.text.split() for r in got} == want and len(got) == len(texts)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)


def test_benchmark_decontamination_finds_items_in_long_documents(spark, tmp_path):
    rng = random.Random(3)
    items = [words(rng, n) for n in (8, 12, 20, 33, 64, 130)]
    texts = []
    for i in range(90):
        own = words(rng, 300 + 10 * i)
        item = items[i % 6]
        if i % 4 == 0:  # whole, its last tenth missing, or half of it
            part = item if i % 8 == 0 else item[: len(item) - max(1, len(item) // 10)]
        else:
            part = item[: len(item) // 2] if i % 4 == 1 else []
        at = rng.randrange(len(own))
        texts.append((i, " ".join(own[:at] + part + own[at:])))
    texts += [(200, None), (201, ""), (202, " ".join(items[5][:70] + words(rng, 40) + items[5][66:]))]  # an item in two places
    rows = [(k, " ".join(t)) for k, t in enumerate(items)] + [(6, None), (7, ""), (0, " ".join(items[0]))]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets = [shingles(" ".join(t)) for t in items]
    want = {i for i, t in texts if not any(len(s & shingles(t or "")) >= 0.8 * len(s) for s in sets)}
    assert 202 not in want and 60 < len(want) < 80
    got = corpus_pipeline.benchmark_decontamination(spark, frame(spark, texts), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_toxicity_rejects_planted_documents_only(spark, tmp_path):
    rng = random.Random(4)
    bad = ["scumwit", "grubhead", "vilefool", "rotbrain"]
    texts, toxic = [], {}
    for i in range(400):
        own = words(rng, 30 + i % 50)
        if i % 4 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
            toxic[i] = 1
        texts.append((i, " ".join(own)))
    labels = [(i, 1, toxic.get(i, 0)) for i in range(300)]  # the last hundred have no label
    texts += [(500, None), (501, ""), (502, " ".join(words(rng, 60_000))), (503, texts[1][1]), (503, texts[1][1])]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(r.doc_id for r in corpus_pipeline.toxicity(spark, frame(spark, texts), str(tmp_path)).collect())
    assert got == sorted(i for i, _ in texts if i not in toxic)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_base_phrases_by_sql(spark):
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM '{SMALL}/documents.parquet'),
        p(label, phrase) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
        h AS (SELECT doc_id, label, i FROM d, p, unnest(range(len(w))) t(i) WHERE w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase)
        SELECT d.doc_id, len(any_value(w)) n_words, count(i) n_base, min(i) first_word, max(i) last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') base_labels
        FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id ORDER BY d.doc_id""").fetchall()
    got = queries()["op3_license_scan"](spark, SMALL).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r.score <= 1 for r in got)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_edited_texts_by_sql(spark):
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') t FROM '{SMALL}/documents.parquet'),
        n AS (SELECT doc_id, t, length(t) n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) o FROM d)
        SELECT doc_id, n_chars, sha256(substr(t, 1, n_chars - n_chars // 3) || substr(o, 1, n_chars // 3)) FROM n ORDER BY doc_id""").fetchall()
    got = queries()["op7_fingerprints"](spark, SMALL).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == want
