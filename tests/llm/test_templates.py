"""Near duplicates among texts of one template: similar, not linked."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftpool.llm import neardup
from siftpool.llm.neardup import SLOTS, near_duplicates, rare_prefixes


@given(st.integers(0, 2**32), st.sampled_from([60, 80, 85, 95]), st.integers(1, 300))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_rare_shingle(seed, percent, n):
    """Whatever the counters say, linked sets share one of their first shingles, and one that counts for the smaller."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 5, SLOTS).astype(np.int32)
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    drop, new = rng.integers(0, max(1, len(a) // 5 + 1)), rng.integers(0, max(1, len(a) // 5 + 1))
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
        return
    small, large = sorted((a, b), key=len)
    first, index = rare_prefixes(small, counts, percent)
    other, _ = rare_prefixes(large, counts, percent)
    assert set(first[:index]) & set(other)


def plain(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("crowd", [4, 10_000])
def test_texts_of_one_template(spark, monkeypatch, crowd):
    """Unlinked texts of a template with links among them, near the threshold on both sides, and a few small texts of the template alone."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "LEADERS", 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base + [word() for _ in range(20)])) for i in range(160)]
    for j in range(60):
        own = rows[rng.randrange(160)][1].split()
        for _ in range(rng.randint(1, 9)):  # about 3 shingles each: some links hold, some do not
            own[rng.randrange(120, 140)] = word()
        rows.append((200 + j, " ".join(own)))
    rows += [(300 + j, " ".join(base[j : j + 110])) for j in range(6)]
    rows += [(400 + j, rows[5][1]) for j in range(5)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shingle=3, percent=85).collect()}
    want = plain(rows, 3, 85)
    assert got == want
    assert len(set(want.values())) > 100 and sum(i != c for i, c in want.items()) > 20


def test_a_template_alone_brings_no_sets_together(spark, monkeypatch):
    """Texts that share the template and nothing else are in no comparison of full sets, and hardly in one of sketches."""
    monkeypatch.setattr(neardup, "CROWD", 16)
    seen = {}
    keep = neardup.written

    def written(df, name):
        out = keep(df, name)
        if name in ("likely", "members"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "written", written)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    base = [word() for _ in range(240)]
    rows = [(i, " ".join(base + [word() for _ in range(38)])) for i in range(400)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shingle=3, percent=85)
    assert got.where("kept").count() == 400
    assert seen == {"members": 0, "likely": 0}
