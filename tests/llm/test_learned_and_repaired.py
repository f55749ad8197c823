"""Operators 11 to 13 against plain versions, and their odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftpool.llm import clustering, repair
from siftpool.llm.clustering import Tree, clustered, squared
from siftpool.llm.quality import COUNTS, STATISTICS, counts, fit_quality, learned, with_quality

# ---- 11: ball trees


def plain_kmeans(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for j, vs in own.items():
            centroids[j] = [sum(col) // len(vs) for col in zip(*vs)]
    got = [(i, *nearest(v)) for i, v in kept]
    total = {}
    for _, d, j in got:
        total[j] = total.get(j, 0) + d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_clusters_are_those_of_plain_kmeans(spark, spread, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 128)
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.5, (5, 64))
    x = (middle[rng.integers(0, 5, 400)] + rng.normal(0, spread, (400, 64))).astype(np.float32)
    x[100:140] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert rows_of(clustered(df, 16, 3), *CLUSTER) == plain_kmeans(rows, 16, 3)


def test_clusters_of_odd_vectors(spark):
    one = [0.1 * i for i in range(64)]
    rows = [(1, one), (1, one), (1, [0.0] * 64), (None, [1.0] * 64), (2, None), (3, []), (4, [1.0] * 63), (5, [None] + one[1:]), (6, [float("nan")] + one[1:]), (7, [float("inf")] + one[1:]), (8, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<double>, id int, cluster int, x int")
    assert rows_of(clustered(df, 16, 3), *CLUSTER) == plain_kmeans(rows, 16, 3)
    assert clustered(df.where("vec_id > 99"), 16, 3).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    assert {r.distance for r in clustered(huge, 3, 1).collect()} == {0}


def test_whole_balls_go_at_once():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-400, 400, (8, 64))
    x = centroids[rng.integers(0, 8, 4000)] + rng.integers(-9, 9, (4000, 64))
    tree, order = Tree.of(x)
    assert np.array_equal(tree.x, x[order])
    cluster, whole, compared = tree.assign(centroids)
    assert len(compared) < 400 and 8 <= len(whole) < 200  # nine tenths of the vectors are not looked at
    assert np.array_equal(cluster, squared(tree.x, centroids).argmin(axis=1))
    count, sums = tree.partial(centroids)
    for c in range(8):
        assert count[c] == (cluster == c).sum() and np.array_equal(sums[c], tree.x[cluster == c].sum(axis=0))


@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 12), st.sampled_from([1, 3, 100, 1 << 25]))
@settings(max_examples=60, deadline=None)
def test_ties_go_to_the_smaller_number(seed, n, k, size):
    rng = np.random.default_rng(seed)
    x, centroids = rng.integers(-size, size + 1, (n, 3)), rng.integers(-size, size + 1, (k, 3))
    tree, _ = Tree.of(x)
    exact = ((tree.x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert np.array_equal(tree.assign(centroids)[0], exact.argmin(axis=1))


# ---- 12: decision lists


def plain_counts(text):
    word = r"[^\x20\x09-\x0D]+"
    own = re.findall(word, text or "")
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    hit = {i + k for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(word, x)]
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_lines": len(lines),
        "n_distinct_words": len(set(own)),
        "n_digits": len(re.findall("[0-9]", text or "")),
        "n_upper": len(re.findall("[A-Z]", text or "")),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z\u0080-\U0010FFFF]", w)) for w in own),
        "longest_word": max(map(len, own), default=0),
    }


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\r\t#|A1."), max_size=120), st.lists(st.sampled_from(["a", "b"]), max_size=60).map(" ".join)), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_counts_of_texts(texts):
    got = counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert plain_counts(t).items() <= {c: int(got[c][i]) for c in COUNTS}.items()


def test_quality_query_on_whole_texts(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        docs.append((i, " ".join(w + "###" for w in prose(60).split()) if bad else prose(60), "x", 1.5))
        labels.append((i, 0 if bad else 1))
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, prose(50)), (1003, "a b " * 50), (7, docs[7][1]), (1004, ("w" + "x" * 70000 + " ") * 40), (1005, prose(30000))]
    docs += [(i, t, "x", 1.5) for i, t in odd]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, id string, n_words double").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1), (4242, 0)], "doc_id bigint, quality int")
    rules = fit_quality(df, known, F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0))
    assert len(rules.rules) >= 1 and "reject if" in str(rules)
    got = with_quality(df, rules).collect()
    assert len(got) == len(docs)
    text = {i: t for i, t, *_ in docs}
    for r in got:
        want = plain_counts(text[r.doc_id])
        assert all(r[c] == n for c, n in want.items())
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r.kept == (not r.base_failed and r.rule is None)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 5 != 0)  # held out rows too
    none = fit_quality(df, known.where("quality = 1"))
    assert not none.rules and with_quality(df, none).where("kept = base_failed").count() == 0
    assert with_quality(df.where("doc_id = -5"), rules).count() == 0
    assert not fit_quality(df.where("doc_id = -5"), known).rules


def test_lists_stay_right_on_noise_and_conjunctions():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(STATISTICS)))
    a, b = STATISTICS.index("digit_share"), STATISTICS.index("mark_share")
    y = (x[:, a] > 0.6) & (x[:, b] <= 0.3)
    got = learned(x, y)
    hit = np.zeros(3000, bool)
    for r in got.rules:
        hit |= r.covers(x)
    assert (hit & ~y).sum() <= 5 and (hit & y).sum() >= 0.95 * y.sum()
    assert {c.statistic for c in got.rules[0].conditions} == {"digit_share", "mark_share"}
    assert not learned(x, rng.random(3000) < 0.1).rules  # labels without cause reject nothing
    assert learned(x, y) == learned(x, y)


# ---- 13: repair

ALLOWED = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, repaired) of the best of all edits, two insertions at most at each place."""
    options = []
    for (role, text), f in zip(rows, faults(rows)):
        more = 5 if f == "t" else 0
        own = [(2, "D", [])]
        if f not in ("b", "d"):
            own += [(more, "K", [(role, text)]), (1 + more, "R", [("user", text)]), (1 + more, "R", [("assistant", text)])]
        options.append([(5 * n + c, "I" * n + e, [(r, "") for r in new] + kept) for n in range(3) for new in itertools.product(("user", "assistant"), repeat=n) for c, e, kept in own])
    options.append([(5 * n, "I" * n, [(r, "") for r in new]) for n in range(3) for new in itertools.product(("user", "assistant"), repeat=n)])
    best = None
    for choice in itertools.product(*options):
        kept = [x for _, _, k in choice for x in k]
        if ALLOWED.fullmatch("".join(r[:1] or "-" for r, _ in kept)):
            got = (sum(c for c, _, _ in choice), "".join(e for _, e, _ in choice), kept)
            best = min(best, got) if best else got
    return best


def plain_repair(rows):
    """The same for long conversations: least (cost, audit) of each state, turn by turn."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(at):
        for _ in range(3):
            for s, (c, a) in list(at.items()):
                for r in "ua":
                    if (s, r) in steps:
                        to = steps[s, r]
                        at[to] = min(at.get(to, (10**9, "")), (c + 5, a + "I"))
        return at

    at = {0: (0, "")}
    for (role, _), f in zip(rows, faults(rows)):
        new = {}
        for s, (c, a) in closed(at).items():
            ways = [(s, 2, "D")]
            if f not in ("b", "d"):
                more = 5 if f == "t" else 0
                ways += [(steps.get((s, role[:1])), more, "K")] + [(steps.get((s, r)), 1 + more, "R") for r in "ua"]
            for to, p, e in ways:
                if to is not None:
                    new[to] = min(new.get(to, (10**9, "")), (c + p, a + e))
        at = new
    at = closed(at)
    return min(at[s] for s in (0, 3) if s in at)


def plain_result(rows, every):
    out = []
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        pairs, turns = [(r, t) for _, _, r, t in own], [r[1] for r in own if r[1] is not None]
        cost, audit = plain_repair(pairs)
        roles, left, lines = repair._roles(audit), iter(pairs), []
        for e in audit:
            if e == "I":
                lines.append(f"{next(roles)}:")
            else:
                role, text = next(left)
                if e != "D":
                    wanted = next(roles)
                    assert e == "R" or role[:1] == wanted[0]
                    lines.append(f"{role if e == 'K' else wanted}:{text}")
        f = Counter(faults(pairs))
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, f["b"], f["d"], f["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_short_conversations_against_all_edits(spark):
    rng = random.Random(9)
    rows, convs = [], {}
    for conv in range(150):
        own = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", " ", "Why?", f"{rng.random()}!"])) for _ in range(rng.randint(1, 3))]
        convs[conv] = own
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(own)]
    got = {r.conv_id: r for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv, own in convs.items():
        cost, audit, kept = every_repair(own)
        assert (got[conv].cost, got[conv].audit) == (cost, audit) == plain_repair(own), own
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def test_damaged_conversations_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "Ursa", None]), rng.choice(["Ok.", "é!\n", "cut", "", None, "a?b"])) for _ in range(700)]
    rows += [(77, 2, "user", "Only."), (78, None, None, None)] + [(conv, 0, "user", "x.") for conv in range(1000, 1060)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", cost int, pos string").repartition(5)
    hurt = repair.damaged(df)
    assert Counter(map(tuple, hurt.collect())) == Counter(plain_damage(rows))
    got = rows_of(repair.repaired(hurt, every=df), *REPAIR)
    assert got == plain_result(plain_damage(rows), {r[0] for r in rows})
    assert any(r[7] == "" for r in got)  # dropped whole
    empty = df.where("conv_id = -9")
    assert repair.repaired(repair.damaged(empty), every=empty).count() == 0


def test_one_long_conversation_among_short_ones(spark, monkeypatch):
    """A conversation over all partitions, of many pieces and several steps that put them together."""
    monkeypatch.setattr(repair, "FAN", 4)
    rng = random.Random(6)
    rows = [(5, i // 2 if i % 7 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"{i}.", f"{i}", " "])) for i in range(6000)]
    rows += [(conv, i, "user" if i % 2 == 0 else "assistant", f"{conv} {i}.") for conv in range(20, 60) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(repair.repaired(df), *REPAIR) == plain_result(rows, {r[0] for r in rows})
