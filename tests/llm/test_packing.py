import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftpool.llm import packing
from siftpool.llm.packing import _deal, best_fit_decreasing, packed_ids, retrieval_packed
from siftpool.llm.registry import vocabulary
from siftpool.llm.textops import text_bytes
from siftpool.llm.tokens import Encoder
from tests.llm.test_text_operators import corpus

TEXT = st.lists(st.sampled_from(["a", " the", "b ", " ", "  ", "\n", "\t", "é", " ", "　", "\x1c", "1", "'s", "!", "<|endoftext|>", "日本"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    own.encode_special_tokens = True
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_ids_are_the_tokenizers(plain, texts):
    import pyarrow as pa

    ids, at = _encoder().encode(*text_bytes(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


_made = []


def _encoder():
    if not _made:
        _made.append(Encoder(vocabulary()))
    return _made[0]


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    bins, n = best_fit_decreasing(np.array(lengths, int), 64)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the plain form
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
    for i, b in enumerate(bins):
        want[b] = want.get(b, 0) + lengths[i]
    assert sorted(64 - w for w in want.values()) == sorted(room) and n == len(room)


@pytest.fixture(scope="module")
def rows(spark, plain):
    data = corpus(n=40)
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id bigint, text string, n int").repartition(3)
    return df, {i: plain(t) + [0] for i, t in data}


def test_retrieval_packing(spark, rows):
    df, ids = rows
    for size in (64, 1024):
        got = retrieval_packed(df, vocabulary(), size=size).toPandas()
        for i, g in got.sort_values("start").groupby("doc_id"):
            at = 0
            for r in g.itertuples():
                assert r.start == at and r.doc_tokens == len(ids[i])
                assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids[i])
        assert set(got.doc_id) == set(ids)
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= size
        full = got.groupby("sequence_id").length.sum()
        assert (full < size).sum() <= 1
    assert retrieval_packed(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary()).count() == 0


@given(st.dictionaries(st.integers(-1, 40), st.integers(1, 400), max_size=30))
def test_shards_hold_a_block_to_two(loads):
    places, shards = _deal(loads, 100)
    held = [0.0] * shards
    for token, load in loads.items():
        first, n = places[token]
        assert load < 100 and n == 1 or n == load // 100
        for k in range(first, first + n):
            held[k] += load / n
    assert all(h < 200 for h in held) and sum(h < 100 for h in held) <= 1


def test_packing_depends_on_documents_alone(spark, monkeypatch):
    """The same pieces from any partitioning, with several shards in a task, repeated rows and null ids."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(packing, "TASKS", 3)
    data = [(i, t) for i, t in corpus(n=60)] + [(None, "river mountain"), (None, "river mountain"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    runs = [retrieval_packed(d, vocabulary(), size=64).toPandas() for d in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("doc_id")))]
    order = runs[0].columns.tolist()
    first, *others = (r.sort_values(["sequence_id", "offset"]).reset_index(drop=True)[order] for r in runs)
    assert first.sequence_id.nunique() > 10 and not first.duplicated(["sequence_id", "offset"]).any()
    assert all(first.equals(o) for o in others)


def test_neighbours_share_words(spark):
    """Windows are filled with documents of the same rare words."""
    rng = np.random.default_rng(1)
    topics = ["river mountain valley forest glacier meadow", "piano violin trumpet guitar cello flute", "enzyme protein neuron tissue membrane genome", "mortgage dividend equity pension loan audit"]
    topics = [t.split() for t in topics]
    data = [(i, " ".join(rng.choice(topics[i % 4], 8))) for i in range(80)]
    got = retrieval_packed(spark.createDataFrame(data, "doc_id bigint, text string"), vocabulary(), size=64).toPandas()
    share = [(g.doc_id % 4).value_counts(normalize=True).max() for _, g in got.groupby("sequence_id") if len(g) > 1]
    assert np.mean(share) > 0.8


def test_packed_ids(spark, rows):
    df, ids = rows
    got = packed_ids(df, vocabulary(), size=128).collect()
    parts = {}
    for r in got:
        x = np.frombuffer(r.input_ids, "<u2")
        assert len(x) == 128 and r.n_tokens == r.cu_seqlens[-1] and not x[r.n_tokens :].any() and r.position_resets == r.cu_seqlens[:-1]
        for a, b, i, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
            parts.setdefault(i, []).append((s, x[a:b].tolist()))
    assert {i: [t for _, p in sorted(x) for t in p] for i, x in parts.items()} == ids
    assert len({r.sequence_id for r in got}) == len(got)
    assert packed_ids(df.limit(0), vocabulary()).count() == 0
