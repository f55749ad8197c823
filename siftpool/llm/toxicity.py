"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training reads a bounded sample of labelled documents. Words and word beginnings
that favour toxic documents become evidence classes, which the chain observes. Its
labelled tokens come from the documents' labels and from nothing that it observes:
all tokens of a document that is not toxic are labelled so; of a toxic document it
is known only that one token at least is toxic, and which ones is latent. The chain
is trained by gradient ascent on the exact likelihood of that. A document's score
is a logistic regression on sums of the chain's forward-backward marginals.

Scoring reads whole texts. Almost all tokens show no evidence; a run of them is
a power of one 2x2 matrix, so forward and backward steps are taken at evidence
only, for all documents of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import ALNUM, fresh, slices, text_bytes, window_hashes, word_hashes, words, written

SAMPLE = 20_000  # labelled documents that training reads at most, about
CHAIN_DOCS, CHAIN_WORDS = 1000, 2000  # of those, documents that train the chain, and their longest; all of them train the rest
_SEGMENT = 250  # tokens of a document that the chain's training takes at a time
FEATURES = 50_000  # words and beginnings kept at most
PREFIXES = (4, 5)  # bytes of a longer word's beginnings
BINS = (1.0, 2.5, 4.0)  # log odds of the evidence classes
_FILTER = 1 << 20


def _features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token and of its beginnings (0 where it is too short), where each text's tokens begin, and the tokens' spans of bytes."""
    buf, offs = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, bounds = words(buf, offs, ALNUM)
    out = [word_hashes(buf, starts, ends)]
    for p in PREFIXES:
        h = np.zeros(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > p)
        h[long] = word_hashes(buf, starts[long], starts[long] + p, 1)
        out.append(h)
    return out, bounds, starts, ends


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    bins: np.ndarray
    emit: np.ndarray  # log weight of label 1 over label 0, by evidence class
    step: np.ndarray  # log weights of transitions
    doc: np.ndarray  # of the logistic regression, the constant last; empty: every score is base
    base: float = 0.0

    def __post_init__(self):
        self.hit = np.zeros(_FILTER, bool)
        self.hit[self.keys & np.uint64(_FILTER - 1)] = True

    def classes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The evidence class of each token (4 * that of the word + the highest of its beginnings), with the rest of _features()."""
        hashes, bounds, starts, ends = _features(column)
        out = np.zeros(len(starts), np.uint8)
        if not len(self.keys):
            return out, bounds, starts, ends
        found = []
        for h in hashes:
            b = np.zeros(len(h), np.uint8)
            at = np.flatnonzero(self.hit[h & np.uint64(_FILTER - 1)])
            where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            same = self.keys[where] == h[at]
            b[at[same]] = self.bins[where[same]]
            found.append(b)
        return found[0] * 4 + np.max(found[1:], axis=0), bounds, starts, ends

    def marginals(self, cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Evidence tokens, and the probability that each is toxic, by forward and backward passes in which runs without evidence are matrix powers."""
        at = np.flatnonzero(cls)
        first = np.searchsorted(at, bounds)
        n = np.diff(first)
        if not len(at):
            return at, np.zeros(0)
        t, e = np.exp(self.step), np.exp(self.emit)
        plain = t * np.array([1.0, e[0]])  # into a token without evidence
        val, vec = np.linalg.eig(plain)
        order = np.argsort(-val.real)
        val, vec = val.real[order], vec.real[:, order]
        inv = np.linalg.inv(vec)
        p1, p2, ratio = np.outer(vec[:, 0], inv[0]), np.outer(vec[:, 1], inv[1]), val[1] / val[0]

        def run(gap: np.ndarray) -> np.ndarray:
            """plain ** gap, but for a factor."""
            return p1 + (np.sign(ratio) ** gap * np.abs(ratio) ** gap)[:, None, None] * p2

        docs = np.argsort(-n, kind="stable")
        active = np.searchsorted(-n[docs], -np.arange(1, int(n.max()) + 1), "right")  # documents with so many evidence tokens
        fore, back = np.zeros((len(at), 2)), np.ones((len(at), 2))
        start = np.array([1.0, 1.0])
        for k, m in enumerate(active):
            i = first[docs[:m]] + k
            own = np.stack([np.ones(m), e[cls[at[i]]]], axis=1)
            if k:
                gap = at[i] - at[i - 1] - 1
                a = np.einsum("ni,nij->nj", fore[i - 1], run(gap)) @ t
            else:
                gap = at[i] - bounds[docs[:m]]
                a = np.where((gap > 0)[:, None], np.einsum("i,nij->nj", start * np.array([1.0, e[0]]), run(np.maximum(gap - 1, 0))) @ t, start)
            a = a * own
            fore[i] = a / a.sum(axis=1, keepdims=True)
        last = at[first[docs[: active[0]] + 1] - 1]
        for k in range(len(active) - 1, -1, -1):
            m = active[k]
            i = first[docs[:m]] + k
            ends_here = n[docs[:m]] == k + 1
            gap = np.where(ends_here, bounds[docs[:m] + 1] - at[i] - 1, np.append(at, 0)[i + 1] - at[i] - 1)
            j = np.minimum(i + 1, len(at) - 1)
            after = np.where(ends_here[:, None], 1.0, (np.stack([np.ones(m), e[cls[at[j]]]], axis=1) * back[j]) @ t.T)
            b = np.einsum("nij,nj->ni", run(gap), after)
            back[i] = b / b.sum(axis=1, keepdims=True)
        both = fore * back
        return at, both[:, 1] / both.sum(axis=1)

    def documents(self, column: pa.Array) -> tuple[np.ndarray, tuple]:
        """Features of each document: log of the expected toxic tokens, the surest, any at all, and their share."""
        cls, bounds, starts, ends = self.classes(column)
        at, p = self.marginals(cls, bounds)
        first = np.searchsorted(at, bounds)
        total = np.concatenate(([0.0], np.cumsum(p)))
        none = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))))
        expected = total[first[1:]] - total[first[:-1]]
        surest = np.maximum.reduceat(np.append(p, 0.0), first[:-1]) * (np.diff(first) > 0) if len(bounds) > 1 else np.zeros(0)
        x = np.stack([np.log1p(np.maximum(expected, 0)), surest, 1 - np.exp(none[first[1:]] - none[first[:-1]]), np.sqrt(np.maximum(expected, 0) / np.maximum(np.diff(bounds), 1))], axis=1)
        return x, (at, p, first, starts, ends)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.doc):
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(x @ self.doc[:-1] + self.doc[-1], -40, 40)))


def _train_chain(docs: list[np.ndarray], toxic: list[bool], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent (Adam) on the penalised likelihood of the documents' labels.

    docs: the classes of each document's tokens. No token is toxic in documents
    that are not, one at least in those that are. Documents are cut into
    segments; the condition holds for all segments of a document together.
    """
    cut = [(i, d[j : j + _SEGMENT]) for i, d in enumerate(docs) for j in range(0, len(d), _SEGMENT)]
    doc = np.array([i for i, _ in cut])
    n, width = len(cut), max(len(c) for _, c in cut)
    lens = np.array([len(c) for _, c in cut])
    obs = np.zeros((n, width), np.int64)
    for k, (_, c) in enumerate(cut):
        obs[k, : len(c)] = c
    real, y = np.arange(width)[None] < lens[:, None], np.array(toxic, bool)[doc]
    pair = real[:, 1:]
    classes = np.arange(16)
    theta = np.concatenate([2.0 * np.maximum(classes // 4, classes % 4) - 5, np.zeros(4)])
    m, v = np.zeros(20), np.zeros(20)
    for r in range(1, rounds + 1):
        emit, t = np.exp(theta[:16]), np.exp(theta[16:].reshape(2, 2))
        own = np.stack([np.ones((n, width)), emit[obs]], axis=2)
        fore, back, scale = np.empty((n, width, 2)), np.ones((n, width, 2)), np.empty((n, width))
        for k in range(width):
            a = (fore[:, k - 1] @ t) * own[:, k] if k else own[:, 0]
            scale[:, k] = a.sum(axis=1)
            fore[:, k] = a / scale[:, k, None]
        for k in range(width - 2, -1, -1):
            b = (own[:, k + 1] * back[:, k + 1]) @ t.T
            b /= b.sum(axis=1, keepdims=True)
            back[:, k] = np.where(pair[:, k][:, None], b, 1.0)
        both = fore * back
        p1 = both[..., 1] / both.sum(axis=2)
        joint = fore[:, :-1, :, None] * t * (own * back)[:, 1:, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        clear = theta[16] * (lens - 1) - np.where(real, np.log(scale), 0).sum(axis=1)  # log chance that no token of a segment is toxic
        none = np.exp(np.minimum(np.bincount(doc, clear, len(docs)), -1e-6))[doc]  # of its document
        some = 1 / (1 - none)
        want = np.where(y[:, None], p1 * some[:, None], 0.0)
        want2 = np.where(y[:, None, None, None], joint * some[:, None, None, None], 0.0)
        want2[..., 0, 0] = np.where(y[:, None], (joint[..., 0, 0] - none[:, None]) * some[:, None], 1.0)
        grad = np.concatenate([np.bincount(obs[real], (want - p1)[real], 16), (want2 - joint)[pair].sum(axis=0).ravel()]) / len(docs) - 0.001 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.25 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return theta[:16], theta[16:].reshape(2, 2)


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant last, not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def _apart(rows: DataFrame) -> DataFrame:
    """rows (id, text, y) with copies and most near copies left out, whose words would count as often as the copies: one for each smallest hash of three words."""

    def signed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds, _, _ = _features(part.column("text"))
                w = window_hashes(hashes[0], 3)
                low = [int(w[a : b - 2].min().view(np.int64)) if b - a > 2 else None for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "text", "y")), pa.array(low, pa.int64())], ["id", "text", "y", "sign"])

    told = rows.select("id", "text", "y").mapInArrow(signed, "id bigint, text string, y int, sign bigint")
    return told.groupBy(F.coalesce("sign", F.xxhash64("text")).alias("sign"), "y").agg(F.min(F.struct("id", "text")).alias("one")).select("one.id", "one.text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled documents; train is a condition on the labels' rows.

    About SAMPLE labelled rows are read, chosen by a hash of their id; nothing
    but texts and labels is learned from. Of copies and near copies (rows of one
    label whose smallest hash of three words is the same) one is learned from.
    The chain is trained on CHAIN_DOCS of them, half of them toxic if there are
    so many, none longer than CHAIN_WORDS. Words and beginnings count from three
    toxic documents on, the FEATURES strongest at most. Rows with a null id or
    label are left out; rows that repeat an id are toxic if any of them is. Where
    a class is missing, every score is the share of toxic rows (0 if there are
    none).
    """
    spark = docs.sparkSession
    known = labels if train is None else labels.where(train)
    known = known.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    count = known.count()
    share = min(1 << 20, int((1 << 20) * SAMPLE / max(count, 1)))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    sample = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # SAMPLE rows, about
    sample = written(_apart(sample), "labelled")
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    none = Model(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(16), np.zeros((2, 2)), np.zeros(0), pos / max(pos + neg, 1))
    if not pos or not neg:
        return none

    def counted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds, _, _ = _features(part.column("text"))
                y = part.column("y").to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                both = np.concatenate([np.unique(np.stack([np.tile(doc, len(hashes)).astype(np.uint64), np.concatenate(hashes)], axis=1)[np.concatenate(hashes) != 0], axis=0)])
                keys, back = np.unique(both[:, 1], return_inverse=True)
                toxic = np.bincount(back, y[both[:, 0].astype(np.int64)], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(keys)) - toxic)], ["key", "p", "n"])

    odds = F.log((F.col("p") + 0.1) / (pos + 0.2)) - F.log((F.col("n") + 0.1) / (neg + 0.2))
    seen = sample.select("text", "y").mapInArrow(counted, "key bigint, p bigint, n bigint").groupBy("key").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p >= 3").select("key", "p", odds.alias("odds")).where(F.col("odds") >= BINS[0])
    seen = seen.orderBy(F.desc(F.col("odds") * F.sqrt("p")), "key").limit(FEATURES).toPandas().sort_values("key")
    keys = seen["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    bins = np.digitize(seen["odds"].to_numpy(), BINS).astype(np.uint8)
    bins = np.where((bins == 3) & (seen["p"].to_numpy() < max(5, pos / 200)), 2, bins).astype(np.uint8)
    model = Model(keys[order], bins[order], np.zeros(16), np.zeros((2, 2)), np.zeros(0))

    def coded(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                cls, bounds, _, _ = model.classes(part.column("text"))
                keep = [i for i, m in enumerate(np.diff(bounds)) if 0 < m <= CHAIN_WORDS]
                yield pa.RecordBatch.from_arrays([part.column("y").take(pa.array(keep, pa.int64())), pa.array([cls[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())], ["y", "cls"])

    # half of the chain's documents are toxic, if there are so many
    codes = sample.orderBy(F.xxhash64("id")).select("text", "y").mapInArrow(coded, "y int, cls binary")
    got = [r for y in (0, 1) for r in codes.where(F.col("y") == y).limit(CHAIN_DOCS // 2).collect()]
    seqs = [np.frombuffer(bytes(r.cls), np.uint8) for r in got]
    if seqs:
        model.emit, model.step = _train_chain(seqs, [bool(r.y) for r in got])

    def aggregated(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x, _ = model.documents(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("text", "y").mapInArrow(aggregated, "y int, x array<double>").toPandas()
    model.doc = _regression(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))
    return model


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score", spans: str | None = None, below: float | None = None) -> DataFrame:
    """The rows of docs with a column of that score, from 0 to 1.

    With spans, a further column holds the toxic words as
    array<struct<start, end>> in code points of the text in lower case. With
    below, only rows of a lower score stay. Null and empty texts get the score
    of a document without evidence. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(score, F.lit(0.0).cast("double"))
    text = fresh(out, "scored_text")
    if spans:
        out = out.withColumn(spans, F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    out = out.withColumn(text, F.col(text_col).cast("string"))

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                x, (at, p, first, starts, ends) = model.documents(part.column(text))
                got = model.scores(x)
                cols = {n: part.column(n) for n in part.schema.names} | {score: pa.array(got)}
                if spans:
                    buf, offs = text_bytes(pc.utf8_lower(pc.fill_null(part.column(text), "")))
                    point = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                    found = []
                    for i, (a, b) in enumerate(zip(first, first[1:])):
                        hit = at[a:b][p[a:b] >= 0.5]
                        found.append([{"start": int(point[starts[k]] - point[offs[i]]), "end": int(point[ends[k]] - point[offs[i]])} for k in hit])
                    cols[spans] = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                rows = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
                yield rows if below is None else rows.filter(pa.array(got < below))

    return out.mapInArrow(run, out.schema).drop(text)


def held_out(id_col: Column, n: int, rest: int) -> Column:
    """Whether CRC-32 of the id as text leaves that remainder; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))
