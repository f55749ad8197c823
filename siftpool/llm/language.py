"""Language identification, word first: known words by their log frequency in each language, unseen words by character n-grams.

An unseen word is scored by its longest n-grams that are known: if none of its
5-grams is, by its 4-grams, and so on to single characters. Training counts
words and n-grams of a bounded sample of labelled documents in Spark; the model
is a table of bounded size. Each batch scores its distinct words once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import fresh, mix, run_starts, slices, text_bytes, window_hashes, word_hashes, words

SAMPLE = 30_000  # labelled documents that training reads at most, about
KEEP = {0: 50_000, 1: 2_000, 2: 10_000, 3: 30_000, 4: 40_000, 5: 40_000}  # words, and n-grams by length, kept at most
SMOOTH = 0.1
UNKNOWN = "und"
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_ASCII = re.compile("[A-Za-z]")


def _distinct(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct lower-case words of a batch and their hashes, which of them each word is, and where each text's words begin."""
    buf, offs = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, bounds = words(buf, offs, LETTERS)
    keys, first, back = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    own = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return own, keys, back, bounds


def _grams(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed characters of all words, each between two marks, and where each word begins."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in own).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.append(np.flatnonzero(points == 2), len(points))
    return mix(points.astype(np.uint64)), bounds


@dataclass
class Model:
    langs: list[str]
    keys: dict[int, np.ndarray]  # sorted hashes of words (0) and of n-grams by length
    logs: dict[int, np.ndarray]  # log frequency of each in each language
    prior: np.ndarray

    def _find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_scores(self, own: list[str], keys: np.ndarray) -> np.ndarray:
        """A row for each word: its score in each language."""
        at, known = self._find(0, keys)
        out = np.where(known[:, None], self.logs[0][at] if len(self.keys[0]) else 0.0, 0.0)
        left = np.flatnonzero(~known)
        for n in range(5, 0, -1):
            if not len(left):
                break
            points, bounds = _grams([own[i] for i in left])
            begin = run_starts(bounds, n)
            h = window_hashes(points, n, 1)[begin]
            at, found = self._find(n, h)
            word = np.searchsorted(bounds, begin[found], "right") - 1
            count = np.bincount(word, minlength=len(left))
            have = count > 0
            for k in range(len(self.langs)):
                total = np.bincount(word, self.logs[n][at[found], k], len(left))
                out[left[have], k] = total[have] / count[have]
            left = left[~have]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability among the learned ones; ties go to the first in order."""
        own, keys, back, bounds = _distinct(column)
        scores = self.word_scores(own, keys) if own else np.zeros((0, len(self.langs)))
        total = np.zeros((len(column), len(self.langs)))
        doc = np.repeat(np.arange(len(column)), np.diff(bounds))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, scores[back, k], len(column))
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total).sum(axis=1)
        letters = [t is not None and (_ASCII.search(t) is not None or any(map(str.isalpha, t))) for t in column.to_pylist()]
        return [self.langs[b] if has else UNKNOWN for b, has in zip(best, letters)], np.where(letters, sure, 0.0)


def fit_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from documents of the condition train whose language and text are not null.

    About SAMPLE of them are read, as many of each language if it has so many,
    chosen by a hash of their id and text. Words and n-grams that occur twice at
    least are kept, KEEP at most of each length: those that are most frequent in
    any one language, so that a frequent language can't push out the others.
    Rows that repeat count as often. No rows give a model that tells nothing.
    """
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    totals = known.groupBy("lang").count().collect()  # one row for each language
    langs = sorted(r["lang"] for r in totals)
    count = sum(r["count"] for r in totals)
    prior = np.log(np.array([next(r["count"] for r in totals if r["lang"] == x) for x in langs], float) / max(count, 1))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 20, int((1 << 20) * SAMPLE / len(langs) / r["count"]))) for r in totals], "lang string, share bigint")
    sample = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.col("share")).select("lang", "text")
    n = len(langs)

    def counted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own, keys, back, bounds = _distinct(part.column("text"))
                if not own:
                    continue
                lang = np.array([langs.index(x) for x in part.column("lang").to_pylist()])
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                freq = np.bincount(back * n + lang[doc], minlength=len(own) * n).reshape(-1, n)
                kinds, names, counts = [np.zeros(len(own), np.int32)], [keys], [freq]
                points, at = _grams(own)
                for k in range(1, 6):
                    begin = run_starts(at, k)
                    h = window_hashes(points, k, 1)[begin]
                    word = np.searchsorted(at, begin, "right") - 1
                    grams, where = np.unique(h, return_inverse=True)
                    counts.append(np.stack([np.bincount(where, freq[word, j], len(grams)) for j in range(n)], axis=1).astype(np.int64))
                    kinds.append(np.full(len(grams), k, np.int32))
                    names.append(grams)
                kinds, names, counts = np.concatenate(kinds), np.concatenate(names), np.concatenate(counts)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names.view(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, j])) for j in range(n))], ["kind", "key", *(f"c{j}" for j in range(n))])

    keys = {k: np.zeros(0, np.uint64) for k in KEEP}
    logs = {k: np.zeros((0, n)) for k in KEEP}
    if n:
        cols = [f"c{j}" for j in range(n)]
        seen = sample.mapInArrow(counted, ", ".join(["kind int", "key bigint", *(f"{c} bigint" for c in cols)])).groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in cols))
        total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        seen = seen.withColumn("total", total).where("total > 1").persist()
        sums = {r["kind"]: r for r in seen.groupBy("kind").agg(*(F.sum(c).alias(c) for c in cols)).collect()}
        for k, most in KEEP.items():
            if k not in sums:
                continue
            often = F.array_max(F.array(*(F.col(c) / F.lit(max(sums[k][c], 1)) for c in cols)))
            top = seen.where(F.col("kind") == k).orderBy(F.desc(often), "key").limit(most).toPandas()
            own = top["key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(own)
            c = top[cols].to_numpy(float)[order]
            keys[k] = own[order]
            logs[k] = np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * max(len(c), 1)))
        seen.unpersist()
    return Model(langs, keys, logs, prior)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of docs with the predicted language and its probability.

    Null texts and texts without a letter get "und" and 0, as do all texts where
    no language was learned. Other columns stay; an empty table gives no rows.
    """
    text = fresh(docs, "told_text")
    out = docs.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0).cast("double")).withColumn(text, F.col(text_col).cast("string"))
    if not model.langs:
        return out.withColumn(lang, F.lit(UNKNOWN)).drop(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                told, sure = sent.value.predict(part.column(text))
                cols = {n: part.column(n) for n in part.schema.names} | {lang: pa.array(told, pa.string()), score: pa.array(sure)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return out.mapInArrow(run, out.schema).drop(text)
