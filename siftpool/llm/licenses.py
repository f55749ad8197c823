"""License scans: gated signature rules over whole texts, with overlapping detections resolved."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.llm.license_rules import Rule, rules
from siftpool.llm.textops import ALNUM, LOWER, slices, text_bytes, word_hashes, words

#: Phrases whose places are always reported, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_FILTER = 1 << 16


def _hash(terms: list[str]) -> np.ndarray:
    buf, offs = text_bytes(pa.array(terms, pa.string()))
    return word_hashes(buf, offs[:-1], offs[1:])


class Scanner:
    """Rules, their keywords by hash, and the base phrases."""

    def __init__(self):
        self.rules: list[Rule] = rules()
        terms = sorted({w for r in self.rules for group in r.gate for w in group})
        keys = _hash(terms)
        order = np.argsort(keys)
        self.keys, self.terms = keys[order], [terms[i] for i in order]
        self.hit = np.zeros(_FILTER, bool)
        self.hit[self.keys & np.uint64(_FILTER - 1)] = True
        self.base = [(label, _hash(phrase.split())) for phrase, label in BASE.items()]

    def places(self, h: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Word numbers where each base phrase begins inside one text."""
        out = {}
        for label, phrase in self.base:
            at = np.flatnonzero(h[: max(0, len(h) - len(phrase) + 1)] == phrase[0])
            for j, p in enumerate(phrase):
                at = at[h[at + j] == p]
            row = np.searchsorted(bounds, at, "right") - 1
            out[label] = at[at + len(phrase) <= bounds[row + 1]] if len(at) else at
        return out

    def present(self, h: np.ndarray, bounds: np.ndarray) -> dict[int, set[str]]:
        """The keywords of each text that has any."""
        at = np.flatnonzero(self.hit[h & np.uint64(_FILTER - 1)])
        where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[where] == h[at]
        row = np.searchsorted(bounds, at[same], "right") - 1
        out: dict[int, set[str]] = {}
        for r, w in np.unique(np.stack([row, where[same]], axis=1), axis=0).tolist():
            out.setdefault(r, set()).add(self.terms[w])
        return out

    def detections(self, own: list[str], keywords: set[str]) -> list[tuple[int, int, Rule]]:
        """(first word, end, rule) of what stays: by priority, then length, then place; what lies inside a detection that stays is suppressed."""
        gated = [r for r in self.rules if all(any(w in keywords for w in group) for group in r.gate)]
        if not gated:
            return []
        text = " ".join(own)
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in own])))
        found = []
        for rank, r in enumerate(gated):
            for m in r.pattern.finditer(text):
                a, b = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)
                found.append((r.priority, a - b, a, rank, b, r))
        kept: list[tuple[int, int, Rule]] = []
        ends: list[int] = []  # the furthest end of kept detections by place, to test containment
        begins: list[int] = []
        for _, _, a, _, b, r in sorted(found, key=lambda x: x[:4]):
            i = bisect_right(begins, a)
            if i and ends[i - 1] >= b:
                continue
            kept.append((a, b, r))
            begins.insert(i, a)
            ends.insert(i, max(b, ends[i - 1] if i else b))
            for j in range(i + 1, len(ends)):
                if ends[j] >= ends[i]:
                    break
                ends[j] = ends[i]
        return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one for each row of docs.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    n_base counts all places of the base phrases, first_word and last_word are
    the smallest and largest of them (null without any). labels joins the base
    labels and those of the rules' detections; score is the chance that any of
    them is right. detections holds the rules' intervals of words. Null texts
    count as empty; null ids stay; repeated rows are reported each; other
    columns are not read; an empty table gives no rows.
    """
    schema = "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<start:bigint,end:bigint,label:string>>"

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_bytes(part.column("text"))
                buf = LOWER[buf]
                starts, ends, bounds = words(buf, offs, ALNUM)
                h = word_hashes(buf, starts, ends)
                n = part.num_rows
                count, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, at in scanner.places(h, bounds).items():
                    row = np.searchsorted(bounds, at, "right") - 1
                    for r, a in zip(row.tolist(), (at - bounds[row]).tolist()):
                        count[r] += 1
                        first[r] = a if first[r] < 0 else min(first[r], a)
                        last[r] = max(last[r], a)
                        base[r].add(label)
                labels, score, detected = [set(x) for x in base], np.zeros(n), [[] for _ in range(n)]
                for r, keywords in scanner.present(h, bounds).items():
                    own = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[bounds[r] : bounds[r + 1]], ends[bounds[r] : bounds[r + 1]])]
                    miss = 1.0
                    for a, b, rule in scanner.detections(own, keywords):
                        labels[r].add(rule.label)
                        miss *= 1 - rule.sure
                        detected[r].append({"start": a, "end": b, "label": rule.label})
                    score[r] = 1 - miss
                score = np.maximum(score, np.where(count > 0, 0.9, 0))
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(count), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score), pa.array(detected, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows
