"""Quality rules: a decision list over text statistics, learned by sequential covering.

Statistics of whole texts are counted in Arrow batches. Training reads those of a
bounded sample of labelled documents. Rules that reject are grown one at a time on
two thirds of what earlier rules leave, condition by condition by information gain,
pruned on the other third, and kept while they are nearly always right on both.
Each is a conjunction of a few thresholds that can be read; the list becomes one
ordered conditional expression, which Spark evaluates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.llm.textops import mix, run_starts, slices, text_bytes, window_hashes, word_hashes, words

SAMPLE = 20_000  # labelled documents that training reads at most, about
WINDOW = 8  # words of a repeated passage
PRECISION = 0.95  # share of rejections that are right, by the lower end of an interval, of a rule that stays
COVER = 3  # rejected documents that a rule has at least
CONDITIONS = 4  # of a rule at most

#: Counts that the rules' statistics come from, and the statistics as shares and means of them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_marks", "n_letter_words", "longest_word")
SHARES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "letter_word_share": ("n_letter_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
STATISTICS = ("n_words", "longest_word", *SHARES)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_SYMBOL = _table("#*$%&|<>")
_DIGIT = _table("0123456789")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _table("!\"'(),-./:;=?@[\\]^_`{}~+")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one document."""
    return mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text of an Arrow column; nulls count as empty."""
    buf, offs = text_bytes(column)
    n = len(offs) - 1
    starts, ends, bounds = words(buf, offs)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(n), n_words)

    def within(marked: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marked)))
        return total[offs[1:]] - total[offs[:-1]]

    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    size = points[ends] - points[starts]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, size)
    letters = np.concatenate(([0], np.cumsum(_LETTER[buf])))

    h = word_hashes(buf, starts, ends)
    distinct = np.unique(_own(h, doc), return_index=True)[1]
    first = run_starts(bounds, WINDOW)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(first):
        _, back, times = np.unique(_own(window_hashes(h, WINDOW)[first], doc[first]), return_inverse=True, return_counts=True)
        again = first[times[back] > 1]
        np.add.at(repeated, again, 1)
        np.add.at(repeated, again + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0

    cuts = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate((offs[:-1], cuts + 1)))
    begin = begin[begin < len(buf)]
    end = np.minimum(np.append(cuts, len(buf))[np.searchsorted(cuts, begin)], offs[np.minimum(np.searchsorted(offs, begin, "right"), n)])
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[full], end[full]
    line_doc = np.searchsorted(offs, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    once = np.unique(_own(word_hashes(buf, begin, end, 1), line_doc), return_index=True)[1]
    return {
        "n_words": n_words,
        "word_chars": np.bincount(doc, size, n).astype(np.int64),
        "n_symbols": within(_SYMBOL[buf]),
        "n_dup_lines": lines - np.bincount(line_doc[once], minlength=n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "n_lines": lines,
        "n_distinct_words": np.bincount(doc[distinct], minlength=n),
        "n_digits": within(_DIGIT[buf]),
        "n_upper": within(_UPPER[buf]),
        "n_marks": within(_MARK[buf]),
        "n_letter_words": np.bincount(doc[letters[ends] > letters[starts]], minlength=n),
        "longest_word": longest,
    }


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Rows (id, COUNTS as long, SHARES as double), one for each row of docs; a share of nothing is 0.

    Null and empty texts have counts of 0; null ids stay; repeated rows are
    reported each. carry names an integer column to keep as "carried"; others
    are not read; an empty table gives no rows.
    """
    kept = [F.col(carry).cast("int").alias("carried")] if carry else []
    names = ["id", *(["carried"] if carry else [])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*names, *COUNTS])

    schema = "id bigint, " + ("carried int, " if carry else "") + ", ".join(f"{c} bigint" for c in COUNTS)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), *kept, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.select("*", *((F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)).alias(s) for s, (a, b) in SHARES.items()))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        own = F.col(self.statistic).cast("double")
        return own > F.lit(self.threshold) if self.above else own <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        own = x[:, STATISTICS.index(self.statistic)]
        return own > self.threshold if self.above else own <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; right and wrong count the training rows that it is the first to cover."""

    conditions: tuple[Condition, ...]
    right: int = 0
    wrong: int = 0

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions)) + f"  ({self.right} right, {self.wrong} wrong)"

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()

    def rule(self) -> Column:
        """Number of the first rule that covers a row of statistics, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for k in reversed(range(len(self.rules))):
            out = F.when(self.rules[k].column(), F.lit(k + 1)).otherwise(out)
        return out

    def keeps(self) -> Column:
        """Whether no rule rejects a row of statistics."""
        return self.rule().isNull()

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "keep otherwise"])


def _sure(right: int, wrong: int) -> float:
    """The lower end of Wilson's interval (one standard error) of a rule's share of right rejections."""
    n = right + wrong
    if not n:
        return 0.0
    p = right / n
    return (p + 1 / (2 * n) - np.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the highest information gain on rows with flags y of what is to be rejected."""
    p0, n0 = int(y.sum()), int((~y).sum())
    before, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for k, name in enumerate(STATISTICS):
        order = np.argsort(x[:, k], kind="stable")
        v, pos = x[order, k], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p = pos[cut]
        below_n = cut + 1 - below_p
        for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def _grown(x: np.ndarray, y: np.ndarray) -> Rule | None:
    conditions: list[Condition] = []
    while len(conditions) < CONDITIONS and y.any() and not y.all():
        _, found = _best(x, y)
        if found is None:
            break
        conditions.append(found)
        inside = found.holds(x)
        x, y = x[inside], y[inside]
    return Rule(tuple(conditions)) if conditions else None


def _pruned(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows that it was not grown on; ties keep fewer conditions."""

    def worth(r: Rule) -> float:
        inside = r.covers(x)
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)), key=worth)


def learned(x: np.ndarray, y: np.ndarray, seed: int = 1) -> DecisionList:
    """A list from rows of STATISTICS and flags of those to be rejected; empty if one of the classes is missing.

    Rows are dealt anew to growing and pruning for every rule. A rule stays if
    _sure() of its share of right rejections is PRECISION at least, over all
    rows that are left; the first that is not, after a second deal, ends the
    list. Each rule that stays covers COVER rejected rows at least, so the list ends.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    failed = 0
    while y.sum() >= COVER and not y.all() and failed < 2:
        grow = rng.random(len(y)) < 2 / 3
        if not y[grow].any():
            break
        rule = _grown(x[grow], y[grow])
        if rule is None:
            break
        rule = _pruned(rule, x[~grow], y[~grow])
        inside = rule.covers(x)
        right, wrong = int(y[inside].sum()), int((~y[inside]).sum())
        if right < COVER or _sure(right, wrong) < min(PRECISION, _sure(right, 0)):
            failed += 1
            continue
        rules.append(Rule(rule.conditions, right, wrong))
        x, y, failed = x[~inside], y[~inside], 0
    return DecisionList(tuple(rules))


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DecisionList:
    """A decision list from labelled documents; train is a condition on the labels' rows.

    About SAMPLE labelled rows are read, chosen by a hash of their id; only
    statistics of texts and labels are learned from, once for each different
    row of them, and those of texts that fail the base rules not at all. Rows with a null id or label are left out; a document is good
    if all labels of its id are above 0. Without labels of both kinds the list is
    empty and rejects nothing.
    """
    known = labels if train is None else labels.where(train)
    known = known.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min((F.col(label_col) > 0).cast("int")).alias("good"))
    share = min(1 << 20, int((1 << 20) * SAMPLE / max(known.count(), 1)))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # SAMPLE ids, about
    got = text_statistics(rows, "id", "text", carry="good").where(~_base_failed()).select("carried", *STATISTICS).distinct().toPandas()
    got = got.sort_values(list(got.columns), kind="stable")  # the same list whatever the order of rows
    return learned(got[list(STATISTICS)].to_numpy(float), got["carried"].to_numpy() == 0)


def with_quality(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, COUNTS, SHARES, base_failed, rule, kept), one for each row of docs.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows
    of WINDOW words. rule is the number of the first rule that rejects, else
    null; kept is false if base_failed or a rule rejects. Cases are as in
    text_statistics().
    """
    rows = text_statistics(docs, id_col, text_col)
    rows = rows.withColumn("base_failed", _base_failed()).withColumn("rule", rules.rule())
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumnRenamed("id", id_col)
