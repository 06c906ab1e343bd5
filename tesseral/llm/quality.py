"""Quality by weak supervision.

Rules vote for a text, against it, or abstain. Documents are counted by their pattern of votes (at most
3 to the number of rules), and expectation-maximisation over those counts estimates, without labels, how common
good documents are and how often each rule votes each way on good and on bad ones. A document's posterior
probability of being good replaces the demand that it pass every rule: votes for outweigh a vote against by a rule
that proves weak, and one vote by a rule that proves sharp can be enough.

Priors are worth a share (STRENGTH) of the corpus, whatever its size, so rules that see no bad document keep the prior's
chances, and a corpus without bad documents loses none.

Counts are over the whole corpus; only the table of patterns goes to the driver. Null texts have no words
and fail the base rules. Ids may be null or repeated: one row out per row in. An empty table gives an
empty result. Columns named like a result's are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint, enter, ship

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "repeats", "lines", "word_length", "shouting", "plain_words", "vocabulary", "sentences")
STRENGTH = 0.05
#: Before any document is seen: share of good and bad; by class, chances of a vote against, of none, of a vote for.
SHARE, CHANCES = np.array([0.9, 0.1]), np.array([[0.05, 0.2, 0.75], [0.5, 0.2, 0.3]])
LONG = 50_000
WINDOW = 2000
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_ended: int
    n_shouted: int
    distinct: float
    plain: float


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n <= LONG:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == n - 2:
            return 0
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        hit = np.fromiter((w in twice for w in windows), bool, n - 2)
    else:
        ids: dict[bytes, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, pair = np.unique(x[:-2] << 32 | x[1:-1], return_inverse=True)
        _, window, count = np.unique(pair << 32 | x[2:], return_inverse=True, return_counts=True)
        hit = count[window] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def distinct_share(words: list[bytes]) -> float:
    """Share of distinct words, the mean over windows of WINDOW words that follow each other (the last one ends with the text)."""
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / n if n else 0.0
    starts = [*range(0, n - WINDOW, WINDOW), n - WINDOW]
    return sum(len(set(words[k : k + WINDOW])) for k in starts) / (WINDOW * len(starts))


def plain_share(text: str) -> float:
    """Share of words that are letters with punctuation around them."""
    words = text.split()
    return sum(w.isalpha() or w.strip(_AROUND).isalpha() for w in words) / len(words) if words else 0.0


def measures(text: str) -> Measures:
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return Measures(
        n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines),
        sum(x.rstrip()[-1:] in _ENDS for x in lines), sum(len(w) > 1 and w.isupper() for w in words), distinct_share(words), plain_share(text),
    )


_AROUND = ".,;:!?()[]{}\"'"
_ENDS = set(".!?:;\"'”’»。！？…)")


def votes(m: Measures) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains; in the order of RULES."""
    n = m.n_words

    def judge(x: float, good: float, bad: float) -> int:
        return 1 if x <= good else -1 if x > bad else 0

    if not n:
        return (0,) * len(RULES)
    mean, ended = m.word_chars / n, m.n_ended / m.n_lines
    return (
        judge(m.n_symbols / n, 0.02, 0.1),
        judge(m.n_repeat_words / n, 0.05, 0.3),
        judge(m.n_dup_lines / m.n_lines, 0.1, 0.34) if m.n_lines > 3 else 0,
        1 if 3.5 <= mean <= 6.5 else -1 if mean < 2.5 or mean > 12 else 0,
        judge(m.n_shouted / n, 0.05, 0.3),
        1 if m.plain >= 0.9 else -1 if m.plain < 0.7 else 0,
        (1 if m.distinct >= 0.4 else -1 if m.distinct < 0.1 else 0) if n >= 20 else 0,
        1 if ended >= 0.8 else -1 if ended < 0.1 and m.n_lines > 3 else 0,
    )


def _pattern(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x + 1
    return out


def all_patterns() -> np.ndarray:
    """Votes by pattern number."""
    return np.array(list(itertools.product((-1, 0, 1), repeat=len(RULES))), np.int8)


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


class Fit(NamedTuple):
    """p_good by pattern number; shares of good and bad; chances[class, vote + 1, rule], classes good and bad."""

    p_good: np.ndarray
    share: np.ndarray
    chances: np.ndarray

    def accuracies(self) -> np.ndarray:
        """(2, rules): how often a rule that votes is right, about good and about bad documents."""
        right = np.stack([self.chances[0, 2], self.chances[1, 0]])
        return right / (self.chances[:, 0] + self.chances[:, 2])


def fit(counts: np.ndarray, rounds: int = 500, strength: float = STRENGTH) -> Fit:
    """Expectation-maximisation from counts by pattern, begun with all documents good that no rule votes against."""
    v = all_patterns()
    cast = np.stack([v == k for k in (-1, 0, 1)]).astype(float)
    weight = strength * max(counts.sum(), 1)
    p = np.where((v < 0).any(1), 0.2, 0.95)
    for _ in range(rounds):
        held = np.stack([p, 1 - p]) * counts
        size = held.sum(1)
        share = (size + weight * SHARE) / (size.sum() + weight)
        chances = (np.einsum("kp,vpr->kvr", held, cast) + weight * CHANCES[:, :, None]) / (size + weight)[:, None, None]
        score = np.log(share)[:, None] + np.einsum("vpr,kvr->kp", cast, np.log(chances))
        before, p = p, 1 / (1 + np.exp(score[1] - score[0]))
        if np.abs(p - before).max() < 1e-9:
            break
    return Fit(p, share, chances)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("quality")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"]
    for b in batches:
        rows = []
        for x in b.column(1):
            m = measures(x.as_py() or "")
            rows.append((*m[:5], _pattern(votes(m))))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.int32())], names)


def fitted(patterns: DataFrame) -> Fit:
    """The fit to a DataFrame with the column ``pattern``."""
    counts = np.zeros(3 ** len(RULES))
    for k, n in patterns.groupBy("pattern").count().collect():  # at most 3 to the number of rules
        counts[k] = n
    return fit(counts)


def fitted_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(rule, accuracy_good, accuracy_bad, for_good, against_good, for_bad, against_bad): what the fit says of each rule."""
    f = fitted(docs.select(_pattern_of(docs.sparkSession)(docs[text_col].cast("string")).alias("pattern")))
    rows = [(rule, *(float(x) for x in (*f.accuracies()[:, k], f.chances[0, 2, k], f.chances[0, 0, k], f.chances[1, 2, k], f.chances[1, 0, k]))) for k, rule in enumerate(RULES)]
    return docs.sparkSession.createDataFrame(rows, "rule string, accuracy_good double, accuracy_bad double, for_good double, against_good double, for_bad double, against_bad double")


def _pattern_of(spark):
    ship(spark)

    @F.arrow_udf("int")
    def pattern(texts: pa.Array) -> pa.Array:
        enter("quality")
        return pa.array([_pattern(votes(measures(x.as_py() or ""))) for x in texts], pa.int32())

    return pattern


def _look_up(spark, values: list[float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), "pattern int, p_good double"))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the five measures, base_failed, kept, p_good (posterior probability of good)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = checkpoint(rows.mapInArrow(_features, FEATURES))
    out = rows.join(_look_up(spark, fitted(rows).p_good.tolist()), "pattern").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good")


def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_scores would keep, with their own columns; texts are not shuffled."""
    f = fitted(docs.select(_pattern_of(docs.sparkSession)(docs[text_col].cast("string")).alias("pattern")))
    good = f.p_good >= threshold

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        enter("quality")
        out = []
        for x in texts:
            m = measures(x.as_py() or "")
            out.append(not base_failed(m.n_words, m.n_repeat_words) and bool(good[_pattern(votes(m))]))
        return pa.array(out, pa.bool_())

    return docs.where(kept(docs[text_col].cast("string")))
