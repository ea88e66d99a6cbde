"""Quality rules by weak supervision.

Every rule looks at one number of a text and votes *bad*, *good* or abstains.
A latent good/bad class is fitted to all votes by expectation maximisation:
for every rule the chance of a bad vote on bad and on good documents, and the
share of good documents. A document's posterior chance of being good then
replaces an all-rules-must-pass filter.

Scale: statistics are one pass over the texts without a shuffle. Votes are
counted per vote pattern (at most ``3 ** len(RULES)`` patterns, whatever the
input), so EM runs on a table of proven size on the driver.

Defined cases: a null or empty text has no words; its numbers are 0, every
rule abstains and ``base_failed`` holds. Repeated rows are judged each. An
empty table gives an empty result and a model of the starting values.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hearth.llm.common import SPACES, staged

BAD, GOOD, ABSTAIN = 0, 1, 2

#: Numbers of a text, in the order :func:`text_stats` gives them.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_exclaims", "n_ascii_other", "n_sentence_ends")
STATS_SCHEMA = StructType([StructField(c, LongType(), False) for c in STATS])

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ENDED = re.compile(r"[.!?](?=[\x20\x09-\x0D]|$)")


@dataclass(frozen=True)
class Rule:
    """``num / den`` at ``good`` or beyond it (away from ``bad``) votes good, at
    ``bad`` or beyond it votes bad, and abstains between or when ``den`` is 0."""

    name: str
    num: tuple[str, ...]
    den: tuple[str, ...]
    good: float
    bad: float


#: The production rules. Each defect is seen by at least two of them, so that
#: agreement between rules carries the evidence.
RULES = (
    Rule("symbols_per_word", ("n_symbols",), ("n_words",), 0.02, 0.1),
    Rule("other_marks_share", ("n_ascii_other",), ("word_chars",), 0.06, 0.08),
    Rule("exclaims_per_word", ("n_exclaims",), ("n_words",), 0.05, 0.3),
    Rule("upper_case_share", ("n_upper",), ("n_upper", "n_lower"), 0.2, 0.5),
    Rule("repeated_words_share", ("n_repeat_words",), ("n_words",), 0.25, 0.4),
    Rule("duplicate_lines_share", ("n_dup_lines",), ("n_lines",), 0.2, 0.4),
    Rule("distinct_words_share", ("n_distinct_words",), ("n_words",), 0.2, 0.1),
    Rule("sentence_ends_per_word", ("n_sentence_ends",), ("n_words",), 0.02, 0.01),
)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of :data:`STATS` for one whole text.

    Words are runs of characters other than ASCII white space. ``n_repeat_words``
    counts words inside 3-word windows that occur twice or more in the text.
    """
    if not text:
        return (0,) * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = sum(map(text.count, SPACES))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n)
    repeated = 0
    if n >= 4:
        size = np.uint64(len(known))
        if len(known) < 1 << 21:
            windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # three ids no longer fit in 64 bits: number the pairs first
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.uint64)
            windows = pairs[:-1] * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        at = np.concatenate([order[1:][same], order[:-1][same]])
        hit = np.zeros(n, bool)
        hit[at] = hit[at + 1] = hit[at + 2] = True
        repeated = int(hit.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    ascii_words = len(data.translate(None, bytes(range(128, 256)))) - spaces
    digits = len(data) - len(data.translate(None, b"0123456789"))
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(lines), len(known), upper, lower, text.count("!"), ascii_words - upper - lower - digits,
            len(_ENDED.findall(text)))


@F.pandas_udf(STATS_SCHEMA)
def stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in text], columns=list(STATS))


def _total(names: tuple[str, ...], stats: Column) -> Column:
    out = stats[names[0]]
    for n in names[1:]:
        out = out + stats[n]
    return out.cast("double")


def vote(rule: Rule, stats: Column) -> Column:
    den = _total(rule.den, stats)
    x = _total(rule.num, stats) / F.nullif(den, F.lit(0.0))
    low = rule.good < rule.bad
    bad = x >= rule.bad if low else x <= rule.bad
    good = x <= rule.good if low else x >= rule.good
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def pattern_of(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All votes as one number in base 3, the first rule lowest."""
    out = F.lit(0)
    for j, r in enumerate(rules):
        out = out + vote(r, stats) * (3 ** j)
    return out


@dataclass(frozen=True)
class QualityModel:
    """What EM estimated: the share of good documents and, per rule, the chance that
    a vote of it is *bad* on a bad and on a good document."""

    rules: tuple[Rule, ...]
    good_share: float
    bad_if_bad: tuple[float, ...]
    bad_if_good: tuple[float, ...]
    min_posterior: float = 0.5

    def log_odds(self, pattern: int) -> float:
        """Log odds of good over bad for one vote pattern."""
        z = math.log(self.good_share / (1 - self.good_share))
        for j in range(len(self.rules)):
            v = pattern // 3 ** j % 3
            if v == BAD:
                z += math.log(self.bad_if_good[j] / self.bad_if_bad[j])
            elif v == GOOD:
                z += math.log((1 - self.bad_if_good[j]) / (1 - self.bad_if_bad[j]))
        return z

    def posterior(self, pattern: Column) -> Column:
        """The chance of being good, as built-in arithmetic on the vote pattern."""
        z = F.lit(math.log(self.good_share / (1 - self.good_share)))
        for j in range(len(self.rules)):
            v = F.floor(pattern / (3 ** j)) % 3
            z = z + (F.when(v == BAD, math.log(self.bad_if_good[j] / self.bad_if_bad[j]))
                     .when(v == GOOD, math.log((1 - self.bad_if_good[j]) / (1 - self.bad_if_bad[j])))
                     .otherwise(0.0))
        return 1 / (1 + F.exp(-z))


#: EM's start and bounds (production parameters).
ITERATIONS = 20
START_GOOD, START_BAD_IF_BAD, START_BAD_IF_GOOD = 0.9, 0.4, 0.005
MAX_FALSE_ALARM, LEAST = 0.01, 0.001
PRIOR_VOTES = 2.0


def expectation_maximisation(patterns: dict[int, int], rules: tuple[Rule, ...] = RULES,
                             iterations: int = ITERATIONS) -> QualityModel:
    """Fit the two-class vote model to counted patterns.

    A rule is built to be silent on good text, so its false-alarm chance stays
    within ``MAX_FALSE_ALARM``; ``PRIOR_VOTES`` pseudo-votes keep a rule that
    never fires at its start.
    """
    keys = sorted(patterns)
    votes = np.array([[k // 3 ** j % 3 for j in range(len(rules))] for k in keys], int).reshape(-1, len(rules))
    n = np.array([patterns[k] for k in keys], float)
    good, a, b = START_GOOD, np.full(len(rules), START_BAD_IF_BAD), np.full(len(rules), START_BAD_IF_GOOD)
    for _ in range(iterations if len(keys) else 0):
        z = np.full(len(keys), math.log(good / (1 - good)))
        z += np.where(votes == BAD, np.log(b / a), np.where(votes == GOOD, np.log((1 - b) / (1 - a)), 0.0)).sum(1)
        p = 1 / (1 + np.exp(-z))
        wg, wb = (n * p)[:, None], (n * (1 - p))[:, None]
        voted = votes != ABSTAIN
        a = ((wb * (votes == BAD)).sum(0) + PRIOR_VOTES * START_BAD_IF_BAD) / ((wb * voted).sum(0) + PRIOR_VOTES)
        b = ((wg * (votes == BAD)).sum(0) + PRIOR_VOTES * START_BAD_IF_GOOD) / ((wg * voted).sum(0) + PRIOR_VOTES)
        a, b = np.clip(a, 2 * MAX_FALSE_ALARM, 1 - LEAST), np.clip(b, LEAST, MAX_FALSE_ALARM)
        good = float(np.clip((n * p).sum() / n.sum(), LEAST, 1 - LEAST))
    return QualityModel(rules, good, tuple(map(float, a)), tuple(map(float, b)))


def with_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``_stats`` and the vote pattern ``_votes`` added."""
    return docs.withColumn("_stats", stats_of(F.col(text))).withColumn("_votes", pattern_of(F.col("_stats")))


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES) -> QualityModel:
    """Count the vote patterns of all rows of ``votes(_votes)`` and run EM on them."""
    rows = votes.groupBy("_votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules)
    return expectation_maximisation({r[0]: r[1] for r in rows}, rules)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(docs: DataFrame) -> DataFrame:
    """Judge every row of ``docs(doc_id, text)``: ``doc_id``, all :data:`STATS`,
    ``base_failed``, ``posterior`` (of being good) and ``kept``."""
    stats = staged(with_votes(docs.select("doc_id", "text")).drop("text"), "quality")
    model = fit(stats)
    s = F.col("_stats")
    out = stats.select("doc_id", *[s[c].alias(c) for c in STATS], base_failed(s).alias("base_failed"),
                       model.posterior(F.col("_votes")).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= model.min_posterior))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    model = fit(with_votes(docs.select("text")))
    stats = stats_of(F.col("text"))
    judged = docs.select(F.struct(*docs.columns).alias("_row"), stats.alias("_stats"))
    kept = ~base_failed(F.col("_stats")) & (
        model.posterior(pattern_of(F.col("_stats"))) >= model.min_posterior)
    return judged.where(kept).select("_row.*")
