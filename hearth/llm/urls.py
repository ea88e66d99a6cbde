"""URL filtering by host rules and mined association rules.

Fixed host rules decide what they cover. Their verdicts are labels: FP-growth
(``pyspark.ml.fpm``) mines the token combinations that go with *allow* or
*block*, rules below the least support or confidence, or with more than
``MAX_TOKENS`` tokens, are pruned, and the rest judges every URL that no host
rule covers. A mined rule is found through an inverted index: it is listed
under its rarest token, and only rules listed under one of a URL's tokens are
tested. The rule with the highest confidence, then the higher support, then
*block*, decides; a URL that none fits is allowed.

Scale: mining is a distributed FP-growth over all labelled URLs. With a least
support as a share of them, the number of frequent combinations doesn't grow
with their number, so the index that tasks receive is bounded by
``MAX_RULES``; mining raises an error beyond it. Judging is one pass without a
shuffle.

Defined cases: a null URL and one without ``://`` have an empty host and path
and no tokens, so no rule fits and they are allowed. Repeated URLs each count.
Without labelled URLs there are no mined rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hearth.llm.common import staged

ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS, MAX_RULES = 0.02, 0.95, 3, 100_000

#: The given host rules (fixed values): verdict, host, path.
HOST_RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DECISION = StructType([StructField("verdict", StringType()), StructField("confidence", DoubleType()),
                        StructField("tokens", StringType())])


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(_raw_host(url), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(_rest(url), F.length(_raw_host(url)) + 1, F.length(url))
    return F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: ``h:`` host labels and ``p:`` path segments, with every
    run of digits as ``#``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda x: F.length(x) > 2))


def judged_by_host(pages: DataFrame, rules=HOST_RULES) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule, verdict (null if open) and tokens."""
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                        tokens_of(F.col("host"), F.col("path")).alias("tokens"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules ``(tokens, verdict, confidence, support)`` from ``labelled(tokens, verdict)``."""
    label = F.concat(F.lit("="), F.col("verdict"))
    baskets = labelled.select(F.array_append(F.col("tokens"), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    to = F.col("consequent")[0]
    return (model.associationRules
            .where(to.isin("=" + ALLOW, "=" + BLOCK) & (F.size("antecedent") <= max_tokens)
                   & ~F.exists("antecedent", lambda x: x.startswith("=")))
            .select(F.array_sort("antecedent").alias("tokens"), F.substring(to, 2, 9).alias("verdict"),
                    "confidence", "support"))


@dataclass(frozen=True)
class UrlRules:
    """Mined rules by their rarest token, best first."""

    index: dict[str, list[tuple[tuple[str, ...], str, float]]]

    @classmethod
    def build(cls, rules: DataFrame, max_rules: int = MAX_RULES) -> UrlRules:
        found = rules.limit(max_rules + 1).collect()
        if len(found) > max_rules:
            raise ValueError(f"more than {max_rules} rules: raise the least support or confidence")
        uses: dict[str, int] = {}
        for r in found:
            for t in r["tokens"]:
                uses[t] = uses.get(t, 0) + 1
        index: dict[str, list] = {}
        # rank: confidence, support, block before allow, then the tokens
        order = sorted(found, key=lambda r: (-round(r["confidence"], 9), -round(r["support"], 9),
                                             r["verdict"] != BLOCK, list(r["tokens"])))
        for rank, r in enumerate(order):
            rare = min(r["tokens"], key=lambda t: (uses[t], t))
            index.setdefault(rare, []).append((rank, tuple(r["tokens"]), r["verdict"], r["confidence"]))
        return cls(index)

    def decide(self, tokens: list[str]) -> tuple[str | None, float | None, str | None]:
        own = set(tokens)
        fits = [r for t in own for r in self.index.get(t, ()) if own.issuperset(r[1])]
        if not fits:
            return None, None, None
        best = min(fits)
        return best[2], best[3], " ".join(best[1])

    def decision(self, tokens: Column) -> Column:
        @F.pandas_udf(_DECISION)
        def decide(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.decide(list(t)) for t in column], columns=_DECISION.names)

        return decide(tokens)


def filter_urls(pages: DataFrame, rules=HOST_RULES) -> DataFrame:
    """Judge every row of ``pages(page_id, url)``: ``page_id``, ``host``, ``path``, ``rule``,
    ``verdict``, and for mined verdicts ``mined_rule`` (its tokens) and ``confidence``."""
    known = staged(judged_by_host(pages, rules), "urls")
    labelled = known.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    mined = UrlRules.build(mine(labelled)) if not labelled.isEmpty() else UrlRules({})
    open_tokens = F.when(F.col("verdict").isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>"))
    out = known.withColumn("_d", mined.decision(open_tokens))
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("verdict", F.col("_d.verdict"), F.lit(ALLOW)).alias("verdict"),
                      F.col("_d.tokens").alias("mined_rule"), F.col("_d.confidence").alias("confidence"))
