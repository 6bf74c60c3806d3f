"""Quality rules as weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Every rule is a JVM expression over counts of the whole text. The corpus enters the fit as a histogram of vote patterns,
at most 3 ** len(RULES) rows whatever its size, summed before the shuffle; the fit itself is arithmetic on that
histogram. How each rule votes in good and in bad texts (hence its accuracy) and the share of good texts are estimated
together; a text's posterior log odds are then a sum over its votes, so the verdict is again a JVM expression and filtering needs no shuffle. A fixed floor (too short, or mostly repeats) fails a text whatever the vote.

Defined results: a null text counts as empty and fails; rows are judged one by one, so repeated rows get equal verdicts
and null ids need no rule; an empty table gives an empty result; other columns pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import let, text_of, word_array
from tidemark.llm.session import materialize

GRAM = 5
#: Rounds of expectation-maximisation, and the change of the good share at which it ends.
ROUNDS, SETTLED = 500, 1e-9
#: Shares of (bad, abstain, good) votes that a rule starts from, in bad and in good texts.
START = ((0.35, 0.35, 0.30), (0.02, 0.28, 0.70))
#: Texts that each starting share counts as, relative to all texts: keeps estimates off zero and classes from trading places.
PRIOR = 0.01
#: Posterior probability from which a text is kept.
THRESHOLD = 0.5


def _repeated(words: Column) -> Column:
    """Words inside GRAM-word windows that occur twice or more in the text, each word once."""
    last = F.size(words) - GRAM

    def count(grams: Column) -> Column:
        def spread(ordered: Column) -> Column:
            same = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["g"] == x["g"]) | (F.get(ordered, k + 1)["g"] == x["g"]))
            starts = F.array_sort(F.transform(same, lambda x: x["k"]))
            step = lambda a, s: F.struct(s.alias("at"), (a["n"] + F.least(F.lit(GRAM), s - a["at"])).alias("n"))
            return F.aggregate(starts, F.struct(F.lit(-GRAM).alias("at"), F.lit(0).alias("n")), step, lambda a: a["n"])

        ordered = F.array_sort(F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, spread))

    hashed = lambda h: F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(*(F.get(h, k + j) for j in range(GRAM))))
    return F.when(last < 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), count)))


def measures(text: Column) -> Column:
    """Struct of counts over a whole text."""

    def inner(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _repeated(w),
            "n_lines": F.size(lines),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "n_wordy": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
            "n_marks": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")),
            "n_stutters": F.size(F.filter(w, lambda x, k: x == F.get(w, k - 1))),
            "n_stops": F.regexp_count(t, F.lit(r"[.?!:;](?:[\x20\x09-\x0D]|$)")),
        }
        return F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))

    return let(text, lambda t: let(word_array(t), lambda w: inner(t, w)))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


#: Name: vote from the measures. A vote is 1 (good), -1 (bad) or 0 (abstain).
RULES = {
    "length": lambda m: _vote(m["n_words"] >= 30, m["n_words"] < 10),
    "word_length": lambda m: _vote(m["word_chars"].between(m["n_words"] * 2.5, m["n_words"] * 10), ~m["word_chars"].between(m["n_words"] * 2, m["n_words"] * 14)),
    "symbols": lambda m: _vote(m["n_symbols"] * 100 <= m["n_words"], m["n_symbols"] * 10 > m["n_words"]),
    "lines": lambda m: _vote((m["n_dup_lines"] == 0) & (m["n_lines"] >= 3), m["n_dup_lines"] * 100 > m["n_lines"] * 30),
    "repeats": lambda m: _vote(m["n_repeat_words"] * 20 <= m["n_words"], m["n_repeat_words"] * 5 > m["n_words"]),
    "letters": lambda m: _vote(m["n_wordy"] * 10 >= m["n_words"] * 9, m["n_wordy"] * 10 < m["n_words"] * 7),
    "capitals": lambda m: _vote(m["n_upper"] * 5 <= m["word_chars"], m["n_upper"] * 2 > m["word_chars"]),
    "marks": lambda m: _vote(m["n_marks"] * 12 <= m["word_chars"], m["n_marks"] * 8 > m["word_chars"]),
    "stutters": lambda m: _vote(m["n_stutters"] * 20 <= m["n_words"], m["n_stutters"] * 4 > m["n_words"]),
    "stops": lambda m: _vote((m["n_stops"] >= 1) & (m["n_stops"] * 3 <= m["n_words"]), (m["n_stops"] * 2 > m["n_words"]) & (m["n_words"] >= 10)),
}


def votes(m: Column) -> Column:
    return F.array(*(rule(m) for rule in RULES.values()))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


@dataclass(frozen=True)
class Weights:
    """Posterior log odds of good: bias plus, for each rule, what its vote (-1, 0, 1) adds."""

    bias: float
    adds: tuple[tuple[float, float, float], ...]
    good_share: float
    accuracies: tuple[float, ...]
    settled: bool = True

    def posterior(self, v: Column) -> Column:
        odds = F.lit(self.bias)
        for k, (bad, none, good) in enumerate(self.adds):
            vote = F.get(v, F.lit(k))
            odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def _adds(shares: list[list[list[float]]]) -> list[tuple[float, float, float]]:
    """Log likelihood ratios; a good vote never speaks against a text, a bad one never for it."""
    out = []
    for bad, good in shares:
        low, none, high = (math.log(g / b) for b, g in zip(bad, good, strict=True))
        out.append((min(low, 0.0), none, max(high, 0.0)))
    return out


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> Weights:
    """Expectation-maximisation over (votes, count) rows, from START.

    The share of good texts is held within [0.01, 0.99]. Ends when it changes by less than SETTLED, else after ROUNDS rounds,
    which ``settled`` tells and a warning says.
    """
    share, total, settled = 0.8, sum(n for _, n in patterns), False
    shares = [[list(START[0]), list(START[1])] for _ in RULES]
    for _ in range(ROUNDS if total else 0):
        adds, old = _adds(shares), share
        found = [[[PRIOR * total * x for x in START[c]] for c in (0, 1)] for _ in RULES]
        good, bias = 0.0, math.log(share / (1 - share))
        for vote, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + sum(a[v + 1] for a, v in zip(adds, vote, strict=True))))))
            good += n * p
            for rule, v in zip(found, vote, strict=True):
                rule[1][v + 1] += n * p
                rule[0][v + 1] += n * (1 - p)
        shares = [[[x / sum(c) for x in c] for c in rule] for rule in found]
        share = min(0.99, max(0.01, good / total))
        settled = abs(share - old) < SETTLED
        if settled:
            break
    if total and not settled:
        warnings.warn(f"expectation-maximisation has not settled in {ROUNDS} rounds", stacklevel=2)
    right = tuple((share * g[2] + (1 - share) * b[0]) / (share * (g[0] + g[2]) + (1 - share) * (b[0] + b[2])) for b, g in shares)
    return Weights(math.log(share / (1 - share)), tuple(_adds(shares)), share, right, settled or not total)


def fit(voted: DataFrame) -> Weights:
    """Weights from all rows' ``votes``."""
    rows = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate(sorted((tuple(r["votes"]), r["n"]) for r in rows))


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, base_failed, posterior, kept) of each row."""
    m = measures(text_of())
    rows = materialize(docs.select(F.col("doc_id").cast("long"), let(m, lambda x: F.struct(x.alias("m"), votes(x).alias("votes"))).alias("r")).select("doc_id", "r.m", "r.votes"))
    weights = fit(rows)
    judged = rows.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), weights.posterior(F.col("votes")).alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Texts are measured once: rows are written to the checkpoint folder with their votes, and read back for the verdict.
    """
    # the row goes as one column, so that no column of docs can clash with ours
    judged = let(measures(text_of()), lambda x: F.struct(votes(x).alias("votes"), base_failed(x).alias("failed")))
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), judged.alias("seen")).select("row", "seen.*"))
    weights = fit(rows)
    return rows.where(~F.col("failed") & (weights.posterior(F.col("votes")) >= THRESHOLD)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts and verdict of all documents."""
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"))
