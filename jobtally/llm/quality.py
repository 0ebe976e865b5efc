"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Only DataFrame functions run on the executors. What meets on the driver is how
often each pattern of votes occurs: at most three to the number of rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .batches import free_name

WORD_BREAK = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, -1, 0
FALSE_CALLS = 0.002  # share of good documents that a rule written with care calls bad
RIGHT_CALLS = 0.3  # share of bad documents that a rule is thought to call bad, as each sees its own defects


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def with_features(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` without ``text`` but with a struct ``into`` of counts over the whole text.

    Three-word windows are compared by 64-bit hashes of their words.
    """
    t, w, g, s, p, lines = (free_name(docs, name) for name in ("t_", "w_", "g_", "s_", "p_", "l_"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(*rest, whole.alias(t))
    out = out.withColumn(w, F.array_remove(F.split(t, WORD_BREAK), ""))
    out = out.withColumn(lines, F.filter(F.split(t, "\n"), lambda line: line.rlike(HAS_WORD)))
    n = F.size(w)
    # element_at counts from one; the three reads keep Spark from computing the array again for each
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
    )
    out = out.withColumn(g, F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(
        s, F.when(F.size(F.array_distinct(g)) < F.size(g), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )

    def repeated(x: Column, k: Column) -> Column:
        before = (k > 0) & (F.try_element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"])
        after = (k < F.size(s) - 1) & (F.try_element_at(s, F.least(k + 2, F.size(s)))["h"] == x["h"])
        return before | after

    found = F.filter(s, repeated)
    out = out.withColumn(p, F.array_sort(F.transform(found, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        p, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last"))
    )["n"]
    counts = {
        "n_words": n,
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": F.length(t) - F.length(_without(F.col(t), SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_upper": F.length(F.regexp_replace(t, "[^A-Z]+", "")),
        "n_shouts": F.length(t) - F.length(_without(F.col(t), "!?")),
        "n_digits": F.length(F.regexp_replace(t, "[^0-9]+", "")),
    }
    return out.select(*rest, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]).alias(into))


@dataclass(frozen=True)
class Rule:
    """Votes by the rates ``part / whole`` of a document.

    Bad if any rate lies outside its ``wide`` limits, good if all are within the
    ``narrow`` ones, else (or with nothing to divide by) the rule abstains. Parts:
    ``(part, whole, narrow low, narrow high, wide low, wide high)``.
    """

    name: str
    parts: tuple[tuple[str, str, float, float, float, float], ...]

    def vote(self, f: Column) -> Column:
        good, bad = F.lit(True), F.lit(False)
        for part, whole, low, high, wide_low, wide_high in self.parts:
            rate = f[part] / F.nullif(f[whole], F.lit(0))
            good &= F.coalesce(rate.between(low, high), F.lit(False))
            bad |= F.coalesce(~rate.between(wide_low, wide_high), F.lit(False))
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


RULES = (
    Rule("symbols", (("n_symbols", "n_words", 0, 0.02, 0, 0.1),)),
    Rule("repeats", (("n_repeat_words", "n_words", 0, 0.1, 0, 0.3),)),
    Rule("same_lines", (("n_dup_lines", "n_lines", 0, 0.05, 0, 0.5),)),
    Rule("shouting", (("n_upper", "word_chars", 0, 0.1, 0, 0.3), ("n_shouts", "n_words", 0, 0.02, 0, 0.1))),
    Rule("word_length", (("word_chars", "n_words", 3.5, 9, 2.5, 15),)),
    Rule("digits", (("n_digits", "word_chars", 0, 0.05, 0, 0.2),)),
)


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of good quality; for each rule the log odds of good that a vote adds, and how often it is right."""

    prior: float
    weights: dict[str, dict[int, float]]
    accuracies: dict[str, dict[str, float]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            adds = self.weights[name]
            odds = odds + F.when(vote == GOOD, adds[GOOD]).when(vote == BAD, adds[BAD]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_votes(names: list[str], patterns: dict[tuple[int, ...], int], rounds: int = 1000) -> VoteModel:
    """Expectation-maximisation of how each rule votes on good and on bad documents.

    The posterior of every pattern of votes is free. A document starts as good
    unless a rule calls it bad; ``prior`` is the share of good ones. A rule may
    be right more often on one kind than on the other; where it abstains it says
    nothing, and no vote counts against itself. What is believed beforehand
    enters as imagined votes, ten times as many as there are documents on each
    kind: ``FALSE_CALLS`` of those on good ones and ``RIGHT_CALLS`` of those on bad
    ones are bad. Without that belief, bad documents that fail one rule each
    would not stand out as a kind.
    """
    good = {p: 0.05 if BAD in p else 0.95 for p in patterns}
    total = sum(patterns.values())
    imagined = 10.0 * total + 1
    prior, rates, weights = 0.5, {}, {name: {GOOD: 0.0, BAD: 0.0} for name in names}
    for _ in range(rounds):
        prior = (sum(good[p] * n for p, n in patterns.items()) + 1) / (total + 2)
        for j, name in enumerate(names):
            seen = {GOOD: [0.0, 0.0], BAD: [0.0, 0.0]}
            for p, n in patterns.items():
                if p[j] != ABSTAIN:
                    seen[p[j]][0] += good[p] * n
                    seen[p[j]][1] += (1 - good[p]) * n
            false = (seen[BAD][0] + FALSE_CALLS * imagined) / (seen[BAD][0] + seen[GOOD][0] + imagined)
            right = (seen[BAD][1] + RIGHT_CALLS * imagined) / (seen[BAD][1] + seen[GOOD][1] + imagined)
            rates[name] = {"good": 1 - false, "bad": right}
            weights[name] = {GOOD: max(0.0, math.log((1 - false) / (1 - right))), BAD: min(0.0, math.log(false / right))}
        base, moved = math.log(prior / (1 - prior)), 0.0
        for p in patterns:
            odds_good = base + sum(weights[name].get(v, 0.0) for name, v in zip(names, p))
            new = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds_good))))
            moved = max(moved, abs(new - good[p]))
            good[p] = new
        if moved < 1e-9:
            break
    return VoteModel(prior, weights, rates)


def score_quality(
    docs: DataFrame, text: str = "text", into: str = "quality", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5
) -> DataFrame:
    """``docs`` without ``text`` but with a struct ``into``: counts, votes, posterior and verdict.

    Words are runs of other than ASCII white space. Fields: ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an earlier
    line), ``n_repeat_words`` (words in three-word windows that occur twice or
    more) and others; ``votes`` by rule name; ``posterior`` of good quality;
    ``base_failed`` (under 50 words, or over half of them repeated); ``kept``. Counts
    are written to the shared folder once, so that votes are counted and documents judged from the
    same rows.

    Null or empty text: no words, ``base_failed``. Repeated rows: each is judged,
    and counted. No rows: no rows. Columns of other names are kept; ``into``
    must not be one of them.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    counted = materialize(with_features(docs, text, into))
    f = F.col(into)
    votes = {rule.name: rule.vote(f) for rule in rules}
    names = list(votes)
    rows = counted.groupBy(*[v.alias(f"v_{k}") for k, v in votes.items()]).agg(F.count("*").alias("n_")).collect()
    model = fit_votes(names, {tuple(r[f"v_{k}"] for k in names): r["n_"] for r in rows})
    failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    posterior = model.posterior(votes)
    return counted.withColumn(
        into,
        F.struct(
            f"{into}.*",
            F.struct(*[v.alias(k) for k, v in votes.items()]).alias("votes"),
            posterior.alias("posterior"),
            failed.alias("base_failed"),
            (~failed & (posterior >= threshold)).alias("kept"),
        ),
    )
