"""Quality counts against plain Python, and the vote model on planted votes."""

import math
import random
import re

import pytest

from jobtally.llm.quality import fit_votes, score_quality
from jobtally.llm.queries import op10_quality_rules

SF = "/root/testdata/sf0.001"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    base = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), base


ODD = [
    None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z w",
    "line one\nline one\n\nline one \n  \n  \nline one", "#$ <|a|> \U0001f600 é", "w " * 60, "tick tock " * 20000,
    " lead and trail \r\n lead and trail \r\n", "\x0b\x0c mixed\x0bspaces\x0chere",
]


def test_counts(spark, documents):
    texts = ODD + [d["text"] for d in documents]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id int, text string, w_ int")
    rows = score_quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.w_ == r.doc_id
        assert (*(r.quality[k] for k in NAMES), r.quality["base_failed"]) == brute(texts[r.doc_id])
        assert 0 <= r.quality["posterior"] <= 1
        assert not (r.quality["kept"] and r.quality["base_failed"])


def test_query(spark, documents):
    rows = op10_quality_rules(spark, SF).collect()
    texts = {d["doc_id"]: d["text"] for d in documents}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (*(r[k] for k in NAMES), r.base_failed) == brute(texts[r.doc_id])


def test_no_rows(spark):
    assert score_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bad_share", [0.05, 0.3])
def test_votes(bad_share):
    """Bad documents fail one of the rules each; good ones hardly any."""
    rnd = random.Random(7)
    patterns, truth = {}, {}
    for _ in range(5000):
        bad = rnd.random() < bad_share
        kind = rnd.randrange(4)
        votes = tuple(
            -1 if (bad and j == kind and rnd.random() < 0.9) or rnd.random() < 0.005 else rnd.choice([1, 1, 1, 0])
            for j in range(4)
        )
        patterns[votes] = patterns.get(votes, 0) + 1
        truth.setdefault(votes, []).append(not bad)
    model = fit_votes([*"abcd"], patterns)
    right = 0
    for votes, kinds in truth.items():
        import math

        odds = math.log(model.prior / (1 - model.prior)) + sum(model.weights[n].get(v, 0) for n, v in zip("abcd", votes))
        right += sum((odds > 0) == good for good in kinds)
    assert right / 5000 > 0.95


def test_verdict_is_the_posterior(spark, documents):
    """The query's posteriors from its own votes, by plain expectation-maximisation, and its verdicts from them."""
    rows = score_quality(spark.read.parquet(f"{SF}/documents.parquet"), into="q").select("q.*").collect()
    votes = [tuple(r.votes) for r in rows]
    good = [0.05 if -1 in v else 0.95 for v in votes]
    n, believed = len(votes), {True: (10 * len(votes) + 1, 0.002), False: (10 * len(votes) + 1, 0.3)}
    for _ in range(1000):
        prior, rates = (sum(good) + 1) / (n + 2), []
        for j in range(len(votes[0])):
            rate = {}
            for kind, (weight, share) in believed.items():
                mine = [g if kind else 1 - g for g in good]
                bad = sum(m for m, v in zip(mine, votes) if v[j] == -1)
                rate[kind] = (bad + share * weight) / (sum(m for m, v in zip(mine, votes) if v[j]) + weight)
            rates.append(rate)
        before, good = good, []
        for v in votes:
            odds = prior / (1 - prior)
            for vote, rate in zip(v, rates):
                if vote == 1:
                    odds *= max(1.0, (1 - rate[True]) / (1 - rate[False]))
                elif vote == -1:
                    odds *= min(1.0, rate[True] / rate[False])
            good.append(odds / (1 + odds))
        if max(abs(a - b) for a, b in zip(before, good)) < 1e-9:
            break
    for r, g in zip(rows, good):
        assert abs(r.posterior - g) < 1e-6
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_contested_documents_may_fall_either_way():
    """One bad vote is overruled by many good ones where bad documents are rare; two are not; among abstentions one weighs more."""
    patterns = {(1,) * 6: 9000, (-1, 1, 1, 1, 1, 1): 8, (1, -1, -1, 1, 1, 1): 60, (1, -1, 0, 0, 0, 0): 5}
    model = fit_votes([*"abcdef"], patterns)

    def posterior(p):
        odds = math.log(model.prior / (1 - model.prior)) + sum(model.weights[n].get(v, 0) for n, v in zip("abcdef", p))
        return 1 / (1 + math.exp(-odds))

    assert posterior((1,) * 6) > 0.99 and posterior((-1, 1, 1, 1, 1, 1)) > 0.5
    assert posterior((1, -1, -1, 1, 1, 1)) < 0.05 and posterior((1, -1, 0, 0, 0, 0)) < posterior((1, -1, 1, 1, 1, 1))
