"""Near words, forms and roots against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from jobtally.llm.queries import op11_spelling_variants
from jobtally.llm.spelling import count_words, edit_sites, group_variants, near_words, variable_grams

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, least=7, slip=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip and h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def plain_groups(counts, ratio=10):
    """Two words are near if one without a letter is the other, or both without a letter at the same place are equal."""
    near, gaps = {w: set() for w in counts}, {}
    for w in counts:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            gaps.setdefault((k, rest), []).append(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for words in gaps.values():
        for w in words:
            near[w].update(v for v in words if v != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def invented(seed, n, letters="abcé", sizes=(7, 12)):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(*sizes))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        k = r.randrange(len(w))
        words.add(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + r.choice(letters) + w[k:]]))
    return {w: r.choice([2, 3, 25, 300, 4000, 50000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("one_in,longest_list", [(1000, 1000), (20, 1000), (1, 1000), (20, 3), (1000, 1)])
def test_near_words(spark, one_in, longest_list):
    counts = invented(one_in, 1500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = rows_of(group_variants(words, one_in=one_in, longest_list=longest_list))
    assert found == plain_groups(counts)
    assert any(f and f != r for _, f, r, *_ in found)


def test_short_and_odd_words(spark):
    counts = invented(3, 800, "ab🙂", (1, 7)) | {"🙂🙂🙂🙂🙂🙂🙂": 7, "a": 3, "b": 40, "ab": 2, "x" * 3000: 50, "x" * 2999: 2, "same": 3, "samé": 30, "samè": 30}
    words = spark.createDataFrame([*[(w, n, "more") for w, n in counts.items()], (None, 9, "more")], "word string, n long, key string")
    assert rows_of(group_variants(words, one_in=5)) == plain_groups(counts)


def test_sites_meet():
    """Whatever one edit does, both words have a site with equal letters outside and the fitting kinds."""
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(2, 11)))
        frequent = frozenset(x + y for x in "abc" for y in "abc" if r.random() < 0.5)
        k = r.randrange(len(a))
        for b, edits in ((a[:k] + "z" + a[k + 1 :], (1, 1)), (a[:k] + "z" + a[k:], (2, 1)), (a + "z", (2, 1))):
            keys = [{(w[:x], w[y:]): e for (x, y), e in edit_sites(w, frequent).items()} for w in (a, b)]
            assert any(keys[0][s] & edits[0] and keys[1].get(s, 0) & edits[1] for s in keys[0])


def test_variable_grams():
    assert variable_grams("abcd", frozenset()) == [(0, 2), (1, 3), (2, 4)]
    assert variable_grams("abcd", frozenset({"ab"})) == [(0, 3), (2, 4)]
    assert variable_grams("a", frozenset()) == []


def test_count_words(spark):
    rows = [(1, None), (2, ""), (3, "ÀÉtroublesÿ! Troubles troubles×troubles Ābcdefgh"), (None, "nothing named nothing"),
            (3, "ÀÉtroublesÿ! Troubles"), (4, "q" * 500 + " " + "é" * 70), (5, "abcdefg1abcdefgh_abcdefghi")]
    rows += [(k, "misspelling wordbook lengthening " * 3) for k in range(6, 200)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, word string")
    for slip in (31, 2, None):
        assert dict(map(tuple, count_words(docs, slip_one_in=slip).collect())) == plain_counts(rows, slip=slip)
    assert count_words(docs.limit(0)).count() == 0


def test_empty_and_refused(spark):
    words = spark.createDataFrame([], "word string, n long")
    assert group_variants(words).count() == 0
    assert near_words(words).count() == 0
    with pytest.raises(ValueError):
        group_variants(words, ratio=1)


def test_query(spark, documents):
    counts = {w: n for w, n in plain_counts([(d["doc_id"], d["text"]) for d in documents]).items() if n >= 2}
    assert rows_of(op11_spelling_variants(spark, SF)) == plain_groups(counts)
