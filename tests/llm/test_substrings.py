"""Substring dedup against brute force over odd texts, windows and group sizes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from jobtally.llm import substrings
from jobtally.llm.substrings import deduplicate_substrings, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    lists = [WORD.findall(t or "") for t in texts]
    count = {}
    for words in lists:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(words), len(gone), [w for k, w in enumerate(words) if k not in gone]))
    return out


@pytest.mark.parametrize("window,group", [(1, 4), (3, 5), (5, 40), (8, 1 << 20)])
def test_random_texts(spark, window, group):
    rnd = random.Random(window)
    texts = [None, "", " \n ", "é " * 30, "a"] + [
        " ".join(rnd.choice(["a", "b", "cc", "É", "d"]) for _ in range(rnd.randrange(0, 60))) for _ in range(40)
    ]
    texts += [texts[10]] * 3 + [" \t".join(rnd.choice("abcdefghij") for _ in range(3000)) + "\x0b", texts[20] + "\nthe end"]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, part_ int")
    rows = remove_repeats(docs, window=window, group_suffixes=group, part_bytes=500).collect()
    wanted = brute(texts, window)
    assert len(rows) == len(texts)
    for r in rows:
        n_words, n_removed, kept = wanted[r.doc_id]
        assert (r.repeats["n_words"], r.repeats["n_removed"], WORD.findall(r.text or "")) == (n_words, n_removed, kept)
        assert sum(s["end"] - s["start"] for s in r.repeats["spans"]) == n_removed and r.part_ == r.doc_id
        if not n_removed:
            assert r.text == texts[r.doc_id]
    assert deduplicate_substrings(docs, window=window).columns == docs.columns


def test_packed_prints():
    found = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (substrings.unpacked(substrings.packed(found)) == found).all()


def test_groups_are_of_bounded_size(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "the", f"w{rnd.randrange(3000)}"]) for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    firsts, size = substrings.prefix_groups(docs, 5, 500)
    assert size >= sum(map(len, texts)) and len(firsts) > 20 and (np.diff(firsts.astype(np.int64)) > 0).all()
    groups, _ = substrings.grouped_prints(pa.chunked_array([texts]), 5, firsts)
    assert max(map(len, groups.values())) < 700  # of 15,840


def test_windows_of_one_hot_prefix_are_split(spark):
    """A third of all windows begin with the same four words; their groups are no larger than others."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(300)) for _ in range(40)]
    texts += [f"once upon a time w{rnd.randrange(500)} w{rnd.randrange(500)}" for _ in range(6000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    firsts, _ = substrings.prefix_groups(docs.select("text"), 6, 500)
    groups, _ = substrings.grouped_prints(pa.chunked_array([texts]), 6, firsts)
    assert sum(map(len, groups.values())) > 15000 and max(map(len, groups.values())) < 1000
    found = {r.doc_id: r.repeats["n_removed"] for r in remove_repeats(docs, window=6, group_suffixes=500).collect()}
    assert found == {k: n_removed for k, (_, n_removed, _) in enumerate(brute(texts, 6))}


def test_equal_rows_and_clashing_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e")] * 3000 + [(2, "x y z")], "doc_id long, text string")
    got = remove_repeats(docs, window=3, part_bytes=1000).groupBy("doc_id", "text").count().collect()
    assert sorted(map(tuple, got)) == [(1, "", 3000), (2, "x y z", 1)]
    with pytest.raises(ValueError):
        remove_repeats(docs, into="TEXT")


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
