"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from jobtally.llm import simhash
from jobtally.llm.components import connected_components
from jobtally.llm.queries import op2_simhash

SF = "/root/testdata/sf0.001"


def plain_print(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_texts(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(0, 5)):
            words[rnd.randrange(400)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


ODD = [None, "", " \t\n", "One", "one", "one two", "ONE\x0btwo", "one  two   three four", "One two three four", "É é", "a b c " * 3000]


def test_fingerprints(documents):
    texts = ODD + [d["text"] for d in documents[:80]]
    got = simhash.fingerprints_of(pa.array(texts, pa.string()), 3)
    assert got.tolist() == [plain_print(t) for t in texts]


def test_query(spark, documents):
    prints = {d["doc_id"]: plain_print(d["text"]) for d in documents}
    wanted = plain_components(prints)
    rows = op2_simhash(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted(
        (i, f"{p:016x}", wanted[i]) for i, p in prints.items()
    )


@pytest.mark.parametrize("block", [20_000, 7])
def test_near_copies(spark, block):
    texts = ODD + near_texts(1, 60) + near_texts(2, 40)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    from pyspark.sql import functions as F

    rows = simhash.clusters(docs, [F.col("doc_id")], block=block).collect()
    wanted = plain_components({k: plain_print(t) for k, t in enumerate(texts)})
    assert {r.doc_id: r.least["doc_id"] for r in rows} == wanted and len(rows) == len(texts)
    kept = simhash.deduplicate_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))


def test_links_find_every_close_pair():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        x = np.uint64(0)
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            x |= np.uint64(1) << np.uint64(bit)
        assert any(simhash.links(np.array([x]), s, 3)[0] for s in range(4))
    far = np.array([0x7, 0xF, 0x0001000100010001], np.uint64)
    assert [simhash.links(far, s, 3).tolist() for s in range(4)][1] == [True, False, False]


def test_dense_group_keeps_no_pairs():
    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(1) << rng.integers(16, 64, 3000, dtype=np.uint64) | np.uint64(1) << rng.integers(16, 64, 3000, dtype=np.uint64))
    label = simhash.spanning(prints, 0, 3)
    assert len(label) == len(prints)


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1300)] + [(5, 5), (1000, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and got[5] == 5
    assert {got[k] for k in [3, 7, *range(1000, 1300)]} == {3}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "q r s t u v"), (3, "q r s t u v"), (3, "other words here entirely"), (2, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 2), (-1, 2), (2, 2), (3, 3), (3, 3), (3, 3)]
    assert sorted(map(tuple, simhash.deduplicate_near(docs).collect())) == [(2, "a b c d"), (3, "other words here entirely"), (3, "q r s t u v")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
