"""Packing: every id in one piece, gapless sequences, little padding; the solver on its own."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobtally.llm import packing
from jobtally.llm.queries import op5_packing
from jobtally.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def check(rows, wanted, window):
    """``rows`` cover exactly the ids of ``wanted`` (doc_id to ids); returns the share of padding."""
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = wanted[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in wanted.items():
        at = 0
        for start, length in sorted(covered[doc_id]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, total)


def test_query(spark, documents):
    whole = Tokenizer.from_file(default_path())
    wanted = {d["doc_id"]: whole.encode(d["text"] or "", add_special_tokens=False).ids + [2] for d in documents}
    assert check(op5_packing(spark, SF).collect(), wanted, 4096) < 0.001


@pytest.mark.parametrize("seed", range(5))
def test_packer_on_random_lengths(seed):
    random = np.random.default_rng(seed)
    lengths = random.integers(1, 4096, 3000) if seed % 2 else np.minimum(4095, random.geometric(0.003, 3000))
    histogram = np.bincount(-(-lengths // 32) - 1, minlength=packing.UNITS).astype(float)
    patterns = packing.combinations([k + 1 for k in range(packing.UNITS) if histogram[k]])
    assert (patterns @ np.arange(1, packing.UNITS + 1) == packing.UNITS).all()
    repeats = packing.non_negative_least_squares(patterns.T, histogram)
    assert (repeats >= 0).all()
    packer = packing.Packer(4096, patterns, repeats / len(lengths))
    left = packer.pack([(k, 0, int(n)) for k, n in enumerate(lengths[:2000])], False)
    assert sum(p[2] for p in left) < 4096
    packer.pack(left + [(k, 0, int(lengths[k])) for k in range(2000, 3000)], True)
    placed = defaultdict(int)
    for sequence in packer.emit:
        for doc, _, length in sequence:
            placed[doc] += length
    assert [placed[k] for k in range(3000)] == lengths.tolist()
    sizes = [sum(p[2] for p in s) for s in packer.emit]
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)
    uncut = sum(1 for s in packer.emit for doc, start, n in s if start == 0 and n == lengths[doc])
    assert uncut > 0.6 * len(lengths)


def test_solver_against_gradient_conditions():
    random = np.random.default_rng(1)
    for _ in range(20):
        a, b = random.random((12, 30)), random.random(12)
        x = packing.non_negative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-6).all() and np.abs(gradient[x > 0]).max() < 1e-6


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "null id", "x"), (3, "same", "x"), (3, "same", "x"), (4, "long " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = packing.pack_documents(docs, default_path(), chunk_tokens=100).collect()
    assert sum(r.length for r in got) == 20000 + 1 + 1 + 1 + 2 * 2 + 3
    assert [r.length for r in got if r.doc_id == 1] == [1]
    assert sum(r.length for r in got if r.doc_id == 3) == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, default_path()).count() == 0
