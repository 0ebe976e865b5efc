"""Token files against whole-text encoding, and round trips of the bit packing."""

import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobtally.llm import bitpack
from jobtally.llm.queries import op8_token_files
from jobtally.llm.token_files import read_token_files, write_token_files
from jobtally.llm.tokens import WordEncoder, default_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  ", "don't\tYou'll 3rd", "É é ́x Σς", "<|endoftext|> a<|STARTOFTEXT|>b", "a b c\x0bd", "x" * 5000]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, width), len(ids), width) == ids).all()


def test_shard_random_access():
    ids, counts = np.arange(1000, dtype=np.uint32), np.array([0, 400, 1, 599])
    data = bitpack.shard_bytes(np.arange(4), np.zeros(4, bool), counts, ids, 11, 64)
    shard = bitpack.ShardReader(io.BytesIO(data))
    assert [shard.document(k).tolist() for k in range(4)] == [[], list(range(400)), [400], list(range(401, 1000))]
    assert shard.ids(130, 700).tolist() == list(range(130, 700))


def test_words_encode_like_texts(documents):
    import pyarrow as pa

    texts = ODD + [d["text"] for d in documents[:60]]
    whole = Tokenizer.from_file(default_path())
    for limit in (1 << 20, 50):
        encode = WordEncoder(default_path(), max_words=limit)
        for part in (texts[:10], texts[5:], texts):
            ids, counts = encode.encode(pa.array(part, pa.string()))
            wanted = [whole.encode(t or "", add_special_tokens=False).ids for t in part]
            assert counts.tolist() == [len(w) for w in wanted]
            assert ids.tolist() == [i for w in wanted for i in w]


def brute(rows, end=1):
    whole, start, out = Tokenizer.from_file(default_path()), 0, []
    for doc_id, text in sorted(rows):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, documents):
    got = sorted(tuple(r) for r in op8_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute([(d["doc_id"], d["text"]) for d in documents])


def test_odd_rows(spark):
    rows = [(k, t, k) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, (None, "null id", 1), (3, "again", 2)], "doc_id long, text string, start long")
    manifest = write_token_files(docs, default_path(), shard_ids=8)
    got = read_token_files(spark, manifest).orderBy("start").collect()
    assert len(got) == len(ODD) + 2 and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted([*range(len(ODD)), 3])
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert manifest.count() >= 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_files(spark, write_token_files(docs, default_path())).count() == 0
