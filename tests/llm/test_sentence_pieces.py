"""Encoding by backtracking against the library on whole texts."""

import hashlib
import random

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from jobtally.llm.queries import op13_sentence_pieces
from jobtally.llm.sentence_pieces import SPACE, PieceEncoder, decode_pieces, default_path, encode_pieces

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a\nb ▁ c", " ▁▁ x▁y", "\x00\x7f é ☃🙂 ñ​ 漢字", "<s> <0x0A> <unk></s>", "x" * 5000, "\0\0 a\0b", " " * 77 + "the"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=default_path())


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(default_path())


def texts_of(encoder):
    r = random.Random(7)
    pieces = list(encoder.vocabulary.id)
    for k in range(120):
        yield " " * k
        yield " " * k + "the"
    for _ in range(6000):
        yield "".join(r.choice(pieces) for _ in range(r.randint(1, 6))).replace(SPACE, r.choice([" ", SPACE]))
        yield "".join(r.choice("etaoinsrhl  du▁.\n") for _ in range(r.randint(1, 30)))


def test_ids_are_the_librarys(encoder, library, documents):
    texts = [*ODD, *texts_of(encoder), *[d["text"] for d in documents]]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    wanted = [library.encode(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_small_memory_changes_nothing(library, documents):
    encoder = PieceEncoder(default_path(), most_units=20, longest_unit=5)
    encoder.vocabulary.most_pairs = 10
    texts = [*ODD, *[d["text"] for d in documents[:20]]]
    for part in (texts[:12], texts[5:], texts):
        ids, _ = encoder.encode(pa.array(part, pa.string()))
        assert ids.tolist() == [i for t in part for i in library.encode(t or "")]
    assert len(encoder.slots) <= 20


def test_failed_places_are_left_for_shorter_pieces(encoder, library):
    """Words whose longest first piece leads nowhere, so that laying has to go back."""
    vocabulary, wanted = encoder.vocabulary, 0
    for first in list(vocabulary.length)[:4000]:
        for rest in ("ing", "ed", "s", "ation"):
            text = vocabulary.piece[first] + rest
            ids = vocabulary.encode([text])[0]
            assert ids == vocabulary.encode([text])[0] and [vocabulary.piece[i] for i in ids] == vocabulary.merged(text)
            wanted += ids[0] != first
    assert wanted


def test_columns_and_cases(spark, library):
    rows = [(k, t, "keep") for k, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd col` string")
    coded = encode_pieces(docs, default_path(), decoded="back")
    assert coded.columns == ["doc_id", "text", "odd col", "ids", "back"]
    for row in coded.collect():
        assert list(row.ids) == library.encode(row.text or "") and row.back == library.decode(list(row.ids))
    again = decode_pieces(coded.drop("text"), default_path()).collect()
    assert all(row.text == row.back for row in again)
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert decode_pieces(nothing, default_path()).first()["text"] == ""
    assert encode_pieces(docs.limit(0), default_path()).count() == 0
    with pytest.raises(ValueError):
        encode_pieces(docs, default_path(), ids="TEXT")
    with pytest.raises(ValueError):
        encode_pieces(docs, default_path(), decoded="ids")
    with pytest.raises(ValueError):
        decode_pieces(coded, default_path())


def test_query(spark, documents, library):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = set()
    for d in documents:
        ids = library.encode(d["text"] or "")
        wanted.add((d["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    got = op13_sentence_pieces(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(documents) and set(map(tuple, got)) == wanted
