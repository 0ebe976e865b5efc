"""Language and toxicity: held-out accuracy, kernels against plain sets, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from jobtally.llm import language, toxicity
from jobtally.llm.queries import op6_toxicity, op9_language

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = op9_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_presence_kernel():
    texts = ["The cat, sat", "ÉTÉ été", "", "12 34", "aaa"]
    grams = language.presence(pa.array(texts))

    def plain(text):
        size = len(text.lower().encode())
        data = bytes(language._LETTERS[b] for b in text.lower().encode() + b"  ")
        return {data[i : i + n] for n in (1, 2, 3) for i in range(size)}

    for row, text in zip(grams, texts):
        assert (row == language.presence(pa.array([text]))[0]).all()
        assert len(plain(text)) - 2 <= row.sum() <= len(plain(text))
    same = language.presence(pa.array(["the end of the line", "the end of the line"]))
    assert (same[0].astype(int) @ same[1]) > 0.9 * same[0].sum()


def test_nystroem_agrees_with_exact_ridge():
    rng = np.random.default_rng(3)
    words = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"], "z": ["eins", "zwei", "drei"]}
    labels = [k for k in words for _ in range(12)]
    texts = [" ".join(rng.choice(words[k], 6)) for k in labels]
    grams = language.presence(pa.array(texts))
    model = language.fit(grams, labels, landmarks=len(texts), ridge=1e-2)
    unit = grams / np.sqrt(grams.sum(1))[:, None]
    kernel, targets = unit @ unit.T, np.where(np.array(labels)[:, None] == np.array(model.languages), 1.0, -1.0)
    exact = kernel @ np.linalg.solve(kernel + 12e-2 * np.eye(len(texts)), targets)
    assert np.abs(model.scores(grams) - exact).max() < 0.02


def test_language_odd_rows(spark):
    rows = [(k, t, lang, 1.5) for k, (t, lang) in enumerate(
        [("the cat sat on the mat", "en")] * 5 + [("el gato está en la casa", "es")] * 5
        + [(None, "en"), ("", "en"), ("123 !?", None), ("the mat", None), ("the cat " * 50000, None)]
    )] + [(None, "el gato", None, 0.0), (3, "the cat", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ double")
    got = language.identify(docs, into=("p", "s")).collect()
    assert len(got) == len(rows)
    by_text = {r.text[:20] if r.text else r.text: r for r in got}
    assert [by_text[t].p for t in (None, "", "123 !?", "the mat", "the cat " * 2 + "the ", "el gato")] == ["und"] * 3 + ["en", "en", "es"]
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.p for r in language.identify(unlabelled, into=("p", "s")).collect()} == {"und"}
    assert language.identify(docs.limit(0), into=("p", "s")).count() == 0


def test_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) is not None]
    assert np.mean([p for p, t in known if t]) > 0.5 and np.mean([p for p, t in known if not t]) < 0.1


def test_toxicity_on_planted_words(spark):
    rng = np.random.default_rng(5)
    plain = ["river", "stone", "garden", "window", "letter", "simple", "morning", "yellow", "paper", "travel"]
    foul = ["zorbagulator", "quixnarlish", "vlimperdoon"]

    def text(bad):
        words = list(rng.choice(plain, 60))
        for place in rng.choice(60, 4, replace=False) if bad else ():
            words[place] = rng.choice(foul)
        return " ".join(words)

    bad = [k % 4 == 0 for k in range(400)]
    rows = [(k, text(b), "x") for k, b in enumerate(bad)]
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (1002, "?! ...", "x"), (0, text(True), "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(k, int(b)) for k, b in enumerate(bad) if k % 5] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int"
    )
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 404
    assert all((r.score >= 0.5) == bad[r.doc_id] for r in got if r.doc_id < 400)
    assert {r.score for r in got if r.doc_id >= 1000} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_of_short_words_and_long_texts():
    rng = np.random.default_rng(5)
    plain = ["river", "stone", "garden", "window", "letter", "simple", "morning", "yellow", "paper", "travel"]

    def text(n, foul, at=None):
        words = list(rng.choice(plain, n))
        for place in rng.choice(60, 4, replace=False) if foul else ():
            words[place + (at or 0)] = rng.choice(foul)
        return " ".join(words)

    for foul in (["zorbag", "quixnarl", "vlimp"], ["zog", "vlim", "quixn"]):
        model = toxicity.fit([text(60, foul) for _ in range(80)], [text(60, ()) for _ in range(240)])
        held = [text(60, foul) for _ in range(40)] + [text(20_000, foul, at=9_000) for _ in range(3)]
        assert (model.scores(pa.array(held)) >= 0.5).all()
        assert (model.scores(pa.array([text(60, ()), text(20_000, ()), "", None])) < 0.5).all()


@pytest.mark.parametrize("ids", [[None], [1], [2], range(3000)])
def test_language_with_odd_ids(spark, ids):
    """Equal or missing ids still give a model; equal rows count once."""
    words = {"en": "the thing and there", "fr": "le chose où était"}
    rows = [(ids[k % len(ids)], f"{words[lang]} {words[lang]} {k}", lang) for k in range(1500) for lang in words]
    rows += [(7, "same the same thing", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in got} == {("en", "en"), ("fr", "fr")}
