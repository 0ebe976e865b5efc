"""Language identification with string kernels: n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .batches import filled, free_name, pieces

BUCKETS = 1 << 15
UNKNOWN = "und"
MOST_LANGUAGES = 500  # bounds the sample and the model
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
_LETTERS = np.full(256, 32, np.uint8)  # everything that is no letter reads as a space
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)


def presence(texts: pa.Array, longest: int = 3) -> np.ndarray:
    """Which n-grams of one to ``longest`` bytes each lower-cased text holds, hashed to ``BUCKETS``.

    The inner product of two rows is the blended-spectrum presence kernel.
    """
    lower = pc.utf8_lower(filled(texts)).cast(pa.binary())
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    gap = longest - 1
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lower)], lower), b"\n" * gap)[0].as_buffer()
    data = np.append(_LETTERS[np.frombuffer(joined, np.uint8)], np.full(gap, 32, np.uint8))
    # grams that begin between texts go to a row that is thrown away; each text ends in spaces
    rows = np.arange(2 * len(sizes), dtype=np.int64) // 2
    rows[1::2] = len(sizes)
    row = np.repeat(rows * BUCKETS, np.stack([sizes, np.full(len(sizes), gap)], 1).ravel())
    out = np.zeros((len(sizes) + 1, BUCKETS), np.uint8)
    flat = out.reshape(-1)
    gram = np.zeros(len(data), np.uint32)
    for n in range(longest):
        gram = (gram[: len(data) - n] << np.uint32(8)) | data[n:]
        place = (gram * np.uint32(_ODD[n])) >> np.uint32(32 - 15)
        flat[row[: len(place)] + place] = 1
    return out[:-1]


@dataclass
class LanguageModel:
    """``directions`` fold the landmarks into one column a language; see :func:`fit`."""

    languages: list[str]
    directions: np.ndarray

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """A row a text, a column a language: the regressions' values, one matrix product for the batch."""
        norms = np.sqrt(np.maximum(1.0, grams.sum(1, dtype=np.int64)))
        return (grams.astype(np.float32) @ self.directions) / norms[:, None]


def fit(grams: np.ndarray, labels: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel | None:
    """One-versus-rest kernel ridge regression in the span of Nyström landmarks.

    Kernel values are cosines of presence rows. With ``K`` between landmarks and
    ``C`` between texts and landmarks, features are ``C K^(-1/2)``. A text's values
    are its kernel row to the landmarks times a small matrix; as the
    kernel is linear in presence, both products fold into one.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    grams = grams.astype(np.float32) / np.sqrt(np.maximum(1.0, grams.sum(1, dtype=np.int64)))[:, None].astype(np.float32)
    turn = {name: 0 for name in languages}
    order = []
    for k, name in enumerate(labels):  # landmarks are dealt out evenly to the languages
        order.append((turn[name], k))
        turn[name] += 1
    chosen = [k for _, k in sorted(order)[:landmarks]]
    marks = grams[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = (grams @ marks.T).astype(np.float64) @ root
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([labels.count(name) for name in labels])  # each language counts alike
    weighted = features * weight[:, None]
    solved = np.linalg.solve(weighted.T @ features + ridge * np.eye(features.shape[1]), weighted.T @ targets)
    return LanguageModel(languages, (marks.T @ (root @ solved).astype(np.float32)).astype(np.float32))


def sample_grams(rows: DataFrame, per_language: int) -> tuple[np.ndarray, list[str]]:
    """Presence rows of at most ``per_language`` texts of each language, chosen by a hash of id and text.

    Only these bits reach the driver. A first choice by rate keeps what is ranked small.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("doc_id", F.lit(23), "text")
    # equal rows are drawn or passed over together, so they count once
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(order).alias("n")).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has {len(counts)} values; more than {MOST_LANGUAGES} are hardly languages")
    if not counts:
        return np.zeros((0, BUCKETS), np.uint8), []
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2.0 * per_language + 50) / n))])
    drawn = rows.where(F.pmod(order, F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("lang", "text", order.alias("o"))
    drawn = drawn.dropDuplicates(["lang", "o"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            grams = np.packbits(presence(batch.column("text")), axis=1)
            packed = pa.array([g.tobytes() for g in grams], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("o"), packed], names=["lang", "o", "grams"])

    found = drawn.mapInArrow(bits, "lang string, o long, grams binary")
    top = F.array_sort(F.collect_list(F.struct("o", "grams")))  # rows are few: at most about twice the sample
    taken = found.groupBy("lang").agg(F.slice(top, 1, per_language).alias("rows")).collect()
    pairs = sorted(((s["o"], r["lang"], bytes(s["grams"])) for r in taken for s in r["rows"]))
    if not pairs:
        return np.zeros((0, BUCKETS), np.uint8), []
    grams = np.unpackbits(np.frombuffer(b"".join(p[2] for p in pairs), np.uint8).reshape(len(pairs), -1), axis=1)
    return grams, [p[1] for p in pairs]


def identify(
    docs: DataFrame, train: Column | None = None, per_language: int = 250, into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language of each whole ``text`` and a score between 0 and 1.

    The model learns from at most ``per_language`` texts of each non-null
    ``lang`` among rows that satisfy ``train``; predictions read the text alone.
    The score is the softmax of the regressions' values, sharpened fourfold.

    Null text, or one without a letter: ``und``, score 0. No labelled rows: all
    ``und``. Over ``MOST_LANGUAGES`` values of ``lang``: an error. Repeated rows: each is predicted. No rows: no rows. All columns
    are kept; those in ``into`` must not be among them.
    """
    if {c.lower() for c in into} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column of {into}")
    sample = docs if train is None else docs.where(train)
    sample = sample.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit(*sample_grams(sample, per_language))
    held = docs.sparkSession.sparkContext.broadcast(model)
    languages = np.array([*(model.languages if model else []), UNKNOWN])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            texts = batch.column("text").cast(pa.string())
            known = pc.match_substring_regex(filled(texts), r"\p{L}").to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(languages) - 1), np.zeros(batch.num_rows)
            if held.value and known.any():
                for at in range(0, batch.num_rows, 256):
                    part = slice(at, at + 256)
                    values = np.exp(4 * held.value.scores(presence(texts[part])))
                    best[part], score[part] = values.argmax(1), values.max(1) / values.sum(1)
            best[~known], score[~known] = len(languages) - 1, 0.0
            columns = [*batch.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *into])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{schema}, {into[0]} string, {into[1]} double")


def keep_identified(docs: DataFrame, train: Column | None = None, **options: int) -> DataFrame:
    """``docs`` without those of no language, ``und``; how sure the others are plays no part.

    Columns and cases as in :func:`identify`.
    """
    into = (free_name(docs, "lang_pred"), free_name(docs, "score"))
    found = identify(docs, train, into=into, **options)
    return found.where(F.col(into[0]) != UNKNOWN).select(*docs.columns)
