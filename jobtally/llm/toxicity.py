"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .batches import filled, pieces
from .words import NOT_ALPHANUMERIC

LEVEL = 3
PASSAGE = 50  # words
SHORT = 7  # bytes: a match in the dictionary costs as many
WHOLE = 16  # the gain of a telling short word, above any limit
_SPACED = np.where(NOT_ALPHANUMERIC, 32, np.arange(256)).astype(np.uint8)


def windows(texts: pa.Array) -> pa.ListArray:
    """The windows of each text: its lower-cased words, runs of other than ASCII punctuation and white space."""
    lower = pc.utf8_lower(filled(texts)).cast(pa.binary())
    spaced = _SPACED[np.frombuffer(lower.buffers()[2] or b"", np.uint8)]
    lower = pa.Array.from_buffers(
        pa.string(), len(lower), [None, lower.buffers()[1], pa.py_buffer(spaced.tobytes())], offset=lower.offset
    )
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower))


def dictionary(words: list[str], size: int) -> bytes:
    """A trained dictionary of ``words`` as they occur; the words themselves if they are too few to train on."""
    samples = [" ".join(["", *words[i : i + 8], ""]).encode() for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    """Dictionaries of toxic and ordinary text, and calibrated limits.

    A window counts if the toxic dictionary saves at least ``gain`` bytes more than the ordinary
    one, or if it is a short word with a stem of ``short``; ``share`` is the share of such windows at which a text scores one half, ``passage`` their
    number in its worst ``PASSAGE`` neighbouring words at which it does, however long the text is.
    """

    toxic: bytes
    ordinary: bytes
    gain: int = 2
    share: float = 0.01
    passage: float = 2.5
    short: frozenset[str] = frozenset()
    remember: int = 1 << 20
    _seen: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        def compressor(data: bytes):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False).compress

        self._toxic, self._ordinary = compressor(self.toxic), compressor(self.ordinary)

    def _gain(self, window: str) -> int:
        data = f" {window} ".encode()
        if len(data) <= SHORT + 2 and not self.short.isdisjoint((window, window[:5], window[:6])):
            out = WHOLE
        else:
            out = len(self._ordinary(data)) - len(self._toxic(data))
        if len(self._seen) < self.remember:
            self._seen[window] = out
        return out

    def gains(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The gain of every window, and where each text's windows begin and end."""
        coded = lists.flatten().dictionary_encode()
        get = self._seen.get
        found = [self._gain(w) if (g := get(w)) is None else g for w in coded.dictionary.to_pylist()]
        offsets = lists.offsets.to_numpy()
        return np.array(found, np.int64)[coded.indices.to_numpy()], offsets - offsets[0]

    def shares(self, texts: pa.Array, gain: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The share of each text's windows that count, and their number in its worst passage."""
        gains, bounds = self.gains(windows(texts))
        hits = np.concatenate([[0], np.cumsum(gains >= (self.gain if gain is None else gain))])
        starts, stops = bounds[:-1], bounds[1:]
        worst = np.zeros(len(starts), np.int64)
        some = stops > starts
        if some.any():
            ends = np.minimum(np.arange(bounds[-1]) + PASSAGE, np.repeat(stops, np.diff(bounds)))
            worst[some] = np.maximum.reduceat(hits[ends] - hits[:-1], starts[some])
        return (hits[stops] - hits[starts]) / np.maximum(1, np.diff(bounds)), worst

    def scores(self, texts: pa.Array) -> np.ndarray:
        shares, worst = self.shares(texts)
        return np.maximum(shares / (shares + self.share), worst / (worst + self.passage))


def stems(word: str) -> set[str]:
    return {word} | {word[:k] for k in range(3, 8) if len(word) > k}


def train(bad: list[list[str]], good: list[list[str]], size: int, least_share: float, ratio: float) -> ToxicityModel:
    """The toxic dictionary from the words of ``bad`` that have a telling stem, the ordinary one from all of ``good``."""
    bad_in, good_in = (
        Counter(stem for words in texts for stem in {x for w in set(words) for x in stems(w)}) for texts in (bad, good)
    )
    least = max(min(3, len(bad)), least_share * len(bad))
    telling = {
        stem for stem, n in bad_in.items()
        if n >= least and n / len(bad) > ratio * (good_in[stem] + 1) / (len(good) + 1)
    }
    chosen = [w for words in bad for w in words if not telling.isdisjoint(stems(w))]
    model = ToxicityModel(dictionary(chosen or ["-"], size), dictionary([w for words in good for w in words] or ["-"], size))
    seen = {w for words in bad for w in words}  # a stem of three or four letters tells only of the word it is
    model.short = frozenset(t for t in telling if len(t.encode()) <= SHORT and (len(t) > 4 or t in seen))
    return model


def fit(
    toxic: list[str], ordinary: list[str], size: int = 8192, least_share: float = 0.02, ratio: float = 5.0
) -> ToxicityModel | None:
    """Dictionaries from the texts of each class, and limits calibrated on texts the dictionaries have not seen.

    A stem (a word or its first three to seven characters) is telling if it is
    ``ratio`` times as common among toxic texts as among ordinary ones and in
    ``least_share`` of them. The limits come from two models, each trained on one half and applied to the
    other: those of best balanced accuracy, in the middle if several are. The share comes first;
    the passage adds to it, between the least number that is as good as any and the toxic texts' median. None
    without two different texts of each class.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if min(len(toxic), len(ordinary)) < 2:
        return None
    words = [windows(pa.array(texts)).to_pylist() for texts in (toxic, ordinary)]
    folds = [(train(words[0][k::2], words[1][k::2], size, least_share, ratio), 1 - k) for k in (0, 1)]
    best = (-1.0, 0, 0, 0.0, 0.0)
    for gain in range(1, 7):
        found = [[model.shares(pa.array(texts[k::2]), gain) for model, k in folds] for texts in (toxic, ordinary)]
        (a, worst_a), (b, worst_b) = ([np.concatenate(x) for x in zip(*halves)] for halves in found)
        edges = np.unique(np.concatenate([[0.0], a, b]))
        limits = (edges[:-1] + edges[1:]) / 2 if len(edges) > 1 else np.array([0.01])
        right = 1 - np.searchsorted(np.sort(a), limits) / len(a) + np.searchsorted(np.sort(b), limits) / len(b)
        top = np.flatnonzero(right >= right.max() - 1e-9)
        limit = float(limits[top[len(top) // 2]])
        counts = np.arange(1, PASSAGE + 1)
        both = np.array([np.mean((a >= limit) | (worst_a >= n)) + np.mean((b < limit) & (worst_b < n)) for n in counts])
        good = counts[both >= both.max() - 1e-9]
        usual = np.median(worst_a[a >= limit]) if (a >= limit).any() else good[0]
        passage = float(np.median(good[good <= max(good[0], usual)])) - 0.5
        best = max(best, (float(both.max()), -gain, gain, limit, passage))
    model = train(words[0], words[1], size, least_share, ratio)
    model.gain, model.share, model.passage = best[2:]
    return model


def sample_texts(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int, max_bytes: int) -> dict[int, list[str]]:
    """At most ``per_class`` labelled texts of each class, chosen by a hash of the id; longer texts are left out."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(rows)
    )
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    short = docs.where(F.octet_length("text").between(1, max_bytes)).select("doc_id", "text")
    taken = short.join(ids, "doc_id").orderBy(order, "doc_id", "text").limit(2 * per_class).collect()
    return {k: [r["text"] for r in taken if r["toxic"] == k] for k in (0, 1)}


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = 1500, max_bytes: int = 1 << 16
) -> DataFrame:
    """``(doc_id, score)``, the score between 0 and 1 and one half at the calibrated limit.

    The model learns from at most ``per_class`` texts of each class of up to ``max_bytes`` bytes
    whose ``doc_id`` satisfies ``train``. Windows are single words;
    each distinct one is compressed once in a worker and remembered, up to a fixed number. Words of
    up to ``SHORT`` bytes, which no dictionary shortens, count if they or their first five letters
    or more are telling. The score is the greater of those of the whole text and of its worst passage.

    Null or empty text: score 0. Labels other than 0 and 1, or without a
    ``doc_id``, teach nothing; of several for one document the toxic one holds.
    Fewer than two labelled texts of a class: all scores 0. Repeated rows: each is scored. No
    rows: no rows. Other columns are not read. Long texts are read whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = sample_texts(rows, labels, F.lit(True) if train is None else train, per_class, max_bytes)
    fitted = fit(texts[1], texts[0])
    parts = fitted and (fitted.toxic, fitted.ordinary, fitted.gain, fitted.share, fitted.passage, fitted.short)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*parts) if parts else None
        for batch in pieces(batches):
            scores = model.scores(batch.column("text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")
