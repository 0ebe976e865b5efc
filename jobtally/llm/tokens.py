"""Encoding of whole texts by a public tokenizer, inside tasks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import filled


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, each distinct word encoded once.

    For tokenizers that treat ASCII white space as a boundary and give it no id,
    as ``word_bpe_49k.json`` does: the ids of a text are then those of its
    words one after another. ``max_words`` bounds the words remembered; others
    are encoded whenever they come.
    """

    def __init__(self, path: str, max_words: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.max_words = max_words
        self.slots: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and how many each text has."""
        lists = pc.ascii_split_whitespace(filled(texts))
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        get = self.slots.get
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        known = len(self.starts)
        ids, lengths = self._words([words[i] for i in new])
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        all_ids = np.concatenate([self.ids, ids])
        all_starts, all_lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        slots[new] = known + np.arange(len(new))
        if keep := max(0, min(len(new), self.max_words - known)):
            self.slots.update((words[i], int(slots[i])) for i in new[:keep])
            self.starts, self.lengths = all_starts[: known + keep], all_lengths[: known + keep]
            self.ids = all_ids[: int(self.starts[-1] + self.lengths[-1])]
        of_word = slots[coded.indices.to_numpy()]
        sizes = all_lengths[of_word]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(all_starts[of_word] - (ends - sizes), sizes) + np.arange(total)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        return all_ids[at], np.diff(bounds)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new counts."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
