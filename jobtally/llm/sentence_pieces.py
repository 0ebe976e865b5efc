"""Exact byte-pair encoding with a SentencePiece vocabulary, and its decoding.

Encoding never runs the merges over a text. Any two neighbouring pieces of the
right encoding come out again when the two alone are merged, and only the right
encoding has this everywhere. So pieces are laid from left to right, the longest
first, where they agree with the piece before; a place from which no piece leads
on is marked and never tried again.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import filled, pieces

SPACE = "▁"  # stands for a space in the vocabulary


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceVocabulary:
    """The pieces of a model: what merges, and which two may be neighbours.

    ``most_pairs`` bounds the answers about neighbours that are remembered.
    """

    def __init__(self, path: str, most_pairs: int = 1 << 19):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.most_pairs, self.pairs = most_pairs, {}
        every = range(self.model.get_piece_size())
        plain = [i for i in every if not (
            self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.piece = {i: self.model.id_to_piece(i) for i in plain}
        self.bytes = {int(self.model.id_to_piece(i)[3:5], 16): i for i in every if self.model.is_byte(i)}
        self.score = {self.piece[i]: self.model.get_score(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with a space inside are not supported")
        if not set("".join(self.id)) <= self.id.keys():
            raise ValueError("a character of a piece is no piece itself")
        if "\0" in self.id or len(self.bytes) < 256:
            raise ValueError("the model has no piece for some bytes, or one for the separator")
        # a piece its own merges do not give never stands in an encoding
        usable = {p: i for p, i in self.id.items() if self.merged(p) == [p]}
        self.shorter = {i: next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1) for p, i in usable.items()}
        self.length = {i: len(p) for p, i in usable.items()}
        self.backwards = ahocorasick.Automaton()
        for p, i in usable.items():
            self.backwards.add_word(p[::-1], i)
        self.backwards.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: best score first, leftmost of equals."""
        parts: list[str] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        score = self.score.get

        def offer(a: int, b: int) -> None:
            both = parts[a] + parts[b]
            if (s := score(both)) is not None:
                heappush(heap, (-s, a, b, both))

        heap: list[tuple[float, int, int, str]] = []
        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heappop(heap)
            if not parts[a] or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in parts if p]

    def agree(self, left: int, right: int) -> bool:
        """Whether the two pieces, merged on their own, stay these two."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) < self.most_pairs:
                self.pairs[left << 32 | right] = known
        return known

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; spaces are already ``SPACE``. All are searched in one go."""
        joined = "\0".join(texts)
        last = len(joined) - 1
        longest = [-1] * (last + 1)
        seen = -1
        for end, i in self.backwards.iter(joined[::-1]):  # at one end the longest match comes first
            if end != seen:
                longest[last - end] = i
                seen = end
        out, start = [], 0
        for text in texts:
            stop = start + len(text)
            ids: list[int] = []
            if -1 in longest[start:stop]:
                for at in [k for k in range(start, stop) if longest[k] < 0]:
                    self._lay(longest, start, at, ids)
                    ids += [self.bytes[b] for b in joined[at].encode()]  # a character of no piece: its bytes
                    start = at + 1
            self._lay(longest, start, stop, ids)
            out.append(ids)
            start = stop + 1
        return out

    def _lay(self, longest: list[int], start: int, stop: int, laid: list[int]) -> None:
        """Append the pieces of a stretch to ``laid``; what is there already stays and binds nothing."""
        if start == stop:
            return
        lengths, shorter, known, base = self.length, self.shorter, self.pairs, len(laid)
        failed: bytearray | None = None
        at, candidate = start, longest[start]
        while True:
            while candidate >= 0:
                end = at + lengths[candidate]
                if failed is None or not failed[(end - start) >> 3] >> (end - start & 7) & 1:
                    if len(laid) == base:
                        break
                    agreed = known.get(laid[-1] << 32 | candidate)
                    if self.agree(laid[-1], candidate) if agreed is None else agreed:
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                laid.append(candidate)
                if end == stop:
                    return
                at, candidate = end, longest[end]
            else:
                if failed is None:
                    failed = bytearray((stop - start) // 8 + 1)
                failed[(at - start) >> 3] |= 1 << (at - start & 7)
                candidate = laid.pop()
                at -= lengths[candidate]


# No piece holds these, so a text may be cut before and after each.
def _lone_bytes(vocabulary: PieceVocabulary) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[b for b in range(128) if chr(b) not in vocabulary.id and b != 32]] = True
    return flags


class PieceEncoder:
    """Ids of many texts at once, each distinct stretch between cuts encoded once.

    A text is cut where a space follows another character, and around
    characters of no piece; no merge crosses such a cut. ``most_units`` and
    ``longest_unit`` bound what is remembered; other stretches are encoded
    whenever they come.
    """

    def __init__(self, path: str, most_units: int = 1 << 19, longest_unit: int = 64):
        self.vocabulary = PieceVocabulary(path)
        self.most_units, self.longest_unit = most_units, longest_unit
        self.lone = _lone_bytes(self.vocabulary)
        self.slots: dict[bytes, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stretches of all texts as bytes, and where those of each text begin; a space goes before each text."""
        texts = pc.replace_substring(filled(texts), SPACE, " ")
        started = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        sizes = pc.binary_length(started).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(started)], started.cast(pa.binary())), b"")[0].as_buffer()
        data = np.frombuffer(joined, np.uint8)
        firsts = np.cumsum(sizes) - sizes
        cut = np.zeros(len(data) + 1, bool)
        cut[len(data)] = True
        cut[firsts[sizes > 0]] = True
        space = data == 32
        cut[1:-1] |= space[1:] & ~space[:-1]
        lone = self.lone[data]
        cut[:-1] |= lone
        cut[1:] |= lone
        offsets = np.flatnonzero(cut)
        units = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), joined]
        ) if len(offsets) > 1 else pa.array([], pa.binary())
        return units, np.append(np.searchsorted(offsets[:-1], firsts), len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), and how many each text has."""
        units, bounds = self._cut(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        get = self.slots.get
        slots = np.fromiter((get(u, -1) for u in distinct), np.int64, len(distinct))
        new = sorted(np.flatnonzero(slots < 0).tolist(), key=lambda k: len(distinct[k]) > self.longest_unit)
        fresh = [distinct[k] for k in new]
        found = self.vocabulary.encode([t.replace(" ", SPACE) for t in map(bytes.decode, fresh)])
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        slots[new] = len(self.lengths) + np.arange(len(new))
        all_lengths = np.concatenate([self.lengths, lengths])
        all_ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
        starts = np.cumsum(all_lengths, dtype=np.int64) - all_lengths
        short = sum(len(u) <= self.longest_unit for u in fresh)
        if keep := max(0, min(short, self.most_units - len(self.lengths))):
            self.slots.update(zip(fresh[:keep], slots[new[:keep]].tolist()))
            self.lengths = all_lengths[: len(self.lengths) + keep]
            self.ids = all_ids[: int(self.lengths.sum(dtype=np.int64))]
        of_unit = slots[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = all_lengths[of_unit].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(starts[of_unit] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return all_ids[at], np.diff(np.concatenate([[0], ends])[bounds])


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, path: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole ``text`` as the array ``ids``, without begin or end ids.

    ``decoded`` names a further column for the text that the ids give back: all
    of the text, but that the stand-in character of a space comes back as a space.

    Null or empty text: no ids, decoded empty. Characters of no piece become
    their bytes. Repeated rows: each is encoded. No rows: no rows. All other
    columns are kept; ``ids`` and ``decoded`` must not be among them.
    """
    added = [ids, *([decoded] if decoded else [])]
    if {c.lower() for c in added} & {c.lower() for c in docs.columns} or len({c.lower() for c in added}) < len(added):
        raise ValueError(f"docs has a column of {added}, or they are the same")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in pieces(batches):
            found, counts = encoder.encode(batch.column("text").cast(pa.string()))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
            columns = [*batch.columns, lists]
            if decoded:
                texts = encoder.vocabulary.model.decode(lists.to_pylist(), num_threads=1) if len(lists) else []
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(encode, f"{schema}, `{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text ``into`` of its arrays ``ids``; null or empty ids give an empty text.

    All other columns are kept; ``into`` must not be among them.
    """
    if into.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"there is a column {into}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(path).vocabulary.model
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [found or [] for found in part.column(ids).to_pylist()]
                texts = pa.array(model.decode(lists, num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, into])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, f"{schema}, `{into}` string")
