"""Packing of token ids into fixed windows: least-squares repeat counts, then greedy filling.

Documents are cut at every full window; what is left of each, its tail, is
placed by repeat counts of length combinations that fill a window exactly. The
counts solve a non-negative least-squares problem against the histogram of all
tails of the corpus. Each task rounds its share of the counts down, and fills
the gaps and packs the rest greedily, cutting a tail where none fits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .batches import pieces
from .bitpack import bits_for, pack, unpack
from .tokens import encoder, with_end

UNITS = 128  # length classes in a window
TOKENS = "doc_id long, n_tokens long, width int, packed binary"
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``(doc_id, n_tokens, width, packed)``: all ids of each document, its end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        width = bits_for(max(words.vocabulary, end_id + 1))
        width = -(-width // 8) * 8
        for batch in pieces(batches):
            ids, counts = with_end(*words.encode(batch.column("text")), end_id)
            data = pack(ids, width)
            offsets = np.concatenate([[0], np.cumsum(counts) * (width // 8)]).astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(np.full(len(counts), width, np.int32)), packed],
                names=["doc_id", "n_tokens", "width", "packed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, TOKENS)


def combinations(classes: list[int], units: int = UNITS) -> np.ndarray:
    """Length combinations of up to three pieces, or of two lengths repeated, that fill ``units``.

    One row a combination; column ``k`` counts its pieces of class ``k + 1``.
    """
    have, found = set(classes), set()
    for a in classes:
        for m in range(1, units // a + 1):
            rest = units - a * m
            if not rest:
                found.add(((a, m),))
            for b in classes if rest else ():
                if b > rest:
                    break
                if b != a and rest % b == 0:
                    found.add(tuple(sorted(((a, m), (b, rest // b)))))
        for b in classes:
            c = units - a - b
            if a < b < c and c in have:
                found.add(((a, 1), (b, 1), (c, 1)))
    out = np.zeros((len(found), units))
    for row, combination in enumerate(sorted(found)):
        for length, count in combination:
            out[row, length - 1] = count
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """``x >= 0`` that minimises ``|a x - b|``, by an active set: one column enters at a time."""
    x = np.zeros(a.shape[1])
    inside: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[inside] = -np.inf
        best = int(np.argmax(gradient)) if len(gradient) else 0
        if not len(gradient) or gradient[best] <= tolerance:
            break
        inside.append(best)
        while inside:
            solved = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[inside] = solved
                break
            now = x[inside]
            low = solved <= 0
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            x[inside] = now + step * (solved - now)
            gone = {i for i, bad in zip(inside, low) if bad and x[i] <= 1e-12 * max(1.0, x.max())}
            gone = gone or {inside[int(np.argmin(np.where(low, x[inside], np.inf)))]}
            x[list(gone)] = 0
            inside = [i for i in inside if i not in gone]
    return x


@dataclass
class Packer:
    """Packs the tails of one task; pieces are ``(document, start, length)``."""

    window: int
    patterns: np.ndarray
    shares: np.ndarray  # repeat counts for each tail of the corpus
    emit: list = field(default_factory=list)  # finished sequences, each a list of pieces

    def fill(self, sequence: list, gap: int, pool: list) -> int:
        """Adds tails from ``pool``, sorted by length, until the gap closes or the pool is empty."""
        while gap and pool:
            at = bisect_right(pool, gap, key=lambda p: p[2]) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:
                doc, start, length = pool.pop(bisect_left(pool, gap, key=lambda p: p[2]))
                piece = (doc, start, gap)
                insort(pool, (doc, start + gap, length - gap), key=lambda p: p[2])
            sequence.append(piece)
            gap -= piece[2]
        return gap

    def pack(self, tails: list, last: bool) -> list:
        """Emits full sequences of ``tails``; returns the pieces left over, none if ``last``."""
        unit = self.window // UNITS
        classes: list[list] = [[] for _ in range(UNITS + 1)]
        for piece in tails:
            classes[-(-piece[2] // unit)].append(piece)
        open_sequences = []
        counts = np.floor(self.shares * len(tails) + 1e-9).astype(np.int64)
        for row in np.argsort(-counts, kind="stable"):
            if not counts[row]:
                break
            need = [(k + 1, int(m)) for k, m in enumerate(self.patterns[row]) if m]
            for _ in range(min(int(counts[row]), *(len(classes[k]) // m for k, m in need))):
                sequence = [classes[k].pop() for k, m in need for _ in range(m)]
                open_sequences.append(sequence)
        pool = sorted((p for pieces_ in classes for p in pieces_), key=lambda p: p[2])
        while open_sequences:
            sequence = open_sequences.pop()
            gap = self.window - sum(p[2] for p in sequence)
            while gap and (pool or open_sequences):
                if not pool:  # nothing left to fill gaps with: one sequence goes back
                    pool = sorted(open_sequences.pop(), key=lambda p: p[2])
                gap = self.fill(sequence, gap, pool)
            if gap:
                pool = sorted(sequence, key=lambda p: p[2])
            else:
                self.emit.append(sequence)
        total = sum(p[2] for p in pool)
        while total >= self.window:
            sequence: list = []
            self.fill(sequence, self.window, pool)
            self.emit.append(sequence)
            total -= self.window
        if not last:
            return pool
        while total:  # a sequence whose length is a power of two needs no padding
            size = 1 << (total.bit_length() - 1)
            sequence = []
            self.fill(sequence, size, pool)
            self.emit.append(sequence)
            total -= size
        return []


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, chunk_tokens: int = 1 << 22
) -> DataFrame:
    """Packs all ``docs`` into sequences of at most ``window`` ids; one row a piece.

    ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)``: the piece
    holds the ids ``start .. start + length`` of its document, at ``offset`` of
    its sequence; ``ids`` are little-endian unsigned 32-bit. Sequences are full
    but for the last few of a task, whose lengths are powers of two. A task holds about
    ``chunk_tokens`` ids at a time and carries its leftovers on. What meets on
    the driver is the histogram of tail lengths, at most ``window`` rows.

    Null or empty text: one piece, the end id. Null ``doc_id``: kept as null.
    Repeated rows: each is a document of its own. No rows: no pieces. Other
    columns are not read. A very long text: cut at every full window.
    """
    if window % UNITS:
        raise ValueError(f"the window must be a multiple of {UNITS}")
    stored = materialize(tokenized(docs, tokenizer, end_id))
    unit = window // UNITS
    histogram = np.zeros(UNITS)
    for row in (
        stored.select((F.col("n_tokens") % window).alias("tail")).where("tail > 0").groupBy("tail").count().collect()
    ):
        histogram[-(-row["tail"] // unit) - 1] += row["count"]
    patterns = combinations([k + 1 for k in range(UNITS) if histogram[k]])
    weight = np.sqrt(np.arange(1, UNITS + 1))  # a long tail left over costs more
    repeats = non_negative_least_squares((patterns * weight).T, histogram * weight)
    used = np.flatnonzero(repeats > 0)
    patterns, shares = patterns[used], repeats[used] / max(1.0, histogram.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequences = TaskContext.get().partitionId() << 40, 0
        packer = Packer(window, patterns, shares)
        held: list[tuple] = []  # (doc_id, ids) by the numbers the pieces carry
        tails: list[tuple] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, held, tails
            left = packer.pack(tails, last)
            rows: list[list] = [[] for _ in range(7)]
            size = 0
            for sequence in packer.emit:
                offset = 0
                for doc, start, length in sequence:
                    doc_id, ids = held[doc]
                    piece = ids[start : start + length].astype("<u4").tobytes()
                    for column, value in zip(rows, (doc_id, start, length, len(ids), base + sequences, offset, piece)):
                        column.append(value)
                    offset += length
                    size += 4 * length
                sequences += 1
                if size > 1 << 23:
                    yield batch_of(rows)
                    rows, size = [[] for _ in range(7)], 0
            if rows[0]:
                yield batch_of(rows)
            packer.emit = []
            numbers = {doc: k for k, doc in enumerate(dict.fromkeys(p[0] for p in left))}
            held = [held[doc] for doc in numbers]
            tails = [(numbers[doc], start, length) for doc, start, length in left]

        waiting = 0
        for batch in pieces(batches, "packed"):
            for doc_id, count, width, packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = unpack(packed, count, width)
                doc = len(held)
                held.append((doc_id, ids))
                whole = count - count % window
                packer.emit += [[(doc, start, window)] for start in range(0, whole, window)]
                if count % window:
                    tails.append((doc, whole, count - whole))
                waiting += count
                if waiting >= chunk_tokens:
                    yield from flush(False)
                    waiting = 0
        yield from flush(True)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)

    return stored.mapInArrow(place, PIECES)
