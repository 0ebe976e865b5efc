"""Fill-in-middle: documents cut in three and put together in another order.

Texts are cut as bytes. Only the places of characters longer than a byte are
recorded, with the bytes they take beyond one; between them ASCII needs no count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .batches import filled, pieces
from .words import WHITE_SPACE, split

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("tokens", "characters")
FIELDS = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


class ByteIndex:
    """Between code points and bytes of UTF-8 ``data``, by its longer characters alone.

    ``places`` are the bytes at which these start, ``points`` their numbers among
    the code points, ``excess[k]`` the bytes beyond one that the first ``k`` take.
    """

    def __init__(self, data: np.ndarray):
        self.places = np.flatnonzero(data >= 0xC0)
        lead = data[self.places]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.points = self.places - self.excess[:-1]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """How many code points lie before each byte, which starts a character or ends the data."""
        return places - self.excess[np.searchsorted(self.places, places)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """The byte at which each code point starts."""
        return points + self.excess[np.searchsorted(self.points, points)]


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits from a text."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut_texts(texts: pa.Array, drawn: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text; its parts as bytes of the joined texts, and as code points.

    ``drawn`` has two numbers a text, each of which falls on one of its ``n + 1`` places.
    """
    words = split(texts, WHITE_SPACE)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    stops = starts + sizes
    index = ByteIndex(words.data)
    if unit == "characters":
        first = index.to_points(starts)
        n = index.to_points(stops) - first
        cuts = index.to_bytes(first[:, None] + np.sort(drawn % (n + 1)[:, None], axis=1))
    else:
        known = np.diff(words.bounds)
        ends = np.append(words.ends, 0)
        last = np.where(known > 0, ends[words.bounds[1:] - 1], starts)
        n = known + (last < stops)  # white space that ends a text is a token of its own
        chosen = np.sort(drawn % (n + 1)[:, None], axis=1)
        at_word = ends[np.minimum(words.bounds[:-1, None] + np.maximum(chosen - 1, 0), len(words.ends))]
        cuts = np.where(chosen == 0, starts[:, None], np.where(chosen > known[:, None], stops[:, None], at_word))
    places = np.column_stack([starts, cuts, stops])
    return n, places, index.to_points(places), words.data


def transform_infill(
    docs: DataFrame, into: str = "infill", seed: int = 42, unit: str = "tokens", percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A token is a run of other characters with the white space before it, or the
    white space that ends a text; ``unit`` may also be ``characters``. Four
    numbers of 32 bits, from the SHA-256 of ``<seed>:<doc_id>``, draw the two cuts
    among the ``n + 1`` places, whether the text is transformed (``percent``), and
    whether the suffix then comes first, ``spm`` (``spm_percent``), or the prefix,
    ``psm``. Otherwise ``form`` is ``plain``, the output the text, and both
    lengths, in code points, are null. A text that holds one of the marks stays
    plain, so that every output can be undone.

    Null or empty text: plain and empty. A null ``doc_id`` reads as an empty one.
    Repeated rows come out alike. No rows: no rows. All other columns are kept;
    ``into`` must not be one of them.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    prefix, suffix, middle = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = filled(batch.column("text").cast(pa.string()))
            keys = batch.column("doc_id").cast(pa.string()).to_pylist()
            drawn = np.array([draws(f"{seed}:{'' if k is None else k}") for k in keys], np.int64).reshape(-1, 4)
            n, places, points, data = cut_texts(texts, drawn[:, :2], unit)
            marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
            plain = (places[:, 0] == places[:, 3]) | marked | (drawn[:, 2] % 100 >= percent)
            spm = drawn[:, 3] % 100 < spm_percent
            outputs = []
            for whole, back, (a, b, c, d) in zip(plain.tolist(), spm.tolist(), places.tolist()):
                if whole:
                    parts = [data[a:d].tobytes()]
                elif back:
                    parts = [suffix, data[c:d].tobytes(), prefix, data[a:b].tobytes(), middle, data[b:c].tobytes()]
                else:
                    parts = [prefix, data[a:b].tobytes(), suffix, data[c:d].tobytes(), middle, data[b:c].tobytes()]
                outputs.append(b"".join(parts))
            values = [
                pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
                pa.array(points[:, 1] - points[:, 0], mask=plain), pa.array(points[:, 2] - points[:, 1], mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            made = pa.StructArray.from_arrays([v.cast(k) for v, k in zip(values, kinds)], names=list(FIELDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    struct = ", ".join(f"{name}: {kind}" for name, kind in FIELDS.items())
    return docs.mapInArrow(transform, f"{schema}, `{into}` struct<{struct}>")


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transform_infill` was made of; null where either is null."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    )
