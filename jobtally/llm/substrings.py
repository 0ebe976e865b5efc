"""Substring dedup by hashes of fixed windows of words.

No suffix tree or order is built. Each window is hashed to 64 bits and sent to a group, a range
of a code of its words; hashes that a group holds twice are repeated windows, and words are not
compared. The code opens with the first two words, goes on with all of the window, and is hashed
apart from the fingerprint. Ranges are cut so that groups hold about as many windows, by counts
over the first two words and in equal parts of the code beyond, over which windows spread evenly
whatever words they begin with. Repeated windows at neighbouring places merge into the removed
spans of each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import free_name, pieces
from .words import WHITE_SPACE, Words, mix, rolling, split, window_hash

SHALLOW = 12  # bits of the code that the first two words fill, six each
CODE = 48  # the whole window fills the rest
MOST_GROUPS = 1 << 20  # their first codes are broadcast, eight bytes each


def suffixes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (word number), prefix code and fingerprint of each suffix of at least ``window`` words."""
    counts = np.maximum(0, np.diff(words.bounds) - window + 1)
    ends = np.cumsum(counts)
    places = np.repeat(words.bounds[:-1] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    hashes = words.hashes()
    prints = window_hash(rolling(hashes), places, places + window)
    salted = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))  # not the bits that the fingerprint is made of
    code = window_hash(rolling(salted), places, places + window) >> np.uint64(64 - CODE + SHALLOW)
    for k in range(min(2, window)):  # a window of one word has a shorter prefix
        code |= (salted[places + k] >> np.uint64(64 - SHALLOW // 2)) << np.uint64(CODE - SHALLOW // 2 * (k + 1))
    return places, code, prints


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.Array]:
    table = pa.table({"text": column.cast(pa.string())})
    for batch in pieces(iter(table.to_batches())):
        yield batch.column("text")


def prefix_groups(texts: DataFrame, window: int, group_suffixes: int) -> tuple[np.ndarray, int]:
    """First codes of the groups but the first, and the bytes of all texts; one pass over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, size = np.zeros(1 << SHALLOW, np.int64), 0
        for batch in pieces(batches):
            size += batch.column("text").nbytes
            _, code, _ = suffixes(split(batch.column("text"), WHITE_SPACE), window)
            bins += np.bincount((code >> np.uint64(CODE - SHALLOW)).astype(np.int64), minlength=1 << SHALLOW)
        found = np.flatnonzero(bins)
        yield pa.RecordBatch.from_pydict({"bin": np.append(found, -1), "n": np.append(bins[found], size)})

    rows = texts.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = {r["bin"]: r["n"] for r in rows}
    size = counts.pop(-1, 0)
    group_suffixes = max(group_suffixes, -(-2 * sum(counts.values()) // MOST_GROUPS))
    firsts, held, width = [], 0, 1 << (CODE - SHALLOW)
    for prefix in sorted(counts):
        n = counts[prefix]
        if held and held + n > group_suffixes:
            firsts.append(prefix * width)
            held = 0
        held += n
        if held > group_suffixes:  # a common prefix is read to the window's end: its range is cut into equal parts
            parts = -(-held // group_suffixes)
            firsts += [prefix * width + width * k // parts for k in range(1, parts)] + [(prefix + 1) * width]
            held = 0
    return np.array(firsts, np.uint64), size


def packed(sorted_prints: np.ndarray) -> bytes:
    """Gaps of ascending numbers, byte by byte: the high bytes are alike and shrink in the shuffle."""
    gaps = np.diff(sorted_prints, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.uint64).ravel(), dtype=np.uint64)


def grouped_prints(column: pa.ChunkedArray, window: int, firsts: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The distinct fingerprints of a part by suffix group, ascending; and those it has twice or more."""
    prints, groups = [], []
    for texts in texts_of(column):
        _, code, found = suffixes(split(texts, WHITE_SPACE), window)
        prints.append(found)
        groups.append(np.searchsorted(firsts, code, side="right").astype(np.int32))
    if not prints:
        return {}, np.zeros(0, np.uint64)
    found, group = np.concatenate(prints), np.concatenate(groups)
    order = np.argsort(found)
    found, group = found[order], group[order]
    new = np.append(True, found[1:] != found[:-1])[: len(found)]
    again = np.unique(found[~new])
    found, group = found[new], group[new]
    order = np.argsort(group, kind="stable")
    found, group = found[order], group[order]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    return {int(group[a]): found[a:b] for a, b in zip(edges, np.append(edges[1:], len(group)))}, again


def repeated_in_group(table: pa.Table) -> pa.Table:
    """One group: for each part, which of its fingerprints other parts have too."""
    lists = [unpacked(data) for data in table.column("prints").to_pylist()]
    every = np.sort(np.concatenate(lists))  # each part names a fingerprint once
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    masks = [np.packbits(np.isin(found, twice, assume_unique=True)).tobytes() for found in lists]
    return pa.table({"part": table.column("part"), "group": table.column("group"), "mask": pa.array(masks, pa.binary())})


def cut(words: Words, removed: np.ndarray, row: int, first: int, stop: int) -> tuple[str, list[dict]]:
    """A text (bytes ``first`` to ``stop``) without its removed words and the white space after them; their ranges."""
    low, high = int(words.bounds[row]), int(words.bounds[row + 1])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], removed[low:high], [False]]).view(np.int8)))
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    out, at = [], first
    for a, b in spans:
        out.append(words.data[at : words.starts[low + a]].tobytes())
        at = int(words.starts[low + b]) if low + b < high else stop
    out.append(words.data[at:stop].tobytes())
    return b"".join(out).decode(), [{"start": a, "end": b} for a, b in spans]


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    into: str = "repeats",
    group_suffixes: int = 1 << 20,
    part_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` without words inside repeated windows, and a struct ``into`` of what was removed.

    Words are runs of other than ASCII white space, unchanged. Each run of
    ``window`` words that begins anywhere else too, in any document or the same,
    is removed wherever it stands, the first place included; windows are judged
    on the input. ``text`` loses those words and the white space after them;
    a text without any stays as it is. The struct: ``n_words``, ``n_removed``,
    ``spans`` (removed word ranges, merged windows).

    Documents are dealt into parts of about ``part_bytes`` by a hash of id and text. A part names each
    of its fingerprints once to the group of its prefix, so a passage in a third of all
    documents weighs no more in its group than one in every part. Windows are
    compared by 64-bit hashes inside a group of about ``group_suffixes``, or more
    where there would be over ``MOST_GROUPS`` groups. A window that many parts have counts once for each.
    Rows equal in id and text are one part, however many.
    The text is shuffled once and read from that shuffle twice.

    Null text: no words, stays null. Texts shorter than the window: unchanged.
    Repeated rows: each repeats the others. No rows: no rows. Other columns are
    kept; ``into`` must not be one of them.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    spark = docs.sparkSession
    firsts, size = prefix_groups(docs.select(F.col("text").cast("string").alias("text")), window, group_suffixes)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * part_bytes)))
    parts = 4 * tasks  # several to a task, so that their hashes spread evenly over tasks
    part = free_name(docs, "part_")
    keys = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(parts))).repartition(tasks, part)
    held = spark.sparkContext.broadcast(firsts)

    def name_prints(table: pa.Table) -> pa.Table:
        groups, _ = grouped_prints(table.column("text"), window, held.value)
        return pa.table(
            {
                "part": pa.array([table.column(part)[0].as_py()] * len(groups), pa.int64()),
                "group": pa.array(list(groups), pa.int64()),
                "prints": pa.array([packed(found) for found in groups.values()], pa.binary()),
            }
        )

    def remove(table: pa.Table, masks: pa.Table) -> pa.Table:
        names = [c for c in table.schema.names if c != part]
        groups, again = grouped_prints(table.column("text"), window, held.value)
        repeated = [again] + [
            groups[g][np.unpackbits(np.frombuffer(mask, np.uint8), count=len(groups[g])).astype(bool)]
            for g, mask in zip(masks.column("group").to_pylist(), masks.column("mask").to_pylist())
        ]
        repeated = np.unique(np.concatenate(repeated))
        texts_out: list[str | None] = []
        found: list[dict] = []
        for texts in texts_of(table.column("text")):
            words = split(texts, WHITE_SPACE)
            places, _, prints = suffixes(words, window)
            spot = np.searchsorted(repeated, prints)
            spot[spot == len(repeated)] = 0
            hit = places[repeated[spot] == prints] if len(repeated) else places[:0]
            steps = np.bincount(hit, minlength=len(words.starts) + 1) - np.bincount(hit + window, minlength=len(words.starts) + 1)
            removed = np.cumsum(steps)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(removed)])
            n_removed = np.diff(before[words.bounds])
            plain = texts.to_pylist()
            sizes = np.array([0 if t is None else len(t.encode()) for t in plain], np.int64)
            ends = np.cumsum(sizes + 1) - 1
            for row, text in enumerate(plain):
                spans: list[dict] = []
                if n_removed[row]:
                    text, spans = cut(words, removed, row, int(ends[row] - sizes[row]), int(ends[row]))
                texts_out.append(text)
                n_words = int(words.bounds[row + 1] - words.bounds[row])
                found.append({"n_words": n_words, "n_removed": int(n_removed[row]), "spans": spans})
        kind = pa.struct(
            [("n_words", pa.int64()), ("n_removed", pa.int64()),
             ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        )
        columns = {c: table.column(c) for c in names}
        columns["text"] = pa.array(texts_out, pa.string())
        return pa.table([*columns.values(), pa.array(found, kind)], names=[*names, into])

    masks = (  # from whole rows, so that both readers share one shuffle
        dealt.groupBy(part)
        .applyInArrow(name_prints, "part long, group long, prints binary")
        .groupBy("group").applyInArrow(repeated_in_group, "part long, group long, mask binary")
    )
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += f", {into} struct<n_words:bigint,n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>>"
    return dealt.groupBy(part).cogroup(masks.groupBy("part")).applyInArrow(remove, schema)


def deduplicate_substrings(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with repeated windows cut out of their texts; cases as in :func:`remove_repeats`."""
    into = free_name(docs, "repeats")
    return remove_repeats(docs, into=into, **options).select(*docs.columns)
