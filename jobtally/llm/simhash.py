"""SimHash near-dedup: pigeonring candidates, chains of segments, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .batches import free_name, pieces
from .components import connected_components
from .words import WHITE_SPACE, split

SEGMENTS, SEGMENT_BITS = 4, 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[65:91] += 32
_SPACED[WHITE_SPACE] = 32


def fingerprints_of(texts: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included; zero without words."""
    words = split(texts, WHITE_SPACE)
    starts, ends, bounds = words.starts, words.ends, words.bounds
    n_words = np.diff(bounds)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(1, n_words))
    total = np.cumsum(counts)
    first = np.repeat(bounds[:-1] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
    row = np.repeat(np.arange(len(counts)), counts)
    last = np.minimum(first + shingle, bounds[1:][row]) - 1
    raw, digest = _SPACED[words.data].tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first)
    )
    if len(starts) > 1:  # where words stand further apart, their bytes are not the shingle
        far = np.concatenate([[0], np.cumsum(starts[1:] - ends[:-1] > 1)])
        for k in np.flatnonzero(far[last] > far[first]).tolist():
            hashes[k] = digest(b" ".join(raw[starts[first[k]] : ends[last[k]]].split()), seed)
    out = np.zeros(len(counts), np.uint64)
    for lane in range(8):
        byte = ((hashes >> np.uint64(8 * lane)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(row * 256 + byte, minlength=256 * len(counts)).reshape(-1, 256) @ _BITS
        out |= np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * lane)
    return out


def fingerprints(docs: DataFrame, keys: list[Column], shingle: int) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint of the whole ``text``, as a signed long."""
    rows = docs.select(*keys, F.col("text").cast("string").alias("text_"))
    names = rows.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_"):
            found = pa.array(fingerprints_of(batch.column("text_"), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), found], names=[*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(scan, f"{schema}, fp long")


def links(x: np.ndarray, segment: int, most: int) -> np.ndarray:
    """Which differences ``x`` (fingerprints xor-ed) have a viable chain from ``segment`` and at most ``most`` bits.

    Of the ring of segments, the first ``l`` of a chain may differ in
    ``l * most / 4`` bits together, for every ``l``; some chain of any pair within ``most`` bits does.
    """
    x = x.ravel()
    shift = np.uint64(SEGMENT_BITS * segment)
    if segment:
        x = (x >> shift) | (x << (np.uint64(64) - shift))
    alive = np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (SEGMENT_BITS * length)) - 1)
        alive = alive[np.bitwise_count(x[alive] & mask) <= length * most // SEGMENTS]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def spanning(prints: np.ndarray, segment: int, most: int, cells: int = 1 << 21) -> np.ndarray:
    """For each print of a group, the smallest one its links within the group reach; pairs are not kept."""
    label = prints.copy()
    open_ = np.argsort(prints.view(np.int64))
    while len(open_):
        root, frontier, open_ = open_[0], open_[:1], open_[1:]
        while len(frontier) and len(open_):
            reached = np.zeros(len(open_), bool)
            step = max(1, cells // len(open_))
            for at in range(0, len(frontier), step):
                x = prints[frontier[at : at + step]][:, None] ^ prints[open_][None, :]
                reached |= links(x, segment, most).reshape(x.shape).any(0)
            label[open_[reached]] = prints[root]
            frontier, open_ = open_[reached], open_[~reached]
    return label


def link_groups(prints: DataFrame, most: int, block: int) -> DataFrame:
    """Edges ``(u, v)`` between fingerprints that hold every component of links of at most ``most`` bits.

    Pigeonring: with four segments some segment is equal and the next differs in
    one bit at most, so one half of that is equal too. Prints meet by that
    segment and half: eight keys of 24 bits each. A key with more than
    ``block`` prints is dealt out as pairs of blocks, each pair a group of its own.
    """
    fp = F.col("fp")

    def segment(k: int) -> Column:
        return F.shiftrightunsigned(fp, SEGMENT_BITS * (k % SEGMENTS)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))

    keys = [
        F.shiftleft(F.lit(2 * k + half).cast("long"), 24)
        + F.shiftleft(segment(k), 8)
        + F.shiftrightunsigned(segment(k + 1), 8 * half).bitwiseAND(F.lit(255))
        for k in range(SEGMENTS) for half in range(2)
    ]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("lo"), F.greatest(own, k).alias("hi"))
    )
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    dealt = (
        keyed.join(hot, "key", "left")
        .select("key", "fp", F.explode(F.when(F.col("n").isNull(), one).otherwise(pairs)).alias("b"))
        .select("key", "b.lo", "b.hi", "fp")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            us, vs = [], []
            edge = np.flatnonzero((np.diff(rows[:3]) != 0).any(0)) + 1
            starts = np.concatenate([[0], edge])
            stops = np.append(edge, rows.shape[1])
            for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
                group = rows[3, a:b].view(np.uint64)
                label = spanning(group, int(rows[0, a]) >> 25, most)
                other = label != group
                us.append(group[other])
                vs.append(label[other])
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            new = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            held = np.concatenate([held, new], axis=1)
            if held.shape[1]:
                begins = np.flatnonzero((held[:3] != held[:3, -1:]).any(0))
                cut = int(begins[-1]) + 1 if len(begins) else 0  # the last group may go on in the next batch
                if cut:
                    yield edges(held[:, :cut])
                    held = np.ascontiguousarray(held[:, cut:])
        if held.shape[1]:
            yield edges(held)

    return dealt.mapInArrow(scan, "u long, v long")


def clusters(
    docs: DataFrame, keys: list[Column], shingle: int = 3, most_bits: int = 3, block: int = 20_000
) -> DataFrame:
    """``keys``, ``fp`` and ``least``: the smallest ``struct(keys)`` of the component of the row.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; a shingle is
    ``shingle`` words joined by a space, or all words of a shorter text. A bit of
    the fingerprint is set if over half of the shingles' XXH64 hashes (seed 42)
    have it. Fingerprints that differ in at most ``most_bits`` are linked.
    Equal fingerprints are one node, so copies make no pairs.

    Null, empty or blank text: fingerprint zero, linked like any other. Repeated
    rows: each gets its row. No rows: no rows. Other columns are not read.
    """
    if not 0 <= most_bits < SEGMENTS:
        raise ValueError(f"most_bits must be below {SEGMENTS}, the number of segments")
    stored = materialize(fingerprints(docs, keys, shingle))
    names = [c for c in stored.columns if c != "fp"]
    prints = materialize(stored.groupBy("fp").agg(F.min(F.struct(*names)).alias("least")))
    roots = connected_components(link_groups(prints.select("fp"), most_bits, block))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_print = rooted.select("fp", "root").join(least, "root").select("fp", "least")
    return stored.join(of_print, "fp").select(*names, "fp", "least")


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: 16 hex digits, and the smallest ``doc_id`` reached over links.

    Null ids count as no id: a component of them alone has none. Other cases as in :func:`clusters`.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"))
    found = clusters(docs, [order.alias("key")], shingle, most_bits)
    return found.select(
        F.col("key.doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.key.doc_id").alias("component_id"),
    )


def deduplicate_near(docs: DataFrame, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """One row of each component of near duplicates: that of the smallest ``doc_id`` (null last), then text hash.

    Rows that agree in both are one row more than once; one of them stays. All
    columns are kept as they are.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text")
    )
    found = clusters(docs, [key.alias("key")], shingle, most_bits)
    chosen = found.where(F.col("key") == F.col("least.key")).groupBy("key").agg(F.count("*").alias("n"))
    chosen = materialize(chosen.select(F.xxhash64("key").alias("h"), F.col("key").alias("k"), "n"))
    h, k, n = (free_name(docs, name) for name in ("h_", "k_", "n_"))
    marked = docs.withColumn(k, key).withColumn(h, F.xxhash64(k))
    renamed = chosen.select(F.col("h").alias(h + "2"), F.col("k").alias(k + "2"), F.col("n").alias(n))
    kept = marked.join(renamed, (F.col(h) == F.col(h + "2")) & F.col(k).eqNullSafe(F.col(k + "2")))
    if chosen.where("n > 1").isEmpty():
        return kept.select(*docs.columns)
    return kept.dropDuplicates([h, k]).select(*docs.columns)
