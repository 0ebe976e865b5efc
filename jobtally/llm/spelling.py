"""Spelling variants: words one edit apart, and the form the rarer ones stand for.

Words are taken apart into grams of varying length: frequent short grams are
lengthened, so that no list of words with a gram is long for want of letters.
An edit at a given place can touch only the grams on it and a few behind it; all
others must be in the other word too. So the lists of all those grams are merged
at once, place by place, and what meets there is verified.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .batches import filled, pieces

SHORTEST, LONGEST = 2, 3  # letters of a gram
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)


def crc32_after(before: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts whose first parts have the CRCs ``before``, and whose rest is ``data[starts:starts + sizes]``."""
    state = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    for k in range(int(sizes.max(initial=0))):
        rows = order[: np.searchsorted(falling, -k)]
        state[rows] = _TABLE[(state[rows] ^ data[starts[rows] + k]) & 0xFF] ^ (state[rows] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF as bytes, A-Z lower-cased: data, starts, ends, runs before each text."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts.cast(pa.binary())), b"\n")[0].as_buffer()
    data = np.frombuffer(joined, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    inside = (data >= 97) & (data <= 122)
    two = data == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    inside |= two
    inside[1:] |= two[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return data, starts, ends, np.append(np.searchsorted(starts, np.cumsum(sizes + 1) - (sizes + 1)), len(starts))


def count_words(docs: DataFrame, least_length: int = 7, slip_one_in: int | None = None) -> DataFrame:
    """``(word, n)``: the letter runs of all texts, lower-cased (A-Z only), of at least ``least_length`` letters.

    ``slip_one_in`` plants misspellings, to measure the grouping by: of each
    ``<doc_id>:<run>`` whose CRC-32 it divides, one letter is left out, the one
    that the CRC modulo the length names. Counts of a batch reach the shuffle.

    Null or empty text: no words. A null ``doc_id`` reads as an empty one.
    Repeated rows count again. No rows: no rows. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=8 << 20):
            data, starts, ends, bounds = letter_runs(filled(batch.column("text").cast(pa.string())))
            firsts = np.concatenate([[0], np.cumsum(data == 0xC3)])
            of_doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            letters = ends - starts - (firsts[ends] - firsts[starts])
            long = np.flatnonzero(letters >= least_length)
            starts, sizes, letters, of_doc = starts[long], (ends - starts)[long], letters[long], of_doc[long]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            packed = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))]
            runs = pa.Array.from_buffers(
                pa.binary(), len(long), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed)]
            ).dictionary_encode()
            of_run = runs.indices.to_numpy(zero_copy_only=False)
            slips: Counter[bytes] = Counter()
            kept = np.ones(len(long), bool)
            if slip_one_in:
                keys = batch.column("doc_id").cast(pa.string()).to_pylist()
                before = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
                short = sizes <= 64
                crc = np.zeros(len(long), np.uint32)
                crc[short] = crc32_after(before[of_doc[short]], packed, offsets[:-1][short], sizes[short])
                for k in np.flatnonzero(~short):
                    crc[k] = zlib.crc32(packed[offsets[k] : offsets[k + 1]].tobytes(), int(before[of_doc[k]]))
                kept = crc % slip_one_in != 0
                for k in np.flatnonzero(~kept & (letters > least_length)).tolist():
                    word = packed[offsets[k] : offsets[k + 1]].tobytes().decode()
                    at = int(crc[k]) % len(word)
                    slips[(word[:at] + word[at + 1 :]).encode()] += 1
            counts = np.bincount(of_run[kept], minlength=len(runs.dictionary))
            some = np.flatnonzero(counts)
            words = pa.concat_arrays([runs.dictionary.take(pa.array(some)), pa.array(list(slips), pa.binary())])
            numbers = np.concatenate([counts[some], np.fromiter(slips.values(), np.int64, len(slips))])
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, one_in: int) -> frozenset[str]:
    """The grams short of ``LONGEST`` that are more than one in ``one_in`` of the grams of their length.

    So there are fewer than ``one_in`` of each length, however many words there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word in batch.column("word").to_pylist():
                for size in range(SHORTEST, LONGEST):
                    found.update(word[k : k + size] for k in range(len(word) - size + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"]
            )

    counted = words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    totals = counted.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("total"))
    frequent = counted.join(F.broadcast(totals), F.length("gram") == F.col("size"))  # one row a length
    return frozenset(r["gram"] for r in frequent.where(F.col("n") * one_in > F.col("total")).select("gram").collect())


def variable_grams(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """Start and end of each gram: lengthened while frequent, and none inside another."""
    grams, reached = [], 0
    for start in range(len(word) - SHORTEST + 1):
        end = start + SHORTEST
        while end < len(word) and end - start < LONGEST and word[start:end] in frequent:
            end += 1
        if end > reached:
            grams.append((start, end))
            reached = end
    return grams


def edit_sites(word: str, frequent: frozenset[str]) -> dict[tuple[int, int], int]:
    """Where the word may be edited: from the end of the last gram before that must stay to the start of the first behind.

    Grams that end before an edit stay, as lengthening reads no further than the
    gram, unless the word's end alone kept them short. One that starts behind it stays unless a gram through the edit may
    swallow it: one that ends at most ``LONGEST - 2`` letters behind the edit's
    next letter, all of it but the last letter frequent. The values tell the
    edits: 1 a letter replaced or taken out there, 2 a letter put in.
    """
    grams, size = variable_grams(word, frequent), len(word)
    last_end = [0] * (size + 1)
    for start, end in grams:
        if end < size or end - start == LONGEST or word[start:end] not in frequent:  # not cut short by the word's end
            last_end[end] = end
    for k in range(1, size + 1):
        last_end[k] = last_end[k] or last_end[k - 1]
    first_start = [size] * (size + 2)  # of the grams that stay when the letters from here on do
    behind = len(grams)
    for at in range(size, -1, -1):
        while behind and grams[behind - 1][0] >= at:
            behind -= 1
        for k in range(behind, min(behind + LONGEST + 1, len(grams))):  # the next but a few stays in any case
            start, end = grams[k]
            if end - 1 - at > LONGEST - 2 or end - 1 - at >= SHORTEST and word[at : end - 1] not in frequent:
                first_start[at] = start
                break
    sites: dict[tuple[int, int], int] = {}
    for at in range(size + 1):
        site = (last_end[at], first_start[at])
        sites[site] = sites.get(site, 0) | 2
        if at < size:
            site = (last_end[at], first_start[at + 1])
            sites[site] = sites.get(site, 0) | 1
    return sites


_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79_2468ACE1 % ((1 << 61) - 1)


def site_keys(word: str, sites: Iterable[tuple[int, int]]) -> list[int]:
    """A hash of the letters outside each site, from those of the word's beginnings and ends."""
    before, after = [0], [0]
    for letter in word:
        before.append((before[-1] * _BASE + ord(letter) + 1) % _PRIME)
    for letter in reversed(word):
        after.append((after[-1] * _BASE + ord(letter) + 1) % _PRIME)
    size = len(word)
    return [((before[left] * 3 + left) * _BASE + after[size - right] * 5 + size - right) % _PRIME for left, right in sites]


def _sites(words: DataFrame, frequent: frozenset[str]) -> DataFrame:
    """``(word, n, key, left, right, edits)``: a row a word and site; ``key`` is a hash of the letters outside the site.

    Different letters of one hash only make words meet that are found not to be near.
    """

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word", 1 << 14):
            words = batch.column("word").to_pylist()
            found = [edit_sites(word, frequent) for word in words]
            taken = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            keys = np.array([k for word, f in zip(words, found) for k in site_keys(word, f)], np.int64)
            places = np.array([(*site, edits) for f in found for site, edits in f.items()], np.int32).reshape(-1, 3)
            rows = [taken, *map(pa.array, (keys, *places.T))]
            step = max(1, (8 << 20) // max(map(len, words)))  # a long word comes once for each of its letters
            for at in range(0, len(taken), step):
                which, *rest = [r.slice(at, step) for r in rows]
                columns = [batch.column("word").take(which), batch.column("n").take(which), *rest]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "key", "left", "right", "edits"])

    return words.select("word", "n").mapInArrow(
        take_apart, "word string, n bigint, key bigint, left int, right int, edits int"
    )


TAKEN_OUT = 4  # of edits: 1 replaced or taken out, 2 put in, 4 taken out only


def _split_long_lists(sites: DataFrame, longest_list: int) -> DataFrame:
    """``(word, n, left, right, key, edits)``: sites, those of keys of more than ``longest_list`` told apart by all their letters but one."""
    long = sites.groupBy("key").count().where(F.col("count") > longest_list).select(F.col("key").alias("long_key"))
    long = materialize(long)  # its size is then known, so sites stay where they are unless it is large
    joined = sites.join(long, F.col("key") == F.col("long_key"), "left")
    length = F.col("right") - F.col("left")
    middle, nothing = F.substring("word", F.col("left") + 1, length), F.array().cast("array<struct<key: bigint, edits: int>>")
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))

    def without(k: Column) -> Column:
        return F.concat(F.substring(middle, F.lit(1), k - 1), F.substring(middle, k + 1, length))

    def entry(edits: int, *parts: Column) -> Column:
        return F.struct(F.xxhash64("key", *parts).alias("key"), F.lit(edits).alias("edits"))

    one, two = F.col("edits").bitwiseAND(1) > 0, F.col("edits").bitwiseAND(2) > 0
    replaced = F.transform(places, lambda k: entry(1, k, without(k)))
    taken_out = F.transform(places, lambda k: entry(TAKEN_OUT, F.lit(0), without(k)))
    put_in = F.array(entry(2, F.lit(0), middle))
    split = F.concat(
        F.when(one, F.concat(replaced, F.array_distinct(taken_out))).otherwise(nothing), F.when(two, put_in).otherwise(nothing)
    )
    whole = F.array(F.struct("key", "edits"))
    lists = F.when(F.col("long_key").isNull(), whole).otherwise(split).alias("lists")
    kept = ["word", "n", "left", "right"]
    return joined.select(*kept, lists).select(*kept, F.inline("lists"))


def near_words(words: DataFrame, one_in: int = 1000, longest_list: int = 1000) -> DataFrame:
    """``(word, n, near, near_n)``: both ways, each pair of ``words`` that differ by one letter put in, left out or replaced.

    Grams more frequent than one in ``one_in`` are lengthened. A list of more than
    ``longest_list`` words is split by its words' letters at the site, so that
    what meets in its parts differs in one letter.

    Words are distinct and not null. No words: no rows.
    """
    frequent = frequent_grams(words, one_in)
    sites = materialize(_sites(words, frequent))
    lists = _split_long_lists(sites, longest_list)
    a = lists.select(*[F.col(c).alias(f"a_{c}") for c in lists.columns])
    b = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])

    def has(side: str, edits: int) -> Column:
        return F.col(f"{side}_edits").bitwiseAND(edits) > 0

    def size(side: str) -> Column:
        return F.length(f"{side}_word")

    def part(side: str, which: int) -> Column:
        """The letters before, in and behind the site."""
        word, left, right = (F.col(f"{side}_{c}") for c in ("word", "left", "right"))
        start, stop = [(F.lit(0), left), (left, right), (right, F.length(word))][which]
        return F.substring(word, start + 1, stop - start)

    replaced = has("a", 1) & has("b", 1) & (size("a") == size("b")) & (F.col("a_word") < F.col("b_word"))
    longer = has("a", 2) & has("b", 1 | TAKEN_OUT) & (size("a") + 1 == size("b"))
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & (replaced | longer))
    same = (F.col("a_left") == F.col("b_left")) & (part("a", 0) == part("b", 0)) & (part("a", 2) == part("b", 2))
    met = met.where(same & (F.levenshtein(part("a", 1), part("b", 1), 1) == 1))
    pairs = met.select("a_word", "a_n", "b_word", "b_n").distinct()
    def way(word: str, near: str) -> Column:
        names = {f"{word}_word": "word", f"{word}_n": "n", f"{near}_word": "near", f"{near}_n": "near_n"}
        return F.struct(*[F.col(c).alias(name) for c, name in names.items()])

    both = F.array(way("a", "b"), way("b", "a"))
    return pairs.select(F.inline(both))


def group_variants(words: DataFrame, ratio: int = 10, **limits: int) -> DataFrame:
    """``words`` (``word``, ``n``), each with the form it is a variant of, and the form that comes of following forms.

    ``form`` is the most frequent of the near words (the first of equals), if it
    is at least ``ratio`` times as frequent; else null, as is ``form_n``. ``root``
    is where forms lead in the end, the word itself without one. ``n_near``
    counts near words.

    Null words are left out; words must be distinct. No words: no rows. Other columns are not kept.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in a circle")
    words = words.where(F.col("word").isNotNull()).select("word", "n")
    best = near_words(words, **limits).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ))
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    largest = formed.agg(F.max("n")).first()[0] or 1
    links = max(1, math.ceil(math.log(max(largest, 2), ratio)))  # counts grow by the ratio with every link
    for _ in range(math.ceil(math.log2(links)) if links > 1 else 0):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
