"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .batches import free_name, pieces
from .words import NOT_ALPHANUMERIC, Words, split

RANGES = "array<struct<start:bigint,end:bigint>>"
FOUND = f"struct<n_words:bigint,spans:{RANGES},bytes:{RANGES},items:array<string>>"


class SuffixAutomaton:
    """All runs of words of all items; a state stands for runs with the same ends.

    ``window`` words make a match; a shorter item matches as a whole.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window_items: dict[int, set[str]] = {}
        self.whole_items: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= window:
                    self.window_items.setdefault(self.suffix(state), set()).add(item)
            if 0 < len(words) < window:
                self.whole_items.setdefault(state, []).append((len(words), item))
        # the nearest state on the way along the suffix links that is a whole item
        self.whole_link = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.whole_link[state] = up if up in self.whole_items else self.whole_link[up]

    def _extend(self, last: int, word: bytes) -> int:
        if (there := self.next[last].get(word)) is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, word, there)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at][word]
            exact = self.length[there] == self.length[at] + 1
            self.link[new] = there if exact else self._split(at, word, there)
        return new

    def _state(self, length: int, transitions: dict[bytes, int]) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, there: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[there]))
        self.link[clone], self.link[there] = self.link[there], clone
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def suffix(self, state: int) -> int:
        """The state of the last ``window`` words of ``state``'s runs."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of ``words`` inside items, from the longest match at each word, and the items met."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = length = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            longest = length if length >= self.window else 0
            if longest:
                items |= self.window_items[self.suffix(state)]
            whole = state
            while whole:
                for size, item in self.whole_items.get(whole, ()):
                    if size <= length:
                        items.add(item)
                        longest = max(longest, size)
                whole = self.whole_link[whole]
            if longest:
                start = at + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, items


class Matcher:
    """The automaton with a quick exclusion of words that no match can hold.

    A match has only pairs of neighbours that an item has too. The pairs are
    looked up by hash, for all words of a batch at once, and the automaton
    reads only the runs that are left; it compares the words themselves.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = pa.array([text for _, text in items], pa.binary())
        words = split(texts, NOT_ALPHANUMERIC, lower=True)
        bounds = words.bounds.tolist()
        lists = [(item, words.text(a, b)) for (item, _), a, b in zip(items, bounds, bounds[1:])]
        lists = [(item, found) for item, found in lists if found]
        self.automaton = SuffixAutomaton(lists, window)
        self.shortest = min([window, *(len(found) for _, found in lists)])
        self.empty = not lists
        hashes = words.hashes()
        self.known = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True
        codes = np.searchsorted(self.known, hashes)
        same = np.ones(len(hashes), bool)
        same[words.bounds[:-1][words.bounds[:-1] < len(hashes)]] = False
        pairs = codes[:-1] * len(self.known) + codes[1:]
        self.pairs = np.unique(pairs[same[1:]]) if len(hashes) > 1 else np.zeros(0, np.int64)

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges, none across texts, outside which nothing can match."""
        hashes = words.hashes()
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        code = np.searchsorted(self.known, hashes[at])
        hit = code < len(self.known)
        hit[hit] = self.known[code[hit]] == hashes[at][hit]
        at, code = at[hit], code[hit]
        first = np.zeros(len(words.starts) + 1, bool)
        first[words.bounds] = True
        joined = np.zeros(len(at), bool)  # to the word before
        if len(at) > 1:
            near = (at[1:] == at[:-1] + 1) & ~first[at[1:]]
            pair = code[:-1] * len(self.known) + code[1:]
            place = np.searchsorted(self.pairs, pair)
            place[place == len(self.pairs)] = 0
            joined[1:] = near & (self.pairs[place] == pair) if len(self.pairs) else False
        starts = np.flatnonzero(~joined)
        sizes = np.diff(np.append(starts, len(at)))
        long = sizes >= self.shortest
        return at[starts[long]], at[starts[long]] + sizes[long]

    def read(self, texts: pa.Array, before: list[dict | None]) -> list[dict]:
        """What each text shares with the items, added to what earlier blocks have found in it."""
        words = split(texts, NOT_ALPHANUMERIC, lower=True)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(sizes + 1) - (sizes + 1)
        found = [
            old or {"n_words": n, "spans": [], "bytes": [], "items": []}
            for n, old in zip(np.diff(words.bounds).tolist(), before)
        ]
        starts, stops = ([], []) if self.empty else self.runs(words)
        for start, stop in zip(starts, stops):
            spans, items = self.automaton.matches(words.text(start, stop))
            if not spans:
                continue
            row = int(np.searchsorted(words.bounds, start, side="right")) - 1
            out, base, first = found[row], int(words.bounds[row]), int(firsts[row])
            for a, b in spans:
                a, b = int(start) + a, int(start) + b
                out["spans"].append((a - base, b - base))
                out["bytes"].append((int(words.starts[a]) - first, int(words.ends[b - 1]) - first))
            out["items"] = sorted({*out["items"], *items})
        return found


def merged(ranges: list) -> list[dict]:
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) if isinstance(r, dict) else r for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most about ``block_bytes`` of text, one block on the driver at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    total = items.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * int(total) // block_bytes) if total > block_bytes else 1)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r["item"], r["text"].encode()) for r in block.collect()]


_MATCHERS: dict[int, tuple[list[tuple[str, bytes]], Matcher]] = {}


def _matcher(items: list[tuple[str, bytes]], window: int) -> Matcher:
    """The automaton of a block of items, built once in a worker process; one at a time is kept."""
    held = _MATCHERS.get(window)
    if held is None or held[0] != items:
        _MATCHERS.clear()
        held = _MATCHERS[window] = (items, Matcher(items, window))
    return held[1]


def _scan(rows: DataFrame, text: str, into: str, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    broadcast = rows.sparkSession.sparkContext.broadcast(items)
    kind = pa.struct(
        [("n_words", pa.int64())]
        + [(k, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for k in ("spans", "bytes")]
        + [("items", pa.list_(pa.string()))]
    )
    first = into not in rows.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(broadcast.value, window)
        for batch in pieces(batches, text, 2 << 20):
            names = batch.schema.names
            before = [None] * batch.num_rows if first else batch.column(into).to_pylist()
            found = matcher.read(batch.column(text).cast(pa.string()), before)
            for f in found:
                f["spans"], f["bytes"] = merged(f["spans"]), merged(f["bytes"])
            columns = [batch.column(k) for k in names if k != into] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[k for k in names if k != into] + [into])

    plain = rows if first else rows.select(*[c for c in rows.columns if c != into], into)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(read, f"{schema}, {into} {FOUND}" if first else schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, into: str = "contamination", window: int = 13, one_in: int = 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with a struct ``into`` of what each ``text`` shares with the ``benchmark`` items.

    Texts are lower-cased (A-Z only); words are runs of ASCII letters and digits
    and of non-ASCII characters. A span is a longest stretch of words covered by
    runs of ``window`` or more words of an item, or by whole shorter items. The
    struct: ``n_words``, ``n_hit`` (words in spans), ``spans`` (word ranges),
    ``bytes`` (the same as UTF-8 byte ranges), ``items`` (ids as strings,
    sorted), ``contaminated`` (a hit, and at least one word in ``one_in`` hit).

    Items reach the tasks as automata of at most about ``block_bytes`` of item text
    each; a larger benchmark is gone through in blocks, each over all documents.

    Null or empty text: no words, not contaminated. Items without words match
    nothing; a null ``item_id`` reads ``null``. Repeated items and rows change
    nothing and are kept. Empty tables: no hits, no rows. All other
    columns are kept as they are; ``into`` must not be one of them.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    rows = docs
    for number, items in enumerate(item_blocks(benchmark, block_bytes)):
        if number:
            rows = materialize(rows)
        rows = _scan(rows, "text", into, items, window)
    hits = F.aggregate(f"{into}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = rows.withColumn(into, F.col(into).withField("n_hit", hits))
    bad = (F.col(f"{into}.n_hit") > 0) & (F.col(f"{into}.n_hit") * one_in >= F.col(f"{into}.n_words"))
    return rows.withColumn(into, F.col(into).withField("contaminated", bad))


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: bool = False, **limits: int) -> DataFrame:
    """``docs`` without contaminated documents or, if ``cut``, with their spans cut out of the text.

    Every other document stays as it is, all columns included; cases as in
    :func:`find_contamination`.
    """
    into = free_name(docs, "contamination")
    found = find_contamination(docs, benchmark, into, **limits)
    if not cut:
        return found.where(~F.col(f"{into}.contaminated")).select(*docs.columns)
    raw, ranges = F.encode("text", "UTF-8"), F.col(f"{into}.bytes")
    nothing = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    ends = F.struct(F.length(raw).cast("long").alias("start"), F.length(raw).cast("long").alias("end"))
    kept = F.zip_with(
        F.concat(F.array(nothing), ranges), F.concat(ranges, F.array(ends)),
        lambda a, b: F.decode(F.substring(raw, (a["end"] + 1).cast("int"), (b["start"] - a["end"]).cast("int")), "UTF-8"),
    )
    text = F.when(F.col(f"{into}.contaminated"), F.array_join(kept, "")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
