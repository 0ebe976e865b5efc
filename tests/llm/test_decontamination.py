"""The suffix automaton and the whole operator against brute force."""

import random
import re

import pytest

from jobtally.llm.decontamination import SuffixAutomaton, decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text, items, window=13):
    words, hit, met = words_of(text), set(), set()
    for item, item_text in items:
        item_words = words_of(item_text)
        size = min(window, len(item_words))
        runs = {tuple(item_words[i : i + size]) for i in range(len(item_words) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                met.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    rnd = random.Random(seed)
    letters = [b"a", b"b", b"c"][: 2 + seed % 2]
    items = [(str(k), [rnd.choice(letters) for _ in range(rnd.randrange(1, 12))]) for k in range(6)]
    text = [rnd.choice(letters) for _ in range(60)]
    window = rnd.randrange(1, 7)
    spans, met = SuffixAutomaton(items, window).matches(text)
    as_text = " ".join(w.decode() for w in text)
    wanted = brute(as_text, [(k, " ".join(w.decode() for w in ws)) for k, ws in items], window)
    covered = {i for a, b in spans for i in range(a, b)}
    assert (len(text), len(covered), sorted(met)) == wanted[:3]


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "Short item"),
    (3, None),
    (4, "--- !!!"),
    (None, "zwei drei"),
    (2, "Short item"),
    (5, "é ñ ß"),
    (6, "again and again and again and again and again and again and again and again and again"),
]
DOCS = [
    None, "", "nothing here", "a SHORT, item!", "short", "item short item short",
    "x " + "one two three four five six seven eight nine ten eleven twelve thirteen" + " y" * 300,
    "two THREE four five six seven eight nine ten eleven twelve thirteen fourteen fifteen",
    "one two three four five six seven eight nine ten eleven twelve", "É é ñ ß zwei\ndrei",
    "and again " * 40, "short item " * 3 + "w " * 30000, "item",
]


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_operator(spark, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(DOCS)], "doc_id long, text string, spans string")
    found = find_contamination(docs, benchmark, block_bytes=block_bytes).select("doc_id", "text", "spans", "contamination.*")
    rows = found.collect() if block_bytes > 1000 else find_contamination(docs, benchmark, block_bytes=block_bytes).select(
        "doc_id", "text", "contamination.*").collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(r.text, ITEMS)
        for part in r.bytes:
            assert words_of(r.text.encode()[part["start"] : part["end"]].decode())
        kept = {r.doc_id for r in rows if not r.contaminated}
    clean = decontaminate(docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == kept
    cut = {r.doc_id: r.text for r in decontaminate(docs, benchmark, cut=True, block_bytes=block_bytes).collect()}
    assert cut[3] == "a !" and cut[2] == DOCS[2] and cut[0] is None and words_of(cut[9]) == ["É"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 1
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(docs.limit(0), benchmark).count() == 0
