"""Fill-in-middle against plain Python on code points, and its way back."""

import hashlib
import re

import numpy as np
import pytest

from jobtally.llm.infill import ByteIndex, restored_text, transform_infill
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, " ", " \t\n", "one", " lead and trail \n", "é ☃🙂 ñ​ 漢字 x", "a <P> b", "a <S> b c", "<M>", "<P", "a\xa0b c", "<", "P> <S",
       "x" * 3000 + " é" * 3000, "tie tie tie", "🙂" * 50]


def plain(doc_id, text, unit="tokens", seed=42, percent=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text) if unit == "tokens" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["tokens", "characters"])
def test_against_code_points(spark, documents, unit):
    rows = [(k, t) for k, t in enumerate(ODD * 12)] + [(None, "no id at all"), (None, "no id at all")]
    rows += [(10_000 + d["doc_id"], d["text"]) for d in documents]
    docs = spark.createDataFrame([(k, "x", t) for k, t in rows], "doc_id long, n string, text string")
    got = transform_infill(docs, unit=unit, percent=70).select(
        "doc_id", "n", "text", "infill", restored_text(F.col("infill.output"), F.col("infill.form")).alias("back")
    ).collect()
    assert len(got) == len(rows)
    forms = set()
    for row in got:
        assert tuple(row.infill) == plain(row.doc_id, row.text, unit, percent=70)
        assert row.back == (row.text or "")
        forms.add(row.infill.form)
    assert forms == {"plain", "spm", "psm"}


def test_byte_index():
    text = "aé☃🙂b" * 7 + "plain ascii " * 5 + "éé"
    index = ByteIndex(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in points])
    assert (index.to_bytes(points) == places).all() and (index.to_points(places) == points).all()
    assert len(index.places) == sum(not c.isascii() for c in text)


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        transform_infill(docs, into="Text")
    with pytest.raises(ValueError):
        transform_infill(docs, unit="bytes")
    assert transform_infill(docs.limit(0)).count() == 0
    assert transform_infill(docs, percent=0).first()["infill"]["form"] == "plain"
    assert transform_infill(docs, percent=100, spm_percent=0).first()["infill"]["form"] == "psm"
