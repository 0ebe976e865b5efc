"""The pipeline's stages one by one against brute force on their own input."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_decontamination import brute as plain_contamination
from test_packing import check as check_packing
from test_simhash import plain_components, plain_print
from test_substrings import WORD, brute as plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from jobtally.llm.tokens import default_path
from jobtally.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    plants = [(9001, None, "en"), (9002, "", "en"), (9003, "1234 !!", "en"), (9004, texts[0], "en"), (9005, "".join(c.upper() if c.isascii() else c for c in texts[0]), "en")]
    extra = spark.createDataFrame([(*p, "src", 0) for p in plants], docs.schema)
    docs, outs = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        outs.append(docs)
        if name != "packing":
            assert docs.columns == columns
    after = [{r.doc_id: r.text for r in d.collect()} for d in outs[:4]]
    assert set(texts) - set(after[0]) == set() and {9001, 9002, 9003}.isdisjoint(after[0])
    components = plain_components({k: plain_print(t) for k, t in after[0].items()})
    assert set(after[1]) == set(components.values()) and {9004, 9005}.isdisjoint(after[1])
    ids = sorted(after[1])
    for doc_id, (_, gone, kept) in zip(ids, plain_repeats([after[1][k] for k in ids], 35)):
        assert WORD.findall(after[2][doc_id]) == kept
        assert gone or after[2][doc_id] == after[1][doc_id]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert after[3] == {k: t for k, t in after[2].items() if not plain_contamination(t, items)[3]}
    assert len(after[3]) < len(after[2])
    assert all(r.n_chars == len(r.text) for r in outs[3].collect())
    whole = Tokenizer.from_file(default_path())
    wanted = {k: whole.encode(t, add_special_tokens=False).ids + [2] for k, t in after[3].items()}
    rows = outs[4].withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check_packing(rows, wanted, 4096) < 0.001


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
