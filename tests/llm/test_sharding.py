"""Shards: limits kept, prefixes disjoint, no needless split; hot keys and odd rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobtally.llm.sharding import assign_shards, read_shards, write_shards


def check(rows, limit):
    held = defaultdict(list)
    for r in rows:
        held[r.s.name].append(r.s)
    names = sorted(held)
    for a, b in zip(names, names[1:]):
        assert not b.startswith(a)
    total = {n: sum(s.bytes for s in held[n]) for n in names}
    for name, shards in held.items():
        assert {(s.shard_bytes, s.shard_docs, s.depth) for s in shards} == {(total[name], len(shards), len(name))}
        assert total[name] <= limit or len(shards) == 1
        if name:  # its parent did not fit
            assert sum(b for n, b in total.items() if n.startswith(name[:-1])) > limit
    return names


@pytest.mark.parametrize("limit", [50, 1000, 10**6])
def test_limits(spark, limit):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 40).alias("size"))
    rows = assign_shards(docs, F.col("doc_id"), F.col("size"), limit, into="s").collect()
    assert len(rows) == 2000
    names = check(rows, limit)
    assert (len(names) == 1) == (limit == 10**6)


def test_hot_key_and_odd_rows(spark):
    rows = [(7, 10)] * 500 + [(None, 5)] * 30 + [(1, None), (2, 10_000), (3, 0)]
    docs = spark.createDataFrame([(k, n, "x") for k, n in rows], "doc_id long, size int, row_ string")
    got = assign_shards(docs, F.col("doc_id"), F.col("size"), 100, into="s")
    found = got.collect()
    assert len(found) == len(rows)
    check(found, 100)
    assert max(len(r.s.name) for r in found) > 60  # the hot key is split by row numbers
    assert assign_shards(docs.limit(0), F.col("doc_id"), F.col("size"), 100).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))
    write_shards(assign_shards(docs, F.col("doc_id"), F.octet_length("text"), 1000), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 300
    assert read.groupBy("shard_name").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] <= 1000


def test_query_reads_whole_documents_from_its_files(spark):
    from glob import glob

    from jobtally.llm.queries import op3_sharding
    from jobtally.session import checkpoint_folder

    def folders():
        return set(glob(checkpoint_folder(spark).removeprefix("file:") + "/shards-*"))

    sf, before = "/root/testdata/sf0.001", folders()
    got = {(r.doc_id, r.bytes) for r in op3_sharding(spark, sf).collect()}
    (made,) = folders() - before
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    written = spark.read.parquet(made).select(docs.columns)
    assert written.exceptAll(docs).isEmpty() and docs.exceptAll(written).isEmpty()
    assert got == {(r.doc_id, r.n) for r in docs.select("doc_id", F.octet_length("text").alias("n")).collect()}


def test_odd_files(spark, tmp_path):
    """Clashing column names, null texts, a key over the limit, no rows and no files."""
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (None, "é" * 30, None, "b"), *[(3, "x" * 90, "a", None)] * 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard_name string, leaf_ string")
    for limit in (200, 10**6):
        path = str(tmp_path / f"shards{limit}")
        write_shards(assign_shards(docs, F.col("doc_id"), F.octet_length("text"), limit), path)
        read = read_shards(spark, docs.schema, path).collect()
        assert sorted((r.doc_id or 0, r.bytes) for r in read) == sorted((k or 0, len((t or "").encode())) for k, t, *_ in rows)
        assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in read)
        assert (len({r.name for r in read}) == 1) == (limit == 10**6)
    empty = str(tmp_path / "empty")
    write_shards(assign_shards(docs.limit(0), F.col("doc_id"), F.octet_length("text"), 200), empty)
    assert read_shards(spark, docs.schema, empty).count() == 0
    assert read_shards(spark, docs.schema, str(tmp_path / "missing")).count() == 0
    with pytest.raises(ValueError):
        assign_shards(docs, F.col("doc_id"), F.octet_length("text"), 200, into="Text")
