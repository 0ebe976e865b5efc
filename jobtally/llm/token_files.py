"""Token-id output: bit-packed shard files in document order, and their reader."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_folder, materialize
from .batches import pieces
from .bitpack import ShardReader, bits_for, shard_bytes
from .tokens import encoder, with_end

MANIFEST = "shard long, path string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shard_ids: int = 1 << 23, block: int = 4096
) -> DataFrame:
    """Encodes ``text`` of all ``docs`` in ascending ``doc_id`` order into shard files under ``folder``.

    Returns the manifest ``(shard, path, n_docs, n_ids)``, one row a file, the
    files' order being that of ``shard``. Documents are dealt out by ranges of
    ``doc_id``; a task writes shards of about ``shard_ids`` ids. A file bears the
    name of the attempt that wrote it and counts only if the manifest lists it,
    so a repeated task does no harm. ``folder`` is any URI that pyarrow opens.

    Null text: empty, only the end id. Null ``doc_id``: first, marked as null.
    Rows with the same ``doc_id``: all kept, ordered by the hash of their text.
    No rows: no files, an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = f"{(folder or checkpoint_folder(spark)).rstrip('/')}/tokens-{uuid.uuid4()}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer), TaskContext.get()
        width = bits_for(max(encode.vocabulary, end_id + 1))
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        held: list[tuple] = []
        written = 0

        def flush() -> pa.RecordBatch:
            nonlocal written
            shard = (context.partitionId() << 32) + written
            path = f"{root}/{shard:020d}-{context.taskAttemptId()}.bin"
            ids, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            doc_ids, nulls = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            with files.open_output_stream(path) as out:
                out.write(shard_bytes(doc_ids, nulls, counts, ids, width, block))
            held.clear()
            written += 1
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}
            )

        for batch in pieces(batches):
            ids, counts = with_end(*encode.encode(batch.column("text")), end_id)
            key = batch.column("doc_id")
            held.append((ids, counts, key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)))
            if sum(len(h[0]) for h in held) >= shard_ids:
                yield flush()
        if held:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return materialize(ordered.mapInArrow(write, MANIFEST)).withColumn("folder", F.lit(folder))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of the files that ``manifest`` lists: ``(doc_id, start, n_tokens, ids)``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit. The running total is over one row a file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = file_system(row["folder"])
                with files.open_input_file(row["path"]) as handle:
                    shard = ShardReader(handle)
                    for at in range(0, shard.n_docs, 1000):
                        stop = min(at + 1000, shard.n_docs)
                        bounds = shard.firsts[at : stop + 1]
                        data = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                        offsets = pa.py_buffer((4 * (bounds - bounds[0])).astype(np.int32).tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[at:stop], mask=shard.nulls[at:stop]),
                                pa.array(row["start"] + bounds[:-1]),
                                pa.array(np.diff(bounds)),
                                pa.Array.from_buffers(pa.binary(), stop - at, [None, offsets, pa.py_buffer(data)]),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    # by number, or the few bytes of the manifest would meet in one task that reads every file
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "shard").mapInArrow(read, DOCUMENTS)
