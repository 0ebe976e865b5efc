"""Sharding by extendible hashing: a shard that is too large splits on one more bit of the key's hash."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from ..session import materialize
from .batches import free_name

STEP = 16  # bits of the directory that one pass resolves
BITS = 60  # of a key's hash; as many of a row number follow


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a string of bits."""
    number = F.conv(F.substring(F.md5(F.encode(value, "UTF-8")), 1, 15), 16, 2)
    return F.lpad(number, BITS, "0")


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """For each cell of ``cells(base, cell, bytes, n)`` the least depth at which its bucket fits, null if none does.

    ``base`` are the bits read in passes before and ``cell`` the next ``STEP``. The
    buckets of one base are at most ``2 ** (STEP + 1)``.
    """
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("level"))
    levels = levels.withColumn("bucket", F.substring("cell", F.lit(1), F.col("level")))
    sums = levels.groupBy("base", "level", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = levels.select("base", "cell", "level", "bucket").join(fits, ["base", "level", "bucket"])
    least = found.groupBy("base", "cell").agg(F.min(F.struct("level", "bucket", "shard_bytes", "shard_docs")).alias("leaf"))
    return cells.select("base", "cell").join(least, ["base", "cell"], "left")


def _resolve(waiting: DataFrame, bits: int, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Leaves of ``waiting(path, bytes, n)``, by pass over its first ``bits``, and the rows that fit nowhere, if any.

    A leaf is ``(path, leaf)``: the shard each path falls to.
    """
    settled: list[DataFrame] = []
    for done in range(0, bits, STEP):
        placed = waiting.select(
            "*", F.substring("path", 1, done).alias("base"), F.substring("path", done + 1, min(STEP, bits - done)).alias("cell")
        )
        cells = placed.groupBy("base", "cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        joined = placed.join(materialize(directory(cells, limit)), ["base", "cell"])
        leaf = F.struct(
            F.concat("base", "leaf.bucket").alias("name"), (F.lit(done) + F.col("leaf.level")).alias("depth"),
            F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs"),
        )
        settled.append(joined.where("leaf is not null").select("path", leaf.alias("leaf")))
        waiting = materialize(joined.where("leaf is null").select("path", "bytes", "n"))
        if waiting.isEmpty():
            return settled, None
    return settled, waiting


def _union(frames: list[DataFrame]) -> DataFrame:
    first = frames[0]
    for more in frames[1:]:
        first = first.unionByName(more)
    return first


def assign_shards(docs: DataFrame, key: Column, size: Column, limit: int, into: str = "shard") -> DataFrame:
    """``docs`` with a struct ``into``: ``name``, ``depth``, ``bytes`` of the row, and the shard's bytes and documents.

    The directory is indexed by bits of the hash of ``key``; a bucket splits only
    while its rows hold more than ``limit`` bytes. It is worked out from the bytes
    of each key, 16 bits a pass, without the rows. Rows of one key that exceed the
    limit together split on by a row number; one row that exceeds it alone is a
    shard by itself. The rows are moved once, by the bits that the names of all
    shards have at least, so that a shard comes out in one task.

    Null key: the empty text. Null size: 0. Repeated rows: each counts. No rows: no
    rows. Other columns are kept; ``into`` must not be one of them.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    row, bits, bytes_, base, leaf = (free_name(docs, n) for n in ("row_", "bits_", "bytes_", "base_", "leaf_"))
    rows = docs.withColumn(bytes_, F.coalesce(size, F.lit(0)).cast("long")).withColumn(
        bits, hash_bits(F.coalesce(key.cast("string"), F.lit("")))
    )
    keys = materialize(rows.groupBy(F.col(bits).alias("path")).agg(F.sum(bytes_).alias("bytes"), F.count("*").alias("n")))
    settled, crowded = _resolve(keys, BITS, limit)
    shape = "struct<name:string,depth:int,bytes:bigint,shard_bytes:bigint,shard_docs:bigint>"

    def placed(frame: DataFrame) -> DataFrame:
        found = F.col(leaf)
        shard = F.struct(found["name"], found["depth"], F.col(bytes_), found["shard_bytes"], found["shard_docs"])
        return frame.select(*docs.columns, shard.cast(shape).alias(into))

    leaves = materialize(_union(settled).select("leaf.*").distinct())
    least = leaves.agg(F.min("depth")).first()[0] or 0
    # buckets of one base differ by chance alone, as keys that do not fit are apart: few a base
    bases = leaves.groupBy(F.substring("name", 1, least).alias(base)).agg(F.collect_list(F.struct(*leaves.columns)).alias(leaf))
    others = rows
    if crowded is not None:
        names = crowded.select(F.col("path").alias(base))
        others = rows.join(names, F.col(bits) == F.col(base), "left_anti")
        crowd = materialize(rows.join(names, F.col(bits) == F.col(base), "left_semi").withColumn(row, F.monotonically_increasing_id()))
        numbered = F.concat(F.col(bits), hash_bits(F.col(row).cast("string")))
        paths = crowd.select(numbered.alias("path"), F.col(bytes_).alias("bytes"), F.lit(1).cast("long").alias("n"))
        settled, left = _resolve(paths, 2 * BITS, limit)
        if left is not None:
            raise RuntimeError("row numbers collide; the hash has too few bits")
        split = _union(settled).select(F.col("path").alias(base), F.col("leaf").alias(leaf))
        crowd = crowd.join(split, numbered == F.col(base)).repartition(F.col(leaf)["name"])
    first = F.substring(bits, 1, least) if least else F.lit("")
    joined = others.withColumn(base, first).join(bases.hint("merge"), base)
    whole = F.col(bits)
    joined = joined.withColumn(leaf, F.get(F.filter(leaf, lambda x: whole.startswith(x["name"])), F.lit(0)))
    return placed(joined) if crowded is None else placed(joined).unionByName(placed(crowd))


def write_shards(sharded: DataFrame, path: str, into: str = "shard") -> None:
    """Writes each shard as one folder ``shard_name=...`` under ``path``.

    Rows as :func:`assign_shards` gives them stay in their tasks, so that a shard, at most
    the limit, is one file; other rows make as many files of it as there are tasks.
    """
    plain = sharded.drop(into)
    name = free_name(plain, "shard_name")
    names = F.concat(F.lit("b"), F.col(f"{into}.name")).alias(name)
    sharded.select(*[F.col(f"`{c}`") for c in plain.columns], names).write.partitionBy(name).parquet(path)


def read_shards(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """``(doc_id, name, depth, bytes, shard_bytes, shard_docs)`` from the files of :func:`write_shards`.

    ``bytes`` are those of ``text``; all figures are counted from the rows read,
    not taken from the directory. Null text: 0 bytes. No files: no rows.
    """
    shard = free_name(spark.createDataFrame([], schema), "shard_name")
    try:
        read = spark.read.schema(StructType([*schema.fields]).add(shard, StringType())).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], StructType([*schema.fields]).add(shard, StringType()))
    found = materialize(
        read.select(
            "doc_id", F.substring(shard, 2, 1 << 16).alias("name"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        )
    )
    sums = found.groupBy("name").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return found.join(sums.withColumnRenamed("name", "name_"), F.col("name") == F.col("name_")).select(
        "doc_id", "name", F.length("name").alias("depth"), "bytes", "shard_bytes", "shard_docs"
    )
