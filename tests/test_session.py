"""Where tables read several times are kept."""

import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from jobtally import get_session
from jobtally.session import REMOVE_SHUFFLES, checkpoint_folder, in_parts, materialize


def test_materialize_uses_the_named_folder(spark):
    folder = Path(checkpoint_folder(spark))
    assert str(folder) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(folder.iterdir()) if folder.exists() else set()
    df = spark.range(10).select(F.col("id").alias("a.b"), F.rand().alias("l'x"))
    stored = materialize(df)
    assert len(set(folder.iterdir()) - before) == 1
    assert stored.dtypes == df.dtypes
    assert sorted(stored.collect()) == sorted(stored.collect())
    assert "Rand" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_settings_of_the_session_win(spark):
    key = "spark.sql.adaptive.skewJoin.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert get_session().conf.get(key) == "false"
    finally:
        spark.conf.set(key, before)


def test_what_a_stored_table_shuffled_is_removed(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = disk.getAllFiles().mkString("\n").split("\n")
        return {n for n in names if re.search(r"shuffle_\d+_\d+_0\.data$", n)}

    before = shuffled()
    wide = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("t")).groupBy("t").count()
    stored = materialize(wide)
    until = time.time() + 10  # the executors are told to remove them, not waited for
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(REMOVE_SHUFFLES, None) is None
    assert stored.count() == 20000


def test_parts_are_whole_and_removed(spark):
    folder = Path(checkpoint_folder(spark))
    df = spark.range(100).select("id", F.struct("id", F.lit("x").alias("text")).alias("place"))
    for most_bytes, rounds in ((0, 4), (1 << 30, 1)):
        seen = []
        for part in in_parts(df, F.col("id") % 4, most_bytes):
            stored = list(folder.glob("jobtally-*/_part=*"))
            seen.append(sorted(r.id for r in part.collect()))
            assert part.columns == df.columns and not part.schema["place"].nullable
            assert len(stored) == (4 - len(seen) + 1 if rounds == 4 else 4)
        assert len(seen) == rounds and sorted(sum(seen, [])) == list(range(100))
        assert not list(folder.glob("jobtally-*/_part=*"))
    empty = list(in_parts(df.where("id < 0"), F.lit(0)))
    assert [e.columns for e in empty] == [df.columns]
