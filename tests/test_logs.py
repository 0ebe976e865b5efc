"""Workflow logs: records, run ids, dates and input sizes, from tables and files."""

import random
import re

from pyspark.sql import functions as F

from jobtally.operators import inputs, logs
from jobtally.plans.log_inputs import log_input_sizes, log_input_sizes_of_files, log_input_sizes_of_texts
from jobtally.registry import views
from jobtally.session import materialize
from jobtally.sources.logs import lines_of_texts, read_log_lines, read_log_pieces, read_log_texts
from jobtally.sources.sizes import read_input_sizes, scan_file_sizes
from jobtally.sources.sinks import write_input_sizes

FULL = (
    "[Wed Jan  1 12:00:00 2025]\nrule call_peaks:\n    input: reads_a.fq, reads_b.fq\n"
    "Job 42 has been submitted with SLURM jobid 80417 (log: /tmp/log).\n"
)


def texts(spark, *contents):
    rows = [(f"/p{i}/.snakemake/log/run.log", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "log_path string, content string")


def lines(spark, *contents):
    return lines_of_texts(texts(spark, *contents))


def fields(found):
    got = found.orderBy("log_path", "record_no").collect()
    return [(r.record_no, r.slurm_jobid, r.job_id, r.rule_name, list(r.inputs)) for r in got]


def records(spark, content):
    by_line = fields(logs.log_records(lines(spark, content)))
    assert fields(logs.log_records_of_texts(texts(spark, content))) == by_line
    return by_line


def test_full_record(spark):
    assert records(spark, FULL) == [(1, "80417", "42", "call_peaks", ["reads_a.fq", "reads_b.fq"])]
    assert records(spark, FULL.replace("\n", "\r\n")) == records(spark, FULL)


def test_preamble_empty_records_and_last_match(spark):
    content = (
        "rule ghost:\nJob 1 has been submitted with SLURM jobid 2 (log: x).\n"
        "[a]\n[b]\nlocalrule all:\nrule one:\nrule two: x\n  INPUT : a ,b,\n"
        "Job 3 has been submitted with SLURM jobid 4 (log: x).\n"
        "job 5 HAS been submitted with slurm jobid 6 (log: y).\n"
        "Job 7 has been submitted with SLURM jobid 8 (log: x). trailing\n[c]\ninput:"
    )
    assert records(spark, content) == [
        (1, "", "", "", []), (2, "6", "5", "two", ["a", "b", ""]), (3, "", "", "", []),
    ]
    assert records(spark, "nothing here\n") == []


def test_both_shapes_agree_on_random_logs(spark):
    rng = random.Random(5)
    parts = ["[x]", "rule r1:", "rule", " r2:", "rule r 3:", "text", "  input: a", "input", ":b", "INPUT:c,d ", "",
             "Job 1 has been submitted with SLURM jobid 2 (log: x).", "Job 3 has been submitted with",
             "Job 4 Job 5 has been submitted with SLURM jobid 6 (log: x).", " SLURM jobid 7 (log: x).",
             "[Wed Aug 19 06:25:18 2026]", "a [Thu Aug 20 06:25:18 2026] [x", "] [Fri Aug 21 06:25:18 2026]",
             "SLURM run ID: one", "x SLURM run ID: two"]
    contents = [
        rng.choice(["\n", "\r\n"]).join(rng.choice(parts) for _ in range(rng.randrange(40))) + rng.choice(["", "\n"])
        for _ in range(300)
    ]
    whole, cut = texts(spark, *contents), lines(spark, *contents)
    in_blocks = cut.select(
        "log_path", F.floor(F.col("row") / 7).alias("block"), (F.col("row") % 7).alias("row"), "line"
    )
    expected = fields(logs.log_records_of_texts(whole))
    assert fields(logs.log_records(cut)) == expected and len(expected) > 500
    assert fields(logs.log_records(in_blocks)) == expected
    assert sorted(map(tuple, logs.run_ids(in_blocks).collect())) == sorted(
        map(tuple, logs.run_ids_of_texts(whole).collect())
    )
    assert sorted(logs.run_dates(cut).collect()) == sorted(logs.run_dates_of_texts(whole).collect())


def test_run_ids(spark):
    found = logs.run_ids(lines(
        spark, "Spinning up workers\nSLURM run ID: 80417\nMore", "Start\nSLURM run ID: 70021\nMid\nSLURM run ID: 70022\n",
        "no id", "", "  SLURM run ID: indented",
    ))
    got = {r.log_path[2]: r.run_id for r in found.collect()}
    assert got == {"0": "80417", "1": "70021", "4": "indented"}


def test_run_dates(spark):
    found = logs.run_dates(lines(
        spark, "[Wed Aug 19 06:25:18 2026]\nx\n[Thu Aug 20 00:00:00 2026]", "[Wed Aug 19 23:51:07 2026]", "[nope]",
    ))
    assert sorted(str(r.date) for r in found.collect()) == ["2026-08-19", "2026-08-20"]


def test_input_sizes_against_brute_force(spark):
    rng = random.Random(11)
    sizes = {f"/d/f{i}": rng.randrange(1000) for i in range(40)}
    manifest = spark.createDataFrame(list(sizes.items()), "path string, length bigint")
    contents, wanted = [], []
    for i in range(60):
        text = "preamble\n"
        for j in range(rng.randrange(4)):
            names = [rng.choice(["/d/f0", f"/d/f{rng.randrange(60)}", f"rel{j}"]) for _ in range(rng.randrange(5))]
            text += f"[r]\nrule r{j}:\n"
            text += f"    input: {', '.join(names)}\n" if names else ""
            if rng.random() < 0.8:
                text += f"Job {j} has been submitted with SLURM jobid {i * 10 + j} (log: l).\n"
                wanted.append((str(i * 10 + j), str(j), f"r{j}", sum(sizes.get(n, 0) for n in names), ",".join(names)))
        contents.append(text)
    for got in (
        log_input_sizes(lines(spark, *contents), manifest),
        log_input_sizes_of_texts(texts(spark, *contents), manifest),
    ):
        assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_log_files_and_size_file(spark, tmp_path):
    project = tmp_path / "my project+x"
    log_dir = project / ".snakemake" / "log"
    log_dir.mkdir(parents=True)
    (project / "inputs").mkdir()
    (project / "inputs" / "leaf_03.csv").write_bytes(b"fourteen bytes")
    (project / "inputs" / "sample 2.txt").write_bytes(b"test content 2")
    first = project / "inputs" / "leaf_03.csv"
    (log_dir / "run.log").write_text(
        "SLURM run ID: abc\n[Wed Aug 19 06:25:18 2026]\nrule weigh_leaves:\n"
        f"    input: {first}, inputs/sample 2.txt, inputs/missing.txt\n    jobid: 3\n"
        "Job 3 has been submitted with SLURM jobid 51907 (log: /x.log).\n"
        "[Wed Aug 19 06:26:18 2026]\nrule unsubmitted:\n    input: inputs/leaf_03.csv\n"
    )
    logs_found = [str(log_dir / "run.log"), str(tmp_path / "absent.log")]
    manifest = scan_file_sizes(spark, str(project / "inputs"))
    sizes = log_input_sizes_of_files(spark, logs_found, manifest)
    second = project / "inputs" / "sample 2.txt"
    row = ("51907", "3", "weigh_leaves", 28, f"{first},{second},inputs/missing.txt")
    assert [tuple(r) for r in sizes.collect()] == [row]
    write_input_sizes(sizes, str(tmp_path / "sizes"))
    write_input_sizes(sizes, str(tmp_path / "sizes"))
    back = read_input_sizes(spark, str(tmp_path / "sizes")).collect()
    assert [tuple(r) for r in back] == [(51907, 3, *row[2:])] * 2
    header = next((tmp_path / "sizes").glob("part-*")).read_text().splitlines()[0]
    assert header == "slurm_jobid|job_id|rule_name|input_size_bytes|inputs"
    assert logs.run_ids(read_log_lines(spark, logs_found)).first().run_id == "abc"
    whole = log_input_sizes_of_texts(read_log_texts(spark, logs_found[:1]), manifest)
    assert [tuple(r) for r in whole.collect()] == [row]
    assert read_log_lines(spark, [str(tmp_path / "absent.log")]).count() == 0


def test_log_read_in_many_blocks(spark, tmp_path):
    """A log cut into small blocks gives the same records as in one piece."""
    body = "".join(
        f"[Wed Aug 19 06:25:18 2026]\nrule r{i}:\n    input: a{i}, b{i}\n" + "noise\n" * (i % 5)
        + f"Job {i} has been submitted with SLURM jobid {i + 1000} (log: l).\n"
        for i in range(400)
    )
    path = tmp_path / "big.log"
    path.write_text("preamble\nrule no:\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = read_log_lines(spark, [str(path)])
        assert read.select("block").distinct().count() > 5
        got = logs.log_records(read).orderBy("record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.record_no, r.job_id, r.slurm_jobid, r.rule_name, list(r.inputs)) for r in got] == [
        (i + 1, str(i), str(i + 1000), f"r{i}", [f"a{i}", f"b{i}"]) for i in range(400)
    ]


def test_enrichment_join(spark):
    allocations = spark.createDataFrame(
        [("1", "1", 60, 1048576, 0), ("2", "2", 60, 1048576, 0), ("3", "3_4", 60, 1, 1), (None, "x", 60, 1, 1),
         ("5", None, 60, 1, 1)],
        "JobRoot string, JobID string, ElapsedRaw bigint, ReqMem bigint, MaxRSS bigint",
    )
    sizes = spark.createDataFrame([("1", 1048576, "/a"), ("1", 2097152, "/b"), ("34", 7, "/c"), (None, 7, "/d")],
                                  "slurm_jobid string, input_size_bytes bigint, inputs string")
    got = inputs.enrich_with_input_sizes(allocations, sizes)
    assert got.columns == [*allocations.columns, "MinPerMo", "UsedRAMPerMo", "input_size_bytes", "inputs"]
    rows = sorted((str(r.JobID), r.MinPerMo, r.UsedRAMPerMo, r.inputs) for r in got.collect())
    assert rows == [("1", 0.5, 0.5, "/b"), ("1", 1.0, 1.0, "/a"), ("2", None, None, None),
                    ("3_4", None, None, None), ("None", None, None, None), ("x", None, None, None)]


def test_records_of_files_split_anywhere(spark, tmp_path):
    """Pieces of files split at every few bytes give the records of the whole texts."""
    rng = random.Random(11)
    parts = ["[x]", "[", "[[x", "[rule r9:", "rule r1:", "  input: a, b", "input: c", "", "é noise", "[input: d", "\r", " [y]",
             "Job 1 has been submitted with SLURM jobid 2 (log: x).", "[Job 3 has been submitted with SLURM jobid 4 (log: x)."]
    wanted = []
    for k in range(24):
        ending = rng.choice(["\n", "\n", "\r\n"])
        content = ending.join(rng.choice(parts) for _ in range(rng.randrange(60))) + ending
        (tmp_path / f"{k:02}.log").write_bytes(content.encode())
        wanted.append((f"{tmp_path}/{k:02}.log", content))
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "plain.log").write_text("nothing")
    whole = spark.createDataFrame(wanted, "log_path string, content string")
    expected = sorted(map(tuple, logs.log_records_of_texts(whole).collect()))
    assert len(expected) > 200
    settings = {c: spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")}
    for size, least in ((61, 8), (331, 2), (1 << 20, 1)):
        try:
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            read = read_log_pieces(spark, [f"{tmp_path}/*.log", str(tmp_path / "absent.log")])
            assert read.select("block").distinct().count() >= least
            found = logs.log_records_of_pieces(read)
        finally:
            for c, value in settings.items():
                spark.conf.set(f"spark.sql.files.{c}", value)
        assert sorted(map(tuple, found.collect())) == expected
    none = read_log_pieces(spark, [str(tmp_path / "absent.log")])
    assert logs.log_records_of_pieces(none).count() == 0


def test_records_of_pieces_are_scanned_once(spark, tmp_path):
    """What is numbered is the stored fields; their rows meet no exchange but that of a join by block."""
    (tmp_path / "a.log").write_text(FULL * 50)
    found = logs.log_records_of_pieces(read_log_pieces(spark, [str(tmp_path / "a.log")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and plan.count("FileScan parquet") == 2 and "BroadcastHashJoin" in plan
    assert found.count() == 50


def test_texts_are_matched_once(spark, tmp_path):
    from jobtally.operators.inputs import input_sizes
    from jobtally.registry import views

    spark.sql(
        "SELECT bigint(3) AS o_orderkey, bigint(5) AS o_custkey, 'F' AS o_orderstatus, 1.5D AS o_totalprice, "
        "timestamp_ntz'1997-01-05 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT bigint(2) AS p_partkey, 901.5D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    texts = views.log_texts(spark, str(tmp_path))
    spark.conf.set("spark.sql.maxMetadataStringLength", 100000)
    try:
        sizes = input_sizes(logs.log_records_of_texts(texts), views.manifest(spark, str(tmp_path)))
        wanted = sizes.where("try_cast(slurm_jobid as bigint) >= 0")
        plan = wanted._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("Building DAG") == 1 and plan.count("regexp_extract_all(") == 3


def test_lines_are_computed_once(spark):
    rows = spark.sparkContext.accumulator(0)
    lines = [("l", b, r, t) for b, r, t in [(0, 0, "x"), (0, 1, "[a"), (0, 2, "rule one:"), (1, 0, "rule two:"), (1, 1, "[b"), (1, 2, "rule three:")]]

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    schema = "log_path string, block bigint, row bigint, line string"
    df = spark.createDataFrame(lines, schema).mapInArrow(seen, schema)
    assert {r.record_no: r.rule_name for r in logs.log_records(df).collect()} == {1: "two", 2: "three"}
    assert rows.value == 6
    parts = logs.record_parts(df, F.count("*").alias("n"))
    assert sorted((r.block, r.record_no, r.n) for r in parts.collect()) == [(0, 1, 2), (1, 1, 1), (1, 2, 2)]


def test_parts_of_a_record_meet_in_the_block_it_starts_in(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(logs, "materialize", lambda df, codec=None: stored.append(df) or materialize(df, codec))
    blocks = {  # by log and block: a preamble, a record over four blocks, blocks without a start, one that only ends a record
        ("l", 0): ["x", "y"], ("l", 8): ["z", "[a", "a1"], ("l", 16): ["a2"], ("l", 24): ["a3", "a4"], ("l", 32): ["a5", "[b", "[c"],
        ("l", 40): ["c1"], ("m", 0): ["[d"], ("m", 8): ["[e"], ("n", 0): ["only", "preamble"],
    }
    rows = [(p, b, r, line) for (p, b), lines in blocks.items() for r, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "log_path string, block bigint, row bigint, line string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = logs.record_parts(lines, F.concat_ws(",", F.sort_array(F.collect_list("line"))).alias("lines"))
        joined = parts.groupBy("log_path", "start_block", "record_no").agg(F.min("lines").alias("first"), F.count("*").alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\bExchange hash", plan)) == 2  # both sides of the last join, none of the grouping
    assert sorted((r.log_path, r.start_block, r.record_no, r.first, r.n) for r in joined.collect()) == [
        ("l", 8, 1, "[a,a1", 4), ("l", 32, 2, "[b", 1), ("l", 32, 3, "[c", 2), ("m", 0, 1, "[d", 1), ("m", 8, 2, "[e", 1),
    ]
    assert sorted((r.block, r.record_no, r.lines) for r in parts.where("log_path = 'l'").collect()) == [
        (8, 1, "[a,a1"), (16, 1, "a2"), (24, 1, "a3,a4"), (32, 1, "a5"), (32, 2, "[b"), (32, 3, "[c"), (40, 3, "c1"),
    ]
    # lines that lie by their log already are not shuffled: the one shuffle is that of the texts
    stored.clear()
    logs.record_parts(lines_of_texts(views.log_texts(spark, "/root/testdata/sf0.001")), F.count("*").alias("n"))
    assert len(re.findall(r"\bExchange hash", stored[0]._jdf.queryExecution().executedPlan().toString())) == 1
