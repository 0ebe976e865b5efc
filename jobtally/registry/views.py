"""Accounting rows, logs and file manifests shaped from the given star-schema tables.

Orders become allocation rows and workflow logs, order lines become step rows,
parts become input files. Every row of the tables is used; the formulas spread
all the formats and oddities of real dumps over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ACCOUNTING_COLUMNS
from ..sources.accounting import scan_parquet

UUID = (
    "concat_ws('-', substr(md5({0}), 1, 8), substr(md5({0}), 9, 4), substr(md5({0}), 13, 4), "
    "substr(md5({0}), 17, 4), substr(md5({0}), 21, 12))"
)
RUN_UUID = UUID.format("cast(o_custkey % 50 as string)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, dealt out by its key into as many parts as the session shuffles to, at every size.

    Shaping a row into accounting text costs far more than moving it here, and
    the given files hold few pieces. Without the number small tables would be
    merged into one part again.
    """
    df = scan_parquet(spark, f"{sf_dir}/{name}.parquet")
    return _dealt(df, df.columns[0])


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _seconds(expression: str) -> str:
    return f"make_dt_interval(0, 0, 0, {expression})"


def _iso(expression: str) -> str:
    return f"replace(cast({expression} as string), ' ', 'T')"


def _clock(expression: str) -> str:
    return (
        f"concat(lpad(cast(({expression}) div 3600 as string), 2, '0'), ':', "
        f"lpad(cast(({expression}) div 60 % 60 as string), 2, '0'), ':', "
        f"lpad(cast(({expression}) % 60 as string), 2, '0'))"
    )


def _timed_orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "*",
        f"o_orderdate + {_seconds('o_orderkey * 53 % 86400')} as submit_ts",
        f"o_orderdate + {_seconds('o_orderkey * 53 % 86400 + o_custkey * 37 % 7200')} as start_ts",
        "(o_orderkey * 7919 + o_custkey * 31) % 100000 as elapsed",
        # logs of orders of every third month bear dates forty years on, which no accounting row has
        f"o_orderdate + {_seconds('o_orderkey * 53 % 86400')} + case when month(o_orderdate) % 3 = 0 "
        "then make_ym_interval(40) else make_ym_interval(0) end as logged_ts",
    )


def allocation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed_orders(table(spark, sf_dir, "orders")).selectExpr(
        "to_date(o_orderdate) as date",
        "case when o_orderkey % 53 = 0 then concat('x', o_orderkey) "
        "when o_orderkey % 41 = 0 then concat(o_orderkey, '_', o_orderkey % 5) "
        "else cast(o_orderkey as string) end as JobID",
        f"{RUN_UUID} as JobName",
        "case when o_orderkey % 11 <> 0 then concat('acct', o_custkey % 7) end as Account",
        "o_orderpriority as QOS",
        "case when o_orderkey % 29 = 0 then 'CANCELLED by 1009' when o_orderstatus = 'F' then "
        "'COMPLETED' when o_orderstatus = 'O' then 'FAILED' else 'PREEMPTED' end as State",
        f"{_iso('submit_ts')} as Submit",
        f"case when o_orderkey % 89 = 0 then 'Unknown' else {_iso('start_ts')} end as Start",
        "case when o_orderkey % 97 = 0 then 'Unknown' else "
        f"{_iso('start_ts + ' + _seconds('elapsed'))} end as End",
        f"{_clock('elapsed')} as Elapsed",
        "elapsed as ElapsedRaw",
        "case o_orderkey % 4 when 0 then '4G' when 1 then '1000M' when 2 then '1.50G' "
        "else '900000K' end as ReqMem",
        "cast(null as string) as MaxRSS",
        "case when o_orderkey % 13 = 0 then null "
        f"when o_orderkey % 5 = 0 then concat(o_orderkey % 3, '-', {_clock('elapsed % 86400')}) "
        f"when o_orderkey % 5 = 1 then {_clock('elapsed')} "
        "when o_orderkey % 5 = 2 then concat(lpad(cast(o_custkey % 60 as string), 2, '0'), ':', "
        "lpad(cast(o_orderkey % 60 as string), 2, '0'), '.250') "
        "when o_orderkey % 5 = 3 then 'invalid' "
        f"else concat('1-', {_clock('elapsed % 86400')}, '.5') end as TotalCPU",
        "case when o_orderkey % 5 in (3, 4) and o_orderkey % 13 <> 0 and o_orderkey % 2 = 0 then 0 "
        "else (elapsed + 1) * (1 + o_custkey % 16) end as CPUTimeRAW",
        "1 + o_custkey % 16 as AllocCPUS",
        "case when o_orderkey % 2 = 1 then concat('node', o_custkey % 12) end as NodeList",
        "case o_orderkey % 6 when 0 then concat('rule_align_wildcards_sample', o_custkey % 20) "
        "when 1 then concat('rule_merge_', o_custkey % 4) "
        "when 2 then concat('rule_map_reads_', o_custkey % 3, '_wildcards_s', o_orderkey % 10, '_x') "
        "when 3 then concat('hello ', o_custkey) when 4 then null else 'rule_sort' end as Comment",
        "named_struct('file', 'orders', 'block', cast(0 as bigint), 'row', o_orderkey) as _src",
    )


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    days = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) as date")
    return lines.join(days, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "date",
        "concat(l_orderkey, '.', case l_linenumber when 1 then 'batch' when 2 then 'extern' "
        "when 7 then 'abc' else cast(l_linenumber - 3 as string) end) as JobID",
        "case l_linenumber when 1 then 'batch' when 2 then 'extern' else 'python' end as JobName",
        "'COMPLETED' as State",
        "l_partkey * 13 % 100000 as ElapsedRaw",
        "concat(cast(floor(l_extendedprice * 40) as bigint), 'K') as MaxRSS",
        "concat(lpad(cast(l_linenumber as string), 2, '0'), ':', "
        "lpad(cast(l_suppkey % 60 as string), 2, '0'), '.983') as TotalCPU",
        "concat('node', l_suppkey % 9) as NodeList",
        "named_struct('file', 'lineitem', 'block', l_partkey, 'row', "
        "l_suppkey * 1000000000 + cast(floor(l_extendedprice * 100) as bigint)) as _src",
    )


def accounting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation_rows(spark, sf_dir).unionByName(
        step_rows(spark, sf_dir), allowMissingColumns=True
    )


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as dump lines of eight fields, one in seven with a field too many or few."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, "
        "cast(to_date(o_orderdate) as string), "
        "case when o_orderkey % 7 = 0 then concat('a|\"b', o_orderkey) else '\"q' end, "
        "case when o_orderkey % 3 = 0 then '' else cast(o_custkey as string) end, "
        "case when o_orderkey % 5 = 0 then 'x|tail' else 'tail' end) as line"
    )


def accounting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full dump lines of the orders, one in ten with a field too many."""
    keyed = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as JobID",
        f"{RUN_UUID} as JobName",
        "case when o_orderkey % 11 <> 0 then concat('\"acct', o_custkey % 7) end as Account",
        "o_orderpriority as QOS",
        "replace(cast(o_orderdate as string), ' ', 'T') as Submit",
        "o_orderkey * 7919 % 100000 as ElapsedRaw",
        "case when o_orderkey % 3 <> 0 then o_custkey end as NTasks",
        "case when o_orderkey % 10 = 0 then '/w|extra' else '/w' end as WorkDir",
    )
    parts, pending = [], ""
    for position, name in enumerate(ACCOUNTING_COLUMNS):
        pending += "|" if position else ""
        if name in keyed.columns:
            parts += [F.lit(pending), F.coalesce(F.col(name).cast("string"), F.lit(""))]
            pending = ""
    return keyed.select(F.concat(*parts, F.lit(pending)).alias("line"))


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow log per order: ``(log_path, content)``; its inputs may be any part, or none there is.

    Dealt out by the path, so that what is taken out of a log already lies by it.
    """

    def stamp(expression: str) -> str:
        return (
            f"concat('[', date_format(to_date({expression}), 'EEE MMM'), ' ', "
            f"lpad(cast(day({expression}) as string), 2, ' '), ' ', "
            f"substr(cast({expression} as string), 12, 8), ' ', year({expression}), ']\n')"
        )

    key = "o_orderkey"
    inputs = (
        f"concat('    input: /data/p', {key} * 7 % parts, ', p', {key} * 11 % parts, "
        f"' ,/data/p', o_custkey % 10, '\n')"
    )
    preamble = (
        "concat('Building DAG of jobs...\n', "
        f"case when {key} % 5 <> 0 then concat('SLURM run ID: ', {RUN_UUID}, '\n') else '' end, "
        f"case when {key} % 7 = 0 then concat('SLURM run ID: second-', {key}, '\n') else '' end, "
        f"case when {key} % 3 = 0 then 'rule ghost:\nJob 9 has been submitted with SLURM jobid 999 "
        "(log: /g).\n' else '' end)"
    )
    first = (
        f"concat({stamp('logged_ts')}, 'rule align_', o_custkey % 20, ':\n', "
        f"case when {key} % 9 = 0 then '' else {inputs} end, "
        f"'    output: /out/', {key}, '\n    jobid: 3\nJob 3 has been submitted with SLURM jobid ', "
        f"{key}, ' (log: /l/', {key}, '.log).\n')"
    )
    next_day = "logged_ts + interval 1 day"
    second = (
        f"concat({stamp(next_day)}, 'rule merge:\nrule merge_', o_custkey % 4, ':\n', "
        f"case when {key} % 2 = 0 then concat('  INPUT : /data/p', {key} % parts, '\n') else '' end, "
        f"case when {key} % 6 = 0 then 'Job 4 has been submitted with SLURM jobid 1 (log: /a).\n' "
        "else '' end, "
        f"case when {key} % 8 = 3 then '' else concat('job 5 has been  submitted with slurm jobid ', "
        f"{key} + 1, ' (log: /b).\n') end)"
    )
    third = (
        f"concat('[Xyz Foo 99 25:00:00 2020]\ncheckpoint c', {key}, ':\n    input:\n', "
        f"case when {key} % 4 = 1 then 'done ] [Mon Jan  1 00:00:00 2024]\n' else 'done\n' end)"
    )
    content = f"concat({preamble}, {first}, {second}, {third})"
    # one more than there are parts, so that a path or two is in no manifest
    parts = scan_parquet(spark, f"{sf_dir}/part.parquet").select(F.max("p_partkey") + 1).scalar()
    path = (
        f"case {key} % 4 when 0 then concat('/.snakemake/log/', {key}, '.log') "
        f"when 2 then concat('/tmp/random/', {key}, '.log') "
        f"else concat('/data/.snakemake/log/', {key}, '.log') end"
    )
    orders = scan_parquet(spark, f"{sf_dir}/orders.parquet").withColumn("log_path", F.expr(path))
    shaped = _timed_orders(_dealt(orders, "log_path")).withColumn("parts", parts).selectExpr(
        "log_path",
        f"{content} as content",
        f"{key} % 10 = 1 as returned",
    )
    content = F.when(F.col("returned"), F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    # out of a list of one, so that no filter on a text writes it again where the few pieces of the file are read
    return shaped.select("log_path", F.explode(F.array(content)).alias("content"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as files; every 13th is missing and every 17th is empty."""
    return (
        table(spark, sf_dir, "part")
        .where("p_partkey % 13 <> 0")
        .selectExpr(
            "concat('/data/p', p_partkey) as path",
            "case when p_partkey % 17 = 0 then 0 else cast(floor(p_retailprice * 1000) as bigint) "
            "end as length",
        )
    )


def size_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as an input-size table; a job has as many rows as lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as slurm_jobid",
        "cast(l_linenumber as bigint) as job_id",
        "l_returnflag as rule_name",
        "case when l_partkey % 17 = 0 then 0 else cast(floor(l_extendedprice * 1000) as bigint) "
        "end as input_size_bytes",
        "concat('/data/p', l_partkey) as inputs",
    )
