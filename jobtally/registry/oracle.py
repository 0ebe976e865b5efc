"""The same queries in DuckDB's SQL, written from the meaning of each operator."""

from __future__ import annotations

from ..operators.daily import DEFAULT_CAPACITY, METRIC_LABELS
from ..operators.period import PERIOD_METRICS
from .queries import RUN_A, RUN_B

NAN, INF = "'nan'::DOUBLE", "'inf'::DOUBLE"


def uuid(x: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in cuts)


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def clock(x: str) -> str:
    parts = (f"({x}) // 3600", f"({x}) // 60 % 60", f"({x}) % 60")
    return "(" + " || ':' || ".join(f"lpad(({p})::VARCHAR, 2, '0')" for p in parts) + ")"


def r6(x: str) -> str:
    return f"(round(({x}) * 1e6) / 1e6)"


def kinds(x: str, name: str | None = None) -> str:
    name = name or x
    return (
        f"CASE WHEN isfinite({x}) THEN {r6(x)} END AS {name}, "
        f"CASE WHEN {x} IS NULL THEN 'null' WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN 'inf' "
        f"ELSE 'finite' END AS {name}_kind"
    )


def divide(n: str, d: str) -> str:
    return (
        f"CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL WHEN ({d}) = 0 THEN CASE WHEN ({n}) = 0 "
        f"THEN {NAN} WHEN ({n}) > 0 THEN {INF} ELSE -{INF} END "
        f"ELSE ({n})::DOUBLE / ({d})::DOUBLE END"
    )


def first(c: str, order: str = "ord", condition: str | None = None) -> str:
    return f"arg_min({c}, {{'o': {order}, 'v': {c}}}) FILTER (WHERE {condition or c + ' IS NOT NULL'})"


def quantile(x: str, p: float) -> str:
    """Linear interpolation between order statistics, infinities included."""
    values = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    at = f"((count({x}) - 1) * {p}::DOUBLE)"
    low, high = f"{values}[floor({at})::BIGINT + 1]", f"{values}[ceil({at})::BIGINT + 1]"
    return (
        f"CASE WHEN count({x}) = 0 THEN NULL WHEN {low} = {high} THEN {low}::DOUBLE "
        f"ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"
    )


def statistics(x: str) -> str:
    return (
        f"CASE WHEN bool_or(isnan({x})) THEN {NAN} WHEN bool_or(isinf({x})) THEN {INF} "
        f"ELSE avg({x}) FILTER (WHERE isfinite({x})) END AS {x}_mean, "
        f"{quantile(x, 0.5)} AS {x}_median, "
        f"CASE WHEN count({x}) < 2 THEN NULL WHEN bool_or(NOT isfinite({x})) THEN {NAN} "
        f"ELSE stddev_samp({x}) FILTER (WHERE isfinite({x})) END AS {x}_std, "
        f"min({x}) AS {x}_min, "
        f"coalesce(max({x}) FILTER (WHERE NOT isnan({x})), max({x})) AS {x}_max"
    )


def size_bytes(c: str) -> str:
    unit = f"regexp_extract({c}, '([0-9]+)([KMGT])', 2)"
    factor = f"CASE {unit} WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1099511627776 END"
    return (
        f"CASE WHEN regexp_matches({c}, '[0-9]+[KMGT]') "
        f"THEN regexp_extract({c}, '([0-9]+)([KMGT])', 1)::BIGINT * ({factor})::BIGINT "
        "ELSE 0::BIGINT END"
    )


def size_unit(c: str) -> str:
    return f"nullif(regexp_extract({c}, '([0-9]+)([KMGT])', 2), '')"


def cpu_seconds(c: str) -> str:
    def part(pattern: str, group: int) -> str:
        return f"regexp_extract({c}, '{pattern}', {group})::BIGINT"

    days = "^([0-9]+)-([0-9]+):([0-9]+):([0-9]+)$"
    hours = "^([0-9]+):([0-9]+):([0-9]+)$"
    minutes = r"^([0-9]+):([0-9]+)\.[0-9]+$"
    return (
        f"CASE WHEN regexp_matches({c}, '{days}') THEN {part(days, 1)} * 86400 + "
        f"{part(days, 2)} * 3600 + {part(days, 3)} * 60 + {part(days, 4)} "
        f"WHEN regexp_matches({c}, '{hours}') THEN {part(hours, 1)} * 3600 + "
        f"{part(hours, 2)} * 60 + {part(hours, 3)} "
        f"WHEN regexp_matches({c}, '{minutes}') THEN {part(minutes, 1)} * 60 + {part(minutes, 2)} "
        "ELSE 0::BIGINT END"
    )


RULE_NAME = r"""CASE WHEN regexp_matches(Comment, '^rule_.+?_wildcards_.+')
    THEN regexp_extract(Comment, '^rule_(.+?)_wildcards_(.+)$', 1)
    WHEN starts_with(Comment, 'rule_') THEN nullif(substr(Comment, 6), '') ELSE '' END"""
WILDCARDS = (
    "coalesce(regexp_extract(Comment, '^rule_(.+?)_wildcards_(.+)$', 2), '')"
)


def ts(c: str) -> str:
    return f"try_strptime({c}, '%Y-%m-%dT%H:%M:%S')"


RUN_UUID = uuid("(o_custkey % 50)::VARCHAR")

TIMED = """timed AS (
    SELECT *, o_orderdate + to_seconds(o_orderkey * 53 % 86400) AS submit_ts,
        o_orderdate + to_seconds(o_orderkey * 53 % 86400 + o_custkey * 37 % 7200) AS start_ts,
        (o_orderkey * 7919 + o_custkey * 31) % 100000 AS elapsed,
        o_orderdate + to_seconds(o_orderkey * 53 % 86400)
            + to_years(CASE WHEN month(o_orderdate) % 3 = 0 THEN 40 ELSE 0 END) AS logged_ts,
        (SELECT max(p_partkey) + 1 FROM part) AS parts
    FROM orders)"""

JOBS = f"""{TIMED}, jobs AS (
    SELECT o_orderdate::DATE AS date,
        CASE WHEN o_orderkey % 53 = 0 THEN 'x' || o_orderkey
            WHEN o_orderkey % 41 = 0 THEN o_orderkey || '_' || (o_orderkey % 5)
            ELSE o_orderkey::VARCHAR END AS JobID,
        {RUN_UUID} AS JobName,
        CASE WHEN o_orderkey % 11 <> 0 THEN 'acct' || (o_custkey % 7) END AS Account,
        o_orderpriority AS QOS,
        CASE WHEN o_orderkey % 29 = 0 THEN 'CANCELLED by 1009' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
            WHEN o_orderstatus = 'O' THEN 'FAILED' ELSE 'PREEMPTED' END AS State,
        {iso('submit_ts')} AS Submit,
        CASE WHEN o_orderkey % 89 = 0 THEN 'Unknown' ELSE {iso('start_ts')} END AS Start,
        CASE WHEN o_orderkey % 97 = 0 THEN 'Unknown'
            ELSE {iso('start_ts + to_seconds(elapsed)')} END AS "End",
        {clock('elapsed')} AS Elapsed, elapsed AS ElapsedRaw,
        CASE o_orderkey % 4 WHEN 0 THEN '4G' WHEN 1 THEN '1000M' WHEN 2 THEN '1.50G'
            ELSE '900000K' END AS ReqMem,
        NULL::VARCHAR AS MaxRSS,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 3) || '-' || {clock('elapsed % 86400')}
            WHEN o_orderkey % 5 = 1 THEN {clock('elapsed')}
            WHEN o_orderkey % 5 = 2 THEN lpad((o_custkey % 60)::VARCHAR, 2, '0') || ':' ||
                lpad((o_orderkey % 60)::VARCHAR, 2, '0') || '.250'
            WHEN o_orderkey % 5 = 3 THEN 'invalid'
            ELSE '1-' || {clock('elapsed % 86400')} || '.5' END AS TotalCPU,
        CASE WHEN o_orderkey % 5 IN (3, 4) AND o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0 THEN 0
            ELSE (elapsed + 1) * (1 + o_custkey % 16) END AS CPUTimeRAW,
        1 + o_custkey % 16 AS AllocCPUS,
        CASE WHEN o_orderkey % 2 = 1 THEN 'node' || (o_custkey % 12) END AS NodeList,
        CASE o_orderkey % 6 WHEN 0 THEN 'rule_align_wildcards_sample' || (o_custkey % 20)
            WHEN 1 THEN 'rule_merge_' || (o_custkey % 4)
            WHEN 2 THEN 'rule_map_reads_' || (o_custkey % 3) || '_wildcards_s' || (o_orderkey % 10) || '_x'
            WHEN 3 THEN 'hello ' || o_custkey WHEN 4 THEN NULL ELSE 'rule_sort' END AS Comment,
        'orders' AS src_file, 0::BIGINT AS src_block, o_orderkey AS src_row
    FROM timed)"""

ROWS = f"""{JOBS}, steps AS (
    SELECT o_orderdate::DATE AS date,
        l_orderkey || '.' || CASE l_linenumber WHEN 1 THEN 'batch' WHEN 2 THEN 'extern' WHEN 7 THEN 'abc'
            ELSE (l_linenumber - 3)::VARCHAR END AS JobID,
        CASE l_linenumber WHEN 1 THEN 'batch' WHEN 2 THEN 'extern' ELSE 'python' END AS JobName,
        'COMPLETED' AS State, l_partkey * 13 % 100000 AS ElapsedRaw,
        floor(l_extendedprice * 40)::BIGINT || 'K' AS MaxRSS,
        lpad(l_linenumber::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') ||
            '.983' AS TotalCPU,
        'node' || (l_suppkey % 9) AS NodeList,
        'lineitem' AS src_file, l_partkey AS src_block,
        l_suppkey * 1000000000 + floor(l_extendedprice * 100)::BIGINT AS src_row
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
acct AS (
    SELECT *, nullif(regexp_extract(JobID, '^([0-9]+)', 1), '') AS JobRoot,
        CASE WHEN NOT regexp_matches(JobID, '^[0-9]+\\.') THEN 'allocation'
            WHEN JobID LIKE '%.batch' THEN 'batch' WHEN JobID LIKE '%.extern' THEN 'extern'
            WHEN regexp_matches(JobID, '^[0-9]+\\.[0-9]+$') THEN 'step' ELSE 'unknown' END AS JobInfoType
    FROM (SELECT * FROM jobs UNION ALL BY NAME SELECT * FROM steps)),
ordered AS (
    SELECT *, {{
        'd': date,
        'r': CASE JobInfoType WHEN 'allocation' THEN 0 WHEN 'batch' THEN 1 WHEN 'extern' THEN 2
            WHEN 'step' THEN 3 ELSE 4 END,
        's': coalesce(TRY_CAST(regexp_extract(JobID, '^[0-9]+\\.([0-9]+)$', 1) AS BIGINT), -1),
        'f': src_file, 'b': src_block, 'k': src_row}} AS ord
    FROM acct)"""

TEXTS = ["JobID", "JobInfoType", "Account", "QOS", "State", "Submit", "Start", '"End"', "Elapsed",
         "TotalCPU", "NodeList", "Comment"]


def collapsed(keys: str = "JobRoot") -> str:
    firsts = ", ".join(f"{first(c)} AS {c}" for c in TEXTS)
    date = "" if "date" in keys else f", {first('date')} AS date"
    return f"""{ROWS}, alloc AS (
    SELECT {keys}, {firsts}{date}, {first('JobName', condition='length(JobName) = 36')} AS JobName,
        max(ElapsedRaw) AS ElapsedRaw, max(CPUTimeRAW) AS CPUTimeRAW, max(AllocCPUS) AS AllocCPUS,
        {first('ReqMem')} AS req_text, {first('MaxRSS')} AS rss_text,
        max({size_bytes('MaxRSS')}) AS MaxRSS, max({size_bytes('ReqMem')}) AS ReqMem,
        arg_min({size_unit('MaxRSS')}, {{'o': ord, 'v': {size_unit('MaxRSS')}}})
            FILTER (WHERE {size_unit('MaxRSS')} IS NOT NULL) AS MaxRSS_unit,
        arg_min({size_unit('ReqMem')}, {{'o': ord, 'v': {size_unit('ReqMem')}}})
            FILTER (WHERE {size_unit('ReqMem')} IS NOT NULL) AS ReqMem_unit
    FROM ordered GROUP BY {keys}),
report AS (
    SELECT *, MaxRSS / 1073741824::DOUBLE AS MaxRSS_G, ReqMem / 1073741824::DOUBLE AS ReqMem_G,
        {divide('MaxRSS', 'ReqMem')} AS MemEfficiencyRatio,
        ({divide('MaxRSS', 'ReqMem')}) * 100 AS MemEfficiencyPercent,
        {cpu_seconds('TotalCPU')} AS TotalCPU_seconds,
        CASE WHEN CPUTimeRAW = 0 AND {cpu_seconds('TotalCPU')} = 0 THEN 0
            ELSE {divide(cpu_seconds('TotalCPU'), 'CPUTimeRAW')} END * 100 AS CPUEfficiencyPercent,
        {RULE_NAME} AS rule_name, {WILDCARDS} AS wildcards
    FROM alloc)"""


REPORT = collapsed()
HOURS = "CASE WHEN s::DATE = day AND e::DATE = day THEN date_diff('second', s, e) / 3600::DOUBLE " \
    "WHEN s < day AND e::DATE = day THEN date_diff('second', day::TIMESTAMP, e) / 3600::DOUBLE " \
    "WHEN s::DATE = day AND e >= day + INTERVAL '86399 seconds' " \
    "THEN date_diff('second', s, day + INTERVAL '86399 seconds') / 3600::DOUBLE " \
    "WHEN s < day AND e >= day + INTERVAL '86399 seconds' THEN 24::DOUBLE ELSE 0::DOUBLE END"

RULE_ORDER = "{'n': coalesce(TRY_CAST(JobRoot AS BIGINT), -1), 'r': coalesce(JobRoot, '')}"
EFFICIENCY = ["MemEfficiencyPercent", "CPUEfficiencyPercent", "ElapsedRaw"]
SIZE_RELATIVE = ["UsedRAMPerMo", "MinPerMo"]
STATISTICS = ["mean", "median", "std", "min", "max"]


def rule_statistics(source: str, metrics: list[str]) -> str:
    doubles = [f"{m}::DOUBLE AS {m}" for m in metrics]
    return f"""stats AS (
    SELECT rule_name, {', '.join(statistics(m) for m in metrics)},
        min(Elapsed) AS Elapsed_min, max(Elapsed) AS Elapsed_max,
        {', '.join(f"{first(c, RULE_ORDER)} AS {c}" for c in ('QOS', 'Account', 'NodeList'))}
    FROM (SELECT JobRoot, rule_name, Elapsed, QOS, Account, NodeList, {', '.join(doubles)} FROM {source})
    GROUP BY rule_name)"""


def shown_statistics(metrics: list[str]) -> str:
    def shown(m: str, s: str) -> str:
        if m == "ElapsedRaw" and s in ("min", "max"):
            return f"{m}_{s}::BIGINT AS {m}_{s}"
        return kinds(f"{m}_{s}")

    cells = ", ".join(shown(m, s) for m in metrics for s in STATISTICS)
    return f"SELECT rule_name, {cells}, Elapsed_min, Elapsed_max, QOS, Account, NodeList FROM stats"


def daily(capacity: str | None = None) -> str:
    cpu = f"{DEFAULT_CAPACITY['cpu_secondes']}::DOUBLE"
    gb = f"{DEFAULT_CAPACITY['gb_secondes']}::DOUBLE"
    return f"""{collapsed('date, JobRoot')}, timed_jobs AS (
    SELECT *, date_diff('second', {ts('Submit')}, {ts('Start')}) AS wait,
        date_diff('second', {ts('Start')}, {ts('"End"')})::DOUBLE AS duration
    FROM report),
daily AS (
    SELECT date, CASE WHEN grouping(QOS) = 0 THEN 'qos' ELSE 'global' END AS scope, QOS,
        coalesce(sum(TotalCPU_seconds), 0)::BIGINT AS cpu_seconds,
        cpu_seconds / 3600::DOUBLE AS cpu_hours,
        cpu_seconds / {cpu} * 100 AS cpu_percent,
        coalesce(sum(MaxRSS / 1073741824::DOUBLE * ElapsedRaw), 0) AS gb_seconds,
        coalesce(sum((MaxRSS // 1073741824)::DOUBLE * ElapsedRaw), 0) / {gb} * 100 AS ram_percent,
        avg(wait) AS wait_mean, median(wait::DOUBLE) AS wait_median, min(wait) AS wait_min,
        max(wait) AS wait_max,
        count(JobID) FILTER (WHERE {ts('Submit')}::DATE = date) AS submitted,
        count(JobID) FILTER (WHERE {ts('Start')}::DATE = date) AS started,
        count(JobID) FILTER (WHERE {ts('"End"')}::DATE = date) AS ended,
        count(JobID) FILTER (WHERE State = 'COMPLETED') AS succeeded,
        count(JobID) FILTER (WHERE State = 'FAILED') AS failed,
        count(JobID) FILTER (WHERE State = 'PREEMPTED') AS preempted,
        avg(duration) AS duration_mean, median(duration) AS duration_median,
        min(duration) AS duration_min, max(duration) AS duration_max
    FROM timed_jobs GROUP BY GROUPING SETS ((date), (date, QOS)))"""


DAILY = daily()
ROUNDED = {"cpu_hours", "cpu_percent", "gb_seconds", "ram_percent", "wait_mean", "wait_median",
           "duration_mean", "duration_median"}


def quoted(label: str) -> str:
    return "'" + label.replace("'", "''") + "'"


RAM_LABEL, CPU_LABEL = PERIOD_METRICS
SERIES = f"""{DAILY}, series AS (
    SELECT date, {quoted(RAM_LABEL)} AS metric, coalesce(ram_percent, 0) AS value FROM daily
    WHERE scope = 'global'
    UNION ALL
    SELECT date, {quoted(CPU_LABEL)}, coalesce(cpu_percent, 0) FROM daily WHERE scope = 'global')"""

K = "o_orderkey"


def stamp(x: str) -> str:
    return (
        f"'[' || strftime({x}, '%a %b ') || lpad(day({x})::VARCHAR, 2, ' ') || "
        f"strftime({x}, ' %H:%M:%S %Y') || ']\n'"
    )


CONTENT = f"""'Building DAG of jobs...\n'
    || CASE WHEN {K} % 5 <> 0 THEN 'SLURM run ID: ' || {RUN_UUID} || '\n' ELSE '' END
    || CASE WHEN {K} % 7 = 0 THEN 'SLURM run ID: second-' || {K} || '\n' ELSE '' END
    || CASE WHEN {K} % 3 = 0
        THEN 'rule ghost:\nJob 9 has been submitted with SLURM jobid 999 (log: /g).\n' ELSE '' END
    || {stamp('logged_ts')} || 'rule align_' || (o_custkey % 20) || ':\n'
    || CASE WHEN {K} % 9 = 0 THEN '' ELSE '    input: /data/p' || ({K} * 7 % parts) || ', p'
        || ({K} * 11 % parts) || ' ,/data/p' || (o_custkey % 10) || '\n' END
    || '    output: /out/' || {K} || '\n    jobid: 3\nJob 3 has been submitted with SLURM jobid '
    || {K} || ' (log: /l/' || {K} || '.log).\n'
    || {stamp("logged_ts + INTERVAL 1 DAY")} || 'rule merge:\nrule merge_' || (o_custkey % 4) || ':\n'
    || CASE WHEN {K} % 2 = 0 THEN '  INPUT : /data/p' || ({K} % parts) || '\n' ELSE '' END
    || CASE WHEN {K} % 6 = 0 THEN 'Job 4 has been submitted with SLURM jobid 1 (log: /a).\n' ELSE '' END
    || CASE WHEN {K} % 8 = 3 THEN '' ELSE 'job 5 has been  submitted with slurm jobid ' || ({K} + 1)
        || ' (log: /b).\n' END
    || '[Xyz Foo 99 25:00:00 2020]\ncheckpoint c' || {K} || ':\n    input:\n'
    || CASE WHEN {K} % 4 = 1 THEN 'done ] [Mon Jan  1 00:00:00 2024]\n' ELSE 'done\n' END"""

LINES = f"""{TIMED}, texts AS (
    SELECT CASE {K} % 4 WHEN 0 THEN '/.snakemake/log/' WHEN 2 THEN '/tmp/random/'
            ELSE '/data/.snakemake/log/' END || {K} || '.log' AS log_path,
        rtrim({CONTENT}, '\n') AS content
    FROM timed),
lines AS (
    SELECT log_path, unnest(generate_series(0, len(parts) - 1)) AS n, unnest(parts) AS line
    FROM (SELECT log_path, string_split(content, '\n') AS parts FROM texts)),
recorded AS (
    SELECT * FROM (
        SELECT *, sum(CASE WHEN starts_with(line, '[') THEN 1 ELSE 0 END)
            OVER (PARTITION BY log_path ORDER BY n) ::BIGINT AS record_no
        FROM lines)
    WHERE record_no > 0)"""

SUBMITTED = (
    r"(?i)Job\s+([0-9]+)\s+has\s+been\s+submitted\s+with\s+SLURM\s+jobid\s+([0-9]+)\s+\(log:\s*(.+)\)\.$"
)
INPUT = r"(?i)^\s*input\s*:\s*(.+)"
RULE = r"^rule\s+(\S+):"


def last_match(pattern: str, group: int) -> str:
    return (
        f"coalesce(arg_max(regexp_extract(line, '{pattern}', {group}), n) "
        f"FILTER (WHERE regexp_matches(line, '{pattern}')), '')"
    )


PROJECT = r"""CASE WHEN log_path LIKE '%/.snakemake/log/%' THEN
    coalesce(nullif(regexp_extract(log_path, '^(.*)/\.snakemake/log/[^/]+$', 1), ''), '/') END"""

RECORDS = f"""{LINES}, records AS (
    SELECT log_path, record_no, {last_match(SUBMITTED, 2)} AS slurm_jobid,
        {last_match(SUBMITTED, 1)} AS job_id, {last_match(RULE, 1)} AS rule_name,
        {last_match(INPUT, 1)} AS raw_inputs
    FROM recorded GROUP BY log_path, record_no)"""

SIZES = f"""{RECORDS}, files AS (
    SELECT '/data/p' || p_partkey AS path,
        CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE floor(p_retailprice * 1000)::BIGINT END AS length
    FROM part WHERE p_partkey % 13 <> 0),
named AS (
    SELECT log_path, record_no, unnest(generate_series(1, len(parts))) AS pos, trim(unnest(parts)) AS written
    FROM (SELECT log_path, record_no, string_split(raw_inputs, ',') AS parts FROM records
          WHERE job_id <> '' AND raw_inputs <> '')),
found AS (
    SELECT named.log_path, record_no, string_agg(CASE WHEN path IS NULL THEN written ELSE path END, ','
            ORDER BY pos) AS inputs,
        coalesce(sum(length), 0)::BIGINT AS input_size_bytes
    FROM named LEFT JOIN files ON path = CASE WHEN starts_with(written, '/') OR {PROJECT} IS NULL
        THEN written WHEN {PROJECT} = '/' THEN '/' || written ELSE {PROJECT} || '/' || written END
    GROUP BY named.log_path, record_no),
sizes AS (
    SELECT slurm_jobid, job_id, rule_name, coalesce(input_size_bytes, 0) AS input_size_bytes,
        coalesce(inputs, '') AS inputs
    FROM records LEFT JOIN found USING (log_path, record_no) WHERE job_id <> '')"""

CREWS = RECORDS.replace("lines AS (", f"""crews AS (
    SELECT (o_orderkey % 40)::VARCHAR AS log_path, string_agg(rtrim({CONTENT}, '\n'), '\n' ORDER BY o_orderkey) AS content
    FROM timed GROUP BY o_orderkey % 40),
lines AS (""", 1).replace("AS parts FROM texts)", "AS parts FROM crews)", 1)

RUN_IDS = r"""run_ids AS (
    SELECT log_path, arg_min(regexp_extract(line, 'SLURM run ID: (.*)', 1), n) AS run_id
    FROM lines WHERE contains(line, 'SLURM run ID: ') GROUP BY log_path)"""

STAMPED = r"""run_dates AS (
    SELECT DISTINCT try_strptime(
        regexp_replace(regexp_extract(line, '^[^\[\]]*\[([^\[\]]*)\]', 1), ' +', ' ', 'g'),
        '%a %b %d %H:%M:%S %Y')::DATE AS date
    FROM lines)"""


NUMERIC_ID = "CASE WHEN regexp_matches(report.JobID, '^[0-9]+$') THEN report.JobID::BIGINT END"


def relative(size: str) -> str:
    return (
        f"{divide('ElapsedRaw / 60::DOUBLE', size + ' / 1048576::DOUBLE')} AS MinPerMo, "
        f"{divide('ReqMem / 1048576::DOUBLE', size + ' / 1048576::DOUBLE')} AS UsedRAMPerMo, "
        f"{divide('MaxRSS / 1048576::DOUBLE', size + ' / 1048576::DOUBLE')} AS MaxRSSPerMo"
    )


def band(x: str) -> str:
    v = f"({x})::FLOAT"
    cases = [("0", "20", "#ff0000"), ("21", "60", "#d4a500"), ("61", "75", "#ffa500"),
             ("76", "100", "#008000"), ("101", "125", "#ffa500"), ("126", "150", "#ff0000")]
    between = " ".join(f"WHEN {v} BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in cases)
    return (
        f"CASE WHEN ({x}) IS NULL OR isnan({v}) THEN NULL WHEN {v} < 0 OR {v} > 150 THEN '#ff0000' "
        f"{between} END"
    )


def duration(x: str) -> str:
    v = f"({x})::DOUBLE"
    h, m = f"floor({v} / 3600)::BIGINT", f"floor(({v} % 3600) / 60)::BIGINT"
    s = f"floor({v} % 60)::BIGINT"
    return (
        f"CASE WHEN ({x}) IS NULL OR {v} < 0 THEN 'N/A' "
        f"WHEN {h} > 0 THEN {h} || 'h ' || {m} || 'm ' || {s} || 's' "
        f"WHEN {m} > 0 THEN {m} || 'm ' || {s} || 's' ELSE {s} || 's' END"
    )


def distribution(m: str) -> str:
    x = "x"
    return f"""(SELECT '{m}' AS metric, rule_name, count(x) AS n_values, min(x) AS min_value,
        {quantile(x, 0.25)} AS q1, {quantile(x, 0.5)} AS median, {quantile(x, 0.75)} AS q3,
        coalesce(max(x) FILTER (WHERE NOT isnan(x)), max(x)) AS max_value
    FROM (SELECT rule_name, {m}::DOUBLE AS x FROM report WHERE rule_name IS NOT NULL) GROUP BY rule_name)"""


FENCES = """q1 - 1.5::DOUBLE * (q3 - q1) AS lower_fence, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_fence,
    q1 - 3::DOUBLE * (q3 - q1) AS far_lower_fence, q3 + 3::DOUBLE * (q3 - q1) AS far_upper_fence"""

TABLE_CELLS = [
    ("MemEfficiencyPercent", "Efficacité mémoire", ["moyenne", "médiane", "(écart-type)", "minimum", "maximum"]),
    ("CPUEfficiencyPercent", "Efficacité CPU", ["moyenne", "médiane", "(écart-type)", "minimum", "maximum"]),
    ("ElapsedRaw", "Durée", ["moyenne", "médiane", "(écart-type)", "minimum", "maximum"]),
]
CELLS = " UNION ALL ".join(
    f"SELECT rule_name AS rule, '{title} {words[i]}' AS label, {m}_{s}::DOUBLE AS value FROM stats"
    for m, title, words in TABLE_CELLS
    for i, s in enumerate(STATISTICS)
)
ENTRIES = ", ".join(
    f"{{'label': {quoted(label)}, 'value': {c}::DOUBLE}}" for c, label in METRIC_LABELS.items()
)

SQL: dict[str, str] = {
    "job_classification": f"WITH {ROWS} SELECT JobID, JobRoot, JobInfoType FROM acct",
    "size_parsing": f"""WITH {ROWS}, sized AS (
        SELECT JobID, ReqMem AS t FROM jobs UNION ALL SELECT JobID, MaxRSS FROM steps UNION ALL
        SELECT o_orderkey::VARCHAR, CASE o_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '132.77M'
            WHEN 2 THEN o_custkey || 'T' WHEN 3 THEN 'unknown' ELSE o_custkey || 'Gc' END FROM orders)
        SELECT JobID, {size_bytes('t')} AS MaxRSS, {size_unit('t')} AS MaxRSS_unit,
            ({size_bytes('t')}) / 1073741824::DOUBLE AS MaxRSS_G FROM sized""",
    "cpu_time_parsing": f"WITH {ROWS} SELECT JobID, TotalCPU, {cpu_seconds('TotalCPU')} AS TotalCPU_seconds FROM acct",
    "rule_columns": f"WITH {JOBS} SELECT JobID, Comment, {RULE_NAME} AS rule_name, {WILDCARDS} AS wildcards FROM jobs",
    "wait_and_duration": f"""WITH {JOBS}, t AS (SELECT JobID, {ts('Submit')} AS b, {ts('Start')} AS s,
        {ts('"End"')} AS e FROM jobs)
        SELECT JobID, date_diff('second', b, s) AS wait_time_seconds,
            {r6("date_diff('second', b, s) / 3600::DOUBLE")} AS wait_time_hours,
            date_diff('second', s, e)::DOUBLE AS job_duration_seconds FROM t""",
    "daily_overlap": f"""WITH {JOBS}, t AS (
        SELECT JobID, which, day, {ts('Start')} AS s, {ts('"End"')} AS e FROM (
            SELECT *, 'same' AS which, date AS day FROM jobs UNION ALL
            SELECT *, 'after', (date + INTERVAL 1 DAY)::DATE FROM jobs UNION ALL
            SELECT *, 'fixed', DATE '1998-03-15' FROM jobs))
        SELECT JobID, which, day::VARCHAR AS date, {r6(HOURS)} AS daily_duration_hours FROM t""",
    "daily_overlap_calendar": f"""WITH {JOBS}, t AS (
        SELECT JobID, {ts('Start')} AS s, {ts('"End"')} AS e FROM jobs),
        d AS (SELECT JobID, s, e, unnest(generate_series(s::DATE, e::DATE, INTERVAL 1 DAY))::DATE AS day
            FROM t WHERE s IS NOT NULL AND e IS NOT NULL)
        SELECT JobID, day::VARCHAR AS date, {r6(HOURS)} AS hours FROM d""",
    "daily_occupancy": f"""WITH {JOBS}, t AS (
        SELECT QOS, AllocCPUS AS c, {ts('Start')} AS s, {ts('"End"')} + to_days((ElapsedRaw % 400)::INTEGER) AS e FROM jobs),
        d AS (SELECT *, unnest(generate_series(s::DATE, e::DATE, INTERVAL 1 DAY))::DATE AS day
            FROM t WHERE s IS NOT NULL AND e IS NOT NULL)
        SELECT QOS, day::VARCHAR AS date, count(*) AS running_jobs, {r6(f"sum(({HOURS}) * c)")} AS cpu_hours
        FROM d GROUP BY QOS, day""",
    "alloc_aggregate": f"""WITH {REPORT} SELECT JobRoot, JobID, JobName, JobInfoType, Account, QOS, State,
        Submit, Start, "End", Elapsed, ElapsedRaw, TotalCPU, CPUTimeRAW, AllocCPUS, NodeList,
        req_text AS ReqMem, rss_text AS MaxRSS, date::VARCHAR AS date FROM alloc""",
    "alloc_aggregate_by_day": f"""WITH {collapsed('date, JobRoot')} SELECT date::VARCHAR AS date, JobRoot,
        JobID, State, ElapsedRaw, NodeList FROM alloc""",
    "generic_report": f"""WITH {REPORT} SELECT JobRoot, JobID, JobName, JobInfoType, Account, QOS, State,
        ElapsedRaw, NodeList, MaxRSS, MaxRSS_unit, {kinds('MaxRSS_G')}, ReqMem, ReqMem_unit,
        {kinds('ReqMem_G')}, {kinds('MemEfficiencyRatio')}, {kinds('MemEfficiencyPercent')},
        TotalCPU_seconds, CPUTimeRAW, {kinds('CPUEfficiencyPercent')} FROM report""",
    "memory_efficiency": f"""WITH s AS (
        SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE floor(l_extendedprice * 10)::BIGINT END AS used,
            CASE WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 11 = 0 THEN NULL
                ELSE l_quantity::BIGINT * 1024 END AS asked FROM lineitem),
        t AS (SELECT *, {divide('used', 'asked')} AS ratio, ({divide('used', 'asked')}) * 100 AS pct FROM s)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {kinds('ratio', 'MemEfficiencyRatio')},
            {kinds('pct', 'MemEfficiencyPercent')} FROM t""",
    "run_filter_all": f"""WITH {REPORT} SELECT JobRoot, JobName, QOS FROM report
        WHERE starts_with(JobName, '8f14e') AND contains(JobName, 'dd4bea2543')""",
    "run_filter_any": f"""WITH {REPORT}, picked AS (SELECT JobRoot, JobName, QOS FROM report
        WHERE JobName IN ('{RUN_A}', '{RUN_B}'))
        SELECT *, 'set' AS how FROM picked UNION ALL SELECT *, 'pattern' FROM picked""",
    "run_filter_logged": f"""WITH {REPORT}, {LINES.replace(TIMED + ', ', '')}, {RUN_IDS}
        SELECT JobRoot, JobName, QOS FROM report WHERE JobName IN (SELECT run_id FROM run_ids)""",
    "rule_aggregate": f"WITH {REPORT}, {rule_statistics('report', EFFICIENCY)} {shown_statistics(EFFICIENCY)}",
    "rule_tables": f"""WITH {REPORT}, {rule_statistics('report', EFFICIENCY)}, cells AS ({CELLS})
        SELECT rule, label, {kinds('value')} FROM cells""",
    "rule_display": f"""WITH {REPORT}, {rule_statistics('report', EFFICIENCY)} SELECT rule_name AS c0, {', '.join(
        f"round(CPUEfficiencyPercent_{s} * 1000) / 1000 AS c{i + 1}, "
        + (f"NULL::VARCHAR AS b{i + 1}" if s == 'std' else f"{band(f'CPUEfficiencyPercent_{s}')} AS b{i + 1}")
        for i, s in enumerate(STATISTICS))} FROM stats""",
    "rule_distribution": f"""WITH {REPORT}, d AS (
        {' UNION ALL '.join(distribution(m) for m in EFFICIENCY)}), f AS (SELECT *, {FENCES} FROM d)
        SELECT metric, rule_name, n_values, {', '.join(kinds(c) for c in (
            'min_value', 'q1', 'median', 'q3', 'max_value', 'lower_fence', 'upper_fence',
            'far_lower_fence', 'far_upper_fence'))} FROM f""",
    "rule_outliers": f"""WITH {REPORT}, d AS {distribution('CPUEfficiencyPercent')},
        f AS (SELECT rule_name, {FENCES} FROM d)
        SELECT report.rule_name, JobRoot, {r6('CPUEfficiencyPercent')} AS value,
            CPUEfficiencyPercent < far_lower_fence OR CPUEfficiencyPercent > far_upper_fence AS suspected
        FROM report JOIN f ON report.rule_name = f.rule_name
        WHERE CPUEfficiencyPercent < lower_fence OR CPUEfficiencyPercent > upper_fence""",
    "rule_names": f"WITH {REPORT} SELECT DISTINCT rule_name FROM report WHERE rule_name IS NOT NULL",
    "one_rule": f"WITH {REPORT} SELECT JobRoot, rule_name, wildcards FROM report WHERE rule_name = 'align'",
    "exact_quantiles": f"""SELECT l_returnflag, {', '.join(
        f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS {n}"
        for n, p in (('q01', 0.01), ('q25', 0.25), ('median', 0.5), ('q99', 0.99)))}
        FROM lineitem GROUP BY l_returnflag""",
    "input_size_join": f"""WITH {REPORT}, insizes AS (
        SELECT l_orderkey AS slurm_jobid, CASE WHEN l_partkey % 17 = 0 THEN 0
            ELSE floor(l_extendedprice * 1000)::BIGINT END AS input_size_bytes,
            '/data/p' || l_partkey AS inputs FROM lineitem),
        j AS (SELECT JobRoot, JobID, input_size_bytes, inputs, {relative('input_size_bytes')}
            FROM report LEFT JOIN insizes ON slurm_jobid = {NUMERIC_ID})
        SELECT JobRoot, JobID, input_size_bytes, inputs, {kinds('MinPerMo')}, {kinds('UsedRAMPerMo')},
            {kinds('MaxRSSPerMo')} FROM j""",
    "rule_report_relative": f"""WITH {REPORT}, {SIZES.replace(TIMED + ', ', '')}, joined AS (
        SELECT report.* , {relative('input_size_bytes')}
        FROM report LEFT JOIN sizes ON TRY_CAST(sizes.slurm_jobid AS BIGINT) = {NUMERIC_ID}),
        {rule_statistics('joined', EFFICIENCY + SIZE_RELATIVE)}
        {shown_statistics(EFFICIENCY + SIZE_RELATIVE)}""",
    "daily_metrics": f"""WITH {DAILY} SELECT date::VARCHAR AS date, scope, QOS, {', '.join(
        f"{r6(c)} AS {c}" if c in ROUNDED else c for c in METRIC_LABELS)} FROM daily""",
    "daily_display": f"""WITH {DAILY} SELECT date::VARCHAR AS date, scope, QOS, {', '.join(
        [f"round({c} * 100) / 100 AS n{i}" if c in ROUNDED else f"{c} AS n{i}" for i, c in enumerate(
            c for c, label in METRIC_LABELS.items() if "(secondes)" not in label)]
        + [f"{duration(c)} AS t{i}" for i, c in enumerate(
            c for c, label in METRIC_LABELS.items() if "(secondes)" in label)])} FROM daily""",
    "daily_capacity": f"""WITH {DAILY}, capacity AS (
        SELECT o_orderdate::DATE AS date, count(*) * 86400 AS day_seconds FROM orders GROUP BY 1)
        SELECT daily.date::VARCHAR AS date, scope, QOS,
            {r6('cpu_seconds / (day_seconds * 4)::DOUBLE * 100')} AS cpu_percent,
            {r6('gb_seconds / day_seconds::DOUBLE * 100')} AS ram_percent
        FROM daily LEFT JOIN capacity USING (date)""",
    "events_daily": f"""SELECT ts::DATE::VARCHAR AS date,
        CASE WHEN grouping(event_type) = 0 THEN 'type' ELSE 'global' END AS scope, event_type,
        count(*) AS n_events, count(*) FILTER (WHERE value >= 10) AS n_large,
        {r6('sum(value)')} AS total, {r6('avg(value)')} AS mean, {r6('median(value)')} AS median,
        min(value) AS smallest, max(value) AS largest, max(user_id) AS last_user
        FROM events GROUP BY GROUPING SETS ((ts::DATE), (ts::DATE, event_type))""",
    "period_series": f"""WITH {SERIES} SELECT date::VARCHAR AS date, metric,
        CASE WHEN metric = {quoted(RAM_LABEL)} THEN {quoted(PERIOD_METRICS[RAM_LABEL])}
            ELSE {quoted(PERIOD_METRICS[CPU_LABEL])} END AS title, {r6('value')} AS value
        FROM series WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
    "period_range": f"""WITH {SERIES}, p AS (
        SELECT * FROM series WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')
        SELECT metric, {r6('min(value)')} AS min_value, {r6('max(value)')} AS max_value FROM p GROUP BY metric
        UNION ALL SELECT 'days', count(DISTINCT date)::DOUBLE, count(DISTINCT date)::DOUBLE FROM p""",
    "log_records": rf"""WITH {RECORDS} SELECT log_path, record_no, slurm_jobid, job_id, rule_name,
        regexp_replace(trim(raw_inputs), '\s*,\s*', ';', 'g') AS inputs,
        CASE WHEN raw_inputs = '' THEN 0 ELSE len(string_split(raw_inputs, ',')) END::BIGINT AS n_inputs
        FROM records""",
    "log_record_lines": f"""WITH {LINES} SELECT log_path, record_no, count(*) AS n_lines,
        arg_min(line, n) AS first_line, arg_max(line, n) AS last_line FROM recorded GROUP BY ALL""",
    "log_run_ids": f"WITH {LINES}, {RUN_IDS} SELECT log_path, run_id FROM run_ids",
    "log_dates": f"WITH {LINES}, {STAMPED} SELECT date::VARCHAR AS date FROM run_dates WHERE date IS NOT NULL",
    "project_paths": f"WITH {LINES} SELECT log_path, {PROJECT} AS project_dir FROM texts",
    "log_input_sizes": f"WITH {SIZES} SELECT slurm_jobid, job_id, rule_name, input_size_bytes, inputs FROM sizes",
    "run_days": f"""WITH {JOBS}, {LINES.replace(TIMED + ', ', '')}, {STAMPED}
        SELECT JobID, date::VARCHAR AS date FROM jobs WHERE date IN (SELECT date FROM run_dates)""",
    "merge_days": f"""WITH {JOBS} SELECT JobID, CASE WHEN date < DATE '1998-01-01' THEN QOS END AS QOS,
        CASE WHEN date >= DATE '1998-01-01' THEN State END AS State, ElapsedRaw FROM jobs""",
    "malformed_lines": """WITH d AS (
        SELECT concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
            o_orderdate::DATE::VARCHAR, CASE WHEN o_orderkey % 7 = 0 THEN 'a|"b' || o_orderkey ELSE '"q' END,
            CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey::VARCHAR END,
            CASE WHEN o_orderkey % 5 = 0 THEN 'x|tail' ELSE 'tail' END) AS line FROM orders)
        SELECT 'kept' AS what, line FROM d WHERE len(string_split(line, '|')) = 8
        UNION ALL SELECT 'removed', (count(*) FILTER (WHERE len(string_split(line, '|')) <> 8))::VARCHAR FROM d""",
    "typed_ingest": f"""SELECT o_orderkey::VARCHAR AS JobID, {RUN_UUID} AS JobName,
        CASE WHEN o_orderkey % 11 <> 0 THEN '"acct' || (o_custkey % 7) END AS Account,
        o_orderpriority AS QOS, {iso('o_orderdate')} AS Submit, o_orderkey * 7919 % 100000 AS ElapsedRaw,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS NTasks, '/w' AS WorkDir,
        NULL::BIGINT AS AllocCPUS, NULL::VARCHAR AS Comment, NULL::VARCHAR AS MaxRSS
        FROM orders WHERE o_orderkey % 10 <> 0""",
    "efficiency_bands": f"""WITH {REPORT} SELECT JobRoot, {band('MemEfficiencyPercent')} AS mem_band,
        {band('CPUEfficiencyPercent')} AS cpu_band, {band('ElapsedRaw % 160')} AS duration_band,
        NULL::VARCHAR AS other_band FROM report""",
    "duration_labels": f"""WITH {JOBS}, t AS (
        SELECT *, date_diff('second', {ts('Start')}, {ts('"End"')}) AS d, ElapsedRaw / 7::DOUBLE AS share FROM jobs)
        SELECT JobID, {duration('d')} AS duration, {duration('ElapsedRaw')} AS elapsed, 'N/A' AS not_a_number,
            {duration('share - 100')} AS share, round(share * 100) / 100 AS two_places,
            round(share * 1000) / 1000 AS three_places FROM t""",
    "columnar_json": f"""WITH {REPORT}, g AS (
        SELECT rule_name, count(*) AS jobs, min(ElapsedRaw) AS shortest, max(ElapsedRaw) AS longest,
            min(Account) AS account, min(NodeList) FILTER (WHERE rule_name <> 'sort') AS node
        FROM report GROUP BY rule_name)
        SELECT to_json({{{', '.join(f"'{c}': list({c} ORDER BY rule_name)" for c in (
            'rule_name', 'jobs', 'shortest', 'longest', 'account', 'node'))}}})::VARCHAR AS document FROM g""",
    "daily_document": f"""WITH {DAILY}, e AS (
        SELECT date, CASE WHEN scope = 'global' THEN 'global' ELSE coalesce(QOS, '') END AS key,
            unnest([{ENTRIES}], recursive := true) FROM daily)
        SELECT date::VARCHAR AS date, key, label, {r6('value')} AS value FROM e""",
    "document_days": f"""WITH {SERIES} SELECT date::VARCHAR AS date, metric, {r6('value')} AS value
        FROM series WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    "column_subsets": f"""WITH {ROWS} SELECT Account, AllocCPUS, Comment, ElapsedRaw, JobID, JobName, MaxRSS,
        QOS, ReqMem, Submit, TotalCPU, NULL::VARCHAR AS "User", NULL::VARCHAR AS WorkDir FROM acct""",
}
SQL["log_records_by_line"] = SQL["log_records"]
SQL["run_days_by_line"] = SQL["run_days"]

FIRST_DAY, LAST_DAY = (f"(SELECT {f}(o_orderdate)::DATE FROM orders)" for f in ("min", "max"))
JOINED = f"""{REPORT}, {SIZES.replace(TIMED + ', ', '')}, joined AS (
    SELECT report.*, input_size_bytes, inputs, {relative('input_size_bytes')}
    FROM report LEFT JOIN sizes ON TRY_CAST(sizes.slurm_jobid AS BIGINT) = {NUMERIC_ID})"""
SIZE_CELLS = [
    ("UsedRAMPerMo", "RAM utilisée par Mo", ["(moyenne)", "(médiane)", "(écart-type)", "(minimum)", "(maximum)"]),
    ("MinPerMo", "Minutes par Mo", ["(moyenne)", "(médiane)", "(écart-type)", "(minimum)", "(maximum)"]),
]
ALL_CELLS = CELLS + " UNION ALL " + " UNION ALL ".join(
    f"SELECT rule_name AS rule, '{title} {words[i]}' AS label, {m}_{s}::DOUBLE AS value FROM stats"
    for m, title, words in SIZE_CELLS
    for i, s in enumerate(STATISTICS)
)
SQL |= {
    "narrowed_quantiles": SQL["exact_quantiles"],
    "csv_file": SQL["typed_ingest"],
    "ingested_table": f"""WITH t AS ({SQL["typed_ingest"]}) SELECT JobID, Submit, ElapsedRaw, WorkDir,
        (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS removed_lines FROM t""",
    "one_table_day": f"""WITH {JOBS} SELECT JobID, QOS, ElapsedRaw, date::VARCHAR AS date FROM jobs
        WHERE date = {LAST_DAY}""",
    "day_files": f"""WITH {JOBS} SELECT 'several' AS how, JobID, QOS, ElapsedRaw, date::VARCHAR AS date FROM jobs
        WHERE date IS NOT NULL UNION ALL SELECT 'one', JobID, QOS, ElapsedRaw, date::VARCHAR FROM jobs
        WHERE date = {FIRST_DAY}""",
    "clustered_allocations": SQL["alloc_aggregate"],
    "clustered_daily": f"""SELECT date, scope, QOS, cpu_seconds, submitted, ended, failed, duration_max, wait_median,
        ram_percent FROM ({SQL["daily_metrics"]})""",
    "merged_file": SQL["merge_days"],
    "input_size_file": f"""WITH t AS ({SQL["log_input_sizes"]}) SELECT nullif(slurm_jobid, '') AS slurm_jobid,
        job_id, nullif(rule_name, '') AS rule_name, input_size_bytes, nullif(inputs, '') AS inputs FROM t""",
    "log_record_files": SQL["log_records"].replace(RECORDS, CREWS).replace("SELECT log_path, record_no, slurm", "SELECT log_path AS crew, record_no, slurm"),
    "file_sizes": """SELECT c_nationkey AS nation, sum(strlen(c_name) + 1)::BIGINT AS length, 1::BIGINT AS files
        FROM customer GROUP BY c_nationkey""",
    "daily_json_files": SQL["document_days"],
    "rule_report_tables": f"""WITH {JOINED}, {rule_statistics('joined', EFFICIENCY + SIZE_RELATIVE)},
        cells AS ({ALL_CELLS}) SELECT rule, label, {kinds('value')} FROM cells""",
    "rule_report_distributions": f"""WITH {JOINED}, d AS (
        {' UNION ALL '.join(distribution(m).replace('FROM report WHERE', 'FROM joined WHERE')
                            for m in EFFICIENCY + SIZE_RELATIVE)}), f AS (SELECT *, {FENCES} FROM d)
        SELECT metric, rule_name, n_values, {', '.join(kinds(c) for c in (
            'min_value', 'q1', 'median', 'q3', 'max_value', 'lower_fence', 'upper_fence',
            'far_lower_fence', 'far_upper_fence'))} FROM f""",
    "enriched_allocations": f"""WITH {JOINED} SELECT JobRoot, rule_name, input_size_bytes, inputs,
        {kinds('MinPerMo')}, {kinds('UsedRAMPerMo')} FROM joined""",
    "rule_report_run": f"""WITH {REPORT} SELECT JobRoot, JobName, QOS, rule_name, ElapsedRaw, NodeList FROM report
        WHERE JobName = '{RUN_A}'""",
}
