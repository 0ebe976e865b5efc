"""Workflow logs: records, run ids, run dates.

Logs come in three shapes. Lines ``(log_path, block, row, line)`` are for files of
any size: ``block`` tells apart the pieces of a file that different tasks read,
``row`` orders lines within a block, and no log is ever held whole by one task.
Texts ``(log_path, content)`` are for logs already kept one per row: they are
taken apart within the row, without a shuffle. Pieces ``(log_path, block, row, piece)``
are records as a reader that splits files at record starts gives them. All give the
same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, times
from ..session import materialize

# Line formats of workflow logs.
RECORD_START = "["
RULE_LINE = r"^rule\s+(\S+):"
INPUT_LINE = r"(?id)^\s*input\s*:\s*(.+)"
SUBMISSION_LINE = (
    r"(?id)Job\s+([0-9]+)\s+has\s+been\s+submitted\s+with\s+SLURM\s+jobid\s+([0-9]+)"
    r"\s+\(log:\s*(.+)\)\.\z"
)
RUN_ID_MARK = "SLURM run ID: "
RUN_ID_LINE = r"(?d)SLURM run ID: (.*)"


# The same inside a text of many lines, where white space must not reach the next line.
RULE_IN_TEXT = r"(?md)^rule[^\S\n]+(\S+):"
INPUT_IN_TEXT = r"(?imd)^[^\S\n]*input[^\S\n]*:[^\S\n]*(.+)"
SUBMISSION_IN_TEXT = (
    r"(?imd)Job[^\S\n]+([0-9]+)[^\S\n]+has[^\S\n]+been[^\S\n]+submitted[^\S\n]+with"
    r"[^\S\n]+SLURM[^\S\n]+jobid[^\S\n]+([0-9]+)[^\S\n]+\(log:[^\S\n]*(.+)\)\.$"
)


def number_records(lines: DataFrame) -> DataFrame:
    """Lines with the number of the record they belong to, from 1; others dropped.

    A record starts at a line opening with ``[``; lines before the first one
    belong to none. Record starts are counted within each block, and each block
    then starts from the count of the blocks before it, so a long log is
    numbered by many tasks.
    """
    starts = F.col("line").startswith(RECORD_START).cast("bigint")
    in_block = Window.partitionBy("log_path", "block").orderBy("row")
    before = Window.partitionBy("log_path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = (
        lines.groupBy("log_path", "block")
        .agg(F.sum(starts).alias("_starts"))
        .select(
            F.col("log_path").alias("_path"),
            F.col("block").alias("_block"),
            F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_offset"),
        )
    )
    same_block = (F.col("log_path") == F.col("_path")) & (F.col("block") == F.col("_block"))
    return (
        lines.withColumn("_count", F.sum(starts).over(in_block))
        .join(blocks, same_block)
        .withColumn("record_no", F.col("_count") + F.col("_offset"))
        .where(F.col("record_no") > 0)
        .select(*lines.columns, "record_no")
    )


def record_parts(lines: DataFrame, *values: Column) -> DataFrame:
    """``values`` over the lines that a record has in a block: ``(log_path, block, start_block, record_no, ...)``.

    Lines are computed once and come together by their block, unless they lie so already; they are numbered and
    aggregated there, and what is left of them is stored. A record's lines in later blocks are led by a row of counts a
    block to ``start_block``, where the record starts; all parts then shuffle once, to that block.
    So grouping by ``log_path``, ``start_block`` and ``record_no`` shuffles them no more.
    """
    starts = F.col("line").startswith(RECORD_START).cast("bigint")
    in_block = Window.partitionBy("log_path", "block").orderBy("row")
    counted = lines.withColumn("_count", F.sum(starts).over(in_block))
    found = counted.groupBy("log_path", "block", "_count").agg(*values)
    ahead = F.lead("_count").over(Window.partitionBy("log_path", "block").orderBy("_count"))
    parts = materialize(found.withColumn("_last", ahead.isNull()), "zstd")
    before = Window.partitionBy("log_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("_count") > 0, F.struct("block", "_count"))
    blocks = materialize(
        parts.where("_last").select(
            "log_path", "block",
            F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
            F.last(opened, ignorenulls=True).over(before).alias("_opened"),
        ),
        "zstd",
    )
    parts = parts.drop("_last")
    own = parts.where(F.col("_count") > 0).withColumn("start_block", F.col("block"))
    carried = blocks.where(F.col("_opened").isNotNull()).drop("_offset")
    later = parts.where(F.col("_count") == 0).join(carried, ["log_path", "block"])
    led = later.withColumns({"_count": F.col("_opened._count"), "start_block": F.col("_opened.block")})
    later = materialize(led.select(*own.columns), "zstd")  # so that this join's shuffle and the next are not on disk at once
    offsets = blocks.select("log_path", F.col("block").alias("start_block"), "_offset")
    numbered = own.unionByName(later).join(offsets, ["log_path", "start_block"])
    others = [F.col(f"`{c}`") for c in own.columns if c not in ("log_path", "block", "start_block", "_count")]
    return numbered.select("log_path", "block", "start_block", (F.col("_count") + F.col("_offset")).alias("record_no"), *others)


def _input_list(raw: Column) -> Column:
    parts = F.transform(F.split(raw, ","), text.trim_spaces)
    return F.coalesce(parts, F.array().cast("array<string>"))


def log_records(lines: DataFrame) -> DataFrame:
    """One row per record: ids, rule and inputs, each from its last matching line.

    Lines that say nothing are dropped, and the others cut down to what they
    say, before the shuffle.
    """
    line = F.col("line")
    telling = lines.where(
        line.startswith(RECORD_START)
        | line.rlike(RULE_LINE)
        | line.rlike(INPUT_LINE)
        | line.rlike(SUBMISSION_LINE)
    ).select(
        "log_path",
        "block",
        "row",
        F.substring(line, 1, 1).alias("line"),
        text.extract_or_null(line, SUBMISSION_LINE, 2).alias("slurm_jobid"),
        text.extract_or_null(line, SUBMISSION_LINE, 1).alias("job_id"),
        text.extract_or_null(line, RULE_LINE, 1).alias("rule_name"),
        text.extract_or_null(line, INPUT_LINE, 1).alias("inputs"),
    )

    def last(name: str, place: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(place)))

    fields = ("slurm_jobid", "job_id", "rule_name", "inputs")
    parts = record_parts(telling, *[last(c, "row").alias(c) for c in fields])
    records = parts.groupBy("log_path", "start_block", "record_no").agg(
        *[F.coalesce(last(c, "block"), F.lit("")).alias(c) for c in fields[:3]], last("inputs", "block").alias("_inputs")
    )
    return records.select(
        "log_path",
        "record_no",
        "slurm_jobid",
        "job_id",
        "rule_name",
        _input_list(F.col("_inputs")).alias("inputs"),
        text.project_dir(F.col("log_path")).alias("project_dir"),
    )


def log_records_of_texts(texts: DataFrame) -> DataFrame:
    """``log_records`` of logs kept one per row."""
    content = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    pieces = texts.select(
        "log_path",
        # Only a first piece can be a preamble; number 0 is then the preamble's.
        F.col("content").startswith(RECORD_START).cast("bigint").alias("_first"),
        F.posexplode(F.split(content, r"\n(?=\[)", -1)).alias("_pos", "_piece"),
    )
    numbered = pieces.withColumn("record_no", F.col("_pos") + F.col("_first"))
    found = numbered.where(F.col("record_no") > 0).select(
        "log_path", "record_no", *_matches(F.col("_piece"))
    )
    # out of a list of one, so that filters on fields find no pattern a second time
    found = found.select("log_path", "record_no", F.inline(F.array(F.struct(*_submitted_ids(), "_rule", "_inputs"))))
    return found.select("log_path", "record_no", "slurm_jobid", "job_id", *_other_fields())


def _matches(piece: Column) -> list[Column]:
    """The last submission, rule and input lines of a record."""

    def last(pattern: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(piece, F.lit(pattern), F.lit(group)), F.lit(-1))

    return [
        last(SUBMISSION_IN_TEXT, 0).alias("_submission"),
        last(RULE_IN_TEXT, 1).alias("_rule"),
        last(INPUT_IN_TEXT, 1).alias("_inputs"),
    ]


def _submitted_ids() -> list[Column]:
    def submitted(group: int) -> Column:
        return F.coalesce(F.regexp_extract("_submission", SUBMISSION_IN_TEXT, group), F.lit(""))

    return [submitted(2).alias("slurm_jobid"), submitted(1).alias("job_id")]


def _other_fields() -> list[Column]:
    return [
        F.coalesce("_rule", F.lit("")).alias("rule_name"),
        _input_list(F.col("_inputs")).alias("inputs"),
        text.project_dir(F.col("log_path")).alias("project_dir"),
    ]


def log_records_of_pieces(pieces: DataFrame) -> DataFrame:
    """``log_records`` of logs read in pieces, each a whole record, by one scan.

    The fields are taken out in the scan and stored; the texts go no further. Numbers come from
    what is stored: a row of counts for each block, summed over the blocks before it, tells where
    the block starts, so only those rows are joined and no log is ordered in one task. The first
    piece of a log is a record if it opens with ``[``, else a preamble, which is no record.
    Every other piece lost its ``[`` to the reader.
    """
    # No rule or input line opens with a bracket, so one more in front of a first piece changes nothing.
    whole = F.concat(F.lit(RECORD_START), F.col("piece"))
    opens = F.col("piece").startswith(RECORD_START).cast("bigint")
    matched = pieces.select("log_path", "block", "row", opens.alias("_opens"), *_matches(whole))
    stored = materialize(matched.select("log_path", "block", "row", "_opens", *_submitted_ids(), *_other_fields()))
    by_block = Window.partitionBy("log_path").orderBy("block")
    before = F.sum("_pieces").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = (
        stored.groupBy("log_path", "block")
        .agg(F.min("row").alias("_start"), F.count("*").alias("_pieces"), F.min_by("_opens", "row").alias("_first"))
        .select(
            "log_path", "block", "_start",
            (F.coalesce(before, F.lit(0)) + F.first("_first").over(by_block)).alias("_offset"),
        )
    )
    numbered = stored.join(blocks, ["log_path", "block"]).withColumn(
        "record_no", F.col("row") - F.col("_start") + F.col("_offset")
    )
    return numbered.where(F.col("record_no") > 0).select(
        "log_path", "record_no", "slurm_jobid", "job_id", "rule_name", "inputs", "project_dir"
    )


def submitted_records(records: DataFrame) -> DataFrame:
    return records.where(F.col("job_id") != "")


def run_ids(lines: DataFrame) -> DataFrame:
    """First run id of each log that has one: ``(log_path, run_id)``."""
    marked = lines.where(F.col("line").contains(RUN_ID_MARK))
    run_id = F.regexp_extract("line", RUN_ID_LINE, 1)
    return marked.groupBy("log_path").agg(
        F.min_by(run_id, F.struct("block", "row")).alias("run_id")
    )


def run_ids_of_texts(texts: DataFrame) -> DataFrame:
    marked = texts.where(F.col("content").contains(RUN_ID_MARK))
    run_id = F.regexp_replace(F.regexp_extract("content", RUN_ID_LINE, 1), r"\r\z", "")
    return marked.select("log_path", run_id.alias("run_id"))


def _distinct_dates(stamped: DataFrame) -> DataFrame:
    """Distinct dates of lines that have a stamp.

    Stamps are first reduced to their distinct days as text, map-side, and only
    those few are parsed. They leave the grouping as an aggregate, because a
    filter on a group key would move below it and parse every line again.
    """
    days = (
        stamped.select(times.stamp_day(F.col("line")).alias("day"))
        .groupBy("day")
        .agg(F.any_value("day").alias("text"))
    )
    dated = days.select(times.day_date(F.col("text")).alias("date"))
    return dated.where(F.col("date").isNotNull()).distinct()


def run_dates(lines: DataFrame) -> DataFrame:
    """Distinct dates stamped on lines of any log: ``(date)``."""
    line = F.col("line")
    return _distinct_dates(lines.where(line.contains("[") & times.has_log_stamp(line)))


def run_dates_of_texts(texts: DataFrame) -> DataFrame:
    stamps = F.regexp_extract_all("content", F.lit(times.LOG_STAMP_IN_TEXT), F.lit(0))
    return _distinct_dates(texts.select(F.explode(stamps).alias("line")))
