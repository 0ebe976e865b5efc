"""Fixed schemas: the accounting table, its column subsets, the size table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The accounting dump's columns, in dump order.
ACCOUNTING_COLUMNS = """
    Account AdminComment AllocCPUS AllocNodes AllocTRES AssocID AveCPU
    AveCPUFreq AveDiskRead AveDiskWrite AvePages AveRSS AveVMSize BlockID
    Cluster Comment Constraints ConsumedEnergy ConsumedEnergyRaw Container
    CPUTime CPUTimeRAW DBIndex DerivedExitCode Elapsed ElapsedRaw Eligible
    End ExitCode Flags GID Group JobID JobIDRaw JobName Layout MaxDiskRead
    MaxDiskReadNode MaxDiskReadTask MaxDiskWrite MaxDiskWriteNode
    MaxDiskWriteTask MaxPages MaxPagesNode MaxPagesTask MaxRSS MaxRSSNode
    MaxRSSTask MaxVMSize MaxVMSizeNode MaxVMSizeTask McsLabel MinCPU
    MinCPUNode MinCPUTask NCPUS NNodes NodeList NTasks Partition Priority
    QOS QOSRAW Reason ReqCPUFreq ReqCPUFreqGov ReqCPUFreqMax ReqCPUFreqMin
    ReqCPUS ReqMem ReqNodes ReqTRES Reservation ReservationId Reserved
    ResvCPU ResvCPURAW Start State Submit SubmitLine Suspended SystemComment
    SystemCPU Timelimit TimelimitRaw TotalCPU TRESUsageInAve TRESUsageInMax
    TRESUsageInMaxNode TRESUsageInMaxTask TRESUsageInMin TRESUsageInMinNode
    TRESUsageInMinTask TRESUsageInTot TRESUsageOutAve TRESUsageOutMax
    TRESUsageOutMaxNode TRESUsageOutMaxTask TRESUsageOutMin
    TRESUsageOutMinNode TRESUsageOutMinTask TRESUsageOutTot UID User UserCPU
    WCKey WCKeyID WorkDir
""".split()

# The integer columns; every other column is text.
INTEGER_COLUMNS = """
    AllocCPUS AllocNodes AssocID ConsumedEnergyRaw CPUTimeRAW DBIndex
    ElapsedRaw GID MaxDiskReadTask MaxDiskWriteTask MaxPages MaxPagesTask
    MaxRSSTask MaxVMSizeTask MinCPUTask NCPUS NNodes NTasks Priority QOSRAW
    ReqCPUS ReqNodes ResvCPURAW UID WCKeyID
""".split()

# The columns useful for analysis.
USEFUL_COLUMNS = """
    Account AllocCPUS AllocNodes AveCPU AveCPUFreq AveDiskRead AveDiskWrite
    AvePages AveRSS AveVMSize Comment CPUTime CPUTimeRAW DerivedExitCode
    Elapsed ElapsedRaw End ExitCode Flags Group JobID JobName MaxDiskRead
    MaxDiskReadNode MaxDiskReadTask MaxDiskWrite MaxDiskWriteNode
    MaxDiskWriteTask MaxPages MaxPagesNode MaxPagesTask MaxRSS MaxRSSNode
    MaxRSSTask MaxVMSize MaxVMSizeNode MaxVMSizeTask MinCPU MinCPUNode
    MinCPUTask NCPUS NNodes NodeList NTasks Partition QOS ReqCPUS ReqMem
    ReqNodes Start State Submit SubmitLine Suspended SystemCPU Timelimit
    TimelimitRaw TotalCPU User UserCPU WorkDir
""".split()

# The columns shown in common reports.
INTERESTING_COLUMNS = """
    Account AllocCPUS Comment CPUTime CPUTimeRAW DerivedExitCode Elapsed
    ElapsedRaw End ExitCode Group JobID JobName MaxDiskRead MaxDiskWrite
    MaxRSS MaxVMSize QOS ReqCPUS ReqMem ReqNodes Start State Submit
    SubmitLine Suspended SystemCPU Timelimit TimelimitRaw TotalCPU User
    UserCPU WorkDir
""".split()

ACCOUNTING_SCHEMA = T.StructType(
    [
        T.StructField(name, T.LongType() if name in INTEGER_COLUMNS else T.StringType())
        for name in ACCOUNTING_COLUMNS
    ]
)

# Where a row came from: file, byte offset of its file block, row within the block.
SOURCE_TYPE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)
SOURCE_COLUMN = "_src"
# The place of a row among those of its job, as clustered tables hold it.
PLACE_COLUMN = "_job_place"

INPUT_SIZE_SCHEMA = T.StructType(
    [
        T.StructField("slurm_jobid", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("input_size_bytes", T.LongType()),
        T.StructField("inputs", T.StringType()),
    ]
)

_ACCOUNTING_TYPES = {f.name: f.dataType for f in ACCOUNTING_SCHEMA}


def accounting_cast(df: DataFrame, name: str) -> Column:
    """``name`` of ``df`` in its accounting type; other columns stay as they are."""
    wanted = _ACCOUNTING_TYPES.get(name)
    column = F.col(f"`{name}`")
    if wanted is None or df.schema[name].dataType == wanted:
        return column
    return column.try_cast(wanted).alias(name)


def conform(df: DataFrame, keep_extra: bool = True) -> DataFrame:
    """All accounting columns in order and type (absent ones null), then the extra ones."""
    present = set(df.columns)
    columns = [
        accounting_cast(df, f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in ACCOUNTING_SCHEMA
    ]
    extra = [F.col(f"`{c}`") for c in df.columns if c not in _ACCOUNTING_TYPES]
    return df.select(*columns, *(extra if keep_extra else []))


def column_subset(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)
