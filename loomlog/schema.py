"""Input schemas of the event records and the column lists of the fact tables.

Numeric leaves are declared STRING because logs may carry numbers as text; they are
cast with ``try_cast`` so that anything else counts as 0.
"""

from __future__ import annotations

import re

# Event type names of the public Spark event-log format.
LOG_START = "SparkListenerLogStart"
APP_START = "SparkListenerApplicationStart"
APP_END = "SparkListenerApplicationEnd"
ENVIRONMENT = "SparkListenerEnvironmentUpdate"
RESOURCE_PROFILE = "SparkListenerResourceProfileAdded"
EXECUTOR_ADDED = "SparkListenerExecutorAdded"
EXECUTOR_REMOVED = "SparkListenerExecutorRemoved"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
SQL_START_SUFFIX = "SparkListenerSQLExecutionStart"

APP_SCHEMA = (
    "`App ID` string, `App Name` string, `Spark Version` string, Timestamp string"
)
ENVIRONMENT_SCHEMA = "`Spark Properties` map<string,string>"
PROFILE_SCHEMA = (
    "`Executor Resource Requests` struct<"
    "cores: struct<Amount: string>, memory: struct<Amount: string>, "
    "memoryOverhead: struct<Amount: string>, offHeap: struct<Amount: string>>"
)
EXECUTOR_SCHEMA = (
    "Timestamp string, `Executor ID` string, "
    "`Executor Info` struct<Host: string, `Total Cores`: string>"
)
JOB_START_SCHEMA = (
    "`Job ID` string, `Submission Time` string, "
    "`Stage Infos` array<struct<`Stage ID`: string, `Number of Tasks`: string>>"
)
JOB_END_SCHEMA = "`Job ID` string, `Completion Time` string"
STAGE_SCHEMA = (
    "`Stage Info` struct<`Stage ID`: string, `Stage Attempt ID`: string, "
    "`Stage Name`: string, `Number of Tasks`: string, `Parent IDs`: array<bigint>, "
    "`Submission Time`: string, `Completion Time`: string>"
)
TASK_SCHEMA = (
    "`Stage ID` string, `Stage Attempt ID` string, "
    "`Task Info` struct<`Executor ID`: string, Host: string, `Launch Time`: string, "
    "`Finish Time`: string, Failed: boolean, Speculative: boolean>, "
    "`Task Metrics` struct<`Executor Run Time`: string, `Executor CPU Time`: string, "
    "`Executor Deserialize Time`: string, `Result Serialization Time`: string, "
    "`Result Size`: string, `JVM GC Time`: string, `Peak Execution Memory`: string, "
    "`Memory Bytes Spilled`: string, `Disk Bytes Spilled`: string, "
    "`Shuffle Read Metrics`: struct<`Total Bytes Read`: string, `Remote Bytes Read`: string, "
    "`Local Bytes Read`: string, `Remote Bytes Read To Disk`: string, "
    "`Fetch Wait Time`: string, `Total Records Read`: string>, "
    "`Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: string, "
    "`Shuffle Write Time`: string, `Shuffle Records Written`: string>, "
    "`Input Metrics`: struct<`Bytes Read`: string, `Records Read`: string>, "
    "`Output Metrics`: struct<`Bytes Written`: string, `Records Written`: string>>, "
    "`Task Executor Metrics` struct<MinorGCCount: string, MajorGCCount: string, "
    "TotalGCTime: string>"
)
SQL_START_SCHEMA = "executionId string, description string"
SQL_PLAN_SCHEMA = SQL_START_SCHEMA + ", sparkPlanInfo string"

# task_fact column -> path of its numeric leaf in the task-end record.
TASK_NUMBERS = {
    "stage_id": "`Stage ID`",
    "attempt_id": "`Stage Attempt ID`",
    "launch_ms": "`Task Info`.`Launch Time`",
    "finish_ms": "`Task Info`.`Finish Time`",
    "run_ms": "`Task Metrics`.`Executor Run Time`",
    "cpu_ns": "`Task Metrics`.`Executor CPU Time`",
    "deser_ms": "`Task Metrics`.`Executor Deserialize Time`",
    "ser_ms": "`Task Metrics`.`Result Serialization Time`",
    "result_bytes": "`Task Metrics`.`Result Size`",
    "gc_ms": "`Task Metrics`.`JVM GC Time`",
    "peak_mem_bytes": "`Task Metrics`.`Peak Execution Memory`",
    "mem_spill_bytes": "`Task Metrics`.`Memory Bytes Spilled`",
    "disk_spill_bytes": "`Task Metrics`.`Disk Bytes Spilled`",
    "sr_total_bytes": "`Task Metrics`.`Shuffle Read Metrics`.`Total Bytes Read`",
    "sr_remote_bytes": "`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read`",
    "sr_local_bytes": "`Task Metrics`.`Shuffle Read Metrics`.`Local Bytes Read`",
    "sr_remote_disk_bytes": "`Task Metrics`.`Shuffle Read Metrics`.`Remote Bytes Read To Disk`",
    "fetch_wait_ms": "`Task Metrics`.`Shuffle Read Metrics`.`Fetch Wait Time`",
    "sr_records": "`Task Metrics`.`Shuffle Read Metrics`.`Total Records Read`",
    "sw_bytes": "`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Bytes Written`",
    "sw_time_ns": "`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Write Time`",
    "sw_records": "`Task Metrics`.`Shuffle Write Metrics`.`Shuffle Records Written`",
    "input_bytes": "`Task Metrics`.`Input Metrics`.`Bytes Read`",
    "input_records": "`Task Metrics`.`Input Metrics`.`Records Read`",
    "output_bytes": "`Task Metrics`.`Output Metrics`.`Bytes Written`",
    "output_records": "`Task Metrics`.`Output Metrics`.`Records Written`",
    "minor_gc": "`Task Executor Metrics`.MinorGCCount",
    "major_gc": "`Task Executor Metrics`.MajorGCCount",
    "tem_gc_ms": "`Task Executor Metrics`.TotalGCTime",
}

# Task ends as Spark writes them: whole numbers, which the reader takes without a detour over text.
# Leaves that are text by nature, or may be, stay STRING; ``BAD`` holds a record that differs.
TASK_TEXTS = ("Executor ID", "Host", "Result Size")
BAD = "_bad"
TASK_WHOLE_SCHEMA = re.sub(
    r"`?([A-Z][\w ]*?)`?(:? )string",
    lambda leaf: leaf[0] if leaf[1] in TASK_TEXTS else f"`{leaf[1]}`{leaf[2]}bigint",
    TASK_SCHEMA,
) + f", {BAD} string"

# The configuration keys a report keeps.
ENV_KEYS = (
    "spark.executor.instances",
    "spark.executor.memory",
    "spark.executor.cores",
    "spark.driver.memory",
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.scheduler.mode",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.dynamicAllocation.enabled",
)
