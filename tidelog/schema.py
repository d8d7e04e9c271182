"""The event and frame schemas that all operators share, as DDL text, so that importing needs no session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import levels, timeparse

EVENT = (
    "ts string, ts_ms double, category string, level string, source string, trace_id string, frame_seq bigint, "
    "data map<string,string>, message string, adapter string, raw string, log_label string, log_path string, level_escalated_from string, escalation_reason string"
)
STACK_FRAME = "array<struct<file:string,line:int,func:string>>"
FRAME = (
    "schema_version string, frame_id string, profile string, sequence bigint, timestamp string, timestamp_ms double, summary string, recommended_next string, confidence double, "
    "tags array<string>, program struct<running:boolean,pid:int,name:string>, "
    f"error struct<type:string,message:string,fingerprint:string,occurrences:int,frames:{STACK_FRAME}>, "
    "anomaly struct<kind:string,severity:string,confidence:double,evidence:array<string>>, perf map<string,double>, state_delta map<string,string>, "
    "correlation map<string,array<string>>, capture_meta map<string,string>, image_file string, json_file string, action_log_offset bigint, log_offset bigint"
)
# The shipped events' types as levels.
EVENT_TYPE_LEVEL = {"error": "ERROR", "signup": "WARN", "purchase": "INFO", "click": "DEBUG", "view": "TRACE"}


def from_events(events: DataFrame) -> DataFrame:
    """The shipped events table as unified events: time in epoch ms, level by type, one source per user."""
    return events.select(
        "event_id",
        timeparse.ntz_ms(F.col("ts")).alias("ts_ms"),
        F.col("event_type").alias("category"),
        F.coalesce(levels.lookup(EVENT_TYPE_LEVEL, F.col("event_type")), F.lit("INFO")).alias("level"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        "user_id",
        "value",
        "props",
    )


def load_frame(text: "F.Column") -> "F.Column":
    """A frame from JSON: unknown keys are ignored, missing ones null."""
    return F.from_json(text, FRAME, {"mode": "PERMISSIVE"})
