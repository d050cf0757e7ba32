"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

USER = "struct<role:string,dept:string,seniority:string,email:string>"
THREAD = "struct<id_hash:string,age_days:int,prior_msgs:int>"
ATTACHMENT = (
    "struct<name:string,size:bigint,mime:string,content_summary:string,sensitivity_indicators:array<string>>"
)
SPAN = "struct<type:string,start:int,end:int,text:string,confidence:double>"
LABELS = "struct<sensitivity:double,exposure:double,context:double,obfuscation:double>"

# A converted message, one JSON object per line.
MESSAGE_DDL = f"""
    msg_id bigint, channel string, user {USER}, recipients array<string>, thread {THREAD}, subject string, body string,
    attachments array<{ATTACHMENT}>, links array<string>, labels {LABELS}, spans array<{SPAN}>, meta map<string,string>
"""
MESSAGE_KEYS = [
    "channel", "user", "recipients", "thread", "subject", "body", "attachments", "links", "labels", "spans", "meta",
]


def message_schema(corrupt_column: str | None = None) -> T.StructType:
    schema = T.StructType.fromDDL(MESSAGE_DDL)
    return schema.add(corrupt_column, T.StringType()) if corrupt_column else schema


BATCH_DDL = """
    batch_id string, provider string, model string, request_count int, created_at double, timeout_at double,
    run_session_id string, split_name string, input_file string, status string, request_indices array<int>,
    results_retrieved boolean, error_message string
"""
SESSION_DDL = """
    session_id string, start_time double, config map<string,string>, output_dir string, splits array<string>,
    status string, end_time double, error_message string
"""
PUZZLE_EXAMPLE = "struct<input:array<array<int>>,output:array<array<int>>>"
PUZZLE_FILE_DDL = f"name string, train array<{PUZZLE_EXAMPLE}>, test array<{PUZZLE_EXAMPLE}>"
BOARD_DDL = "source string, q string, a string, rating int"

FINAL_BATCH_STATES = ["completed", "failed"]
