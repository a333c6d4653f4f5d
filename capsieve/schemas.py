"""Input and output schemas, as Spark DDL."""

FINGERPRINT = "STRUCT<exists: BOOLEAN, size: BIGINT, mtime: TIMESTAMP, sha256: STRING>"

SEGMENT_METADATA = (
    "STRUCT<avg_logprob: DOUBLE, no_speech_prob: DOUBLE, compression_ratio: DOUBLE, confidence: DOUBLE>"
)

ENGINE_OUTPUT = (
    "schema_version STRING, sample_id STRING, source_path STRING, engine STRING, "
    "duration_seconds DOUBLE, elapsed_total_seconds DOUBLE, metadata MAP<STRING, STRING>, "
    "segments ARRAY<STRUCT<start_ms: BIGINT, end_ms: BIGINT, text: STRING, "
    f"metadata: {SEGMENT_METADATA}>>"
)

MANIFEST = (
    "run_id STRING, status STRING, created_at_utc STRING, updated_at_utc STRING, "
    "discovery STRUCT<video_count: BIGINT, candidate_count: BIGINT>, "
    "excluded_videos ARRAY<STRING>, candidates ARRAY<STRUCT<sample_id: STRING, video_path: STRING>>, "
    "candidate_failures ARRAY<STRUCT<sample_id: STRING, video_path: STRING, phase: STRING, reason: STRING>>"
)

# Every field is read as a string first, so that a number written as text is still accepted.
EVENT = (
    "event STRING, engine STRING, device STRING, index STRING, total STRING, video_path STRING, "
    "path STRING, run_dir STRING, phase STRING, reason STRING, sample_id STRING"
)
