"""Explicit schemas of the stored tables; a field that an old row lacks reads as null."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

_S, _L, _T, _B = StringType(), LongType(), TimestampNTZType(), BooleanType()

# The closed sets of states.
JOB_STATUSES = ("active", "expired", "closed")
QUEUE_STATUSES = ("pending", "processing", "retry_wait", "completed", "failed")
DISCOVERY_STATUSES = ("pending", "processing", "retry_wait", "completed", "failed", "skipped")


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


CANDIDATE = _fields(url=_S, final_url=_S, confidence=_S, score=_L, reason=_S, label=_S)
POSTING = _fields(
    id=_L, company=_S, role=_S, batch=_S, location=_S, employment_type=_S, apply_url=_S, verified=_B, source=_S, source_id=_S, channel=_S, message_id=_L,
    original_text=_S, cleaned_text=_S, posted_at=_T, created_at=_T, updated_at=_T, status=_S, expires_at=_T, apply_candidates=ArrayType(CANDIDATE),
)
QUEUE_ENTRY = _fields(id=_L, message_key=_S, channel=_S, message_id=_L, text=_S, received_at=_T, status=_S, attempts=_L, claimed_at=_T, next_retry_at=_T, last_error=_S)
PROFILE = _fields(
    id=_L, skills=ArrayType(_S), preferred_roles=ArrayType(_S), preferred_locations=ArrayType(_S), preferred_job_types=ArrayType(_S), experience_years=DoubleType(), manual_fields=ArrayType(_S)
)
AUDIT = _fields(id=_L, post_id=_L, run=_S, old_url=_S, new_url=_S, action=_S, created_at=_T)
MESSAGE = _fields(text=_S, message_id=_L, ts=_T, channel=_S, channel_id=_S)
