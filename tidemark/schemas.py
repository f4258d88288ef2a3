"""Relations of the knowledge model: explicit schemas, closed sets, and validation into valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KNOWLEDGE_TYPES = ("fact", "preference", "procedure", "decision")
SCOPES = ("project", "user")
STATUSES = ("candidate", "active", "stale", "archived", "quarantined")
OUTCOMES = ("used", "verified", "rejected")
EVIDENCE_KINDS = ("observation", "test", "command", "user_approval", "artifact", "duplicate")
AGENT_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"
PROJECT_KEY = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
LIMITS = {"title": 160, "content": 8000, "evidence_summary": 1000, "search_terms": 1000, "query": 500}

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RECORD = _struct(
    id=_S, title=_S, content=_S, knowledge_type=_S, scope=_S, project_key=_S, source_agent=_S, status=_S, source_session=_S, evidence_speaker=_S,
    subject_terms=T.ArrayType(_S), search_terms=_S, content_hash=_S, adopted_count=_L, verified_count=_L, rejected_count=_L, candidate_expires_at=_TS,
    created_at=_TS, updated_at=_TS, last_hit_at=_TS, hit_count=_L, last_restored_at=_TS, claim_topic=_S, claim_value=_S, claim_fingerprint=_S,
    claim_conflicted=_B, superseded_by=_S, valid_from=_TS, valid_until=_TS,
)
EVIDENCE = _struct(
    id=_S, knowledge_id=_S, agent_id=_S, outcome=_S, summary=_S, evidence_kind=_S, evidence_ref=_S, status_before=_S, status_after=_S, created_at=_TS
)
AGENT_EVENT = _struct(
    id=_S, agent_id=_S, project_key=_S, session_id=_S, event_type=_S, payload_json=_S, payload_hash=_S, success=_B, objective_kind=_S, created_at=_TS
)
LEARNING_RUN = _struct(
    id=_S, agent_id=_S, project_key=_S, session_id=_S, turn_hash=_S, status=_S, input_chars=_L, proposal_count=_L, promoted_count=_L,
    latency_ms=T.DoubleType(), created_at=_TS, completed_at=_TS, source_hash=_S, attempts=_L, rejection_reasons=T.MapType(_S, _L),
)
RECALL_EVENT = _struct(
    id=_S, agent_id=_S, project_key=_S, session_id=_S, query=_S, knowledge_ids=T.ArrayType(_S), injected_chars=_L, latency_ms=T.DoubleType(),
    successful_validation=_B, created_at=_TS, completed_at=_TS,
)
TOOL_EVENT = _struct(id=_S, name=_S, input_summary=_S, output_summary=_S, success=_B, objective_kind=_S)
TURN = _struct(user_text=_S, assistant_text=_S, tools=T.ArrayType(TOOL_EVENT), source_turn_key=_S, previous_turn_key=_S)
TRACE_ITEM = _struct(
    knowledge_id=_S, source_agent=_S, rank=T.IntegerType(), score=T.DoubleType(), origin=_S, related_to=_S, omitted_reason=_S, emitted=_B,
    historical=_B, content_hash=_S, citation_observed=_B, source_attribution_observed=_B, check_status=_S,
)
REUSE_TRACE = _struct(
    id=_S, agent_id=_S, project_key=_S, session_id=_S, turn_id=_S, prompt_hash=_S, context_chars=_L, retrieval_ms=T.DoubleType(),
    items=T.ArrayType(TRACE_ITEM), created_at=_TS, completed_at=_TS, association=_S, task_success=_B, ttft_ms=_L, response_total_ms=_L, timing_status=_S,
)
EXPERIENCE = _struct(
    version=T.IntegerType(), applies_when=T.ArrayType(_S), exclude_when=T.ArrayType(_S), steps=T.ArrayType(_S), avoid=T.ArrayType(_S), reason=_S,
    verifier=_struct(kind=_S, command=_S),
)


def validated(rows: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rules are columns that hold for good rows; the first that does not is the reason."""
    why = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    judged = rows.withColumn("reason", why)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def required(name: str, limit: int | None = None):
    """A text that is not blank and no longer, in characters, than its limit."""
    return F.char_length(F.trim(name)).between(1, limit or LIMITS[name])


def publish_rules() -> dict[str, object]:
    return {
        "agent_id": F.col("source_agent").rlike(AGENT_ID),
        "project_key": F.col("project_key").rlike(PROJECT_KEY),
        "title": required("title"),
        "content": required("content"),
        "knowledge_type": F.col("knowledge_type").isin(*KNOWLEDGE_TYPES),
        "scope": F.col("scope").isin(*SCOPES),
    }


def with_defaults(records: DataFrame) -> DataFrame:
    """Records with every column that gates and search read; what is not there has its neutral value."""
    text = "string"
    neutral = {
        "search_terms": F.lit(""), "subject_terms": F.array().cast("array<string>"), "source_session": F.lit(None).cast(text),
        "superseded_by": F.lit(None).cast(text), "claim_fingerprint": F.lit(""), "fingerprint": F.lit(""), "claim_conflicted": F.lit(False),
        "verified_count": F.lit(0).cast("long"), "knowledge_type": F.lit("fact"),
    }
    return records.withColumns({n: c for n, c in neutral.items() if n not in records.columns})
