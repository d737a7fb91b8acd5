"""Explicit schemas of the platform tables (DDL strings → ``StructType``).

Used for reading logs and JSON datasets without inference
(``spark.read.schema(schema(…))``) and as the contract of the operators.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "interactions": (
        "id string, created_at timestamp_ntz, session_id string, skill_id string, phone_number string, "
        "user_input string, agent_response string, system_used string, routing_reason string, "
        "fast_latency_ms int, deep_latency_ms int, total_latency_ms int, stt_latency_ms int, tts_latency_ms int, "
        "user_feedback int, call_completed boolean, error_occurred boolean, error_message string, "
        "input_tokens int, output_tokens int, estimated_cost_usd decimal(10,6), is_training_candidate boolean, "
        "exported_for_training boolean"),
    "hourly_metrics": ("hour_bucket timestamp_ntz, total_calls bigint, system1_calls bigint, system2_calls bigint, "
                       "avg_latency_ms int, error_count bigint, total_cost_usd decimal(18,4)"),
    "service_health": ("id string, checked_at timestamp_ntz, groq_healthy boolean, anthropic_healthy boolean, "
                       "deepgram_healthy boolean, cartesia_healthy boolean, livekit_healthy boolean, "
                       "groq_latency_ms int, anthropic_latency_ms int"),
    "feedback_log": ("timestamp timestamp_ntz, user_input string, agent_response string, skill_used string, "
                     "rating int, correction string, metadata map<string,string>"),
    "corrections": "timestamp timestamp_ntz, prompt string, chosen string, rejected string, skill string",
    "training_data": ("id bigint, skill_id string, user_message string, assistant_response string, rating int, "
                      "corrected_response string, metadata map<string,string>, created_at timestamp_ntz"),
    "extracted_data": (
        "id string, skill_id string, content_type string, user_input string, assistant_response string, "
        "raw_content string, source_filename string, source_type string, category string, tags array<string>, "
        "importance_score double, confidence double, tokens int, is_approved boolean, is_archived boolean, "
        "created_at timestamp_ntz, metadata map<string,string>"),
    "skills": ("id string, name string, description string, skill_type string, system_prompt string, "
               "knowledge array<string>, voice_config map<string,string>, is_builtin boolean, is_active boolean, "
               "created_at timestamp_ntz, updated_at timestamp_ntz, total_requests int, avg_latency_ms double, "
               "satisfaction_rate double"),
    "trained_adapters": ("id string, skill_id string, skill_name string, adapter_name string, base_model string, "
                         "epochs int, lora_r int, final_loss double, training_time_seconds int, adapter_path string, "
                         "status string, created_at timestamp_ntz, metadata map<string,string>"),
    "training_steps": ("timestamp timestamp_ntz, job_id string, skill_id string, event string, "
                       "data struct<step:int,total_steps:int,epoch:double,loss:double,learning_rate:double,"
                       "grad_norm:double,step_time_seconds:double>"),
    "files": "path string, modificationTime timestamp, length bigint, content binary, ext string, category string",
    "parsed_documents": ("path string, text string, pages int, errors array<string>, metadata map<string,string>, "
                         "source_type string, file_type string"),
    "cad_entities": ("drawing string, entity_id bigint, type string, layer string, color int, "
                     "points array<struct<x:double,y:double>>, closed boolean, radius double, text string, "
                     "height double, block_name string, measurement double, units_code int"),
    "frames": "call_id string, ts timestamp_ntz, is_speech boolean, transcript string, energy double",
}


def schema(name: str) -> StructType:
    """The ``StructType`` of a platform table."""
    return StructType.fromDDL(DDL[name])
