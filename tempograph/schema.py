"""Schemas of the entities. Times are UTC without zone; Spark keeps microseconds."""

from __future__ import annotations

NODE = (
    "id string, type string, label string, properties variant, metadata map<string,string>, embedding array<float>, health_score double, failure_prob double, "
    "predicted_latency_ms double, resource_strain double, valid_from timestamp_ntz, valid_to timestamp_ntz, tx_time timestamp_ntz, version int"
)
STEP = "struct<transformer_name:string, executed_at:timestamp_ntz, duration:interval day to second, metadata:map<string,string>>"
EDGE = (
    f"id bigint, from_node_id string, to_node_id string, type string, weight double, confidence double, source_type string, steps array<{STEP}>, "
    "valid_from timestamp_ntz, valid_to timestamp_ntz, tx_time timestamp_ntz, seq bigint"
)
METRIC = "node_id string, ts timestamp_ntz, values map<string,double>"
INSIGHT = "id string, type string, title string, description string, related_node_ids array<string>, confidence double, severity string, generated_at timestamp_ntz"

EDGE_TYPES = ("DerivedFrom", "DuplicateOf", "VersionOf", "AggregatedFrom", "FilteredFrom", "FeedsInto")
INSIGHT_TYPES = ("BottleneckPrediction", "HealthDegradation", "AnomalyDetected", "RetryBudgetExhausted", "ClusterDiscovered")
SEVERITIES = ("Info", "Warning", "Critical")
SCHEMA_VERSION = (0, 1)

#: Values of columns that a writer leaves out, as SQL.
NODE_DEFAULTS = {
    "type": "''", "label": "''", "properties": "parse_json('{}')", "metadata": "cast(map() as map<string,string>)", "embedding": "cast(null as array<float>)", "health_score": "1D", "failure_prob": "0D",
    "predicted_latency_ms": "0D", "resource_strain": "0D", "valid_from": "{now}", "valid_to": "cast(null as timestamp_ntz)", "tx_time": "{now}", "version": "1",
}
EDGE_DEFAULTS = {
    "id": "cast(null as bigint)", "type": "'DerivedFrom'", "weight": "1D", "confidence": "1D", "source_type": "'LOG'", "steps": f"cast(array() as array<{STEP}>)", "valid_from": "{now}",
    "valid_to": "cast(null as timestamp_ntz)", "tx_time": "{now}", "seq": "cast(null as bigint)",
}
