"""Explicit schemas of the lake tables (ids are long, money is decimal(18,2), confidence decimal(3,2))."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
CONFIDENCE = T.DecimalType(3, 2)


ALTERNATIVES = T.ArrayType(
    T.StructType([T.StructField("code", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("description", T.StringType())])
)
KINDS = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "date": T.DateType(), "money": MONEY, "confidence": CONFIDENCE, "alternatives": ALTERNATIVES,
}


def _struct(spec: str) -> T.StructType:
    """Columns written as ``name kind [not null]``; built without a running session."""
    fields = [part.split() for part in spec.split(", ")]
    return T.StructType([T.StructField(f[0], KINDS[f[1]], len(f) == 2) for f in fields])


SUPPLIERS = _struct(
    "id bigint not null, name string not null, normalized_name string not null, domain string, industry string, "
    "naics string, sic string, description string, country string, total_amount money, "
    "transaction_count bigint, currency string, parent_id bigint, parent_name string, parent_domain string, "
    "is_parent boolean, parent_source string, parent_confidence confidence, enriched_at timestamp, "
    "enrich_attempts int, last_enrich_error string, enrich_fingerprint string, stale boolean, stale_reason string, "
    "created_at timestamp, updated_at timestamp"
)

TAXONOMY = _struct(
    "code string not null, segment string, segment_code string, family string, family_code string, class string, "
    "class_code string, commodity string not null, description string, version string"
)

CLASSIFICATIONS = _struct(
    "id bigint not null, supplier_id bigint not null, unspsc_code string, confidence confidence, reasoning string, "
    "llm_model string, alternatives alternatives, "
    "inherited_from_parent boolean, inherited_from_supplier_id bigint, reviewed boolean, corrected_code string, "
    "corrected_by string, corrected_at timestamp, superseded boolean, created_at timestamp"
)

# The ids touched by one correction are kept as rows (one per supplier), never as one unbounded array.
CORRECTIONS = _struct(
    "id bigint not null, supplier_id bigint not null, classification_id bigint, original_code string, "
    "corrected_code string not null, reason string, corrected_by string, applied_to_subsidiaries boolean, "
    "affected_count bigint, created_at timestamp"
)
CORRECTION_SCOPE = _struct("correction_id bigint not null, supplier_id bigint not null")

ENRICHMENT_CACHE = _struct(
    "cache_key string not null, supplier_name string, provider string, domain string, payload string, "
    "raw_response string, credits_used int, hit_count int, created_at timestamp, expires_at timestamp"
)

AUDIT_LOG = _struct(
    "id bigint, entity string not null, entity_id bigint, action string not null, details string, actor string, "
    "created_at timestamp"
)

REPORTS = _struct(
    "id bigint not null, name string, format string, filters string, row_count int, size_bytes bigint, path string, "
    "generated_by string, created_at timestamp"
)

MODEL_USAGE = _struct(
    "model string not null, usage_day date not null, request_count bigint, prompt_tokens bigint, "
    "completion_tokens bigint, failure_count bigint"
)

TABLES = {
    "suppliers": SUPPLIERS,
    "taxonomy": TAXONOMY,
    "classifications": CLASSIFICATIONS,
    "corrections": CORRECTIONS,
    "correction_scope": CORRECTION_SCOPE,
    "enrichment_cache": ENRICHMENT_CACHE,
    "audit_log": AUDIT_LOG,
    "reports": REPORTS,
    "model_usage": MODEL_USAGE,
}
