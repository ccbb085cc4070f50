"""Fixed values of the ledger model: field lists, vocabularies and the status matrix."""

CLAIM_TYPES = ["SOURCE", "DERIVED", "INTERPRETIVE", "DEFINITION"]
CLAIM_STATUSES = [
    "PENDING", "SUPPORTED", "SUPPORTED_CONDITIONAL", "UNESTABLISHED", "UNSUPPORTED", "CONTRADICTED", "OUTDATED",
    "UNRESOLVED",
]
EVIDENCE_STATUSES = [
    "PRIMARY_VERIFIED", "AUTHORITATIVE_SECONDARY", "SECONDARY_ONLY", "LICENSE_REQUIRED", "NOT_RETRIEVED",
    "SOURCE_CONFLICT",
]
RETRIEVAL_METHODS = [
    "primary_text", "official_portal", "licensed_database", "authoritative_secondary", "secondary_summary",
    "internal_source", "none",
]
STANCES = ["AFFIRMS", "QUALIFIES", "CONTRADICTS", "SILENT"]
SOURCE_KINDS = [
    "statute", "regulation", "judgment", "regulator_guidance", "professional_standard", "official_guidance",
    "commentary", "academic", "secondary", "data", "internal",
]
ACCESS_VALUES = ["PUBLIC", "LICENSED", "PAYWALLED", "INTERNAL"]
SEVERITIES = ["BLOCKING", "HIGH", "MEDIUM", "LOW"]
GATE_STATES = ["PASS", "FAIL", "NOT_EVALUATED", "NOT_APPLICABLE"]
CAPABILITIES = [
    "input_file_access", "external_retrieval", "code_execution", "file_output", "document_compile", "image_render",
    "isolated_audit_context",
]
PROTOCOL_VERSION = "v2.2"

RUN_REQUIRED = [
    "run_id", "as_of_date", "document_manifest", "requested_output_formats", "strict_blind_audit_required",
    "prompt_version",
]
CLAIM_REQUIRED = ["claim_id", "normalised_claim", "claim_type", "claim_status", "evidence_status", "depends_on"]
CLAIM_OPTIONAL = [
    "class", "time_sensitive", "source_statement", "conditions", "decision_conditions", "blocked_by",
    "derivation_rule", "appears_in", "severity_if_wrong", "last_checked", "last_successfully_verified", "reopened",
    "qualification",
]
SOURCE_REQUIRED = [
    "source_id", "kind", "identifier", "title", "version_label", "version_date", "access", "locator",
    "sufficient_for",
]
SOURCE_OPTIONAL = ["evidence_level", "provenance_note"]
EVIDENCE_REQUIRED = [
    "evidence_id", "source_id", "retrieved_at", "retrieval_method", "fragment", "extract", "supersession_checked",
    "superseded_by", "queries_attempted", "search_scope", "agent", "prompt_version",
]

# Rows: claim status; columns in the order of EVIDENCE_STATUSES; None marks an illegal combination.
STATUS_MATRIX = {
    "SUPPORTED": ["OK", "OK", "FLAG", None, None, None],
    "SUPPORTED_CONDITIONAL": ["OK", "OK", "FLAG", None, None, None],
    "UNESTABLISHED": ["FLAG", "FLAG", "OK", "OK", "OK", None],
    "UNSUPPORTED": ["OK", "OK", "FLAG", None, None, None],
    "CONTRADICTED": ["OK", "OK", "FLAG", None, None, None],
    "OUTDATED": ["OK", "OK", "FLAG", None, None, None],
    "UNRESOLVED": ["OK", "OK", "OK", None, None, "OK"],
    "PENDING": [None, None, None, "OK", "OK", "OK"],
}
