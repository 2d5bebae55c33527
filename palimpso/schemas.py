"""Declared schemas; nothing is inferred."""

from __future__ import annotations

EFFECT = "struct<target_document_id:string,relation_types:array<string>,impact_scope:string,effective_date:date,status:string>"
INVERSE_EFFECT = EFFECT.replace("target_document_id", "source_document_id")
DOCUMENTS_META = (
    "source_file string, document_id string, title string, document_type string, legal_rank int, issued_date date, effective_date date,"
    f" expiration_date date, status string, affects_documents array<{EFFECT}>, affected_by_documents array<{INVERSE_EFFECT}>, embed_in_qdrant boolean"
)
PROVISION_VERSIONS = (
    "provision_key string, version int, version_id string, document_id string, location_label string, chapter string, article string, clause string,"
    " provision_content string, valid_from date, valid_to date, is_latest boolean, previous_version_id string, superseded_by_version_id string,"
    " amended_by_document_id string, amended_by_source_location string, change_type string, applied_operation_ids array<string>, document_type string,"
    " legal_rank int, status string, effective_date date, expiration_date date"
)
POINTS = "point_id string, version_id string, sub_chunk_index int, content string, original_content string, chunk_size int, augmented_size int, embedding array<float>"
BOUNDARY = "struct<granularity:string,value:string>"
SCOPE_FIELDS = f"type:string,date:string,month:int,year:int,from:{BOUNDARY},to:{BOUNDARY}"
SCOPE = f"struct<{SCOPE_FIELDS},comparison_scopes:array<struct<{SCOPE_FIELDS},label:string>>>"
