"""Tables of the content store, as DDL. Times are epoch milliseconds; '' and null are different states."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "sources": "id string, name string, url string, source_type string, fetch_interval long, enabled boolean, config_json string, last_fetched_at long, last_hash string, last_status string, last_error string, fail_count int, original_fetch_interval long, created_at long, updated_at long",
    "extractions": "id string, source_id string, content_hash string, title string, extracted_text string, extracted_html string, url string, extracted_at long, metadata_json string",
    "fetch_log": "id string, source_id string, status string, status_code int, content_hash string, error_message string, duration_ms long, fetched_at long",
    "search_engines": "id string, name string, strategy string, url_template string, api_config string, selectors string, stealth_level int, rate_limit_ms long, max_pages int, enabled boolean",
    "tracked_questions": "id string, text string, keywords string, channels string, schedule_ms long, max_results int, follow_links boolean, enabled boolean, last_run_at long, last_result_count int, total_results long, created_at long, updated_at long",
    "search_log": "id string, query string, result_count int, searched_at long",
    "folders": "id string, parent_id string, name string, created_at long, updated_at long",
    "extraction_rules": "id string, name string, url_pattern string, page_id string, selectors array<string>, extract_mode string, trust_level string, folder_id string, enabled boolean, priority int, version int, last_success long, fail_count int, created_at long, updated_at long",
    "content_cache": "id string, rule_id string, page_url string, content_hash string, extracted_text string, extracted_html string, title string, metadata_json string, snapshot_ref string, extracted_at long, expires_at long",
    "chunks": "id string, content_id string, chunk_index int, text string, token_count int, overlap_prev int, created_at long",
    "ingest_log": "id string, batch_id string, page_id string, page_url string, kind string, status string, error string, extracted_count int, created_at long, completed_at long",
    "source_pages": "page_id string, page_url string, trust_level string, dom_profile string, last_seen long, created_at long",
    "gpu_pricing": "id string, provider string, status string, is_dedicated boolean, cost_per_unit double, cost_per_sec double, measured_at long",
    "search_tiers": "id string, user_id string, tier string, query string, passes int, results_count int, latency_ms long, created_at long",
    "profiles": "id string, url_pattern string, domain string, extractors string, dom_profile string, trust_level string, success_rate double, total_uses long, total_repairs long, contributors array<string>, created_at long, updated_at long",
    "corrections": "id string, profile_id string, instance_id string, old_extractors string, new_extractors string, reason string, validated int, created_at long",
    "reports": "id string, profile_id string, instance_id string, error_type string, message string, created_at long",
    "instance_reputation": "instance_id string, corrections_accepted long, corrections_rejected long, corrections_pending long, last_active long, domains_covered int",
    "shards": "name string, status string",  # its tenant is the partition
    "watch_pages": "id string, url string, selectors array<string>, filters array<string>, snapshot_interval_ms long, status string",
    "vectors": "ext_id string, vector array<float>",
}
