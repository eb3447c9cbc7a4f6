"""Table schemas as DDL.  Missing values are empty text, empty lists, 0 or ``unknown``, not null."""

FILES = "array<struct<name:string,type:string,size:bigint>>"

DATASET = (
    "gse_id string, title string, pubmed_ids array<string>, sra_ids array<string>, "
    "bioproject_ids array<string>, organism string, disease string, organ string, "
    "omics_type string, omics_granularity string, sample_count int, platform string, "
    "publication_date string, journal string, abstract string, overall_design string, "
    f"keywords array<string>, supplementary_files {FILES}, series_matrix_available boolean, "
    "ftplink string, has_gse boolean, availability_status string, access_type string")

DATASET_VIEW = (
    "gse_id string, title string, organism string, data_type string, sample_count int, "
    "platform string, single_cell boolean, granularity string, has_perturbation boolean, "
    "perturbation_types array<string>, disease string, tissue string, organ string, "
    f"summary string, overall_design string, keywords array<string>, "
    f"supplementary_files {FILES}, series_matrix_available boolean, ftp_link string, "
    "has_processed_matrix boolean, raw_only boolean, pubmed_ids array<string>, "
    "sra_ids array<string>, bioproject_ids array<string>, publication_date string, "
    "journal string, relevance_score double, recency_score double, quality_score double, "
    "total_score double, metadata_version string")

TOPIC = (
    "topic_id string, name string, description string, keywords_used array<string>, "
    "created_at timestamp, last_searched_at timestamp")

TOPIC_DATASET = (
    "edge_id bigint, topic_id string, gse_id string, match_keyword string, "
    "match_source string, match_score double, review_status string, review_note string, "
    "reviewed_at timestamp, added_at timestamp")

REVIEW_LOG = (
    "log_id bigint, topic_id string, gse_id string, action string, old_status string, "
    "new_status string, note string, acted_at timestamp")

SEARCH_HISTORY = (
    "history_id bigint, topic_id string, search_time timestamp, keyword_used string, "
    "results_count bigint")

REPORT = (
    "report_id string, query string, query_hash string, mode string, sources string, "
    "total_found bigint, returned_count bigint, searched_at timestamp")

REPORT_ITEM = (
    "report_id string, rank bigint, gse_id string, relevance_score double, title string")
