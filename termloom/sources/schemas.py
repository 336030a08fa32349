"""Schemas of stored records, as DDL."""

TERM = "text STRING, count INT, relevance DOUBLE, weightage DOUBLE, source STRING, label STRING, keybert_score DOUBLE, embedding_unit ARRAY<FLOAT>"
PAGE_RESULT = (
    "rank INT, url STRING, domain STRING, title STRING, description STRING, word_count INT, heading_count INT, para_count INT, images_count INT, "
    f"authority INT, ranking_method STRING, content_preview STRING, nlp_terms ARRAY<STRUCT<{TERM.replace(' STRING', ': STRING').replace(' INT', ': INT').replace(' DOUBLE', ': DOUBLE').replace(' ARRAY', ': ARRAY')}>>, "
    "nlp_clusters MAP<STRING, ARRAY<STRING>>, nlp_cluster_scores MAP<STRING, STRUCT<sim_to_cluster_1_centroid: DOUBLE, sim_to_anchor_title: DOUBLE>>"
)
ENTITY = (
    "text: STRING, label: STRING, combined_count: INT, sources: ARRAY<STRING>, source_counts: MAP<STRING, INT>, average_relevance: DOUBLE, average_weightage: DOUBLE, "
    "average_keybert_score: DOUBLE, competitor_count: INT, found_in_files: ARRAY<STRING>, competitor_multiplier: INT, adjusted_weightage: DOUBLE, word_range: INT"
)
SESSION_EXPORT = f"session_id STRING, keyword STRING, created_at STRING, merge_output STRUCT<tiering_method: STRING, entities: ARRAY<STRUCT<{ENTITY}>>>"
CLI_EXPORT = f"file STRING, entities ARRAY<STRUCT<{ENTITY}>>"
KEYWORD_EXPORT = (
    "keyword STRING, surfer_id STRING, surfer_link STRING, permalink_hash STRING, location STRING, timestamp STRING, status STRING, "
    "nlp_terms STRUCT<terms: ARRAY<STRUCT<term: STRING, ignored: BOOLEAN, included: BOOLEAN, is_nlp: BOOLEAN, target_range: STRUCT<min: INT, max: INT>, use_in_heading: BOOLEAN>>>"
)
EXPORT_SUMMARY = "keyword STRING, surfer_id STRING, surfer_link STRING, status STRING, json_file STRING"
AUTHORITY = "domain STRING, dr STRING"
TERM_VECTORS = "session_id STRING, key STRING, text STRING, vector ARRAY<FLOAT>"
ANCHORS = "session_id STRING, keyword STRING, anchor STRING, anchor_ord INT, is_variant BOOLEAN, vector ARRAY<FLOAT>"
