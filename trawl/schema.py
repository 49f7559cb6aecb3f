"""Schemas of all files; nothing is inferred."""

from __future__ import annotations

CORPUS = "id string, content string"
QUERIES = "id string, query string, gold_ids array<string>"
GUIDANCE = "id string, query_guidance struct<expected_granularity: string, is_temporal_query: boolean, key_time_anchors: array<string>>"
RUN_FILE = "d string, q string, i array<string>, s array<double>"
JOB = "job_id string, task string, split string, from_hash string, depth int, model string, pairs long, with_text boolean, domains array<string>"
CANDIDATES = "d string, q string, i array<string>"
JOB_QUERIES = "d string, q string, t string"
JOB_DOCUMENTS = "d string, i string, t string"
SCORES = "job_id string, d string, q string, i array<string>, s array<double>"
EMBEDDED = "domain string, doc_id string, v array<float>"
