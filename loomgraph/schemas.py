"""The tables of a corpus."""
from __future__ import annotations

SOURCES = "path string, filename string, subdir string, suffix string, size long, content_hash string"
MANIFEST = "hash string, source_filename string, destination string, status string, reason string, extractor_version string, ts timestamp"
QUARANTINE = "hash string, filename string, original_subdir string, reason string, reason_slug string, details string, ts timestamp"
DOCS = ("doc_id string, filename string, hash string, profile string, text string, title string, authors array<string>, year int, doi string, "
        "arxiv_id string, patent_number string, abstract string, topics array<string>, metadata_source string")
CHUNKS = "chunk_id string, doc_id string, ordinal int, start_offset int, end_offset int, text string, title string, year int, total_chunks int"
CHUNK_VECTORS = "chunk_id string, doc_id string, vec array<float>"
NODES = ("node_id string, node_type string, entity_type string, name string, title string, year int, doi string, arxiv_id string, summary string, "
         "domain string, last_touched string, half_life_days double, relevance double, community_id int")
EDGES = "src string, dst string, relation string, confidence string, score double, similarity double, provenance map<string,string>"
PROJECTION = "a string, b string, weight double"
PARTITION = "node_id string, community_id int, path array<int>"
COMMUNITIES = "community_id int, label string, n_members long, core_nodes array<string>, rigor string, backend string"
CENTROIDS = "community_id int, vec array<double>"
CARDS = ("doc_id string, title string, status string, relevance double, half_life_days double, last_touched string, tags array<string>, "
         "supersedes array<string>, markdown string")
TOKEN_LOG = "ts string, tool string, surface_id string, served long, counterfactual long, ratio double, tokenizer string, extras map<string,string>"

GRAPH_VERSION = 1
STATUSES = ("ingested", "duplicate", "quarantined", "failed")
ENTITY_TYPES = ("author", "citation", "topic", "person", "org", "method", "gene", "place", "other")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
