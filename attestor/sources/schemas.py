"""Schemas of the contract tables, their keys and their fixed vocabularies."""

from __future__ import annotations

#: The version that provenance must state, and allowed words.
SCHEMA_VERSION = "acquisition.e0.v1"
SPLITS = ["train", "dev", "test", "excluded"]
FACT_TYPES = ["entity", "attribute", "action", "relation"]
CONTEXT_STATUSES = ["entailed", "contradicted", "not_entailed", "unknown"]
TRINARY = ["yes", "no", "unknown"]
VISIBILITY = ["full", "partial", "none", "unknown"]
CLAIM_STATUSES = ["correct", "contradicted", "unknown"]
CONTEXT_KINDS = ["sparse", "enriched", "paraphrase", "saturated"]
CANDIDATE_KINDS = ["bbox", "region_set", "stop"]
OBSERVATION_STATUSES = ["ok", "failed", "stop"]
#: Parts of key names that public records must not have.
FORBIDDEN_KEY_PARTS = ["fact_id", "entity_id", "target", "label", "utility", "supported_fact", "covered_fact", "invalid_claim", "gold", "answer"]

PUBLIC = ("images", "contexts", "candidates", "observations")
GOLD = ("context_metadata", "entities", "facts", "context_fact_labels", "candidate_fact_labels", "observation_claim_labels", "action_labels")

VOTES = "annotator_ids array<string>, annotator_votes array<string>, adjudication string"
SCHEMAS = {
    "images": "image_id string, image_path string, image_sha256 string, width int, height int, source string, source_image_id string, duplicate_group_id string, split string",
    "contexts": "context_id string, image_id string, initial_caption string, source_kind string, provenance_id string",
    "candidates": "candidate_id string, image_id string, kind string, boxes array<array<int>>, proposal_generator_revision string, pixel_cost long, proposal_score double",
    "observations": "observation_id string, image_id string, candidate_id string, observer_revision string, prompt_hash string, cache_key string, observed_text string, output_tokens int, latency_ms int, status string",
    "context_metadata": "context_id string, context_kind string, context_group_id string, reference_context_id string",
    "entities": "entity_id string, image_id string, category string, evidence_regions array<array<int>>, annotation_status string, aliases array<string>",
    "facts": "fact_id string, image_id string, fact_type string, subject_entity_id string, predicate string, object struct<literal:string,entity_id:string>, polarity string, visual_support string",
    "context_fact_labels": f"context_id string, fact_id string, status string, mention_links array<struct<span:array<int>,entity_id:string,resolution:string>>, {VOTES}",
    "candidate_fact_labels": "candidate_id string, fact_id string, visibility string, sufficient_to_verify string, annotator_ids array<string>, visibility_annotator_votes array<string>, visibility_adjudication string, annotator_votes array<string>, adjudication string",
    "observation_claim_labels": f"claim_id string, observation_id string, mapped_fact_id string, claim_text string, status string, {VOTES}",
    "action_labels": "context_id string, candidate_id string, new_supported_fact_ids array<string>, repeated_fact_ids array<string>, contradicted_claim_ids array<string>, unknown_claim_ids array<string>, eligible_missing_fact_ids array<string>, pixel_cost long",
}
OPTIONAL = {"candidates": ["proposal_score"], "entities": ["aliases"]}
KEYS = {
    "images": ["image_id"], "contexts": ["context_id"], "candidates": ["candidate_id"], "observations": ["observation_id"], "context_metadata": ["context_id"],
    "entities": ["entity_id"], "facts": ["fact_id"], "context_fact_labels": ["context_id", "fact_id"], "candidate_fact_labels": ["candidate_id", "fact_id"],
    "observation_claim_labels": ["claim_id"], "action_labels": ["context_id", "candidate_id"],
}


def columns(table: str) -> list[str]:
    """Names of a table's columns, in order."""
    out, depth, name = [], 0, ""
    for part in SCHEMAS[table].split(","):
        if depth == 0:
            name = part.split()[0]
            out.append(name)
        depth += part.count("<") - part.count(">")
    return out
