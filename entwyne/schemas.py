"""Schemas at the boundary, and what the engine calls its columns."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), False) for n in names])


RECORD = _strings("entity_id", "business_name", "business_address", "country")
TRUTH = _strings("source1_entity_id", "matched_entity_ids")
MATCHES = TRUTH
CANDIDATES = _strings("source1_entity_id", "candidate_entity_ids")
#: The comparison views of a record. "Missing" is the empty string everywhere.
VIEWS = ("nm_full", "nm_core", "nm_compact", "nm_skel", "ad_full", "ad_core", "ad_num", "ad_alpha", "ctry")
NORMALISED = _strings("entity_id", *VIEWS)
CONTEXT = ("rr_score", "rr_rank", "rr_best", "rr_margin", "rr_rel", "rr_second", "rr_top_gap", "n_cand", "n_keys")
