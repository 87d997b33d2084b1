"""Closed vocabularies of the evidence graph.

The lists below are fixed values: results only agree with existing data when
these words match it exactly.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATION_TYPES = [
    "cites",
    "version_of",
    "uses_method_from",
    "improves_on",
    "alternative_to",
    "uses_dataset_from",
    "compares_against",
    "reproduces",
    "fails_to_reproduce",
    "supports_claim",
    "contradicts_claim",
    "prerequisite_for",
]
HIGH_RISK = ["fails_to_reproduce", "contradicts_claim"]
METHOD_LINEAGE = ["uses_method_from", "improves_on", "alternative_to"]
NOT_PROPOSABLE = ["cites", "version_of"]
SEMANTIC_GROUPS = {
    "method": ["uses_method_from", "improves_on", "alternative_to"],
    "experiment": ["uses_dataset_from", "compares_against", "reproduces", "fails_to_reproduce"],
    "argument": ["supports_claim", "contradicts_claim"],
    "reading": ["prerequisite_for"],
    "meta": ["cites", "version_of"],
}
SOURCE_LAYERS = ["public_fact", "team_record", "ai_candidate"]
REVIEW_STATUSES = ["unreviewed", "confirmed", "disputed", "rejected"]
CLAIM_VERDICTS = [
    "supported",
    "partially_supported",
    "contradicted",
    "not_reproduced",
    "concern",
    "unclear",
]
READING_LEVELS = ["unread", "skimmed", "read", "reproduced", "needs_review"]
COMMENT_KINDS = ["comment", "idea", "thinking", "review", "question", "critique"]
ASPECTS = [
    "problem",
    "contributions",
    "methods",
    "theory",
    "datasets",
    "findings",
    "limitations",
    "positioning",
]
GRAPH_DIMENSIONS = ["citation_coupling", "method_lineage", "topic"]
DIMENSIONS = GRAPH_DIMENSIONS + [f"aspect_{key}" for key in ASPECTS]

STATUS_WEIGHTS = {"confirmed": 3.0, "disputed": 2.5, "unreviewed": 1.0, "rejected": 0.0}
# mode -> ordered (relation types, weight); the first hit counts, the default closes the list
MODE_WEIGHTS = {
    "prerequisite": ([(["prerequisite_for"], 2.0), (METHOD_LINEAGE, 1.2)], 0.8),
    "dispute": ([(HIGH_RISK, 2.0)], 0.7),
    "evolution": ([(["improves_on", "uses_method_from"], 1.8), (METHOD_LINEAGE, 1.3)], 0.8),
    "explore": ([], 1.0),
}


def _lookup(key: Column, pairs, default=None) -> Column:
    out = None
    for values, result in pairs:
        hit = key.isin(values)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(F.lit(default))


def proposable_type(raw: Column) -> Column:
    """Relation type of a model proposal, null unless it is one of the ten semantic types."""
    word = F.lower(F.trim(raw))
    return F.when(word.isin([t for t in RELATION_TYPES if t not in NOT_PROPOSABLE]), word)


def is_high_risk(rel_type: Column) -> Column:
    return rel_type.isin(HIGH_RISK)


def is_method_lineage(rel_type: Column) -> Column:
    return rel_type.isin(METHOD_LINEAGE)


def semantic_group(rel_type: Column) -> Column:
    return _lookup(rel_type, [(v, k) for k, v in SEMANTIC_GROUPS.items()], "other")


def status_weight(status: Column) -> Column:
    return _lookup(status, [([k], v) for k, v in STATUS_WEIGHTS.items()], 0.0)


def mode_weight(mode: str, rel_type: Column) -> Column:
    pairs, default = MODE_WEIGHTS.get(mode, MODE_WEIGHTS["explore"])
    return _lookup(rel_type, pairs, default)


def status_rank(status: Column) -> Column:
    """Severity used when several edges share one bundle: disputed > confirmed > unreviewed."""
    return _lookup(status, [(["disputed"], 3), (["confirmed"], 2), (["unreviewed"], 1)], 0)


def listing_rank(status: Column) -> Column:
    """Reading order of relations on a card: confirmed, disputed, unreviewed, rejected."""
    return _lookup(status, [(["confirmed"], 0), (["disputed"], 1), (["unreviewed"], 2)], 3)


def is_drawable(rel_type: Column, status: Column) -> Column:
    """Edges that may be shown: no citations, nothing rejected, high risk only when confirmed."""
    return (
        (rel_type != "cites")
        & (status != "rejected")
        & (~is_high_risk(rel_type) | (status == "confirmed"))
    )
