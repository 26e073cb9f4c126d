"""Dimension tables: the ontology, cues, weights and word lists, as data.

Fixed values: these must equal what results are compared with, so they are stated plainly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entity types that carry knowledge, and all node labels.
ENTITY_TYPES = ["Drug", "Condition", "Symptom", "RiskFactor", "Biomarker"]
NODE_LABELS = [*ENTITY_TYPES, "Paper"]

#: Relationship types with the (source, target) types they allow.
DIRECTIONS: dict[str, list[tuple[str, str]]] = {
    "TREATS": [("Drug", "Condition")],
    "PREVENTS": [("Drug", "Condition")],
    "REDUCES": [("Drug", "Biomarker")],
    "INCREASES": [("Drug", "Biomarker")],
    "HAS_ADVERSE_EFFECT": [("Drug", "Condition")],
    "CAUSES": [("Condition", "Condition")],
    "HAS_SYMPTOM": [("Condition", "Symptom")],
    "INCREASES_RISK_OF": [("RiskFactor", "Condition")],
    "INTERACTS_WITH": [("Drug", "Drug")],
    "CONTRAINDICATED_FOR": [("Drug", "Condition")],
    "ASSOCIATED_WITH": [(s, t) for s in ENTITY_TYPES for t in ENTITY_TYPES],
    "MENTIONS": [("Paper", t) for t in ENTITY_TYPES],
}

#: Lexical cues and prototype sentence by relationship type, for scoring candidates.
RELATION_CUES: dict[str, list[str]] = {
    "TREATS": ["treat", "therapy", "indicated", "recommended", "management", "intervention"],
    "PREVENTS": ["prevent", "prophylaxis", "reduced incidence", "reduced risk", "protect"],
    "REDUCES": ["reduce", "lower", "decrease", "decline", "lowering", "reduction", "decreased"],
    "INCREASES": ["increase", "raise", "elevate", "elevation", "higher", "increased"],
    "HAS_ADVERSE_EFFECT": ["adverse", "side effect", "toxicity", "induced", "associated with", "rare cases"],
    "CAUSES": ["cause", "leads to", "results in", "pathogenesis", "promote", "contribute"],
    "HAS_SYMPTOM": ["symptom", "presented with", "characterized by", "manifest", "complain"],
    "INCREASES_RISK_OF": ["risk", "increased likelihood", "predispose", "associated with increased", "predictor"],
    "INTERACTS_WITH": ["interact", "coadministration", "combination", "exposure to", "clearance of"],
    "CONTRAINDICATED_FOR": ["contraindicat", "should not be used", "avoid", "not recommended"],
    "ASSOCIATED_WITH": ["associated", "correlated", "linked", "marker", "prevalence", "present with", "characterized by", "predictor"],
}
PROTOTYPES: dict[str, str] = {
    "TREATS": "A drug treats a medical condition.",
    "PREVENTS": "A drug prevents a disease or clinical event.",
    "REDUCES": "A drug lowers a biomarker level.",
    "INCREASES": "A drug raises a biomarker level.",
    "HAS_ADVERSE_EFFECT": "A drug causes an adverse clinical effect.",
    "CAUSES": "One medical condition causes another condition.",
    "HAS_SYMPTOM": "A medical condition has a symptom.",
    "INCREASES_RISK_OF": "A risk factor increases the risk of a medical condition.",
    "INTERACTS_WITH": "Two drugs interact clinically.",
    "CONTRAINDICATED_FOR": "A drug is contraindicated for a condition.",
    "ASSOCIATED_WITH": "Two biomedical entities are clinically or statistically associated.",
}

#: Weights and thresholds of relation scoring.
SCORING = {"threshold": 0.66, "semantic_floor": 0.52, "semantic": 0.50, "cue": 0.25, "proximity": 0.10, "confidence": 0.15, "max_distance": 300}
THRESHOLDS = {"ASSOCIATED_WITH": 0.58, "REDUCES": 0.60, "INCREASES": 0.60, "HAS_ADVERSE_EFFECT": 0.58, "INCREASES_RISK_OF": 0.58, "INTERACTS_WITH": 0.58}

#: Question cues that make a relationship type relevant.
RELEVANCE_CUES: dict[str, list[str]] = {
    "TREATS": ["treat", "therapy", "indicated"],
    "PREVENTS": ["prevent", "risk reduction", "protect"],
    "REDUCES": ["reduce", "lower", "decrease"],
    "INCREASES": ["increase", "raise", "elevate"],
    "ASSOCIATED_WITH": ["associate", "linked", "mark", "present"],
    "HAS_ADVERSE_EFFECT": ["adverse", "side effect", "toxicity"],
    "CAUSES": ["cause", "lead", "pathogenesis"],
    "HAS_SYMPTOM": ["symptom", "present"],
    "INCREASES_RISK_OF": ["risk", "predispose"],
    "INTERACTS_WITH": ["interact", "combination"],
    "CONTRAINDICATED_FOR": ["contraindicat", "avoid"],
    "DEFINITION_OF": ["what is", "define", "definition", "meaning"],
}

#: Question intents in their order of precedence: cues, then the relationship types asked for.
INTENTS: list[tuple[list[str], list[str]]] = [
    (["risk", "predispose"], ["INCREASES_RISK_OF", "MAY_INCREASE_RISK_OF"]),
    (["reduce", "reduces", "lower", "lowers", "decrease", "decreases"], ["REDUCES", "MAY_REDUCE"]),
    (["increase", "increases", "raise", "raises", "elevate", "elevates"], ["INCREASES", "MAY_INCREASE", "INCREASES_RISK_OF", "MAY_INCREASE_RISK_OF"]),
    (["treat", "treats", "therapy"], ["TREATS"]),
    (["interact", "interaction", "combination"], ["INTERACTS_WITH", "MAY_INTERACT_WITH"]),
]
PATH_CUES = ["connect", "path", "through", "multi hop", "multi-hop"]
LIPID_CUES = ["lipid", "biomarker", "cholesterol", "triglyceride", "drug"]
DEFINITION_CUES = ["what is", "define", "definition", "meaning"]

#: Words that never start a graph search.
STOP_TERMS = [
    "and", "associated", "biomarker", "biomarkers", "condition", "connect", "connected", "connects", "cholesterol", "cure", "cures", "definition",
    "does", "drug", "graph", "hop", "path", "relationship", "relationships", "reduce", "reduces", "retrieved", "risk", "the", "through", "lipid",
    "treatment", "using", "what", "which", "with", "what condition is hypertriglyceridemia associated with",
]
#: Words that do not count when a fact is compared by its words.
FACT_STOPWORDS = ["a", "an", "and", "are", "as", "is", "may", "of", "the", "to", "with"]

#: Sentence templates by relationship type; the last serves all other types.
SENTENCES: list[tuple[list[str], str]] = [
    (["INTERACTS_WITH", "MAY_INTERACT_WITH"], "{s} may interact with {t}."),
    (["INCREASES_RISK_OF", "MAY_INCREASE_RISK_OF"], "{s} may increase the risk of {t}."),
    (["REDUCES", "MAY_REDUCE"], "{s} may reduce {t}."),
    (["INCREASES", "MAY_INCREASE"], "{s} may increase {t}."),
    (["TREATS"], "{s} treats {t}."),
    (["PREVENTS"], "{s} prevents {t}."),
    (["ASSOCIATED_WITH"], "{s} is associated with {t}."),
    (["DEFINITION_OF"], "{s}: {t}"),
    ([], "{s} is connected to {t} by {r}."),
]
#: Words that show that an answer states a relationship.
ANSWER_CUES: dict[str, list[str]] = {
    "REDUCES": ["reduce", "reduces", "lower", "lowers", "decrease", "decreases"],
    "MAY_REDUCE": ["reduce", "reduces", "lower", "lowers", "decrease", "decreases"],
    "INCREASES": ["increase", "increases", "raise", "raises", "elevate", "elevates"],
    "MAY_INCREASE": ["increase", "increases", "raise", "raises", "elevate", "elevates"],
    "TREATS": ["treat", "treats"],
    "PREVENTS": ["prevent", "prevents"],
    "DEFINITION_OF": ["definition", "is"],
}
#: Annotation statuses.
UNRESOLVED = ["", "draft", "needs_review"]
ABSTAINED = "I could not find supporting graph evidence for this question."


def directions(spark: SparkSession) -> DataFrame:
    """(type, source_type, target_type): every allowed triple; 40 rows, safe to broadcast."""
    rows = [(r, s, t) for r, pairs in DIRECTIONS.items() for s, t in pairs]
    return spark.createDataFrame(rows, "type string, source_type string, target_type string")


def relation_specs(spark: SparkSession) -> DataFrame:
    """(type, source_type, target_type, cues, threshold): a row per allowed triple but MENTIONS."""
    rows = [(r, s, t, RELATION_CUES[r], THRESHOLDS.get(r, SCORING["threshold"])) for r, pairs in DIRECTIONS.items() if r != "MENTIONS" for s, t in pairs]
    return spark.createDataFrame(rows, "type string, source_type string, target_type string, cues array<string>, threshold double")
