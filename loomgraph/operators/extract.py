"""Mentions, their normalisation, relation candidates and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import dims
from ..functions import text as T
from .lexicon import dictionary_mentions as dictionary_mentions
from .neighbours import nearest as nearest

def alias_table(concepts: DataFrame) -> DataFrame:
    """(type, alias, name) from (pos, type, name, aliases); of equal aliases the later concept counts."""
    each = concepts.select("pos", "type", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("a"))
    return each.groupBy("type", T.normalize_term(F.col("a")).alias("alias")).agg(F.max_by("name", "pos").alias("name")).where("alias <> ''")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for different lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def normalized_mentions(mentions: DataFrame, aliases: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Adds canonical_name, method and score: an alias wins, then a semantic match, else the surface form.

    ``semantic``: (mention, canonical, similarity), already cut by its threshold (see ``nearest``).
    """
    a = aliases.select(F.col("type").alias("_ty"), F.col("alias").alias("_a"), F.col("name").alias("_by_alias"))
    out = mentions.withColumn("_key", T.normalize_term(F.col("text"))).join(a, (F.col("type") == F.col("_ty")) & (F.col("_key") == F.col("_a")), "left")
    if semantic is not None:
        out = out.join(semantic.select(F.col("mention").alias("_m"), "canonical", "similarity"), F.col("mention") == F.col("_m"), "left")
    else:
        out = out.withColumns({"canonical": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")})
    by_alias = F.col("_by_alias").isNotNull()
    method = F.when(by_alias, "alias").when(F.col("canonical").isNotNull(), "semantic").otherwise("surface")
    score = F.when(by_alias, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    kept = [c for c in mentions.columns if c not in ("canonical_name", "method", "score")]
    return out.select(*kept, F.coalesce("_by_alias", "canonical", "text").alias("canonical_name"), method.alias("method"), score.alias("score"))


def candidates(mentions: DataFrame, windows: DataFrame, key: str, semantic: DataFrame | None = None, scoring: dict | None = None, thresholds: dict | None = None) -> DataFrame:
    """All typed pairs of mentions within an evidence window, scored and decided.

    ``mentions``: (key, m, type, name, start, end, confidence), ``windows``: (key, w, start, end, window),
    ``semantic``: optional (key, w, type, semantic).  Mentions meet their windows by an equi-join on
    the document with the interval test as residual; pairs meet within (document, window); the
    ontology's 39 specs are broadcast.  The last rule that applies gives the reason.
    """
    cfg, own = {**dims.SCORING, **(scoring or {})}, dims.THRESHOLDS if thresholds is None else thresholds
    spark = mentions.sparkSession
    win = windows.select(F.col(key).alias("_k"), "w", F.col("start").alias("ws"), F.col("end").alias("we"), "window")
    inside = mentions.join(win, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("we")) & (F.col("end") > F.col("ws"))).drop("_k")
    side = lambda p: inside.select(F.col(key).alias(f"{p}k"), F.col("w").alias(f"{p}w"), *[F.col(c).alias(f"{p}_{c}") for c in ("m", "type", "name", "start", "end", "confidence")], *([F.col("ws"), F.col("we"), F.col("window")] if p == "s" else []))
    pairs = side("s").join(side("t"), (F.col("sk") == F.col("tk")) & (F.col("sw") == F.col("tw")) & (F.col("s_m") != F.col("t_m")))
    specs = dims.relation_specs(spark).drop("threshold")
    pairs = pairs.join(F.broadcast(specs), (F.col("s_type") == F.col("source_type")) & (F.col("t_type") == F.col("target_type")))
    distance = F.greatest(F.lit(0), F.greatest("s_start", "t_start") - F.least("s_end", "t_end"))
    pairs = pairs.withColumn("distance", distance).where(
        ~((F.col("type") == "ASSOCIATED_WITH") & (F.col("s_start") > F.col("t_start"))) & ~((F.col("s_name") == F.col("t_name")) & (F.col("s_type") == F.col("t_type"))) & (F.col("distance") <= cfg["max_distance"])
    )
    if semantic is None:
        pairs = pairs.withColumn("semantic", F.lit(0.0))
    else:
        sem = semantic.select(F.col(key).alias("_k"), F.col("w").alias("_w"), F.col("type").alias("_ty"), F.greatest(F.lit(0.0), "semantic").alias("semantic"))
        pairs = pairs.join(sem, (F.col("sk") == F.col("_k")) & (F.col("sw") == F.col("_w")) & (F.col("type") == F.col("_ty")), "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    pairs = pairs.withColumn("_n", T.normalize_term(F.col("window")))
    cue = F.when(F.exists("cues", lambda c: F.contains("_n", c)), 1.0).otherwise(0.0)
    limit = F.lit(cfg["threshold"])
    for name, value in own.items():
        limit = F.when(F.col("type") == name, value).otherwise(limit)
    pairs = pairs.withColumns({"cue": cue, "proximity": F.greatest(F.lit(0.0), 1.0 - F.col("distance") / max(1, cfg["max_distance"])), "entity_confidence": (F.col("s_confidence") + F.col("t_confidence")) / 2})
    total = (cfg["semantic"] + cfg["cue"] + cfg["proximity"] + cfg["confidence"]) or 1.0
    score = (F.col("semantic") * cfg["semantic"] + F.col("cue") * cfg["cue"] + F.col("proximity") * cfg["proximity"] + F.col("entity_confidence") * cfg["confidence"]) / total
    pairs = pairs.withColumn("confidence", F.round(score, 6))
    reason = (
        F.when((F.col("s_end") <= F.col("ws")) | (F.col("t_start") >= F.col("we")), "candidate endpoints are outside the evidence window")
        .when(T.negated(F.col("window")), "sentence contains a negation cue")
        .when((F.col("cue") == 0) & (F.col("semantic") < cfg["semantic_floor"]), "semantic score below floor and no lexical cue matched")
        .when(score < limit, "score below relation threshold")
        .otherwise("")
    )
    return pairs.select(
        F.col("sk").alias(key), F.col("sw").alias("w"), "type", "s_type", "s_name", "t_type", "t_name", F.round("semantic", 6).alias("semantic"), "cue", F.round("proximity", 6).alias("proximity"), F.round("entity_confidence", 6).alias("entity_confidence"), "confidence", reason.alias("reason"), (reason == "").alias("accepted"), F.col("window").alias("evidence")
    )


def best_relations(candidate_rows: DataFrame, key: str) -> DataFrame:
    """The accepted candidate with the highest confidence per document, type and typed ends; the first wins ties."""
    kept = candidate_rows.where("accepted")
    best = kept.groupBy(key, "type", "s_type", "s_name", "t_type", "t_name").agg(F.max_by(F.struct("confidence", "w", "evidence"), F.struct("confidence", -F.col("w"))).alias("b"))
    return best.select(key, "type", "s_type", "s_name", "t_type", "t_name", F.col("b.confidence").alias("confidence"), F.col("b.w").alias("w"), F.col("b.evidence").alias("evidence"))


def top_mentions(mentions: DataFrame, key: str, n: int = 20) -> DataFrame:
    """At most ``n`` distinct entities a chunk by score, then first start, type and name; n <= 0 keeps all."""
    each = mentions.groupBy(key, "type", "name").agg(F.max("confidence").alias("confidence"), F.min("start").alias("start"))
    if n <= 0:
        return each
    by = W.partitionBy(key).orderBy(F.desc("confidence"), "start", "type", "name")
    return each.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")


def clamp_confidence(c: Column) -> Column:
    """A number within 0 and 1; 1 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(1.0))))


def check_scoring(scoring: dict) -> None:
    """Raises for thresholds outside [0, 1], negative or all-zero weights, or a distance that is not positive."""
    if any(not 0 <= scoring[k] <= 1 for k in ("threshold", "semantic_floor")):
        raise ValueError("thresholds must be within 0 and 1")
    weights = [scoring[k] for k in ("semantic", "cue", "proximity", "confidence")]
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    if scoring["max_distance"] <= 0:
        raise ValueError("the pair distance must be positive")
