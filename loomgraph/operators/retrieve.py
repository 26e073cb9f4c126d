"""Retrieval for batches of questions: terms, anchors, paths, scores, greedy packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import dims
from ..functions import text as T
from ..shared import few, kept
from . import graph as G

ANCHORS = 25
CONNECTORS = 100


def analysed(questions: DataFrame, text: str = "question", stop: Sequence[str] = dims.STOP_TERMS) -> DataFrame:
    """Adds n (normalised), terms but those of ``stop``, types asked for, and whether a path, a drug or lipids are asked for."""
    q = questions.withColumn("n", T.normalize_term(F.col(text)))
    return q.withColumns(
        {
            "terms": T.without_stop_terms(T.question_terms(F.col("n")), stop),
            "types": T.intent(F.col("n")),
            "wants_path": T.path_requested(F.col("n")),
            "wants_drug": F.contains("n", F.lit("drug")),
            "wants_lipids": T.has_any(F.col("n"), dims.LIPID_CUES),
        }
    )


def matched_groups(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(q, c, values): concepts (c, name, aliases) one of whose normalised names stands in the question as words.

    Names are joined to the questions' word n-grams by equality, so no pair is compared that shares none.  N-grams
    are built for the word counts that names have, however long; these counts alone are broadcast.
    """
    c = concepts.select("c", F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), "aliases"), T.normalize_term), lambda x: x != "")).alias("values"))
    names = c.select("c", F.explode("values").alias("value")).withColumn("k", F.size(F.split("value", " ")))
    words = questions.select("q", F.split("n", " ").alias("w"))
    grams = words.join(F.broadcast(names.select("k").distinct()), F.size("w") >= F.col("k"))
    grams = grams.select("q", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("value"))
    hit = grams.join(names, ["k", "value"]).select("q", "c").distinct()
    return hit.join(c, "c").select("q", "c", "values")


def expanded_terms(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Questions with all names of their matched concepts among the terms."""
    more = groups.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("_more"))
    out = questions.join(more, "q", "left")
    return out.withColumn("terms", F.array_sort(T.without_stop_terms(F.array_union("terms", F.coalesce("_more", F.array().cast("array<string>")))))).drop("_more")


def anchors(questions: DataFrame, nodes: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """(q, id, hits): at most ``limit`` nodes a question: most term words in the name, then name, then id.

    The stand-in for full-text search: names and terms meet on their words (an equi-join over an inverted
    list), not by comparing every pair; few words are broadcast, and then only nodes that hold one are shuffled.
    """
    words = nodes.where("label <> 'Paper' and name is not null").select("id", "name", F.explode(F.array_distinct(F.split(T.normalize_term(F.col("name")), " "))).alias("word"))
    asked = questions.select("q", F.explode("terms").alias("t")).select("q", F.explode(F.split("t", " ")).alias("word")).distinct()
    hits = words.join(few(asked), "word").groupBy("q", "id", "name").agg(F.count("*").alias("hits"))
    by = W.partitionBy("q").orderBy(F.desc("hits"), "name", "id")
    return hits.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= limit).select("q", "id", "hits")


def name_pairs(names: DataFrame, terms: DataFrame, width: int = 3) -> DataFrame:
    """(columns of both): a lower-cased ``name`` that holds a ``term``, or stands in one; empty texts pair with nothing.

    Whatever a text holds begins with its first characters, at most ``width``.  So the two sides meet on such heads by
    equality, and ``contains`` is tested on these pairs alone.  The terms' heads and places are broadcast if they are few.
    """
    n = names.withColumn("_low", F.lower("name")).where("_low <> ''")
    t = terms.withColumn("_t", F.lower("term")).where("_t <> ''")
    head = lambda c: F.substring(c, 1, width)

    def grams(c: str) -> Column:
        """Every place's next characters, cut at each length up to ``width``: what heads may stand there."""
        at = F.sequence(F.lit(1), F.length(c))
        there = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.substr(F.col(c), i, k)))
        return F.explode(F.array_distinct(F.flatten(there)))

    inside = n.withColumn("_h", grams("_low")).join(few(t.withColumn("_h", head("_t"))), "_h").where(F.contains("_low", F.col("_t")))
    around = n.withColumn("_h", head("_low")).join(few(t.withColumn("_h", grams("_t"))), "_h").where(F.contains("_t", F.col("_low")))
    return inside.unionByName(around).drop("_h", "_low", "_t").distinct()


def containing(questions: DataFrame, names: DataFrame, limit: int = ANCHORS) -> DataFrame:
    """Fallback anchors (q, id): a name equal to, inside or around a term, by name and id."""
    asked = questions.select("q", F.explode("terms").alias("term"))
    hit = name_pairs(names.where("label <> 'Paper'").select("id", "name"), asked).select("q", "id", "name").distinct()
    by = W.partitionBy("q").orderBy("name", "id")
    return hit.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= limit).select("q", "id")


def direct_paths(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, p, rels): one-step paths at either end of each question's anchors; ``rels`` holds the edge ids."""
    keep = edges.where("type <> 'MENTIONS'").select("id", "src", "dst", "type")
    s = starts.select("q", F.col("id").alias("start"), "types")
    at = lambda end: keep.join(s, F.col(end) == F.col("start"))
    both = at("src").unionByName(at("dst")).where((F.size("types") == 0) | F.array_contains("types", F.col("type")))
    return both.select("q", F.array("id").alias("rels")).distinct()


def two_hop_paths(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, rels): two-step paths from each question's anchors; an asked-for type on either edge is enough."""
    found = G.two_hop(starts.select("id").distinct(), edges, nodes)
    s = starts.select("q", F.col("id").alias("_s"), "types")
    out = found.join(s, F.col("start") == F.col("_s")).where((F.size("types") == 0) | F.array_contains("types", F.col("first_type")) | F.array_contains("types", F.col("second_type")))
    return out.select("q", F.array("first", "second").alias("rels")).distinct()


def connectors(groups: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = CONNECTORS) -> DataFrame:
    """(q, g1, g2, drug, first, second, total): drugs with one edge to a node of each of two concept groups.

    ``groups``: (q, g, member id).  The best ``limit`` a question by the sum of confidences, then the edges.
    """
    near = kept(G.around(edges.where("type <> 'MENTIONS'").select("id", "type", "src", "dst", "confidence"), groups))
    drug = G.among(nodes.where("label = 'Drug'").select("id"), G.ends(near)).select(F.col("id").alias("_d"))
    arms = G.symmetric(near).join(drug, F.col("u") == F.col("_d"), "left_semi")
    arms = arms.join(groups.select("q", "g", F.col("id").alias("_t")), F.col("v") == F.col("_t")).select("q", "g", F.col("u").alias("drug"), F.col("id").alias("edge"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    a, b = (arms.select(F.col("q").alias(f"q{k}"), F.col("g").alias(f"g{k}"), F.col("drug").alias(f"d{k}"), F.col("edge").alias(f"e{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    pairs = a.join(b, (F.col("q1") == F.col("q2")) & (F.col("d1") == F.col("d2")) & (F.col("g1") < F.col("g2")) & (F.col("e1") != F.col("e2")))
    out = pairs.select(F.col("q1").alias("q"), "g1", "g2", F.col("d1").alias("drug"), F.col("e1").alias("first"), F.col("e2").alias("second"), F.round(F.col("c1") + F.col("c2"), 6).alias("total"))
    by = W.partitionBy("q").orderBy(F.desc("total"), "first", "second")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def path_score(steps: Column, overlap: Column, q: dict[str, Column], coverage: Column) -> Column:
    """Score of a path from its steps (overlap, related, confidence, type, drug), the overlap of the names of their ends with the
    terms, and the question's columns.  It never falls when one of overlap and coverage rises."""
    n = F.size(steps)
    edge, related, least = F.array_max(F.transform(steps, lambda s: s["overlap"])), F.array_max(F.transform(steps, lambda s: s["related"])), F.array_min(F.transform(steps, lambda s: s["confidence"]))
    kinds = F.array_distinct(F.transform(steps, lambda s: s["type"]))
    acts = F.size(F.array_intersect(kinds, F.array(F.lit("INCREASES"), F.lit("REDUCES"))))
    action = F.when(~q["wants_lipids"], 0.0).when(acts > 0, F.least(F.lit(1.0), acts / 2)).when(kinds == F.array(F.lit("ASSOCIATED_WITH")), -0.5).otherwise(0.0)
    long = n > 1
    bonus = F.when(long & q["wants_path"], F.when(coverage < 1.0, 0.08 - 0.25).otherwise(0.08)).when(long, -0.05).otherwise(0.03)
    connector = F.when(long & q["wants_drug"], F.when(F.exists(steps, lambda s: s["drug"]), 0.25).otherwise(-0.10)).otherwise(0.0)
    return F.round(0.20 * overlap + 0.30 * coverage + 0.25 * edge + 0.15 * related + 0.15 * action + 0.10 * least + bonus + connector, 6)


def asked_of(questions: DataFrame, groups: DataFrame | None) -> DataFrame:
    """What scores take from a question, with the values of its concept groups (``_g``, empty without any), and each way (i, a, b) to cut
    a term (``_ts``) or a group's value (``_gs``) of several words in two; i is the place of the term or group."""
    asked = questions.select("q", "n", "terms", "types", "wants_path", "wants_drug", "wants_lipids")
    none = F.array().cast("array<array<string>>")
    if groups is None:
        asked = asked.withColumn("_g", none)
    else:
        own = groups.groupBy("q").agg(F.collect_list("values").alias("_g"))
        asked = asked.join(own, "q", "left").withColumn("_g", F.coalesce("_g", none))

    def cuts(value: Column, i: Column) -> Column:
        words = F.split(value, " ")
        at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(i.alias("i"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("a"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("b")))

    return asked.withColumns({"_ts": F.flatten(F.transform("terms", cuts)), "_gs": F.flatten(F.transform("_g", lambda g, i: F.flatten(F.transform(g, lambda v: cuts(v, i)))))})


def edge_facts(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, edge, fact, ends) for pairs (q, edge): what a score takes from an edge for a question.  ``fact`` also holds which of the terms (``hits``)
    and which concept groups (``covers``) stand in the names of the edge's ends, and with which halves of those of several words the names
    end or begin."""
    named = edges.select(F.col("id").alias("edge"), "type", "src", "dst", "confidence", *(["evidence"] if "evidence" in edges.columns else [F.lit("").alias("evidence")]))
    facts = G.triples(named.join(pairs.select("edge").distinct(), "edge", "left_semi"), nodes)
    facts = pairs.select("q", "edge").distinct().join(facts, "edge").join(asked, "q")
    places = lambda c, test: F.filter(F.transform(c, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())

    def fact(z: Column) -> Column:
        return F.struct(
            F.upper("type").alias("type"), F.col("type").alias("plain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), T.overlap(F.col("terms"), z["told"]).alias("overlap"), T.relevance(F.col("type"), F.col("n")).alias("related"),
            ((F.lower("src_label") == "drug") | (F.lower("dst_label") == "drug")).alias("drug"), places("terms", lambda t: (F.length(t) >= 3) & F.contains(z["ends"], t)).alias("hits"), places("_g", lambda g: F.exists(g, lambda v: F.contains(z["ends"], v))).alias("covers"), z["ends"].alias("ends"),
            *[places(c, test).alias(n) for n, c, test in (("tails", "_ts", lambda x: z["ends"].endswith(x["a"])), ("heads", "_ts", lambda x: z["ends"].startswith(x["b"])), ("group_tails", "_gs", lambda x: z["ends"].endswith(x["a"])), ("group_heads", "_gs", lambda x: z["ends"].startswith(x["b"])))],
        )

    names = F.struct(T.normalize_term(F.concat_ws(" ", "src_name", "dst_name", "type", "evidence")).alias("told"), T.normalize_term(F.concat_ws(" ", "src_name", "dst_name")).alias("ends"))
    facts = facts.select("q", "edge", T.bound(names, fact).alias("f"))
    return facts.select("q", "edge", F.col("f").dropFields("ends").alias("fact"), "f.ends")


def scored(paths: DataFrame, edges: DataFrame, nodes: DataFrame, questions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(q, path_id, rels, length, score, best): each path once, with its score and its largest confidence.

    What depends on an edge and the question alone is computed once for each such pair, not for every path.
    """
    asked = asked_of(questions, groups)
    paths = paths.select("q", "rels").distinct()
    each = paths.select("q", "rels", F.posexplode("rels").alias("pos", "edge"))
    facts = edge_facts(each, edges, nodes, asked)
    step = F.struct("pos", "ends", *[F.col(f"fact.{c}").alias(c) for c in ("overlap", "related", "confidence", "type", "drug")])
    full = each.join(facts, ["q", "edge"]).groupBy("q", "rels").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    full = full.join(asked, "q")

    def score_of(ends: Column) -> Column:
        hit = F.size(F.filter("_g", lambda g: F.exists(g, lambda v: F.contains(ends, v))))
        coverage = F.when(F.size("_g") == 0, 1.0).otherwise(hit / F.size("_g"))
        return T.bound(coverage, lambda covered: path_score(F.col("steps"), T.overlap(F.col("terms"), ends), {c: F.col(c) for c in ("wants_path", "wants_drug", "wants_lipids")}, covered))

    score = T.bound(F.array_join(F.transform("steps", lambda s: s["ends"]), " "), score_of)
    best = F.array_max(F.transform("steps", lambda s: s["confidence"]))
    return full.select("q", F.concat(F.lit("path:"), F.sha1(F.array_join("rels", "|"))).alias("path_id"), "rels", F.size("rels").alias("length"), score.alias("score"), best.alias("best"))


def promising_hops(starts: DataFrame, edges: DataFrame, nodes: DataFrame, questions: DataFrame, groups: DataFrame | None, budget: int, work: list | None = None) -> DataFrame:
    """(q, rels): of the two-step paths of ``two_hop_paths``, all that ``promising`` can keep, without scoring the others.

    A path that is kept is among the first m = 2 * budget + 1 of those that begin with its first edge.  A path's score depends
    on little of its edges: type, confidence, overlap, relevance, and which terms and groups their names hold, or hold a half of
    that the other edge's names may complete.  So the edges at a middle node fall into classes, and each pair of classes has
    one score.  For a class of first edges, classes of second edges are counted by falling score and confidence until m paths are there
    beside those that lead back; classes that come later are never joined.  Only what is left is listed, path by path.
    """
    m = 2 * budget + 1
    asked = asked_of(questions, groups)
    keep = G.symmetric(edges.where("type <> 'MENTIONS'").select("id", "src", "dst")).select("u", "v", "id")
    plain = nodes.where("label <> 'Paper'").select(F.col("id").alias("_n"))
    both = keep.join(plain, F.col("v") == F.col("_n"), "left_semi")
    s = starts.select("q", F.col("id").alias("start")).distinct()
    first = s.join(both, F.col("start") == F.col("u")).select("q", "start", F.col("v").alias("mid"), F.col("id").alias("edge"))
    first = kept(first.withColumn("back", F.count("*").over(W.partitionBy("q", "start", "mid"))))
    second = first.select("q", "mid").distinct().join(both, F.col("mid") == F.col("u")).select("q", "mid", F.col("id").alias("edge"), F.col("v").alias("finish"))
    facts = kept(edge_facts(first.select("q", "edge").unionByName(second.select("q", "edge")), edges, nodes, asked).select("q", "edge", "fact", F.to_json("fact").alias("k")))
    first, second = (x.join(facts, ["q", "edge"]) for x in (first, second))
    ones = first.groupBy("q", "mid", F.col("k").alias("k1")).agg(F.first("fact").alias("f1"), F.max("back").alias("back"))
    twos = second.groupBy("q", "mid", F.col("k").alias("k2")).agg(F.first("fact").alias("f2"), F.count("*").alias("size"))
    pairs = ones.join(twos, ["q", "mid"]).join(asked, "q")
    wanted = (F.size("types") == 0) | F.array_contains("types", F.col("f1.plain")) | F.array_contains("types", F.col("f2.plain"))
    across = lambda cut, tails, heads: F.transform(F.array_intersect(f"f1.{tails}", f"f2.{heads}"), lambda p: F.get(cut, p)["i"])
    hits = F.size(F.array_union(F.array_union("f1.hits", "f2.hits"), across("_ts", "tails", "heads")))
    covers = F.size(F.array_union(F.array_union("f1.covers", "f2.covers"), across("_gs", "group_tails", "group_heads")))
    overlap = F.when(F.size("terms") == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.size("terms"), F.lit(6)))))
    coverage = F.when(F.size("_g") == 0, 1.0).otherwise(covers / F.size("_g"))
    score = T.bound(coverage, lambda covered: path_score(F.array("f1", "f2"), overlap, {c: F.col(c) for c in ("wants_path", "wants_drug", "wants_lipids")}, covered))
    best = F.greatest("f1.confidence", "f2.confidence")  # what paths of equal scores are ordered by
    pairs = pairs.where(wanted).select("q", "mid", "k1", "k2", "size", "back", F.struct(score.alias("score"), best.alias("best")).alias("worth"))
    by = W.partitionBy("q", "mid", "k1")
    pairs = pairs.withColumn("seen", F.sum("size").over(by.orderBy(F.desc("worth")).rangeBetween(W.unboundedPreceding, W.currentRow)))
    pairs = pairs.withColumn("least", F.max(F.when(F.col("seen") >= m + F.col("back"), F.col("worth"))).over(by))
    pairs = pairs.where("least is null or worth >= least").select("q", "mid", "k1", "k2")
    a = first.select("q", "mid", F.col("k").alias("k1"), "start", F.col("edge").alias("e1"))
    b = second.select("q", "mid", F.col("k").alias("k2"), "finish", F.col("edge").alias("e2"))
    out = pairs.join(a, ["q", "mid", "k1"]).join(b, ["q", "mid", "k2"]).where("e1 <> e2 and start <> finish")
    if work is not None:
        work += [first, second, out]
    return out.select("q", F.array("e1", "e2").alias("rels")).distinct()


def promising(paths: DataFrame, budget: int) -> DataFrame:
    """The paths, of one or two steps, that greedy packing can choose: a bounded number for each question, and none lost.

    A better path of the same length that was skipped would have fitted, so it shares an edge that is in use by then.  If it also
    shares one with the chosen path, it is the other one: at most two, one a direction, for each edge in use.  Hence a chosen
    path's rank among those of its length at either of its edges is at most m = 2 * budget + 1.  Of the paths within these
    ranks, at most budget * m hold an edge in use, so its rank among all of its length is at most budget * m + 1.
    """
    m = 2 * budget + 1
    order = [F.desc("score"), F.desc("best"), "length", "path_id"]
    by = W.partitionBy("q", "length", "_e").orderBy(*order)
    rest = [c for c in paths.columns if c not in ("q", "path_id")]
    near = paths.withColumn("_e", F.explode("rels")).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= m)
    kept = near.groupBy("q", "path_id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest]).where(F.col("_n") == F.size("rels")).drop("_n")
    each = W.partitionBy("q", "length").orderBy(*order)
    return kept.withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= budget * m + 1).drop("_r")


def packed(paths: DataFrame, budget: int, own: str | None = None) -> DataFrame:
    """Greedy packing: paths in order of score, confidence, length and id; a path that shares an edge with a chosen
    one, or would go over the budget of steps, is skipped.  One fold per question over its ``promising`` paths.

    ``own``: the column of each question's own budget, if that is less for some.
    """
    most = F.least(F.lit(budget), F.col(own)) if own else F.lit(budget)
    key = F.struct((-F.col("score")).alias("a"), (-F.col("best")).alias("b"), F.col("length").alias("c"), F.col("path_id").alias("d"), F.col("rels").alias("rels"), F.col("score").alias("score"))
    each = promising(paths, budget).groupBy("q").agg(F.array_sort(F.collect_list(key)).alias("ps"), F.max(most).alias("_most"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<d:string,rels:array<string>,score:double>>").alias("ids"))

    def step(acc: Column, p: Column) -> Column:
        take = ~F.arrays_overlap(acc["used"], p["rels"]) & (F.size(acc["used"]) + F.size(p["rels"]) <= F.col("_most"))
        row = F.struct(p["d"].alias("d"), p["rels"].alias("rels"), p["score"].alias("score"))
        return F.when(take, F.struct(F.concat(acc["used"], p["rels"]).alias("used"), F.array_append(acc["ids"], row).alias("ids"))).otherwise(acc)

    chosen = each.select("q", F.posexplode(F.aggregate("ps", start, step, lambda a: a["ids"])).alias("rank", "p"))
    return chosen.select("q", F.col("p.d").alias("path_id"), "p.rels", F.size("p.rels").alias("length"), "p.score", (F.col("rank") + 1).alias("rank"))


def top_paths(paths: DataFrame, n: int) -> DataFrame:
    """The best ``n`` paths a question under the same order."""
    by = W.partitionBy("q").orderBy(F.desc("score"), F.desc("best"), "length", "path_id")
    return paths.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def evidence_rows(records: DataFrame, record: str = "record") -> DataFrame:
    """Evidence from loose records (a map of texts): missing text is "", a number that is none its default, an edge without an id gets
    one from its ends, type and chunk.  Columns but the record stay."""
    text = lambda k: F.coalesce(F.element_at(record, k), F.lit(""))
    number = lambda k, kind: F.trim(F.element_at(record, k)).try_cast(kind)
    made = T.key_of("evidence:", text("sourceName"), text("relationshipType"), text("targetName"), text("chunkId"))
    plain = {"source_name": "sourceName", "relationship_type": "relationshipType", "target_name": "targetName", "evidence_text": "evidenceText", "source_pmcid": "sourcePmcid", "source_pmid": "sourcePmid", "chunk_id": "chunkId", "document_id": "documentId", "document_title": "documentTitle", "path_id": "pathId", "source_url": "sourceUrl", "graph_run_id": "graphRunId"}
    return records.select(
        *[c for c in records.columns if c != record], F.coalesce(F.nullif(text("relationshipId"), F.lit("")), made).alias("id"), *[text(k).alias(n) for n, k in plain.items()],
        number("confidence", "double").alias("confidence"), F.coalesce(number("pathStep", "int"), F.lit(1)).alias("path_step"), F.coalesce(number("pathLength", "int"), F.lit(1)).alias("path_length"),
        F.coalesce(number("matchScore", "double"), F.lit(0.0)).alias("match_score"), F.coalesce(F.nullif(text("evidenceKind"), F.lit("")), F.lit("graph")).alias("evidence_kind"),
    )


def edge_records(edges: DataFrame, props: str = "props", keep: list[str] | None = None) -> DataFrame:
    """(record, and the columns to keep): edges (id, type, src_name, dst_name, props) as loose records; the evidence is the first of three properties that is set."""
    p = lambda *names: F.coalesce(*[F.element_at(props, n) for n in names], F.lit(""))
    named = {"relationshipId": F.coalesce(F.element_at(props, "id"), F.col("id")), "sourceName": F.coalesce("src_name", F.lit("")), "relationshipType": F.col("type"), "targetName": F.coalesce("dst_name", F.lit("")), "evidenceText": p("evidence", "evidence_text", "evidenceText"), "confidence": F.element_at(props, "confidence"), "sourcePmcid": p("source_pmcid"), "sourcePmid": p("source_pmid"), "chunkId": p("chunk_id"), "graphRunId": p("graph_run_id")}
    return edges.select(*(keep or []), F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]).alias("record"))


def budgets(limit: int) -> tuple[int, int]:
    """Evidence for definitions (a third, three at most) and for the graph."""
    d = max(0, min(3, limit // 3))
    return d, limit - d


def definitions(questions: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(q, id, name, definition, score, rank): entries (c, name, aliases, definition) whose names the question holds, in entry order."""
    hit = matched_groups(questions, entries).select("q", "c").join(entries.select("c", "name", "definition"), "c").join(questions.select("q", "n"), "q")
    by = W.partitionBy("q").orderBy("c")
    out = hit.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return out.select("q", T.key_of("definition:", F.col("name"), cut=16).alias("id"), "name", "definition", (1.0 + T.relevance(F.lit("DEFINITION_OF"), F.col("n"))).alias("score"), "rank")


def connector_paths(questions: DataFrame, groups: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, rels): two-step paths through a drug, for questions that ask for a path and a drug and name two concepts.

    ``groups``: (q, c, values) as of ``matched_groups``; stop terms name nothing, equal groups are one, and a node
    without a name is in no group.
    """
    own = groups.join(questions.where("wants_path and wants_drug").select("q"), "q", "left_semi")
    own = own.select("q", "c", F.array_sort(T.without_stop_terms(F.col("values"))).alias("values")).where(F.size("values") > 0).groupBy("q", "values").agg(F.min("c").alias("g"))
    members = kept(name_pairs(nodes.select("id", "name"), own.select("q", "g", F.explode("values").alias("term"))).select("q", "g", "id").distinct())
    return connectors(members, edges, nodes).select("q", F.array("first", "second").alias("rels")).distinct()


def evidence(questions: DataFrame, nodes: DataFrame, edges: DataFrame, concepts: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(q, pos, kind, id, path_id, path_step, path_length, match_score, source, type, target, confidence, text): the graph retriever.

    ``questions`` (q, question); ``concepts`` (c, name, aliases) widen the terms and are to be covered by a path;
    ``entries`` are the same with a definition, and of other c.  Per question: definitions take their budget first; anchors are
    found by words, else by containment; one-step paths, two-step paths if a path is asked for, and drug connectors
    are one set of paths, which is scored and packed into what the definitions leave.  Packed steps come first, then the
    definitions.  A question without terms or anchors has definitions alone.
    """
    # the batch of questions, what is found for it, and the part of the graph around that are read by every branch
    asked = kept(analysed(questions))
    groups = kept(matched_groups(asked, concepts.select("c", "name", "aliases").unionByName(entries.select("c", "name", "aliases"))))
    q = kept(expanded_terms(asked, groups))
    told = kept(definitions(q, entries, budgets(limit)[0]))
    found = kept(anchors(q, nodes).select("q", "id"))
    found = kept(found.unionByName(containing(q.join(found, "q", "left_anti"), nodes)))
    starts = kept(found.join(q.select("q", "types", "wants_path"), "q"))
    links = kept(connector_paths(q.join(found, "q", "left_semi"), groups, edges, nodes))
    edges = edges.select("id", "type", "src", "dst", "confidence", *(["evidence"] if "evidence" in edges.columns else []))
    edges, nodes = G.neighbourhood(starts, edges, nodes.select("id", "label", "name"), starts.where("wants_path"), links.select(F.explode("rels").alias("id")))
    paths = direct_paths(starts, edges).unionByName(promising_hops(starts.where("wants_path"), edges, nodes, q, groups, limit))
    paths = kept(paths.unionByName(links))
    left = q.select("q").join(told.groupBy("q").agg(F.count("*").alias("_n")), "q", "left").select("q", (F.lit(limit) - F.coalesce("_n", F.lit(0))).cast("int").alias("budget"))
    best = packed(scored(paths, edges, nodes, q, groups).join(left, "q"), limit, "budget")
    steps = best.select("q", "rank", "path_id", "length", "score", F.posexplode("rels").alias("step", "edge"))
    facts = G.triples(edges.select(F.col("id").alias("edge"), "type", "src", "dst", "confidence", *([] if "evidence" not in edges.columns else ["evidence"])), nodes)
    text = F.col("evidence") if "evidence" in edges.columns else F.lit("")
    graph = steps.join(facts, "edge").select(
        "q", F.lit(0).alias("_late"), (F.col("rank") * 10 + F.col("step")).alias("_at"), F.lit("graph").alias("kind"), F.col("edge").alias("id"), "path_id", (F.col("step") + 1).alias("path_step"), F.col("length").alias("path_length"),
        F.col("score").alias("match_score"), F.col("src_name").alias("source"), "type", F.col("dst_name").alias("target"), "confidence", F.coalesce(text, F.lit("")).alias("text"),
    )
    more = told.select(
        "q", F.lit(1).alias("_late"), F.col("rank").alias("_at"), F.lit("definition").alias("kind"), "id", F.lit("").alias("path_id"), F.lit(1).alias("path_step"), F.lit(1).alias("path_length"),
        F.col("score").alias("match_score"), F.col("name").alias("source"), F.lit("DEFINITION_OF").alias("type"), F.lit("").alias("target"), F.lit(1.0).alias("confidence"), F.col("definition").alias("text"),
    )
    by = W.partitionBy("q").orderBy("_late", "_at")
    return graph.unionByName(more).withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= limit).drop("_late", "_at")


def legacy(question: str, edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Edges one of whose ends is named in the question, with their paper: by source id, else by a mention of the
    source (one row for each such paper).  Largest confidence first, nulls before all."""
    facts = G.triples(edges.where("type <> 'MENTIONS'"), nodes)
    named = lambda c: F.col(c).isNotNull() & F.contains(F.lower(F.lit(question)), F.lower(F.col(c)))
    facts = facts.where(named("src_name") | named("dst_name"))
    papers = nodes.where("label = 'Paper'")
    direct = papers.select(F.col("pmcid").alias("_pm"), F.col("id").alias("_p1"))
    mention = edges.where("type = 'MENTIONS'").select(F.col("dst").alias("_m"), F.col("src").alias("_p2"))
    out = facts.join(direct, F.col("source_pmcid") == F.col("_pm"), "left").join(mention, F.col("src") == F.col("_m"), "left")
    out = out.select("id", "src_name", "type", "dst_name", "confidence", F.coalesce("_p1", "_p2", F.lit("")).alias("document_id")).distinct()
    return out.orderBy(F.desc_nulls_first("confidence"), "id", "document_id").limit(limit)


def noop(questions: DataFrame, rules: list[tuple[list[str], list[str], str]]) -> DataFrame:
    """(q, id): fixed evidence for tests; a rule applies if all of its first and any of its second words are there."""
    out = None
    for need, some, name in rules:
        low = F.lower("question")
        test = F.lit(True)
        for w in need:
            test = test & F.contains(low, F.lit(w))
        part = questions.where(test & T.has_any(low, some)).select("q", F.lit(name).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


RETRIEVERS = {"graph": evidence, "graph_legacy": legacy, "noop": noop}


def get_retriever(name: str):  # noqa: ANN201
    """The registered retriever; names are case-blind, hyphens count as underscores, "none" is noop."""
    key = name.lower().strip().replace("-", "_")
    key = {"none": "noop", "legacy_graph": "graph_legacy"}.get(key, key)
    if key not in RETRIEVERS:
        raise ValueError(f"unknown retriever: {name}")
    return RETRIEVERS[key]
