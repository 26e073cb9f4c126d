"""License scan by diagonal voting.

Every document's rolling word 3-gram hashes are joined to the positions of the same grams in a
small table of license templates (fixed, so safe to broadcast).  A hit votes for the diagonal
``position in document - position in template``; equal gram words are checked in the join.  A
base phrase stands where one diagonal holds all its grams.  For the longer templates, diagonals
at most ``SLACK`` apart are merged (inserted or lost words shift the diagonal), and a merged
span is verified if the template grams it covers make up ``COVER`` of the template.

Only DataFrame functions.  One pass over the texts counts words and keeps, within the row, the
grams whose hash is among the templates' (a fixed set); this small table is written to the
shared folder, and only documents that have such grams take part in the join.

A row is identified by (doc_id, md5 of text), so repeated rows, also of one doc_id with other
texts, get their own results.  A null or empty text has no words, no labels and score 0.  Null
keys pass through; an empty table gives an empty result; other columns are ignored, whatever
their names.  Very long texts, and very long runs of one kind of character in them, take time
and memory in proportion to their length.  Ties: equal grams of several templates vote for each
of them; a gram that stands at several places of a template votes for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .folders import checkpointed

K = 3
SLACK = 3
COVER = 0.6
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters of GAP, but for the capitals, which are lower-cased before.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The base phrases.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Further notices in common use, by label; some with a gram that must be there (it names the version).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be "
        "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
        "software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted "
        "to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """(t, label, base, must, n_grams, tpos, gram, h): one row per 3-gram of each template."""
    rows = [(i, label, i < len(PHRASES), text, must[0] if must else None) for i, (label, text, *must) in enumerate([*PHRASES.items(), *TEMPLATES])]
    t = spark.createDataFrame(rows, "t int, label string, base boolean, text string, must string").withColumn("w", F.split("text", " "))
    t = t.withColumn("n_grams", F.size("w") - (K - 1))
    t = t.select("t", "label", "base", "must", "n_grams", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_grams") - 1), lambda i: F.struct(i.alias("tpos"), F.slice("w", i + 1, K).alias("g")))).alias("x"))
    return t.select("t", "label", "base", "must", "n_grams", "x.tpos", F.array_join("x.g", " ").alias("gram"), F.xxhash64(*[F.get("x.g", k) for k in range(K)]).alias("h"))


def license_words(text: str) -> Column:
    """Lower-cased words (A-Z only: the two characters that lower() would turn into ASCII are masked first)."""
    t = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))
    t = F.btrim(t, F.lit(GAPS))  # looks at each end once, however long a run of other characters stands elsewhere
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def gram_hits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, _key, n_words, grams): one row per row of ``df``; grams: (pos, h, gram) of those that a template has."""
    known = [r["h"] for r in template_grams(df.sparkSession).select("h").distinct().collect()]  # of the fixed templates
    own = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_w", license_words("_t"))
    rolled = F.transform("_w", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, K)]).alias("h")))
    some = F.filter(rolled, lambda x: x["h"].isin(known))
    grams = F.transform(some, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.array_join(F.slice("_w", x["pos"] + 1, K), " ").alias("gram")))
    own = own.withColumn("grams", grams)
    name = F.when(F.size("grams") > 0, F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.md5("_t")))
    return checkpointed(own.select("_id", name.alias("_key"), F.size("_w").cast("long").alias("n_words"), "grams"))


def spans(found: DataFrame, cover: float = COVER) -> DataFrame:
    """Verified spans: (_key, label, base, start, end in words, score), of the rows of ``gram_hits`` that have any."""
    grams = template_grams(found.sparkSession).withColumnsRenamed({"h": "_h", "gram": "_gram"})
    each = found.where("_key is not null").select("_key", F.explode("grams").alias("x")).select("_key", "x.*")
    hits = each.join(F.broadcast(grams), (F.col("h") == F.col("_h")) & (F.col("gram") == F.col("_gram"))).select("_key", "t", "label", "base", "n_grams", "pos", "tpos", (F.col("gram") == F.col("must")).alias("must"))
    votes = hits.groupBy("_key", "t", "label", "base", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("covered"), F.bool_or("must").alias("must"))
    by = W.partitionBy("_key", "t").orderBy("diagonal")
    near = F.when(F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SLACK, F.lit(True)), 1).otherwise(0)
    merged = votes.withColumn("_new", near).withColumn("cluster", F.sum("_new").over(by))
    joined = merged.groupBy("_key", "t", "label", "base", "n_grams", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("covered"))).alias("c"), F.min(F.col("diagonal") + F.array_min("covered")).alias("start"), F.max(F.col("diagonal") + F.array_max("covered") + K).alias("end"), F.bool_or("must").alias("must")
    )
    score = F.size("c") / F.col("n_grams")
    return joined.where(F.when(F.col("base"), F.size("c") == F.col("n_grams")).otherwise((score >= cover) & F.coalesce("must", F.lit(True)))).select("_key", "label", "base", "start", "end", score.alias("score"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("base")
    docs = gram_hits(df, text, key)
    found = spans(docs).groupBy("_key").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    none = {"n_base": F.lit(0).cast("long"), "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    hit = docs.where("_key is not null").select("_key", "_id", "n_words").join(found, "_key", "left").select("_id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])
    rest = docs.where("_key is null").select("_id", "n_words", *[v.alias(c) for c, v in none.items()])
    return hit.unionByName(rest).withColumnRenamed("_id", key)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ", ".join(
    f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, {repr(must[0]) if must else 'NULL'}, '{text}')" for i, (label, text, *must) in enumerate([*PHRASES.items(), *TEMPLATES])
)
ORACLE = rf"""
WITH t(t, label, base, must, text) AS (VALUES {_ROWS}),
tg AS (SELECT t, label, base, must, len(w) - 2 AS n_grams, p - 1 AS tpos, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT t, label, base, must, w, unnest(range(1, len(w) - 1)) AS p FROM (SELECT *, string_split(text, ' ') AS w FROM t))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= {K})),
h AS (SELECT doc_id, t, label, base, must, n_grams, tpos, pos, pos - tpos AS diagonal, dg.g AS g FROM dg JOIN tg ON dg.g = tg.g),
v AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS gap FROM (SELECT DISTINCT doc_id, t, base, diagonal FROM h)),
c AS (SELECT doc_id, t, diagonal, sum(CASE WHEN base OR gap IS NULL OR gap > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS cluster FROM v),
j AS (SELECT h.doc_id, h.t, label, base, n_grams, cluster, count(DISTINCT tpos) AS k, min(pos) AS start, coalesce(bool_or(g = must), true) AS named FROM h JOIN c ON h.doc_id = c.doc_id AND h.t = c.t AND h.diagonal = c.diagonal GROUP BY h.doc_id, h.t, label, base, n_grams, cluster),
ok AS (SELECT *, k / n_grams AS score FROM j WHERE CASE WHEN base THEN k = n_grams ELSE k / n_grams >= {COVER} AND named END),
a AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
