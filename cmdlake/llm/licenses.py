"""Operator 9: license scans as an exact set-similarity join.

Text blocks (WINDOW words, one block every STEP words, so that any STEP words stand whole
in some block, however a text is cut into lines) and license templates are sets of words. A
block meets a template if it holds at least CONTAINMENT of the template's words and, word
by word, the phrase that names the license: without it a notice of another license, or
prose about licenses, shares most words. Words are ordered by how many documents hold them,
rare ones first: to meet a template of n words with a overlap, a block must hold one of the
template's n - a + 1 rarest words (prefix), have a words at all (length), and the words
from the first common one on must be enough in both (position). Blocks that pass are
compared whole.

Only DataFrame operations. The templates are a fixed list, so their side of the join
is broadcast at a known size; a document has one row but for its few blocks with a
prefix word, so a hot source or word gathers nowhere.

Defined cases: null text is empty; a document without words has no places (null
first_word, last_word), no labels and score 0; a long text has as many blocks as it takes;
of templates that tie, all labels are given; repeated rows are separate documents; further
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let

#: Fixed values of the contract: phrases, their labels, and what separates words.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: A block must hold this share of a template's words.
CONTAINMENT = 0.8
#: Words of a block, and from one block's begin to the next; no template is longer than a step.
WINDOW, STEP = 64, 32
#: Fixed values, the method's templates: wording of public license notices, as label, naming phrase, words.
TEMPLATES = (
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache org licenses", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("gpl", "general public license", "licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "attribution sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "bsd license", "licensed under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def license_words(low: Column) -> Column:
    """Words of a lowered text."""
    return let(F.split(low, SEPARATOR + "+"), lambda w: F.when(F.size(w) == 1, F.filter(w, lambda x: x != "")).otherwise(F.slice(w, F.when(w[0] == "", 2).otherwise(1), F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when(F.element_at(w, -1) == "", 1).otherwise(0))))


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, _, t in templates for w in t.split()})


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of a (fixed, small) vocabulary; over the whole table."""
    held = F.array_intersect(F.split(lowered(F.col("text")), SEPARATOR + "+"), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most a row for each word of the templates
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels
    (arrays), score (the largest containment; 1 where a phrase stands)."""
    spark = docs.sparkSession
    counts = document_counts(docs, _vocabulary(templates))
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    prefixes: list = []
    for label, phrase, text in templates:
        ordered = sorted(set(text.split()), key=rank.get)
        need = max(1, math.ceil(containment * len(ordered) - 1e-9))
        prefixes += [(w, p, len(ordered), need, label, f" {phrase} ", ordered) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
    table = spark.createDataFrame(prefixes, "token string, p int, size int, need int, label string, phrase string, wanted array<string>")
    seeds = sorted({x[0] for x in prefixes})
    ranks = F.create_map(*[x for w, i in rank.items() for x in (F.lit(w), F.lit(i))])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), lowered(F.col("text")).alias("low"))
    rows = rows.withColumn("w", license_words(F.col("low")))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))

    # Places of phrases: documents that hold a phrase's words at all are walked.
    def places(phrase: str) -> Column:
        parts = phrase.split()
        at = lambda w, x, i: (x == parts[0]) & F.expr("true") if len(parts) == 1 else (x == parts[0]) & F.forall(F.array(*(F.coalesce(F.get(w, i + k) == p, F.lit(False)) for k, p in enumerate(parts) if k)), lambda y: y)
        walk = let(F.col("w"), lambda w: F.filter(F.transform(w, lambda x, i: F.when(at(w, x, i), i)), lambda x: x.isNotNull()))
        pattern = r"(?s)(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + (SEPARATOR + "+").join(map(re.escape, parts)) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
        quick = F.contains("low", F.lit(parts[-1])) & F.col("low").rlike(pattern)
        return F.when(quick, walk).otherwise(F.array().cast("array<int>"))

    found = [places(p) for p in PHRASES]
    rows = rows.withColumn("places", F.array(*found))

    # Blocks with a prefix word of a template.
    seed = F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<string>")

    def blocks(w: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - STEP) / STEP) - 1, F.lit(0)).cast("int"))
        return F.filter(F.transform(begins, lambda i: F.slice(w, i * STEP + 1, WINDOW)), lambda x: F.arrays_overlap(x, seed))

    rows = rows.withColumn("blocks", F.when(F.arrays_overlap("w", seed), let(F.col("w"), blocks)).otherwise(F.array().cast("array<array<string>>")))
    rows = rows.select("doc_id", "_row", "n_words", "places", F.posexplode_outer("blocks").alias("b", "block"))

    # Tokens of a block in the global order; words of no template come last and need no order among themselves.
    by_rank = lambda x: F.transform(F.array_sort(F.transform(F.array_distinct(x), lambda t: F.struct(F.coalesce(F.try_element_at(ranks, t), F.lit(1 << 30)).alias("r"), t.alias("t")))), lambda y: y.t)
    rows = rows.withColumn("tokens", F.when(F.col("block").isNotNull(), by_rank(F.col("block")))).withColumn("said", F.concat(F.lit(" "), F.array_join("block", " "), F.lit(" "))).drop("block")
    seen = rows.select("*", F.posexplode_outer("tokens").alias("q", "token")).filter(F.col("token").isNull() | (F.col("q") == 0) | F.col("token").isin(*seeds))
    hits = seen.join(F.broadcast(table), "token", "left")
    possible = (F.size("tokens") >= F.col("need")) & (F.least(F.col("size") - F.col("p"), F.size("tokens") - F.col("q")) >= F.col("need"))
    overlap = F.when(possible & F.contains("said", "phrase"), F.size(F.array_intersect("wanted", "tokens")))
    met = F.col("overlap") >= F.col("need")
    hits = hits.withColumn("overlap", overlap).withColumn("label", F.when(met, F.col("label"))).withColumn("share", F.when(met, F.col("overlap") / F.col("size")))
    one = hits.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("places").alias("places"), F.collect_set("label").alias("more"), F.max("share").alias("share"))
    labels = F.array_compact(F.array(*(F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    one = one.withColumn("base_labels", F.array_sort(F.array_distinct(labels))).withColumn("every", F.flatten("places"))
    return one.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        "base_labels", F.array_sort(F.array_union("base_labels", "more")).alias("labels"), F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _sql() -> str:
    words_of = lambda x: f"list_filter(string_split_regex({x}, '{SEPARATOR}+'), lambda y: y <> '')"
    values = ", ".join(f"('{label}', ' {phrase} ', {sorted(set(text.split()))})" for label, phrase, text in TEMPLATES)
    phrase = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, i - 1 AS place FROM p WHERE w[i] = '{parts[0]}' AND " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(parts) if j) for parts, label in ((p.split(), la) for p, la in PHRASES.items())
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
x AS (SELECT k, doc_id, low, {words_of('low')} AS w FROM d),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM x WHERE list_has_any(w, {sorted({p.split()[0] for p in PHRASES})})),
b AS ({phrase}),
pl AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
t(label, phrase, tokens) AS (VALUES {values}),
l AS (SELECT k, unnest([w[i * {STEP} + 1 : i * {STEP} + {WINDOW}] for i in range(greatest(1, ceil((len(w) - {STEP}) / {STEP}::DOUBLE))::BIGINT)]) AS b FROM x),
m AS (SELECT k, label, len(list_intersect(b, tokens))::DOUBLE / len(tokens) AS share FROM l JOIN t ON contains(' ' || array_to_string(b, ' ') || ' ', phrase)
      WHERE len(list_intersect(b, tokens)) >= ceil({CONTAINMENT} * len(tokens) - 1e-9)),
u AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT k, label, share FROM m UNION ALL SELECT k, label, 1.0 FROM b) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM x LEFT JOIN pl USING (k) LEFT JOIN u USING (k)
"""


SQL = _sql()
