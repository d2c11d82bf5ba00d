"""License scans: exact containment join of text blocks against license templates.

Base labels come from places where a phrase's words stand consecutively. Further labels
come from an exact set-similarity join. Blocks are all windows of words, whatever lines they
stand on, a quarter longer than the template, so a wrapped notice is found and words strewn
over a long text are not one. The tokens of all templates are put in one global order,
rarest in the documents first, and so are those of a block. A block that holds at least
``threshold`` of a template's tokens holds one of the template's first few in that order
(prefix filter): only the words around such places are looked at. There must be enough words
(length filter), and enough of the order left after the token, in the template and around
the place (positional filter). What passes is verified window by window.
DataFrame functions only; templates are a fixed, small table, so only they are broadcast.

Defined results: null and empty text have no words and no labels ('' and score 0); every
row is judged by its own text, repeated doc_ids and a null doc_id too; an empty table gives
no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.text import ASCII_LOWER, WORD, words

#: Phrases of the base scan, by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Notice texts by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def base_hits(w, phrases: dict[str, str]):
    """Array of (start, label) of every place where a phrase stands, from the words array."""
    at = F.when(F.lit(False), F.struct(F.lit(0).alias("start"), F.lit("").alias("label")))

    def place(i):
        found = at
        for label, phrase in phrases.items():
            same = F.lit(True)
            for k, word in enumerate(phrase.split(" ")):
                same = same & (F.get(w, i + k) == word)
            found = found.when(same, F.struct(i.alias("start"), F.lit(label).alias("label")))
        return found

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), place), lambda x: x.isNotNull())


def ranked_templates(docs: DataFrame, templates, threshold: float) -> list[dict]:
    """Templates with their distinct tokens in the global order and the number that must match.

    The order is by the number of documents that hold the token, over all documents; the
    counts that reach the driver are as many as the templates have tokens.
    """
    split = [WORD.findall(text.translate(ASCII_LOWER)) for _, text in templates]
    vocabulary = sorted({t for tokens in split for t in tokens})
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col("text")))).alias("token"))
    df = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (df.get(t, 0), t)))}
    return [
        {
            "id": k, "label": label, "tokens": sorted(set(tokens), key=rank.get), "rank": rank,
            "need": math.ceil(threshold * len(set(tokens)) - 1e-9), "window": math.ceil(1.25 * len(tokens)),
        }
        for k, ((label, _), tokens) in enumerate(zip(templates, split, strict=True))
    ]


def _literal(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def prefix_table(spark, ranked: list[dict]) -> tuple[DataFrame, list[str]]:
    """The prefix tokens of the templates with what their blocks are verified by, and the distinct tokens."""
    prefix = [(t, x, i) for x in ranked for i, t in enumerate(x["tokens"][: len(x["tokens"]) - x["need"] + 1])]
    table = spark.sql(
        "select * from values "
        + ", ".join(f"('{t}', {x['id']}, '{x['label']}', {x['need']}, {i}, {x['window']}, {_literal(x['tokens'])})" for t, x, i in prefix)
        + " as t(token, template, label, need, place, window, tokens)"
    )
    return table, sorted({t for t, _, _ in prefix})


def places(docs: DataFrame, ranked: list[dict]) -> DataFrame:
    """The places of prefix tokens with the words around, and ``left``, how much of the order there is from the token on.

    Columns doc_id, tie (hash of the text), token, mid (the token's place in near), near,
    left, and those of the templates the token belongs to.
    """
    table, tokens = prefix_table(docs.sparkSession, ranked)
    order = F.array(*map(F.lit, sorted(ranked[0]["rank"], key=ranked[0]["rank"].get)))
    firsts, reach = F.array(*map(F.lit, tokens)), max(x["window"] for x in ranked)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("w"))
    # Length filter, and documents without any prefix token.
    rows = rows.filter(F.size("w") >= min(x["need"] for x in ranked)).filter(F.arrays_overlap("w", firsts))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(firsts, F.get("w", i)))
    rows = rows.select("doc_id", "tie", F.explode(F.transform(at, lambda i: F.struct(
        F.get("w", i).alias("token"), F.least(i, F.lit(reach - 1)).alias("mid"),
        F.slice("w", F.greatest(i - (reach - 1), F.lit(0)) + 1, F.least(i, F.lit(reach - 1)) + reach).alias("near"),
    ))).alias("x")).select("doc_id", "tie", "x.*")
    # The template tokens around the place in the global order: those from this token on.
    held = F.array_intersect(order, F.col("near"))
    rows = rows.withColumn("left", F.size(held) - F.array_position(held, F.col("token")).cast("int") + 1)
    return rows.join(F.broadcast(table), "token")


def containment_join(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, tie, template, label and containment of every template of which a window of words meets the threshold."""
    found = places(docs, ranked_templates(docs, templates, threshold))
    # The first token of the template that a window holds stands at ``place``: enough must follow on both sides.
    found = found.filter((F.col("left") >= F.col("need")) & (F.size("tokens") - F.col("place") >= F.col("need")))
    # Windows that hold the place start up to window - 1 words before it.
    low = F.greatest(F.col("mid") - F.col("window") + 1, F.lit(0))
    found = found.withColumn("near", F.slice("near", low + 1, F.col("mid") - low + F.col("window"))).withColumn("mid", F.col("mid") - low)
    found = found.filter(F.size(F.array_intersect("tokens", "near")) >= F.col("need"))
    held = F.transform(
        F.sequence(F.lit(0), F.col("mid")), lambda i: F.size(F.array_intersect(F.col("tokens"), F.slice("near", i + 1, F.col("window"))))
    )
    found = found.withColumn("overlap", F.array_max(held)).filter("overlap >= need")
    return found.groupBy("doc_id", "tie", "template", "label").agg(F.max(F.col("overlap") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document."""
    joined = containment_join(docs, templates, threshold).groupBy(F.col("doc_id").alias("id"), "tie").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("w"), F.lower("text").contains("license").alias("may"))
    rows = rows.select("doc_id", "tie", F.size("w").cast("long").alias("n_words"), F.when(F.col("may"), base_hits(F.col("w"), PHRASES)).alias("hits"))
    rows = rows.select(
        "doc_id", "tie", "n_words",
        F.when(F.size("hits") > 0, F.size("hits")).otherwise(0).cast("long").alias("n_base"),
        F.array_min(F.col("hits.start")).cast("long").alias("first_word"),
        F.array_max(F.col("hits.start")).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct("hits.label")), F.array().cast("array<string>")).alias("base"),
    )
    out = rows.join(joined, rows["doc_id"].eqNullSafe(joined["id"]) & (rows["tie"] == joined["tie"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(threshold: float = 0.8) -> str:
    """The same rows by brute force in DuckDB: every window that starts with a template's token, against that template."""
    lower, word = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"({k}, '{label}', '{text.lower()}')" for k, (label, text) in enumerate(TEMPLATES))
    checks = " ".join(
        "when " + " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split(" "))) + f" then '{label}'"
        for label, phrase in PHRASES.items()
    )
    return f"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all({lower}, '{word}') as w from documents),
spots as (select r, i, w[i + 1] as word from (select r, w, unnest(range(len(w))) as i from d)),
base as (select r, count(*) as n, min(i) as lo, max(i) as hi, list_sort(list(distinct label)) as labels
  from (select r, i, case {checks} end as label from (select r, w, unnest(range(len(w))) as i from d)) where label is not null group by r),
tpl as (select k, label, list_distinct(ws) as tokens, ceil(1.25 * len(ws)) as size
  from (select k, label, regexp_extract_all(txt, '{word}') as ws from (values {values}) as v(k, label, txt))),
held as (select r, k, label, len(tokens) as n, size, i, word
  from spots join (select *, unnest(tokens) as token from tpl) as t on word = token),
wins as (select a.r, a.k, a.label, a.n, a.i, count(distinct b.word) as c
  from held a join held b on a.r = b.r and a.k = b.k and b.i >= a.i and b.i < a.i + a.size group by all),
more as (select r, list(distinct label) as labels, max(c / n) as best from wins where c >= ceil({threshold} * n - 1e-9) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(lo as bigint) as first_word, cast(hi as bigint) as last_word,
  coalesce(array_to_string(base.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
  case when coalesce(n, 0) > 0 then 1.0 else coalesce(best, 0.0) end as score
from d left join base using (r) left join more using (r)"""
