"""License scans: diagonal voting between texts and license templates, by DataFrame functions only.

All rolling K-word hashes of all texts are joined to the positions of the same hashes in templates (a table of
fixed size, broadcast). A hit votes for its diagonal, the text position less the template position; diagonals at
most GAP apart are merged, which bridges words put in or left out, and a merged diagonal is verified: by the share
of the template's K-grams that it holds, by its length, by the words that tell its license from those of similar
wording, all of which must be hit, and against the other templates, of which the best one gets a region. Hits are counted on the map side before they are
shuffled by text; a text's hits are the most that one key brings together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.session import table

#: Words of a gram; diagonals so close are one; share of a template's grams, and length by its own, that a span must have.
K, GAP, COVER, STRETCH = 4, 3, 0.6, 1.5
#: Fixed values of the contract.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Licenses of two families by the words in which their sentences differ.
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"gpl-2": ("General", "2"), "gpl-3": ("General", "3"), "lgpl-2.1": ("Lesser General", "2.1"), "lgpl-3": ("Lesser General", "3"), "agpl-3": ("Affero General", "3")}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1"),
    *((f"cc-{k}", f"This work is licensed under a Creative Commons {name} 4.0 International License") for k, name in _CC.items()),
    *((f"cc-{k}", f"Licensed under CC {k.upper()} 4.0") for k in _CC),
    *((k, f"This work is licensed under the GNU {name} Public License, version {v}.") for k, (name, v) in _GNU.items()),
    *((k, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for k, (name, v) in _GNU.items()),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def deciding(templates: list[tuple[str, str]]) -> list[list[int]]:
    """For each template the positions of its words that a template of another label lacks, which has half of its K-grams or more."""
    words = [template_words(t) for _, t in templates]
    grams = [{tuple(w[i : i + K]) for i in range(len(w) - K + 1)} for w in words]
    rivals = [[u for u, g in enumerate(grams) if templates[u][0] != label and 2 * len(g & grams[t]) >= len(grams[t]) > 0] for t, (label, _) in enumerate(templates)]
    return [[i for i, x in enumerate(w) if any(x not in words[u] for u in rivals[t])] for t, w in enumerate(words)]


def _template_rows(templates: list[tuple[str, str]], array: str) -> str:
    """SQL rows (tpl, label, tpos, n_grams, n_words, must, w0, ..); array writes a list of numbers."""
    out = []
    for t, ((label, text), must) in enumerate(zip(templates, deciding(templates))):
        w = template_words(text)
        for i in range(len(w) - K + 1):
            out.append(f"({t}, '{label}', {i}, {len(w) - K + 1}, {len(w)}, {array.format(', '.join(map(str, must)))}, " + ", ".join(f"'{x}'" for x in w[i : i + K]) + ")")
    return ",\n".join(out)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    names = ", ".join(f"w{j}" for j in range(K))
    rows = _template_rows(templates, "cast(array({}) as array<int>)")
    return spark.sql(f"SELECT tpl, label, tpos, n_grams, n_words AS t_words, must, xxhash64({names}) AS gram FROM VALUES {rows} AS t(tpl, label, tpos, n_grams, n_words, must, {names})")


def _with_words(docs: DataFrame) -> DataFrame:
    """docs with norm (words between single spaces, one more at either end) and words."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    line = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return docs.withColumn("line", line).withColumn("words", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(F.split("line", " ", -1)))


def _keyed(docs: DataFrame) -> DataFrame:
    # Rows that agree in doc_id and text share a key, and their hits are one set.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(d, h, label, first, end, cover) of each verified span, in words; d and h name the row by doc_id and text."""
    # The words are bound to a name, so that they are made once a row.
    grams = F.expr(f"transform(array(words), v -> case when size(v) >= {K} then transform(sequence(0, size(v) - {K}), i -> xxhash64({', '.join(f'v[i + {j}]' for j in range(K))})) end)[0]")
    rolled = _with_words(_keyed(docs)).select("d", "h", grams.alias("grams")).select("d", "h", F.posexplode("grams").alias("pos", "gram"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    of_template = [F.first(c).alias(c) for c in ("label", "n_grams", "t_words", "must")]
    votes = hits.groupBy("d", "h", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("at"), *of_template)
    by_row = Window.partitionBy("d", "h", "tpl").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_row) > GAP).cast("int"), F.lit(1))
    merged = votes.withColumn("new", new).withColumn("run", F.sum("new").over(by_row))
    spans = merged.groupBy("d", "h", "tpl", "run").agg(F.min("lo").alias("first"), (F.max("hi") + K).alias("end"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), *of_template)
    spans = spans.withColumn("cover", F.size("at") / F.col("n_grams"))
    decided = F.expr(f"forall(must, p -> exists(at, a -> a <= p and p < a + {K}))")
    spans = spans.where((F.col("cover") >= COVER) & (F.col("end") - F.col("first") <= STRETCH * F.col("t_words")) & decided)
    # Templates compete for the words that they share: of spans that overlap, that of the greatest cover stays.
    in_order = Window.partitionBy("d", "h").orderBy("first", "end", "tpl", "run")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    region = F.sum(F.coalesce((F.col("first") >= F.col("reach")).cast("int"), F.lit(1))).over(in_order)
    best = Window.partitionBy("d", "h", "region").orderBy(F.desc("cover"), F.desc("n_grams"), "tpl", "run")
    ranked = spans.withColumn("reach", reach).withColumn("region", region).withColumn("place", F.row_number().over(best))
    return ranked.where("place = 1").select("d", "h", "label", "first", "end", "cover")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs (doc_id, text).

    Base places are those where a phrase's words stand consecutively; first_word and last_word are null without
    one. The method's labels are those of verified spans; score is the best cover of a span, 1 with a base place,
    else 0. A null or wordless text has no words and no labels; repeated rows get equal rows; other columns are
    ignored; an empty table gives an empty result.
    """
    base = _with_words(_keyed(docs))
    every = []
    for label, phrase in BASE.items():
        w = phrase.split()
        same = " and ".join(f"v[i + {j}] = '{x}'" for j, x in enumerate(w))
        every.append(f"case when contains(norm, ' {phrase} ') then transform(array(words), v -> transform(filter(sequence(0, size(v) - {len(w)}), i -> {same}), i -> named_struct('i', i, 'label', '{label}')))[0] else cast(array() as array<struct<i:int,label:string>>) end")
    base = base.withColumn("norm", F.concat(F.lit(" "), "line", F.lit(" "))).select("doc_id", "d", "h", F.size("words").cast("long").alias("n_words"), F.expr(f"concat({', '.join(every)})").alias("places"))
    spans = license_spans(docs, templates).groupBy("d", "h").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    out = base.join(spans, ["d", "h"], "left")
    labels = F.expr("array_distinct(transform(places, p -> p.label))")
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.i))").cast("long").alias("first_word"),
        F.expr("array_max(transform(places, p -> p.i))").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)), 6).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _places_sql() -> str:
    return "\nUNION ALL\n".join(f"SELECT doc_id, i, '{label}' AS label FROM words WHERE " + " AND ".join(f"w{j} = '{x}'" for j, x in enumerate(p.split())) for label, p in BASE.items())


SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, i - 1 AS i, w0, {", ".join(f"lead(w0, {j}) OVER o AS w{j}" for j in range(1, 5))} FROM (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM docs) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t(tpl, label, tpos, n_grams, t_words, must, {", ".join(f"w{j}" for j in range(K))}) AS (VALUES {_template_rows(TEMPLATES, "CAST([{}] AS INTEGER[])")}),
places AS ({_places_sql()}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
rolled AS (SELECT doc_id, i AS pos, {", ".join(f"w{j}" for j in range(K))} FROM words WHERE w{K - 1} IS NOT NULL),
hits AS (SELECT doc_id, tpl, label, n_grams, t_words, must, pos, tpos, pos - tpos AS diagonal FROM rolled JOIN t USING ({", ".join(f"w{j}" for j in range(K))})),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {GAP} THEN 1 ELSE 0 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id, tpl ORDER BY diagonal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS run FROM marked),
found AS (SELECT doc_id, tpl, label, run, n_grams, any_value(t_words) AS t_words, any_value(must) AS must, list(DISTINCT tpos) AS spots, min(pos) AS first, max(pos) + {K} AS "end" FROM runs GROUP BY doc_id, tpl, label, n_grams, run),
fit AS (SELECT *, len(spots) / n_grams AS cover, max("end") OVER (PARTITION BY doc_id ORDER BY first, "end", tpl, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found
  WHERE len(spots) / n_grams >= {COVER} AND "end" - first <= {STRETCH} * t_words AND len(list_filter(must, lambda p: len(list_filter(spots, lambda a: a <= p AND p < a + {K})) = 0)) = 0),
regions AS (SELECT *, sum(CASE WHEN first < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY first, "end", tpl, run) AS region FROM fit),
spans AS (SELECT doc_id, label, cover FROM regions QUALIFY row_number() OVER (PARTITION BY doc_id, region ORDER BY cover DESC, n_grams DESC, tpl, run) = 1),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  round(greatest(coalesce(m.cover, 0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END), 6) AS score
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""
