"""License scans by diagonal voting, in DataFrame operations only.

Every k consecutive words of a text are hashed and joined with the places of the
same words in license templates. A hit at word p of a text and word q of a
template votes for the diagonal p - q; votes of neighbouring diagonals (words put
in or left out) are merged, and a span is a license where enough of its template
is covered within a length like the template's own.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import table

K = 3
#: Words that may be put in or left out between two neighbouring diagonals.
SLACK = 2
#: The share of a template's k-grams that a span must cover, and its greatest length in template lengths.
MIN_COVER, MAX_STRETCH = 0.6, 1.5

#: The phrases of the contract, with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Openings and notices of public licenses, with the labels of this method.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    # whole licenses
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
        "and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
        "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution this software is "
        "provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
        "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose "
        "including commercial applications and to alter it and redistribute it freely subject to the following restrictions the "
        "origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software "
        "and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under "
        "the license",
    ),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows alike whose results are made in one place.
COPIES = 1000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows(phrases=BASE_PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(template, label, base, n_grams, n_words, place, words) of every k-gram of every template, and one mark."""
    rows = [(-1, "", False, 1, 1, -1, "")]
    for t, (label, text, base) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in templates]):
        words = text.split()
        n = len(words) - K + 1
        if n < 1:
            raise ValueError(f"a template needs {K} words: {text}")
        rows += [(t, label, base, n, len(words), i, " ".join(words[i : i + K])) for i in range(n)]
    return rows


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "'" + v + "'" if isinstance(v, str) else str(v).lower()
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    names = "template, label, base, n_grams, template_words, place, words"
    found = spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t({names})")
    parts = F.split("words", " ")
    mark = F.xxhash64(F.lit("mark"))
    return found.withColumn("hash", F.when(F.col("place") < 0, mark).otherwise(F.xxhash64(*[parts[j] for j in range(K)])))


def text_words(text: str = "text") -> Column:
    """Words of a text (null: none): letters, digits and other non-ASCII characters, A-Z as a-z."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Template k-grams found on each diagonal of each text; every text also has one row of template -1."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_words().alias("w"))
    rows = rows.withColumn("n_words", F.size("w"))
    at = F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - K, F.lit(-1))))
    rows = rows.select("doc_id", "text_hash", "n_words", "w", at.alias("p"))
    gram = [F.get("w", F.col("p") + j) for j in range(K)]
    hashed = F.when(F.col("p") < 0, F.xxhash64(F.lit("mark"))).otherwise(F.xxhash64(*gram))
    # The templates are a fixed list of some hundred rows.
    hits = rows.withColumn("hash", hashed).join(F.broadcast(templates), "hash")
    hits = hits.where((F.col("p") < 0) == (F.col("place") < 0))
    hits = hits.where((F.col("p") < 0) | (F.concat_ws(" ", *gram) == F.col("words")))
    hits = hits.select(
        "doc_id", "text_hash", "n_words", "template", "label", "base", "n_grams", "template_words", "place", "p"
    )
    text = ["doc_id", "text_hash", "n_words"]
    # Votes and marks are summed where they are found: rows of one id and text, such as empty ones without an id, come as one a task.
    return (
        hits.withColumn("diagonal", F.col("p") - F.col("place"))
        .groupBy(*text, "template", "label", "base", "n_grams", "template_words", "diagonal")
        .agg(F.collect_set("place").alias("places"), F.min("p").alias("low"), (F.max("p") + K).alias("high"), F.count("*").alias("votes"))
    )


def license_spans(voted: DataFrame) -> DataFrame:
    """Spans of texts that are verified as a template: neighbouring diagonals merged, and enough of it covered."""
    text = ["doc_id", "text_hash", "n_words", "template", "label", "base", "n_grams", "template_words"]
    order = Window.partitionBy(*text).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True)).cast("int")
    merged = voted.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order))
    spans = merged.groupBy(*text, "group").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min("low").alias("start"),
        F.max("high").alias("end"),
    )
    cover = F.size("places") / F.col("n_grams")
    return spans.withColumn("cover", cover).where(
        (F.col("cover") >= MIN_COVER) & (F.col("end") - F.col("start") <= MAX_STRETCH * F.col("template_words"))
    )


def scan(docs: DataFrame, phrases=BASE_PHRASES, templates=TEMPLATES) -> DataFrame:
    """Licenses of every whole text.

    doc_id, n_words, n_base (all places of base phrases), first_word and last_word
    (their least and greatest start; null without one), base_labels and labels
    (sorted, distinct, joined by commas; labels has those of verified spans too)
    and score (the best cover of a verified span; 1 for a base phrase; else 0).
    A null text is empty and has no words. Repeated rows give a result each; null ids are kept. An empty table gives no rows. Other
    columns are ignored.
    """
    # Three branches below read the votes, some rows a text: they are made once.
    voted = votes(docs, template_table(docs.sparkSession, template_rows(phrases, templates)))
    voted = voted.persist(StorageLevel.MEMORY_AND_DISK)
    text = ["doc_id", "text_hash", "n_words"]
    # A phrase stands wherever one diagonal has all of its k-grams; there it starts at the diagonal's own number.
    places = voted.where("base and size(places) = n_grams").select(
        *text, "label", "diagonal", F.lit(1.0).alias("cover"), F.lit(0).cast("long").alias("rows")
    )
    spans = license_spans(voted.where("template >= 0")).select(
        *text, "label", F.lit(None).cast("int").alias("diagonal"), "cover", F.lit(0).cast("long").alias("rows")
    )
    marks = voted.where("template < 0").select(
        *text, F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("diagonal"), F.lit(0.0).alias("cover"), F.col("votes").alias("rows")
    )
    base = F.when(F.col("diagonal").isNotNull(), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        marks.unionByName(places)
        .unionByName(spans)
        .groupBy(*text)
        .agg(
            F.count("diagonal").alias("n_base"),
            F.min("diagonal").cast("long").alias("first_word"),
            F.max("diagonal").cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined("label").alias("labels"),
            F.max("cover").alias("score"),
            F.sum("rows").alias("rows"),
        )
        # A result for each row, dealt out where very many rows are alike.
        .withColumn("part", F.explode(F.expr(f"sequence(0L, (rows - 1) div {COPIES})")))
        .repartition("doc_id", "text_hash", "part")
        .withColumn("row", F.explode(F.expr(f"sequence(1L, least(rows - part * {COPIES}, {COPIES}L))")))
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            "n_base",
            "first_word",
            "last_word",
            "base_labels",
            "labels",
            "score",
        )
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents by the base phrases and the templates: see ``scan``."""
    return scan(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH templates(template, label, base, n_grams, template_words, place, words) AS (VALUES {_values(template_rows())}),
texts AS (
  SELECT doc_id, coalesce(text, '') AS text, count(*) AS n FROM documents GROUP BY ALL
),
split AS (
  SELECT doc_id, text, n, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{UPPER.lower()}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM texts
),
grams AS (
  SELECT doc_id, text, unnest(range(0, len(w) - {K - 1})) AS p, w FROM split
),
hits AS (
  SELECT g.doc_id, g.text, t.*, CAST(g.p AS BIGINT) AS p
  FROM grams g JOIN templates t ON t.place >= 0 AND t.words = g.w[g.p + 1] || ' ' || g.w[g.p + 2] || ' ' || g.w[g.p + 3]
),
voted AS (
  SELECT doc_id, text, template, label, base, n_grams, template_words, p - place AS diagonal,
         list(DISTINCT place) AS places, min(p) AS low, max(p) + {K} AS high
  FROM hits GROUP BY ALL
),
apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) <= {SLACK}
                 THEN 0 ELSE 1 END AS apart
  FROM voted
),
grouped AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) AS grp FROM apart
),
spans AS (
  SELECT doc_id, text, label, len(list_distinct(flatten(list(places)))) / any_value(n_grams)::DOUBLE AS cover,
         max(high) - min(low) AS size, any_value(template_words) AS template_words
  FROM grouped GROUP BY doc_id, text, template, label, grp
),
found AS (
  SELECT doc_id, text, label, diagonal, 1.0 AS cover FROM voted WHERE base AND len(places) = n_grams
  UNION ALL
  SELECT doc_id, text, label, NULL, cover FROM spans WHERE cover >= {MIN_COVER} AND size <= {MAX_STRETCH} * template_words
),
summed AS (
  SELECT doc_id, text, count(diagonal) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
         list_sort(list(DISTINCT label) FILTER (diagonal IS NOT NULL)) AS base_labels,
         list_sort(list(DISTINCT label)) AS labels, max(cover) AS score
  FROM found GROUP BY doc_id, text
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(f.n_base, 0) AS BIGINT) AS n_base,
       CAST(f.first_word AS BIGINT) AS first_word, CAST(f.last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(f.base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(f.labels, ','), '') AS labels,
       CAST(coalesce(f.score, 0) AS DOUBLE) AS score
FROM (SELECT *, unnest(range(n)) FROM split) s LEFT JOIN summed f ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.text = f.text
"""
