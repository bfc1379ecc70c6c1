"""License scans by diagonal voting, in DataFrame functions.

Method: every k words of a text (a rolling gram; three words, or two for templates of fewer than three) are joined by their hash with the
grams of all templates, and the words compared. A match votes for the diagonal place minus template offset. Votes are
summed by document, template and diagonal; neighbouring diagonals (up to `DRIFT` apart) are merged to spans, which allows for
words put in or left out. A span is verified against its template: at least `SHARE` of the template's grams must stand in it, each offset counted once
whatever it repeats, and it may be at most `STRETCH` times as long. A phrase stands where a single diagonal has all its offsets.

Labels: the base phrases give base_labels; NOTICES, license notices of one or more sentences, give further ones. score is the largest share of a
template's grams in any accepted place or span, 0 without one.

Scale: one scan, a join with a broadcast table of fixed size, and one shuffle of the votes, combined before it; a text's votes are bounded by
its own length and templates.

Cases: null and empty texts have no words; every input row gives a row: equal ones (of one id and text) are scanned as one and given back as often as they
come, null ids like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, table

#: phrase: label
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label: notices, for labels beside those of the phrases
NOTICES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl": ("subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, DRIFT, SHARE, STRETCH = 3, 2, 0.8, 1.5


def templates() -> list[tuple[int, str, bool, int, int, int, str, str, str]]:
    """template, label, base, words of a gram, number of grams, offset and the three words (the third empty in grams of two)."""
    out = []
    for t, (words, label, base) in enumerate([(p, x, True) for p, x in PHRASES.items()] + [(n, x, False) for x, notices in NOTICES.items() for n in notices]):
        w = words.split()
        k = min(K, len(w))
        out.extend((t, label, base, k, len(w) - k + 1, i, w[i], w[i + 1], w[i + 2] if k == K else "") for i in range(len(w) - k + 1))
    return out


def _grams(spark: SparkSession) -> DataFrame:
    text = ";".join(",".join(map(str, (t, label, int(base), k, n, i, a, b, c))) for t, label, base, k, n, i, a, b, c in templates())
    row = F.split(F.col("r"), ",")
    kinds = {"template": "int", "label": "string", "base": "boolean", "k": "int", "grams": "int", "at": "int", "a": "string", "b": "string", "c": "string"}
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("r")).select(*[row[i].cast(kind).alias(name) for i, (name, kind) in enumerate(kinds.items())])
    mark = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("k"), F.lit(0).alias("grams"), F.lit(0).alias("at"), *[F.lit("").alias(x) for x in "abc"], F.lit(0).cast("long").alias("h"))
    return rows.withColumn("h", F.when(F.col("k") == K, F.xxhash64("a", "b", "c")).otherwise(F.xxhash64("a", "b"))).unionByName(mark)


def votes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct row one of template -1, whose `copies` tells how many are equal, and one for each of its diagonals: distinct offsets and first and last place."""
    split = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(doc_id).alias("doc_id"), F.concat(F.array(F.lit("")), split).alias("one"))
    rows = rows.select("row", "doc_id", "one", F.size("one").alias("n")).select("row", "doc_id", "n", "one", F.slice("one", F.lit(2), F.col("n")).alias("two"), F.slice("one", F.lit(3), F.col("n")).alias("three"))
    # place 0 is a mark that keeps rows without any match
    each = rows.select("row", "doc_id", "n", F.posexplode(F.arrays_zip("one", "two", "three")).alias("place", "w")).select("row", "doc_id", "n", "place", "w.*")
    hashes = F.when(F.col("place") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(F.xxhash64("one", "two"), F.xxhash64("one", "two", "three")))
    each = each.select("row", "doc_id", "n", "place", "one", "two", "three", F.explode(hashes).alias("h"))
    same = (F.col("template") == -1) == (F.col("place") == 0)
    words = (F.col("a") == F.col("one")) & (F.col("b") == F.col("two")) & ((F.col("k") < K) | (F.col("c") == F.col("three")))
    hit = each.join(F.broadcast(_grams(docs.sparkSession)), "h").where(same & ((F.col("template") == -1) | words))
    hit = hit.select("row", "doc_id", "n", "template", "label", "base", "k", "grams", "at", (F.col("place") - 1 - F.col("at")).alias("diagonal"), (F.col("place") - 1).alias("place"))
    return hit.groupBy("row", "doc_id", "template", "label", "base", "k", "grams", "diagonal").agg(
        F.max("n").alias("n"), F.count("*").alias("copies"), F.collect_set("at").alias("offsets"), F.min("place").alias("first"), F.max("place").alias("last")
    )


def scanned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    v = votes(docs, doc_id=doc_id, text=text)
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT, F.lit(True))
    span = v.withColumn("new", new).withColumn("span", F.sum(F.col("new").cast("int")).over(w))
    of = Window.partitionBy("row", "template", "span")
    held = F.size(F.array_distinct(F.flatten(F.collect_list("offsets").over(of))))
    span = span.withColumn("held", held).withColumn("size", F.max("last").over(of) - F.min("first").over(of) + F.col("k"))
    place = F.col("base") & (F.size("offsets") == F.col("grams"))
    good = ~F.col("base") & (F.col("template") >= 0) & (F.col("held") >= SHARE * F.col("grams")) & (F.col("size") <= STRETCH * (F.col("grams") + F.col("k") - 1))
    share = F.when(place, F.lit(1.0)).when(good, F.least(F.lit(1.0), F.col("held") / F.col("grams"))).otherwise(F.lit(0.0))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = span.groupBy("row", "doc_id").agg(
        (F.max("n") - 1).cast("long").alias("n_words"), F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        join(F.when(place, F.col("label"))).alias("base_labels"), join(F.when(place | good, F.col("label"))).alias("labels"), F.round(F.max(share), 6).alias("score"), F.max(F.when(F.col("template") == -1, F.col("copies"))).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("row", "copy", "copies")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({t}, '{label}', {base}, {k}, {n}, {i}, '{a}', '{b}', '{c}')" for t, label, base, k, n, i, a, b, c in templates())
SQL = rf"""
WITH t(template, label, base, k, grams, pos, a, b, c) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
p AS (SELECT doc_id, unnest(w) a, unnest(w[2:]) b, unnest(w[3:]) c, unnest(generate_series(0, len(w) - 1)) place FROM d WHERE len(w) > 0),
h AS (SELECT doc_id, template, label, base, k, grams, place, pos FROM p JOIN t USING (a, b, c) WHERE k = {K} UNION ALL SELECT doc_id, template, label, base, k, grams, place, pos FROM p JOIN t USING (a, b) WHERE k < {K}),
v AS (SELECT doc_id, template, label, base, k, grams, place - pos diagonal, list(pos) offsets, count(*) votes, min(place) f, max(place) l FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER w > {DRIFT}, TRUE) THEN 1 ELSE 0 END new FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) span FROM n),
x AS (SELECT doc_id, template, span, len(list_distinct(flatten(list(offsets)))) held, max(l) - min(f) + max(k) size FROM s GROUP BY ALL),
g AS (SELECT *, base AND votes = grams place, NOT base AND held >= {SHARE} * grams AND size <= {STRETCH} * (grams + k - 1) good FROM s JOIN x USING (doc_id, template, span)),
r AS (SELECT doc_id, count(*) FILTER (WHERE place) n_base, min(diagonal) FILTER (WHERE place) f, max(diagonal) FILTER (WHERE place) l,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR good) al,
      max(CASE WHEN place THEN 1.0 WHEN good THEN least(1.0, held / grams) ELSE 0.0 END) score FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(f AS BIGINT) first_word, CAST(l AS BIGINT) last_word,
       coalesce(bl, '') base_labels, coalesce(al, '') labels, CAST(round(coalesce(score, 0), 6) AS DOUBLE) score
FROM d LEFT JOIN r USING (doc_id)
"""
