"""License scans by a positional rare-token index, in DataFrame and SQL functions only.

Templates are notices and whole licence headers as word sequences, each with a mandatory key phrase. Of every text only the licence
words are kept, with their positions. A text's licence words are ranked by inverse document frequency, counted over all texts, and each
template whose key words the text all holds is looked up by the rarest of them: a hit places the template's start, the postings of
its other words are intersected at their relative positions, and a place counts when the whole key phrase stands there; its share is that of
the template's words that stand in place. As every place holds the word that is looked up, none is missed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Words that the headers below pass over, as common prose is full of them.
COMMON = frozenset("0 2 3 v a an and any are as at be by can for has have if in is it may not of on one or see so that the this to use was will with you".split())


def passing(text: str) -> str:
    """A header with * for each common word outside of its key phrase, every word of which counts."""
    before, phrase, after = re.split(r"[\[\]]", text)
    passed = lambda part: " ".join("*" if w in COMMON else w for w in part.split())
    return f"{passed(before)} [{phrase}] {passed(after)}".strip()


#: Fixed values: (label, template, whether it is a base phrase). The key phrase stands in brackets, * is any word.
TEMPLATES = [
    ("cc-by", "[cc by]", True),
    ("gpl", "[general public license]", True),
    ("reserved", "[all rights reserved]", True),
    ("agpl", "gnu [affero general public license] version", False),
    ("apache", "licensed under * [apache license] version", False),
    ("bsd", "released under * [bsd license]", False),
    ("cc-by-nc", "licensed under [cc by nc]", False),
    ("cc-by-nd", "licensed under [cc by nd]", False),
    ("cc-by-sa", "licensed under [cc by sa]", False),
    ("gpl", "work * licensed under * [gnu general public license] version", False),
    ("lgpl", "gnu [lesser general public license] version", False),
    ("mit", "released under * [mit license]", False),
    ("public-domain", "released * * [public domain]", False),
    ("mit", passing("[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"), False),
    ("isc", passing("permission to use copy modify and or distribute this software for any purpose with or [without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies"), False),
    ("bsd", passing("[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"), False),
    ("apache", passing("licensed under the apache license version 2 0 the license you may not use this [file except in compliance with the license] you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"), False),
    ("gpl", passing("this program is free software you can [redistribute it and or modify it under the terms of the gnu general public license] as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"), False),
    ("lgpl", passing("this library is free software you can [redistribute it and or modify it under the terms of the gnu lesser general public license] as published by the free software foundation either version 3 of the license or at your option any later version"), False),
    ("agpl", passing("this program is free software you can [redistribute it and or modify it under the terms of the gnu affero general public license] as published by the free software foundation either version 3 of the license or at your option any later version"), False),
    ("mpl", passing("this source code form is [subject to the terms of the mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"), False),
    ("unlicense", passing("this is [free and unencumbered software] released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"), False),
    ("cc0", passing("to the extent possible under law the author has [dedicated all copyright and related and neighboring rights] to this software to the public domain worldwide this software is distributed without any warranty"), False),
]
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def postings(templates: list[tuple[str, str, bool]] = TEMPLATES) -> list[tuple[int, str, bool, str, int, bool]]:
    """(template, label, base, word, position from the key phrase's start, mandatory) of every word of every template."""
    out = []
    for k, (label, text, base) in enumerate(templates):
        words = text.split()
        first = next(i for i, w in enumerate(words) if w[0] == "[")
        last = next(i for i, w in enumerate(words) if w[-1] == "]")
        out += [(k, label, base, w.strip("[]"), i - first, first <= i <= last) for i, w in enumerate(words) if w != "*"]
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Places of ``templates`` in ``docs`` (doc_id, text), and the documents.

    Returns (uid, template, label, base, start, share) with the key phrase's first word from 0 and the share of the template's words
    that stand in place, and (uid, doc_id, n_words). uid numbers the rows, so repeated and null ids stay apart; a null text has
    no words; places of several templates may overlap and all count; an empty table gives empty results; other columns are ignored. Of words of equal
    rarity the lesser is looked up, which changes no place. A text of any length is one row of its licence words.

    Common words belong to key phrases only, where a rarer licence word stands within two words of each: elsewhere they are not kept.
    """
    spark = docs.sparkSession
    posts = postings(templates)
    listed = lambda words: ", ".join(f"'{w}'" for w in sorted(words)) or "''"
    rare, common = listed({p[3] for p in posts} - COMMON), listed({p[3] for p in posts} & COMMON)
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), SEPARATORS)
    held = docs.select("doc_id", F.array_remove(words, "").alias("w"))
    near = f"exists(slice(w, greatest(i - 2, 1), 5), x -> x IN ({rare}))"
    at = f"filter(sequence(1, size(w)), i -> element_at(w, i) IN ({rare}) OR (element_at(w, i) IN ({common}) AND {near}))"
    rows = held.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"CASE WHEN size(w) = 0 THEN array() ELSE transform({at}, i -> struct(element_at(w, i) AS word, CAST(i - 1 AS BIGINT) AS at)) END").alias("hits"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "licence-words")

    hits = rows.select("uid", F.explode("hits").alias("h")).select("uid", "h.word", "h.at")
    index = spark.createDataFrame(posts, "template int, label string, base boolean, word string, pos int, mandatory boolean")
    own = rows.select("uid", F.explode(F.expr("array_distinct(hits.word)")).alias("word"))
    texts = own.groupBy("word").agg(F.count("*").alias("texts"))  # a row to a licence word
    key = index.where("mandatory")
    needed = key.groupBy("template").agg(F.count_distinct("word").alias("needed"))
    # each text's words in the order of their rarity; a template is looked up if none of its key words is lacking
    ranked = own.join(F.broadcast(texts), "word").join(F.broadcast(key.groupBy("template", "word").agg(F.min("pos").alias("pos"))), "word")
    lookups = ranked.groupBy("uid", "template").agg(F.count("*").alias("held"), F.min(F.struct("texts", "word", "pos")).alias("r")).join(F.broadcast(needed), "template").where("held = needed")
    candidates = hits.join(lookups.select("uid", "template", "r.word", "r.pos"), ["uid", "word"]).select("uid", "template", (F.col("at") - F.col("pos")).alias("start"))
    expected = candidates.join(F.broadcast(index), "template").withColumn("at", F.col("start") + F.col("pos"))
    found = expected.join(hits.withColumn("here", F.lit(1)), ["uid", "at", "word"], "left")
    places = found.groupBy("uid", "template", "label", "base", "start").agg(F.avg(F.coalesce("here", F.lit(0))).alias("share"), F.min(F.when(F.col("mandatory"), F.coalesce("here", F.lit(0)))).alias("whole"))
    return places.where("whole = 1").drop("whole"), rows.select("uid", "doc_id", "n_words")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, docs = scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    sums = places.groupBy("uid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("share").alias("score"),
    )
    zero, none = F.lit(0), F.lit("")
    return docs.join(sums, "uid", "left").select("doc_id", "n_words", F.coalesce("n_base", zero.cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", zero.cast("double")).alias("score"))


#: The key phrases of TEMPLATES in their order, written out for the SQL below, which looks for each as it stands.
PHRASES = [
    "cc by",
    "general public license",
    "all rights reserved",
    "affero general public license",
    "apache license",
    "bsd license",
    "cc by nc",
    "cc by nd",
    "cc by sa",
    "gnu general public license",
    "lesser general public license",
    "mit license",
    "public domain",
    "permission is hereby granted free of charge",
    "without fee is hereby granted",
    "redistribution and use in source and binary forms",
    "file except in compliance with the license",
    "redistribute it and or modify it under the terms of the gnu general public license",
    "redistribute it and or modify it under the terms of the gnu lesser general public license",
    "redistribute it and or modify it under the terms of the gnu affero general public license",
    "subject to the terms of the mozilla public license",
    "free and unencumbered software",
    "dedicated all copyright and related and neighboring rights",
]

ORACLE = f"""
WITH phrase(template, said) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(PHRASES))}),
post(template, label, base, word, pos, mandatory) AS (VALUES {", ".join(f"({k}, '{a}', {b}, '{w}', {p}, {m})" for k, a, b, w, p, m in postings())}),
d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM d),
k AS (SELECT * FROM h WHERE word IN (SELECT word FROM post)),
c AS (SELECT uid, template, place AS start FROM k JOIN post USING (word) JOIN phrase USING (template) JOIN d USING (uid) WHERE pos = 0 AND array_to_string(w[place + 1:place + len(string_split(said, ' '))], ' ') = said),
m AS (SELECT c.uid, c.template, c.start, any_value(label) AS label, any_value(base) AS base, avg(CASE WHEN k.uid IS NULL THEN 0.0 ELSE 1.0 END) AS share
    FROM c JOIN post USING (template) LEFT JOIN k ON k.uid = c.uid AND k.place = c.start + post.pos AND k.word = post.word GROUP BY c.uid, c.template, c.start),
s AS (SELECT uid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (uid)
"""
