"""Licence scans by diagonal voting; DataFrame functions alone.

The rolling K-word hashes of every text are matched with those of licence templates. A match of text
position p and template position q votes for the diagonal p - q. Diagonals of a text and template that
lie within BAND of each other, and whose matches follow closely, are merged into one span; a span
is verified on the words themselves (hash matches count only with equal words) and accepted if it
covers enough of the template: all of a notice under LONG words, where one word tells licences apart,
and COVER of a longer text. The base phrases are templates too, which must match in whole on one
diagonal; each such diagonal is a place of the phrase.

Defined cases: null text is empty; no words: no labels, score 0, null first_word and last_word.
Repeated rows are scanned each on its own, also with equal or null doc_id. Long texts are scanned
whole. Letters other than A-Z keep their case. Only doc_id and text are read: other columns, whatever their names,
play no part. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import cut, table

K, BAND, GAP, COVER, LONG = 3, 2, 8, 0.8, 12
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Openings, notices and bodies of well-known licences (public texts), as words, with the label of each.
TEMPLATES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
        "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution",
        "bsd",
    ),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def gram(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + i) for i in range(K)]


def template_grams(spark: SparkSession) -> DataFrame:
    """(template, label, base, length, q, h, g): every K-gram of the templates; a few hundred rows."""
    rows = [(f"b{i}", label, True, text) for i, (text, label) in enumerate(BASE.items())] + [(f"t{i}", label, False, text) for i, (text, label) in enumerate(TEMPLATES)]
    made = spark.createDataFrame(rows, "template string, label string, base boolean, text string").withColumn("words", F.split("text", " "))
    made = made.withColumn("length", F.size("words")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("length") - K)))
    return made.select("template", "label", "base", "length", "q", F.xxhash64(*gram(F.col("words"), F.col("q"))).alias("h"), F.concat_ws(" ", *gram(F.col("words"), F.col("q"))).alias("g"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with the columns of the contract."""
    spark = docs.sparkSession
    templates = template_grams(spark)  # a few hundred rows, from literals
    hashes = sorted({r["h"] for r in templates.select("h").collect()})
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), WORDS), "")
    x = docs.select("doc_id", words.alias("w"))
    rolled = F.transform("w", lambda _, i: F.struct(i.alias("p"), F.xxhash64(*gram(F.col("w"), i)).alias("h")))
    near = F.filter(rolled, lambda r: r["h"].isin(hashes))
    hits = F.transform(near, lambda r: F.struct(r["p"].alias("p"), r["h"].alias("h"), F.concat_ws(" ", *gram(F.col("w"), r["p"])).alias("g")))
    found = cut(x.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits")))
    votes = found.select("row", F.explode("hits").alias("x")).select("row", "x.*").join(F.broadcast(templates), ["h", "g"])
    votes = votes.groupBy("row", "template", "label", "base", "length", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs"))

    exact = votes.where(F.col("base") & (F.size("qs") == F.col("length") - K + 1))
    places = exact.groupBy("row").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"))

    by = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    far = (F.col("diagonal") - F.lag("diagonal").over(by) > BAND) | (F.greatest(F.col("first"), F.lag("first").over(by)) - F.least(F.col("last"), F.lag("last").over(by)) > GAP + K)
    merged = votes.where(~F.col("base")).withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("far").over(by))
    spans = merged.groupBy("row", "template", "label", "length", "span").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("qs", lambda q: F.sequence(q, q + K - 1))))).alias("parts"))
    spans = spans.withColumn("cover", F.size(F.array_distinct(F.flatten("parts"))) / F.col("length"))
    enough = F.when(F.col("length") >= LONG, F.lit(COVER)).otherwise(1.0)
    best = spans.groupBy("row").agg(F.max("cover").alias("cover"), F.collect_set(F.when(F.col("cover") >= enough, F.col("label"))).alias("own_set"))

    none = F.array().cast("array<string>")
    out = found.drop("hits").join(places, "row", "left").join(best, "row", "left")
    base, own = F.coalesce("base_set", none), F.coalesce("own_set", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
