"""Licence scans by diagonal voting: word k-grams joined to template positions, votes by offset diagonal, spans verified.

A template that occurs in a text leaves hits on one diagonal (text position less template position); words put in or left out
move the rest to a neighbouring one. The hashes of all k-grams of all texts are joined to the templates' positions; votes are
summed by diagonal, neighbouring diagonals merged, and the merged span is verified word by word and measured by the template
words that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_lookup
from .decontaminate import heads, normalised, with_key

#: Phrases (as words) and their labels.
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Labels and template texts: customary licence notices, and licences as a whole.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
                     "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def phrase_places(tokens: str) -> Column:
    """(pos, label) of each place where a phrase's words stand consecutively; texts without a phrase's first word aren't searched."""
    found = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"get({tokens}, i + {j}) = '{w}'" for j, w in enumerate(phrase))
        starts = f"IF(array_contains({tokens}, '{phrase[0]}'), filter(sequence(0, size({tokens}) - 1), i -> {same}), CAST(array() AS array<int>))"
        found.append(F.expr(f"transform({starts}, i -> struct(i AS pos, '{label}' AS label))"))
    return F.concat(*found)


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(template, label, of_template, size): the words of each template and the size of its windows: ``k``, or all its words."""
    rows = spark.createDataFrame([(n, label, text) for n, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.select("template", "label", normalised(F.col("text")).alias("of_template")).where(F.size("of_template") > 0)
    return rows.withColumn("size", F.least(F.size("of_template"), F.lit(k)))


def hit_places(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(key_id, key_text, template, pos, at): every window of every text (id, text) whose hash is that of a template's window."""
    found = None
    for size in sorted(r[0] for r in table.select("size").distinct().collect()):  # k values at most
        own = table.where(F.col("size") == size)
        at = F.transform(F.sequence(F.lit(0), F.size("of_template") - size), lambda i: F.xxhash64(*[F.get("of_template", i + j) for j in range(size)]))
        own = own.select("template", F.posexplode(at).alias("at", "gram")).groupBy("gram").agg(F.collect_list(F.struct("template", "at")).alias("places"))
        own = cut(own)
        places = docs.select(F.col("id").alias("key_id"), "text").withColumn("tokens", normalised(F.col("text")))
        places = places.select("key_id", F.xxhash64("text").alias("key_text"), F.posexplode(heads("tokens", size)).alias("pos", "gram"))
        met = join_lookup(places, own, "gram", own.count(), F.struct("key_id", "key_text", "pos"), "inner")
        met = met.select("key_id", "key_text", "pos", F.explode("places").alias("p")).select("key_id", "key_text", "p.template", "pos", "p.at")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.select(F.col("id").alias("key_id"), F.xxhash64("text").alias("key_text"), *[F.lit(0).alias(c) for c in ("template", "pos", "at")]).where(F.lit(False))
    return found.distinct()  # of repeated rows once


def merged_diagonals(hits: DataFrame, table: DataFrame, shift: int) -> DataFrame:
    """(key_id, key_text, template, label, of_template, size, cells) of each merged span; its cells are the voting (pos, at).

    Votes on one diagonal belong together; neighbouring diagonals merge if they are at most ``shift`` apart and the places in
    the text are at most a template's length apart.
    """
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("key_id", "key_text", "template", "diagonal").agg(
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_list(F.struct("pos", "at")).alias("cells"))
    votes = votes.join(F.broadcast(table.select("template", F.size("of_template").alias("length"))), "template")  # the templates
    by = Window.partitionBy("key_id", "key_text", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > shift) | (F.col("low") - F.lag("high").over(by) > F.col("length"))
    votes = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    spans = votes.groupBy("key_id", "key_text", "template", "span").agg(F.flatten(F.collect_list("cells")).alias("cells"))
    return spans.join(F.broadcast(table), "template").drop("span")


def verified(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(key_id, key_text, label, first_word, last_word, score) of spans with the cells whose words are the template's.

    The score is the share of the template's words that these cells cover.
    """
    packed = spans.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("label", "of_template", "size", "cells")).alias("spans"))
    packed = cut(packed.withColumn("weights", F.flatten("spans.cells")))  # for the size check
    rows = with_key(docs, packed, "id", "text", "inner").select("key_id", "key_text", normalised(F.col("text")).alias("tokens"), "spans")

    def check(s: Column) -> Column:
        same = F.filter(s["cells"], lambda c: F.slice(F.col("tokens"), c["pos"] + 1, s["size"]) == F.slice(s["of_template"], c["at"] + 1, s["size"]))
        covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda c: F.sequence(c["at"], c["at"] + s["size"] - 1)))))
        return F.struct(s["label"].alias("label"), F.array_min(F.transform(same, lambda c: c["pos"])).alias("first_word"),
                        (F.array_max(F.transform(same, lambda c: c["pos"])) + s["size"] - 1).alias("last_word"), (covered / F.size(s["of_template"])).alias("score"))

    return rows.select("key_id", "key_text", F.explode(F.transform("spans", check)).alias("s")).select("key_id", "key_text", "s.*").where("score > 0")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
                  k: int = 4, shift: int = 4, min_score: float = 0.75) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score, spans.

    Texts are ASCII lower-cased; words are runs of ASCII letters, digits and non-ASCII characters, numbered from 0.
    ``base_labels`` are those of the PHRASES found, ``n_base`` counts their places, ``first_word`` and ``last_word`` are the
    smallest and largest start of a place (null without any). ``labels`` adds those of templates of which a span covers at
    least ``min_score`` of the words; ``spans`` are these, and ``score`` is the largest score of any span (0 without any).

    ``templates`` are licence texts (label, text), some hundred at most: their windows are a lookup table. A template of fewer
    than ``k`` words is one window; one without words matches nothing. Null and empty texts have no words and no labels. The
    words of a text, very long ones included, are an array of one row. Spans of one label and place (ties) are given once.
    Repeated rows and ids are judged each by their own text. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = cut(template_table(docs.sparkSession, templates, k))
    hits = cut(hit_places(rows, table))
    found = verified(merged_diagonals(hits, table, shift), rows)
    good = F.when(F.col("score") >= min_score, F.struct("label", "first_word", "last_word", "score"))
    found = cut(found.groupBy("key_id", "key_text").agg(F.max("score").alias("score"), F.array_sort(F.collect_set(good)).alias("spans")))
    joined = with_key(rows, found, "id", "text", "left").withColumn("tokens", normalised(F.col("text")))
    joined = joined.select("id", F.size("tokens").cast("long").alias("n_words"), phrase_places("tokens").alias("places"), "score", "spans")
    starts = F.transform("places", lambda p: p["pos"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    spans = F.coalesce("spans", F.array().cast("array<struct<label:string,first_word:int,last_word:int,score:double>>"))
    return joined.select(
        "id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), base.alias("base_labels"), F.array_sort(F.array_union(base, F.transform(spans, lambda s: s["label"]))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"), spans.alias("spans"))
