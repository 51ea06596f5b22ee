"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations.

A template is the set of its words; a block is a window of a text's words. A block
contains a template if it has at least ``threshold`` of the template's words. Words
are ordered by how many documents have them, rarest first, so that

* prefix filter: such a block has one of the template's |T| - t + 1 rarest words (t: words needed),
* length filter: it has t words of the templates' vocabulary or more,
* positional filter: from the first shared prefix word on, both sides have enough words left,

and what remains is counted in full. No qualifying block is lost. Sets alone would take one
license for its neighbour, so a block must also have the words that set the template's
license apart and none that only another license has; a notice (a template of fewer than NOTICE words) must
have all its words, and they must stand in the text one after the other.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing, to count them.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Templates with fewer words are notices.
NOTICE = 12
#: Paragraphs and notices of public licenses: label, text, words that set it apart, words of its neighbours.
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
        "merge sublicense sell",
        "",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under"
        " the license",
        "apache",
        "",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
        "gnu general public",
        "lesser affero",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software"
        " foundation either version 2 1 of the license or at your option any later version",
        "gnu lesser",
        "",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version",
        "affero",
        "",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source"
        " code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution redistributions binary",
        "",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
        "fee purpose",
        "",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mozilla",
        "",
    ),
    # notices that differ from their neighbours by a word inside stand word for word
    ("lgpl", "gnu lesser general public license", "", ""),
    ("lgpl", "gnu library general public license", "", ""),
    ("agpl", "gnu affero general public license", "", ""),
    ("cc-by", "creative commons attribution 4 0 international", "", ""),
    ("cc-by", "creative commons attribution 3 0 unported", "", ""),
    ("cc-by", "creative commons attribution license", "", ""),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "", ""),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international", "", ""),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", "", ""),
    ("cc-by-sa", "creative commons attribution sharealike 3 0 unported", "", ""),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international", "", ""),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international", "", ""),
    ("cc-by", "licensed under cc by 4 0", "", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "", ""),
    ("cc-by-nd", "licensed under cc by nd 4 0", "", ""),
    ("cc-by-sa", "licensed under cc by sa 4 0", "", ""),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "", ""),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "", ""),
    ("bsd", "under the bsd license", "", ""),
    ("bsd", "2 clause bsd license", "", ""),
    ("bsd", "3 clause bsd license", "", ""),
    ("mpl", "mozilla public license", "", ""),
]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase among the words, from 0."""
    n, k = F.size(words), len(phrase)
    same = lambda i: [F.get(words, i + j) == w for j, w in enumerate(phrase)]

    def here(i: Column) -> Column:
        out = F.lit(True)
        for x in same(i):
            out = out & x
        return out

    return F.when(n >= k, F.filter(F.sequence(F.lit(0), n - k), here)).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str, str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` lists the qualifying blocks: (label, template, first_word, n_words,
    containment). score is the best containment, 1 where a base phrase stands. A window
    is twice a template's words, rounded up to a power of two, and windows overlap by
    half, so any place of a template lies in one. A null text is empty; whole texts count; repeated rows give
    repeated rows; an empty table gives none; other columns are not read. Templates
    are a parameter of bounded size: their vocabulary and prefix index go with the plan.
    """
    spark = docs.sparkSession
    split = [(label, *(re.findall(r"[a-z0-9]+", x.lower()) for x in rest)) for label, *rest in templates]
    vocabulary = sorted({w for _, *rest in split for words in rest for w in words})
    text = _lower(F.coalesce(F.col("text"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    # how many documents have each word of the vocabulary: one row a word
    spread = {r[0]: int(r[1]) for r in docs.select(F.explode(F.array_intersect(words, known)).alias("w")).groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (spread.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    index, sets = [], []
    for number, (label, ws, apart, never) in enumerate(split):
        members = sorted({rank[w] for w in ws})
        notice = len(ws) < NOTICE
        need = len(members) if notice else math.ceil(threshold * len(members) - 1e-9)
        width = 1 << max(1, 2 * len(ws) - 1).bit_length()
        sets.append((number, label, width, notice, members, [rank[w] for w in apart], [rank[w] for w in never]))
        index += [(width, r, number, at, need, len(members)) for at, r in enumerate(members[: len(members) - need + 1])]
    prefix = sorted({x[1] for x in index})
    widths = sorted({x[2] for x in sets})
    rare = [order[r - 1] for r in prefix]

    starts = {label: _places(F.col("_words"), phrase.split()) for phrase, label in phrases}
    all_starts = F.concat(*starts.values()) if starts else F.array().cast("array<int>")
    phrase_words = [phrase.split()[0] for phrase, _ in phrases]
    likely = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in [*rare, *phrase_words]]).cast("array<string>"))
    numbers = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair)) if rank else F.create_map().cast("map<string,int>")
    coded = lambda block: F.array_sort(F.transform(F.array_intersect(block, known), lambda w: numbers[w]))

    def windows(width: int) -> Column:
        half = width // 2
        firsts = F.sequence(F.lit(0), F.greatest(F.size("_words") - half, F.lit(1)) - 1, F.lit(half))
        cut = F.transform(firsts, lambda i: F.struct(F.lit(width).alias("width"), i.alias("first"), coded(F.slice("_words", i + 1, F.lit(width))).alias("ranks")))
        return F.filter(cut, lambda b: F.arrays_overlap(b["ranks"], F.array(*[F.lit(r) for r in prefix])))

    notices = [(number, " ".join(ws)) for number, (_, ws, _, _) in enumerate(split) if len(ws) < NOTICE]
    line = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    said = F.transform(F.array(line), lambda x: F.array_compact(F.array(*(F.when(x.contains(f" {phrase} "), F.lit(number)) for number, phrase in notices)).cast("array<int>")))[0]
    none = F.array().cast("array<struct<width:int,first:int,ranks:array<int>>>")
    held = docs.select("doc_id", words.alias("_words"))
    held = held.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.when(likely, F.array_sort(all_starts)).otherwise(F.array().cast("array<int>")).alias("_starts"),
        F.concat_ws(",", *[F.when(F.when(likely, F.size(at)).otherwise(0) > 0, F.lit(label)) for label, at in sorted(starts.items())]).alias("base_labels"),
        F.when(likely, F.concat(*map(windows, widths))).otherwise(none).alias("_blocks") if widths else none.alias("_blocks"),
        F.when(likely, said).otherwise(F.array().cast("array<int>")).alias("_said"),
    )
    held = settle(held.withColumn("_row", F.monotonically_increasing_id()))  # numbers, starts and coded windows; no texts

    listed = F.broadcast(spark.createDataFrame(index or [(0, 0, 0, 0, 0, 0)], "width int, word int, template int, at int, need int, n_template int"))
    members = F.broadcast(spark.createDataFrame(sets or [(-1, "", 0, False, [], [], [])], "template int, label string, width int, notice boolean, members array<int>, apart array<int>, never array<int>").drop("width"))
    pairs = (
        held.select("_row", "_said", F.explode("_blocks").alias("b")).select("_row", "_said", "b.width", "b.first", "b.ranks")
        .select("_row", "_said", "width", "first", "ranks", F.posexplode("ranks").alias("pos", "word"))
        .join(listed, ["width", "word"])  # prefix filter
        .where(F.size("ranks") >= F.col("need"))  # length filter
        # positional filter: nothing shared before the first shared prefix word, so this is the most that can be shared
        .withColumn("left", 1 + F.least(F.size("ranks") - F.col("pos") - 1, F.col("n_template") - F.col("at") - 1))
        .groupBy("_row", "width", "first", "template").agg(F.max_by(F.struct("left", "need", "n_template", "ranks", "_said"), "left").alias("x"))
        .where("x.left >= x.need")
        .join(members, "template")
        .withColumn("shared", F.size(F.array_intersect("x.ranks", "members")))
        .where(F.col("shared") >= F.col("x.need"))
        .where((F.size(F.array_except("apart", "x.ranks")) == 0) & ~F.arrays_overlap("x.ranks", "never") & (~F.col("notice") | F.array_contains("x._said", F.col("template"))))
        .select("_row", F.struct("label", "template", F.col("first").alias("first_word"), F.col("width").alias("n_words"), (F.col("shared") / F.col("x.n_template")).alias("containment")).alias("block"))
    )
    hits = pairs.groupBy("_row").agg(F.array_sort(F.collect_list("block")).alias("blocks"))  # windows of one text
    scanned = held.where(F.size("_blocks") > 0).join(hits, "_row", "left")
    rest = held.where(F.size("_blocks") == 0).withColumn("blocks", F.lit(None).cast(hits.schema["blocks"].dataType))
    out = scanned.select(*rest.columns).unionByName(rest)
    blocks = F.coalesce("blocks", F.array().cast(hits.schema["blocks"].dataType))
    labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.transform(blocks, lambda b: b["label"]))))
    return out.select(
        "doc_id", "n_words",
        F.size("_starts").cast("long").alias("n_base"),
        F.when(F.size("_starts") > 0, F.array_min("_starts")).cast("long").alias("first_word"),
        F.when(F.size("_starts") > 0, F.array_max("_starts")).cast("long").alias("last_word"),
        "base_labels",
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0))).alias("score"),
        blocks.alias("blocks"),
    )
