"""A small corpus of awkward rows, and the given one, for brute-force comparisons."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, size string, _row long, `rank` int, score string"


def awkward() -> list[tuple]:
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    long = prose(6000)
    base = prose(200)
    near = base.replace("alpha", "omega", 2)
    texts = [
        None, "", " ", "\n\n", "one", "one two", "ÀÉ Ünïcode ß 中文 words", base, base, near, base + " tail", long, long + " end",
        "x" * 5000, "#" * 300, "12345 678", "a|b|c\na|b|c\n\na|b|c\nsame line\nsame line",
        " ".join(["again and again"] * 40),
        "Released under the MIT License. Then the mit\nlicense; Apache-License and General Public License.",
        "mit license mit license", "license mit", "Licensed under the Apache License, Version 2.0.",
        "this work is licensed under the gnu general public licence version 3 of it",
        "mail a.b@c.de and +1 (132) 555-1352 at 233.254.104.120 card 4539 1488 0343 6467 or 2390409500648960",
        "é 999.1.1.1 then 1.2.3.4.5.6.7.8 a@b a@b.c_x@d.org ..@x.y.z. +1-2 +123456789012345678 0004.3.2.001",
        "4539-1488-0343-6467 4539148803436467 45391488034364670000000000 1 2 3", "+49 30 1234567) +49(30)1234567--", "@@@ a@b.c@d.e",
        "\u2028sep\u00a0nbsp\x1ffs\x85nel", "İstanbul ÅNGSTRÖM a\u030a <|endoftext|> 's 't don't",
    ]
    langs, sources = ["en", "de", None, "fr"], ["b", "a", None, "c"]
    rows = [(i, t, langs[i % 4], sources[(i // 2) % 4], None, 1, "s", 7, 2, "x") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, "en", "a", 1, 1, "s", 7, 2, "x"), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def given(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
