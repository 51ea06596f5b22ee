"""URL filters, license scans and PII against plain versions."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadentia.llm import entry, licenses, pii, urls
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_url(url):
    host = path = ""
    if url is not None and "://" in url:
        after = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host):])[0]
        host = host.translate(LOWER)
    best = None
    for verdict, h, p in entry.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > best[0]):
            best = len(h + p), h + p, verdict
    return host, path, best[1] if best else None, best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.NET/x", "http://www.example.net/en/", "http://www.example.net/en", "http://www.example.net/en/a?b#c",
    "http://example.com/de/x", "http://xexample.com/de/x", "http://org/fr/", "http://a.org/fr/1", "http://a.org/de", "http://a.b.c.net?x", "http://net#f", "a://b://c.net/d", "http://.net/", "http://net:80/",
    "http://x/" + "y/" * 3000, "http://a..net/", "http://É.net/é", "http://line\nbreak.net/\nx",
]


def test_urls(spark, sf_dir):
    found = [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    rows = [(i, u, "<p>", "h", "p") for i, u in enumerate([*URLS, *found, *URLS[:8]])] + [(None, "http://a.net/", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    out = urls.filter_urls(pages, urls.rules_table(spark, entry.URL_RULES))
    assert Counter(map(tuple, out.collect())) == Counter((r[0], *plain_url(r[1])) for r in rows)
    assert urls.filter_urls(pages.limit(0), urls.rules_table(spark, entry.URL_RULES)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in urls.filter_urls(pages, none, "block").collect()} == {"block"}


def plain_license(text):
    words = re.findall(licenses.WORD, (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    every, best = set(labels), 1.0 if starts else 0.0
    for label, template, apart, never in licenses.TEMPLATES:
        ws = template.split()
        members = set(ws)
        width = 1 << max(1, 2 * len(ws) - 1).bit_length()
        notice = len(ws) < licenses.NOTICE
        if notice and not any(words[i : i + len(ws)] == ws for i in range(len(words))):
            continue
        for first in range(0, max(1, len(words) - width // 2), width // 2):
            seen = set(words[first : first + width])
            share = len(members & seen) / len(members)
            if share >= (1 if notice else 0.8) and seen >= set(apart.split()) and not seen & set(never.split()):
                every.add(label)
                best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), round(best, 9)


def test_licenses(spark, sf_dir):
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = docs.select("doc_id", "text").collect()
        out = licenses.scan(docs).drop("blocks").collect()
        assert Counter((*r[:7], round(r.score, 9)) for r in out) == Counter((r.doc_id, *plain_license(r.text)) for r in rows)
    assert licenses.scan(cases.frame(spark, [])).count() == 0


#: Labels written by hand, from what the texts say.
SAID = [
    ("released under the BSD license", "bsd"),
    ("the report was released by them under no license at all", ""),
    ("MIT students released the report under a license of their own", ""),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Released under the MIT License.", "mit"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licenced under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("a work under creative direction, in common with others, of international attribution: no license", ""),
    ("the software is provided without charge to any person, and permission to copy the files is granted", ""),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: be kind.",
        "mit",
    ),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"
        " either version 2.1 of the License, or (at your option) any later version.",
        "gpl,lgpl",  # gpl by the base phrase
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this"
        " list of conditions and the following disclaimer in the documentation provided with the distribution.",
        "bsd",
    ),
    *[
        (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
            labels,
        )
        for kind, version, labels in (("", "3", "gpl"), ("", "2", "gpl"), ("Affero ", "3", "agpl,gpl"), ("Lesser ", "3", "gpl,lgpl"))
    ],
    ("Elle a pris sa valise. This work is licensed under a Creative Commons Attribution 4.0 International License. Elle a pris sa valise.", "cc-by"),
    ("Und nd und nc: licensed under CC BY 4.0, sa maison", "cc-by"),
    ("the work is licensed under a creative commons license with attribution and is an international 4 0 thing", ""),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa"),
    ("under the terms of the GNU Library General Public License, version 2", "gpl,lgpl"),
    ("a library of lesser known works by the general public", ""),
]


def test_license_labels_by_hand(spark):
    docs = spark.createDataFrame([(i, text, 1, "x") for i, (text, _) in enumerate(SAID)], "doc_id long, text string, _row int, blocks string")
    out = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert [(text, out[i]) for i, (text, _) in enumerate(SAID)] == SAID


def test_no_license_is_taken_for_its_neighbour(spark):
    """Each template alone, and between foreign words, has its own label and, but for base phrases, no other."""
    base = lambda text: {label for phrase, label in licenses.PHRASES if phrase in text}
    rows = [(2 * i + j, around + text + around) for i, (_, text, _, _) in enumerate(licenses.TEMPLATES) for j, around in enumerate(("", " sa nc nd maison haus "))]
    out = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        label = licenses.TEMPLATES[i // 2][0]
        longer = {other for other, t, _, _ in licenses.TEMPLATES if f" {t} " in f" {text} "}
        assert out[i] == {label} | longer | base(text), text


def plain_spans(text):
    text = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits(x))))) % 10 == 0

    found = []
    for k, (kind, pattern, fits) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(x)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    ]):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if fits(m[0])]
    return sorted(found)


def test_pii_base_spans(spark, sf_dir):
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = docs.select("doc_id", "text").collect()
        out = pii.digest(pii.find(docs, ["doc_id"])).collect()

        def wanted(r):
            spans = plain_spans(r.text)
            shown = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
            return (r.doc_id, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest())

        assert Counter(tuple(r[:6]) for r in out) == Counter(map(wanted, rows))
        listed = {r.doc_id: [x for x in r.spans.split(",") if x and not x.startswith("term")] for r in out}
        assert all(listed[r.doc_id] == [f"{kind}:{s}:{e}" for s, _, e, kind in plain_spans(r.text)] for r in rows if r.doc_id is not None)
    assert pii.find(cases.frame(spark, []), ["doc_id"]).count() == 0


def test_pii_is_linear_in_matches(spark):
    """80,000 addresses in one text, within a time that a square of them would pass by far."""
    text = " ".join(f"u{i}@ex{i % 7}.org" for i in range(80_000))
    begin = time.monotonic()
    (r,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], text=True).collect()
    assert time.monotonic() - begin < 90
    assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(r"\S+", text)]
    assert r.sanitised == " ".join(["[EMAIL]"] * 80_000)


def test_running_and_below(spark):
    values = [(i * 7919) % 1000 for i in range(1500)]
    df = spark.createDataFrame([(values, values[::3]), ([], []), ([5], [5])], "v array<int>, m array<int>")
    v, m = F.col("v"), F.col("m")
    for r in df.select("v", "m", pii.running(v).alias("s"), pii.running(v, lambda a, x: F.greatest(a, x)).alias("g"), pii.below(m, v, False).alias("b"), pii.below(m, v, True).alias("e")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.g == [max(r.v[:i], default=0) for i in range(len(r.v))]
        assert r.b == [sum(x < y for x in r.v) for y in r.m] and r.e == [sum(x <= y for x in r.v) for y in r.m]


@pytest.mark.parametrize("size", [20_000])
def test_pii_is_linear_on_hostile_texts(spark, size):
    texts = ["a" * size, "1" * size, "1-" * size, "a." * size, "+1" * size, "a@" * size, "a@b." + "c." * size, "1.2.3." * size]
    rows = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    out = pii.digest(pii.find(cases.frame(spark, rows), ["doc_id"])).collect()
    assert len(out) == len(texts)


def test_pii_disclosing_terms(spark):
    filler = "the weather here was fine and nobody said much about anything at all today".split()
    rows = []
    for i in range(400):
        words = [filler[(i * i + j * j + i * j // 7) % len(filler)] for j in range(60)]
        if i % 40 == 0:
            words[30:30] = ["Quillon", "met", "anna@example.org", "near"]
        rows.append((i, " ".join(words), *[None] * 8))
    docs = cases.frame(spark, rows)
    out = {r.doc_id: r for r in pii.find(docs, ["doc_id"], text=True).collect()}
    hit = out[40]
    text = rows[40][1]
    assert {text[s.start : s.end] for s in hit.spans if s.kind == 4} == {"Quillon", "met", "near"}
    assert "Quillon" not in hit.sanitised and "[EMAIL]" in hit.sanitised and pii.REMOVED in hit.sanitised
    assert out[41].sanitised == rows[41][1] and not out[41].spans


def test_pii_masks_overlaps(spark):
    text = "x +233.254.104.120 y"  # a phone and, within, an ip
    out = pii.find(cases.frame(spark, [(1, text, *[None] * 8), (2, None, *[None] * 8)]), ["doc_id"], text=True).collect()
    by = {r.doc_id: r for r in out}
    assert by[2].sanitised is None
    assert by[1].sanitised == "x [PHONE] y" and len(by[1].spans) == 2
