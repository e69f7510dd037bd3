"""Mixing, quality, secrets, fingerprints, licences and the pipeline: edge cases, brute force and held-out accuracy."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sitewright.llm import imatch, licenses, mixing, packing, probminhash, quality, secrets
from sitewright.llm.queries import QUERIES, trainable

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, size int, spans int, target string"
ROWS = [(1, "a b c", "x", 9, 9, "t"), (2, None, "y", 9, 9, None), (3, "", None, 9, 9, "t"), (4, "d " * 500, "x", 9, 9, "t"), (4, "d " * 500, "x", 9, 9, "t"), (5, "e f", "y", 9, 9, "t"), (6, " \t\n", "z", 9, 9, "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOC)


def test_mixing_edges(spark, odd):
    got = mixing.assign(odd).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got) and {r.size for r in got if r.doc_id == 4} == {500}
    assert sum(t for t in {(r.source_size, r.target): r.target for r in got}.values()) <= 1.5 * sum(r.size for r in got) + 1e-6
    assert mixing.assign(spark.createDataFrame([], DOC)).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    got = mixing.assign(docs).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)


def test_schedule_is_inverted(spark):
    points = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (1.0, 2.0))])
    got = spark.range(1).select(*[mixing.schedule_position(F.lit(s), points) for s in (0.0, 0.25, 1.0)]).first()
    assert np.allclose(got, [0, 0.5, 1])


def test_curriculum_is_in_order(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "late").otherwise("even").alias("source"))
    got = mixing.curriculum(docs, ("doc_id", "source"), schedules={"late": [(0.0, 0.0), (1.0, 1.0)]}).collect()
    at = [r.position for r in got]
    assert at == sorted(at) and np.mean([r.position for r in got if r.source == "late"]) > np.mean([r.position for r in got if r.source == "even"]) + 0.1


def test_op5_places_copies_by_schedules_that_differ(spark):
    points = mixing.SCHEDULES
    got = QUERIES["op5_mixing"](spark, SMALL).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    of = lambda r: [p for p in (r.position, r.position_again) if p is not None]
    firsts = [of(r)[0] for r in got if of(r)]
    assert firsts == sorted(firsts) and all(r.taken == r.size * len(of(r)) for r in got)
    assert len(firsts) == len(got) or not any(of(r) for r in got[len(firsts) :])
    for n, name in enumerate(sorted({s for s in source.values() if s is not None})):
        t, w = np.array(points[n % len(points)]).T
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])

        def met(x):
            i = min(max(int(np.searchsorted(t, x, "right")) - 1, 0), len(t) - 2)
            d = x - t[i]
            return (area[i] + w[i] * d + (w[i + 1] - w[i]) / (t[i + 1] - t[i]) * d * d / 2) / area[-1]

        copies = sorted((p, r.size, r.target) for r in got if source[r.doc_id] == name for p in of(r))
        before = 0
        for p, size, target in copies:
            assert abs(met(p) - (before + size / 2) / target) < 1e-6
            before += size


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op7_quality"](spark, folder).filter("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert np.mean([g >= 0.3 for g in good]) > 0.95 and trainable(labels).count() < labels.count()


def test_quality_edges(spark, odd):
    network, _ = quality.learn(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    got = quality.score(odd, network).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(spark.createDataFrame([], DOC), network).count() == 0


def test_secrets_against_brute_force(spark):
    texts = ["password = hunter22x API_KEY:'abc' token=abcdef", "AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 3, "", None, "secret : aé", "plain words only here", "PASSWD=\"x.y/z+q=\" " + "f" * 23]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        base = []
        for kind, pattern, group, least in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
            base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind != "grammar"] == sorted(base, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_secrets_in_one_run_with_others_are_scored():
    scanner = secrets.trained()
    key, forge = "wJalrXUtnFEMIK7MDENGbPxRfiCYq9EXzMPL3KeY", "ghp_" + "a8Kd02LmQzX7vbN4tRwY1uEoPs93GhJc5TfV"
    access, hexes = "AKIA" + "Z7Q2" * 4, hashlib.sha256(b"x").hexdigest()
    for text, want in ((f"//{access}.{forge}", forge), (f"//{access}/{key}", key), (f"{hexes}/{forge}", forge), (f"docs/of/words/{forge}/more", forge), (f"a.name={forge}", forge)):
        spans = secrets.spans_of(text, scanner)
        found = [text[a:b] for a, b, k, *_ in spans if k == "grammar"]
        assert any(want in f for f in found), (text, found)  # a run that is likely as a whole is one span
        for a, b, k, *_ in spans:  # what the plain patterns find is scored too, and stays
            if k != "grammar":
                assert any(x <= a and b <= y for x, y, kind, *_ in spans if kind == "grammar"), (text, spans)


def test_grammar_spans_against_brute_force(spark):
    """Every stretch between every two borders of a run, by a scan that knows nothing of the pointer over base spans."""
    scanner = secrets.trained()
    rng = random.Random(4)
    parts = [v for vs in secrets.example_credentials(rows=3, seed=5).values() for v in vs] + ["word", "another/word", "x=1", "key.of.things", "0123"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "/", "=", ".", ", token = ", "\n"]) for _ in range(12)) for _ in range(40)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner).collect()}

    def parts_of(text, a, b, marks="=/."):
        if b - a < secrets.LEAST:
            return set()
        if secrets.Scanner(scanner.grammars, scanner.background).likely(text[a:b]):
            return {(a, b)}
        if a < b and text[a] in "=/.":
            return parts_of(text, a + 1, b, marks)
        if a < b and text[b - 1] in "=/.":
            return parts_of(text, a, b - 1, marks)
        for n, mark in enumerate(marks):
            if mark in text[a:b]:
                cuts = [a - 1, *(i for i in range(a, b) if text[i] == mark), b]
                return set().union(*(parts_of(text, x + 1, y, marks[n + 1 :]) for x, y in zip(cuts, cuts[1:])))
        return set()

    for n, text in enumerate(texts):
        base = [(s.start, s.end) for s in got[n].spans if s.kind != "grammar"]
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", text):
            inside = [(max(a, m.start()), min(b, m.end())) for a, b in base if a < m.end() and m.start() < b]
            covered = {i for a, b in inside for i in range(a, b)}
            free = "".join(" " if i in covered else "x" for i in range(m.start(), m.end()))
            left = [(m.start() + f.start(), m.start() + f.end()) for f in re.finditer("x+", free)] if inside else []
            for a, b in [(m.start(), m.end()), *inside, *left]:
                want |= parts_of(text, a, b)
        assert {(s.start, s.end) for s in got[n].spans if s.kind == "grammar"} == want, text
        assert all((s.format is not None and s.gain > 0) == (s.kind == "grammar") for s in got[n].spans)


def test_secrets_edges(spark, odd):
    got = secrets.scan(odd)
    assert got.count() == len(ROWS)
    assert secrets.scan(spark.createDataFrame([], DOC)).count() == 0
    clashing = spark.createDataFrame([(1, "token = abcdef", "x", 3)] * 2 + [(None, "AKIA" + "Q7" * 8, "y", 4)], "doc_id long, text string, spans string, n_hex int")
    rows = secrets.scan(clashing).collect()
    assert sorted((r.n_assign, r.n_access) for r in rows) == [(0, 1), (1, 0), (1, 0)]


def test_ordinary_tokens_are_bounded_and_free_of_secrets(spark):
    docs = spark.createDataFrame([(i, f"ordinary{i}words token = secretvalue{i} " * 3) for i in range(50)], "doc_id long, text string")
    got = secrets.ordinary_tokens(docs, documents=20, tokens=15)
    assert len(got) == 15 == len(set(got)) and all(t.startswith("ordinary") for t in got) and got == secrets.ordinary_tokens(docs, documents=20, tokens=15)


def test_grammars_know_formats():
    scanner = secrets.trained()
    fresh = secrets.example_credentials(rows=100, seed=99)
    assert all(np.mean([scanner.likely(s) is not None for s in v]) > 0.8 for v in fresh.values())
    assert np.mean([scanner.likely(w) is not None for w in secrets.ordinary_words(500, seed=98) if len(w) >= 16]) < 0.05


def test_fingerprints(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(12))) for i in range(30)] + [(30, None), (31, ""), (32, "w1 w2 w3"), (33, "w1 w2 w3")]
    got = imatch.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"), low=0.01, high=0.9).orderBy("doc_id").collect()
    texts = [t or "" for _, t in rows]
    for n, r in enumerate(got):
        text, after = texts[n], texts[(n + 1) % len(texts)]
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest() and r.n_chars == len(text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[32].fingerprint == got[33].fingerprint and got[32].near_next == 1
    assert imatch.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "the"]
    texts = [" ".join(rng.choices(words, weights=[1] * 401 + [400], k=rng.choice((3, 60, 4000)))) + rng.choice((".", "!", "")) for _ in range(40)]
    rows = [*enumerate(texts), (7, texts[7]), (50, None), (51, ""), (52, texts[3]), (None, "w1 w2 w3"), (60, "é" * 9)]
    got = imatch.compare_with_edits(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, next int, own string"), low=0.05, high=0.8).collect()
    assert len(got) == len(rows)
    terms = lambda t: sorted({signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split(r"[^\w]+|_", t.lower()) if w})
    df = Counter(w for _, t in rows for w in terms(t or ""))
    lexicon = {w for w, n in df.items() if n >= 2 and 0.05 <= n / len(rows) <= 0.8}
    assert 300 < len(lexicon) < len(df)

    def hashed(inside):
        h = 42
        for w in inside:
            h = xxhash.xxh64(struct.pack("<q", w), seed=h).intdigest()
        return f"{h >> 32:08x}" if inside else None

    def brute(t):
        known, out, at = [w for w in terms(t) if w in lexicon], [], 0
        for power, number in imatch.SUBSETS:
            out += [hashed([w for w in known if (w >> at) % (1 << power) == k]) for k in range(number)]
            at += power
        return out

    def near(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = brute(text), brute(edited), brute(after)
        shown = lambda p: "-".join(x or "." for x in p)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), near(a, b), near(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_next_crosses_ranges(spark):
    rows = [(i * 3 % 101, f"t{i}") for i in range(101)] + [(None, "z"), (None, "y")]
    got = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), buckets=17).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {(r.doc_id, r.text): (r.next.doc_id, r.next.text) for r in got} == dict(zip(order, order[1:] + order[:1]))


def test_licenses(spark, odd):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied."
    texts = [mit, "Licensed under the MIT License.", "no licence here", None, ""]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "", 3: "", 4: ""}
    assert licenses.scan(odd).count() == len(ROWS)


GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSDNAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSDASIS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES; LOSS OF USE, DATA, OR PROFITS.'
PUBLISHED = [
    ("MIT", MIT + '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.'),
    ("MIT-part", MIT),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.'),
    ("BSD-3-Clause", BSD2 + "\n" + BSDNAME + "\n" + BSDASIS),
    ("BSD-2-Clause", BSD2 + "\n" + BSDASIS),
    ("BSD-part", BSD2.split("\n\n2.")[0]),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.'),
    ("GPL-or-later", GNU.format("program", "", 2) + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."),
    ("GPL-or-later", GNU.format("program", "", 3).replace("software;", "software:").replace("Foundation;", "Foundation,")),
    ("LGPL", GNU.format("library", "Lesser ", "2.1")),
    ("LGPL", "Released under the GNU Library General Public License v2."),
    ("AGPL", GNU.format("program", "Affero ", 3).replace("software;", "software:").replace("Foundation;", "Foundation,")),
    ("AGPL", "Licensed under the GNU Affero General Public License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Released under the GNU General Public License v2 only."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("BSD", "Distributed under the 3-Clause BSD License."),
    ("CC-BY-NC-SA", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "shared under a Creative Commons Attribution-ShareAlike 4.0 deed"),
    ("CC-BY-ND", "This content is shared under the Creative Commons Attribution-NoDerivs 3.0 deed."),
    ("CC-BY", "This work is released under Creative Commons Attribution 4.0."),
    ("public-domain", "Released under CC0 1.0."),
    ("public-domain", "This work is dedicated to the public domain."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("SPDX-tag", "SPDX-License-Identifier: Zlib"),
    ("all-rights-reserved", "Copyright (c) 2020 Someone. All rights reserved."),
]


PUBLISHED += [
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0."),
]
#: Notices with any subject, of one version, and titles.
NOTICES = [
    ("Apache-2.0", "This package is licensed under the Apache License, Version 2.0."), ("MIT", "Foo is licensed under the MIT license."), ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"),
    ("GPL-3.0", "Licensed under GPL-3.0."), ("CC-BY-SA", "All content is available under CC BY-SA 4.0."), ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "Bar is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("GPL-or-later", "Baz is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-or-later", "The tools are released under the GNU GPL version 3 or any later version."), ("LGPL", "Our parser is distributed under the LGPL v2.1."), ("AGPL", "The server is available under AGPL-3.0."),
    ("EPL", "Eclipse Public License - v 2.0"), ("MPL-2.0", "The code is covered by the Mozilla Public License 2.0."), ("ISC", "It is published under the ISC license."), ("Zlib", "The library is released under the zlib license."),
    ("BSD", "All sources are available under a BSD license."), ("CC-BY-NC", "Photos are shared under CC BY-NC 3.0."), ("public-domain", "The maps are placed in the public domain."),
    ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce."),
    ("", "She was licensed under oath."), ("", "The bridge is available under heavy rain."), ("", "Provided by the city council."), ("", "The licence plate was released by accident."),
]


def test_notices_of_any_subject(spark):
    texts = [t for _, text in NOTICES for t in (text, f"Some words before.\n{text}\nAnd after.")]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.licenses, texts[r.doc_id]) for r in got if r.licenses != NOTICES[r.doc_id // 2][0]] == []


def test_every_rule_finds_its_published_notice_wrapped_or_not(spark):
    assert {name for name, _ in PUBLISHED} == {name for name, _ in licenses.RULES}
    narrow = lambda t: t if t.startswith("SPDX") else re.sub(r"(?<!\n)[ ]+(?!\n)", "\n", t)  # noqa: E731  (a tag is one line)
    marked = lambda t: "\n".join("# " + line for line in narrow(t).split("\n"))
    texts = [t for _, text in PUBLISHED for t in (text, narrow(text), marked(text) if "\n" not in text else text)]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.licenses, texts[r.doc_id]) for r in got if r.licenses != PUBLISHED[r.doc_id // 3][0]] == []


VERBATIM = " Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The licenses for most software are designed to take away your freedom."
FSF = "\n\n Copyright (C) {} Free Software Foundation, Inc.{}\n"
HEADS = [
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007" + FSF.format(2007, " <https://fsf.org/>") + VERBATIM),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991" + FSF.format("1989, 1991", ",") + VERBATIM),
    ("LGPL", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999" + FSF.format("1991, 1999", "") + VERBATIM),
    ("AGPL", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007" + FSF.format(2007, "") + VERBATIM),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions."),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n"),
    ("CC-BY-SA", "Attribution-ShareAlike 4.0 International\n\n=======================================================================\n\nCreative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n"),
    ("CC-BY", "Creative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights"),
    ("public-domain", "CC0 1.0 Universal\n\nStatement of Purpose\n"),
]


def test_full_texts_are_known_by_their_heads_and_the_sql_agrees(spark):
    import duckdb

    texts = [(n, t) for n, (_, t) in enumerate(HEADS + PUBLISHED)] + [(900, None), (901, ""), (902, "plain"), (902, "plain")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = licenses.scan(docs).collect()
    assert {HEADS[r.doc_id][0]: r.licenses for r in got if r.doc_id < len(HEADS)} == {name: name for name, _ in HEADS}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    sql = con.execute(licenses.duckdb_sql()).fetchall()
    assert sorted(map(tuple, got)) == sorted(sql)
    assert licenses.scan(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000 + "\nReleased under the MIT License.\n" + "x. " * 100_000)], "doc_id int, text string")
    assert licenses.scan(long).first().licenses == "MIT"


def test_marks_outside_notices_still_end_sentences(spark):
    texts = ["Licensed under the MIT License; you can redistribute it.", "See section v. All rights reserved.", "All rights reserved; Licensed under CC BY-NC 4.0."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == ["MIT", "all-rights-reserved", "CC-BY-NC,all-rights-reserved"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    kept = corpus_pipeline.good_documents(spark, docs, SMALL)
    alone = corpus_pipeline.distinct_documents(spark, kept, SMALL)
    assert alone.columns == docs.columns and alone.join(kept, "doc_id", "left_anti").count() == 0
    last = corpus_pipeline.run(spark, SMALL)
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0 and last.count() > 0


STAGE_DOC = "doc_id long, text string, lang string, source string, n_chars long, position double, bucket long, rep long, root string, key string, part int, score double, pii string, piece int, item long, place string, at int"
EXTRA = (0.5, 1, 2, "r", "k", 3, 0.1, "p", 4, 5, "q", 6)
STAGE_ROWS = [
    (1, "Call +1 202 555 0143 or write to a.b@example.org today. " * 3, "en", "web", 100), (2, None, None, None, None), (3, "", "en", "web", 0), (4, "word " * 30_000, "en", "web", 150_000),
    (5, "the same text in several rows of one table and more words", "de", "books", 55), (5, "the same text in several rows of one table and more words", "de", "books", 55),
    (6, "the same text in several rows of one table and more words", "de", None, 55), (7, "\x00퟿\t\n", "en", "web", 4), (None, "a text without an id at all, with words", "en", "books", 39),
]


@pytest.mark.parametrize("number", range(5))
def test_each_stage_takes_odd_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in STAGE_ROWS], STAGE_DOC)
    if name != "packing":  # there ``position`` is the order
        docs = docs.withColumn("position", F.lit("no number"))
    got = stage(spark, docs, SMALL)
    rows, empty = got.collect(), stage(spark, docs.limit(0), SMALL)
    assert empty.count() == 0 and empty.columns == got.columns
    if name in ("quality", "near_duplicates", "pii"):
        assert got.columns == list(corpus_pipeline.COLUMNS)
    texts = [r[1] for r in STAGE_ROWS]
    if name == "quality":
        assert all(r.text in texts for r in rows)
    if name == "near_duplicates":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 7), (True, 0)]
    if name == "pii":
        assert len(rows) == len(STAGE_ROWS) and not any("a.b@example.org" in (r.text or "") for r in rows) and {r.text for r in rows if r.doc_id == 2} == {None}
    if name == "mixing":
        assert [r.position for r in rows] == sorted(r.position for r in rows) and not any(r.doc_id in (2, 3) for r in rows)
    if name == "packing":
        pieces = sum(-(-len(packing.token_ids(t, public_tokenizers.path("byte_bpe_50k.tiktoken"))) // 1024) for t in texts)
        fill = Counter()
        for r in rows:
            fill[r.sequence_id] += r.length
        assert len(rows) == pieces and max(fill.values()) <= 1024


def test_pipeline_rows_follow_from_its_stages(spark):
    """Each stage against what it is defined by, on what the one before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SMALL).cache())
    good, distinct, hidden, mixed, packed = kept[1:]
    network, _ = quality.learn(docs, trainable(spark.read.parquet(f"{SMALL}/labels.parquet")))
    scores = {r.doc_id: float(network.score(quality.features(r.text)[None].astype(float))[0]) for r in docs.collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.3}
    texts = {r.doc_id: r.text for r in good.collect()}
    sets = {d: probminhash.shingles(t) for d, t in texts.items()}
    left = {r.doc_id for r in distinct.collect()}
    alike = lambda a, b: probminhash.probability_jaccard(sets[a], sets[b]) >= 0.8
    assert all(any(alike(d, e) for e in sets if e != d) for d in sets if d not in left)
    assert not any(alike(a, b) for a in left for b in left if a < b)
    assert {r.doc_id for r in hidden.collect()} == left
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in hidden.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {d for d, n in sizes.items() if n}
    taken = {r.doc_id: r.taken for r in mixing.assign(hidden, schedules=mixing.SCHEDULES).collect()}
    assert {d: n * sizes[d] for d, n in copies.items()} == {d: t for d, t in taken.items() if t}
    places, first = {}, {}
    for r in packed.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        first[r.sequence_id] = min(r.position, first.get(r.sequence_id, 2.0))
    for at in places.values():
        ends = 0
        for offset, length in sorted(at):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert sum(1 for _ in first) >= -(-sum(n for at in places.values() for _, n in at) // 1024)


def test_grammars_learn_the_corpus_own_credentials(spark):
    rng = random.Random(4)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    secret = lambda: "zq7-" + of("BCDFGHJKLMNP", 5) + "-" + of("0123456789", 9) + "-" + of("xyzvw", 6)
    words = "the quick river ran over stones and every house kept a garden near the water-side path".split()
    lines = [f"{' '.join(rng.sample(words, 8))} token = {secret()} {'-'.join(rng.sample(words, 3))}" for _ in range(120)]
    bare, uuid = secret(), "3f2b8c1e-9a47-4d2c-8f10-5b6e7a8c9d01"
    lines += [f"left here: {bare} and nothing else", f"request {uuid} was answered", "well-known-garden-path of the water-side"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    corpus = secrets.corpus_credentials(docs)
    assert len(corpus["assigned"]) == 120 and bare not in corpus["assigned"] and len(secrets.corpus_credentials(docs, most=7)["assigned"]) == 7
    got = {r.doc_id: r for r in secrets.scan(docs).filter("doc_id >= 120").collect()}
    assert [t for t, s in zip(got[120].found, got[120].spans, strict=True) if s.kind == "grammar"] == [bare] and got[120].spans[0].format == "assigned"
    assert got[121].n_grammar == got[122].n_grammar == 0
    # without what the corpus has taught, the bare one is lost
    assert bare not in {r.doc_id: r for r in secrets.scan(docs, secrets.trained(ordinary=secrets.ordinary_tokens(docs))).collect()}[120].found
    rates = secrets.held_out_rates(corpus, secrets.ordinary_tokens(docs))
    assert rates["assigned"] > 0.9 and rates["ordinary"] < 0.1


def test_ordinary_pairs_are_counted_over_all_texts(spark):
    texts = ["ordinary-words token = secretvalue1 " * 3, None, "", "AKIA" + "Q7" * 8 + "/touched plain.words/abc", "lib/of.things " + "0123456789abcdef" * 2 + "=tail-of-it", "untouched " * 70]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[5])], "doc_id long, text string")
    want = {}
    for text in [*texts, texts[0], texts[5]]:
        spans = secrets.base_spans(text or "")
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", text or ""):
            if not any(a < m.end() and m.start() < b for a, b, _ in spans):
                symbols = "^" + secrets.classed(m[0]) + "$"
                for pair in zip(symbols, symbols[1:]):
                    want[pair] = want.get(pair, 0) + 1
    taught = secrets.lessons(docs.repartition(3))
    assert want and secrets.ordinary_pairs(taught) == want
    assert secrets.confirmed(taught) == secrets.corpus_credentials(docs) and secrets.confirmed(taught)["assigned"] == ["secretvalue1"]
    many = secrets.background([], {k: n * 10**9 for k, n in want.items()} | {("^", "~"): 1})
    assert many.steps["^", "~"] == many.other  # seen once among very many: as likely as what was never seen
    assert secrets.ordinary_pairs(secrets.lessons(docs.limit(0))) == {}


def test_quality_learns_from_all_documents(spark):
    """A first fit sees 40 documents; means, prior and the last steps are those of all, as a plain computation has them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    labels = trainable(spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = quality.feature_rows(docs.repartition(5))
    x = np.stack([quality.features(t) for t in texts]).astype(np.float64)
    assert np.allclose(quality.summed(rows, quality.WIDTH, lambda x: x.sum(0)), x.sum(0))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    xp = np.stack([quality.features(r.text) for r in docs.collect() if r.doc_id in good])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    start = quality.fit(xp, x[:40], 0.5, mean, scale, epochs=2)

    def negative(network, prior=0.5):
        return np.logaddexp(0, network.margin(x)).mean() - prior * np.logaddexp(0, network.margin(xp)).mean()

    def risk(network, prior=0.5):
        return prior * np.logaddexp(0, -network.margin(xp)).mean() + max(0.0, negative(network, prior))

    after = [quality.refined(start, rows, len(x), xp, 0.5, rounds=n) for n in (0, 1, 6)]
    assert negative(start) > 0
    assert risk(after[0]) == risk(start) and risk(after[2]) < risk(after[1]) < risk(start)
    # one small step moves every weight against the sign of the numerical gradient of the risk over all rows
    eps = 1e-5
    for at in ((0, 0), (60, 5), (115, 20)):
        up, down = (quality.Network(mean, scale, start.w1.copy(), start.b1, start.w2, start.b2) for _ in range(2))
        up.w1[at] += eps
        down.w1[at] -= eps
        slope = (risk(up) - risk(down)) / (2 * eps) + 1e-4 * start.w1[at]
        moved = after[1].w1[at] - start.w1[at]
        assert abs(slope) < 1e-6 or np.sign(moved) == -np.sign(slope)
    # where the negative part is under nothing, a step raises it
    assert negative(start, 0.99) < 0 and negative(quality.refined(start, rows, len(x), xp, 0.99, rounds=1), 0.99) > negative(start, 0.99)
    network, prior = quality.learn(docs, labels, start_rows=40, rounds=4)
    assert 0.5 < prior < 0.99 and np.allclose(network.mean, mean) and np.allclose(network.scale, scale, atol=1e-5)
    assert np.mean(network.score(xp.astype(np.float64)) >= 0.3) > 0.97


def test_quality_without_trusted_documents(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    network, prior = quality.learn(odd, none)
    assert prior == 0.95 and {round(r.score, 6) for r in quality.score(odd, network).collect()} == {round(1 / (1 + np.exp(-3)), 6)}
    network, _ = quality.learn(spark.createDataFrame([], DOC), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score(odd, network).count() == len(ROWS)
