"""Operators over sites and directories: quality and licences."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.llm import licenses, quality

GOOD, BAD = "plain words that say something new in every line of it", "BUY!!! BUY!!! BUY!!!"


def test_quality(spark: SparkSession) -> None:
    dice = random.Random(0)
    rows = []
    for k in range(900):
        # Host b is mostly bad; mixed texts leave the decision to the site.
        host = "ab"[k % 2]
        good = dice.random() < (0.9 if host == "a" else 0.1)
        rows.append((k, "the same text" if k % 3 else GOOD if good else BAD, "en", host, int(good)))
    rows += [(2000, "the same text", "en", "a", None), (2001, "the same text", "en", "b", None), (2002, "the same text", "xx", "a", None), (2003, None, None, None, None), (None, "", "en", "new", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    labels = df.where("quality is not null").select("doc_id", "quality")
    got = {r.doc_id: r for r in quality.scores(df.withColumn("score", F.lit(9)), labels).collect()}
    assert len(got) == len(rows)
    assert got[2000].score > 0.7 > 0.3 > got[2001].score
    assert abs(got[2002].score - got[2000].score) < 0.1  # a path without labels has its host's share
    assert all(0 < r.score < 1 for r in got.values())
    assert {r.score for r in quality.scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(df.limit(0), labels).count() == 0


def test_statistics_are_of_whole_texts() -> None:
    assert quality.statistics("") == quality.statistics(" ")
    assert quality.statistics(GOOD + " x" * 500) != quality.statistics(GOOD)


def test_licences(spark: SparkSession) -> None:
    rows = [
        (1, "src/a/x.py", "code\nReleased under the MIT License.\nmore"), (2, "src/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "src/a/b/c/y.py", "nothing here"), (4, "src/z.py", "no licence of its own"),
        (5, "COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, None, None), (7, "src/a/b/w.py", ""), (8, "q.py", "A licensed driver"), (8, "q.py", "A licensed driver"),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id long, file string, text string, license string")
    got = {r.doc_id: r for r in licenses.licences(df, F.col("file")).collect()}
    assert {i: (r.own_license, r.license, r.inherited_from) for i, r in got.items()} == {
        1: ("MIT", "MIT", None), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "src/a"), 4: (None, "GPL-3.0", ""), 5: ("GPL-3.0", "GPL-3.0", None), 6: (None, None, None), 7: (None, "Apache-2.0", "src/a"), 8: (None, "GPL-3.0", ""),
    }
    assert licenses.licences(df, F.col("file")).count() == len(rows)
    assert licenses.licences(df.limit(0), F.col("file")).count() == 0


def test_cosine_by_definition() -> None:
    idf = dict.fromkeys(licenses.VOCABULARY, 2.0) | {"": 3.0}
    x, y = licenses.weights("under the MIT License today", idf), licenses.weights(licenses.TEMPLATES["MIT"], idf)
    dot = sum(x.get(t, 0) * y.get(t, 0) for t in set(x) | set(y))
    assert licenses.cosine(x, y) == pytest.approx(dot / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values())))


def test_real_headers_and_texts() -> None:
    idf = dict.fromkeys(licenses.VOCABULARY, 4.0) | dict.fromkeys("the of and to a in is for this or you that it with".split(), 1.5) | {"": 4.0}
    match = licenses.Matcher(idf)
    code = "\nimport os\n\n\ndef walk(path):\n    return os.listdir(path)\n"
    full = {n: t for tier, n, t in licenses.ALL if tier == 3}
    cases = [
        ("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("# SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL"), ("A licensed driver reads the general terms", None), ("SPDX-License-Identifier: Zlib", None),
        ("// Copyright 2019 The Authors\n//\n" + "\n".join("// " + x for x in licenses.HEADERS["Apache-2.0"].split("\n")), "Apache-2.0"),
        ("/*\n * Copyright (C) 2011 Jane Doe\n *\n" + "\n".join(" * " + x for x in licenses.HEADERS["GPL-3.0"].split("\n")) + "\n */", "GPL-3.0"),
        ("# Copyright (c) 2015, Jane Doe. All rights reserved.\n" + "\n".join("# " + x for x in licenses.HEADERS["BSD-3-Clause"].split("\n")), "BSD-3-Clause"),
        ("Copyright (c) 2015 Jane Doe\n\n" + licenses.HEADERS["MIT"], "MIT"),
    ]
    for text, name in cases:
        assert match(text + code)[0] == name, text
    for name, text in full.items():
        assert match(text)[0] == match("Third-party notices\n\n" + text + code)[0] == name
