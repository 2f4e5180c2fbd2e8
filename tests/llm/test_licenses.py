from collections import Counter

import brute
import pytest
from conftest import DOCUMENTS

from homeledger.llm import licenses


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    return [r for r in licenses.scan(df).orderBy("doc_id").collect()]


def check(rows, texts):
    got = Counter((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == Counter(brute.phrases(t) for t in texts)


def test_hundreds_of_rules():
    table = licenses.rules()
    assert len(table) > 300 and [r[0] for r in table] == list(range(len(table)))
    assert all(r[2] in licenses.ANCHORS for r in table)


def test_base_on_edges(spark, edge, edge_rows, empty):
    check(licenses.scan(edge).collect(), [t for _, t, *_ in edge_rows])
    assert licenses.scan(empty).count() == 0


PHRASES = [
    "Under the MIT\nlicense", "xunder the mit license", "under the mit licenses", "cc by nc cc by nc, cc-by-nc",
    "Apache License, Version 2.0 under the MIT License", "under the mit license under the mit license",
    "CC BY\tNCé", "a" * 99 + " apache\x00license\x7fversion{2}", "under the  mit ...license, cc by nc", "Kİ cc by nc",
    None, "", " ", "license " * 3000, ("under the mit license and " * 2000) + "end",
]


def test_base_phrases(spark):
    check(scan(spark, PHRASES), PHRASES)


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("released under the BSD 3-Clause License", "bsd-3-clause"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    ("distributed under the terms of the MIT license", "mit"),
    ("This text is under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa-4.0"),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa-3.0"),
    ("GNU Lesser General Public License v2.1 and the Eclipse Public License 2.0", "epl-2,lgpl-2.1"),
    ("We have a driving licence, a license plate and mit freundlichen Gruessen", ""),
    ("nothing here", ""),
])
def test_rules(spark, text, labels):
    row = scan(spark, [text])[0]
    assert row.labels == labels
    assert (row.score > 0) == bool(labels) and 0 <= row.score <= 1


OTHER_FORMS = [
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy", "boost"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that", "isc"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event", "zlib"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("released under Apache 2.0", "apache-2"), ("GPLv3", "gpl-3"), ("see LGPLv2.1 there", "lgpl-2.1"), ("the MPL 2.0 text", "mpl-2"),
    ("Apache 2.0 License", "apache-2"), ("GPLv3 License", "gpl-3"), ("GPL v3 license", "gpl-3"), ("MIT licensed", "mit"),
    ("the MIT and Apache licenses", "apache"), ("distributed under the MIT", "mit"), ("code under BSD 3-Clause licenses", "bsd-3-clause"),
    ("Permission was granted to enter, under protest mit Freunden und Apache helicopters, no warranty", ""),
]


def test_bodies_and_names(spark):
    rows = scan(spark, [t for t, _ in OTHER_FORMS])
    assert [(t, r.labels) for (t, _), r in zip(OTHER_FORMS, rows)] == OTHER_FORMS


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the BSD 2-Clause License", "bsd-2-clause"),
    ("distributed under the terms of the 3-clause BSD license", "bsd-3-clause"),
    ("import matplotlib as mpl", ""), ("He scored twice in the EPL final", ""), ("cc by email to all", ""),
    ("we have a cc by law", ""), ("the text is CC BY 4.0", "cc-by-4.0"), ("under a CC BY license", "cc-by"),
    ("Business Source License 1.1", "busl-1.1"), ("the Elastic License 2.0", "elastic-2"), ("X11 License", "x11"),
    ("Server Side Public License", "sspl"), ("SPDX-License-Identifier: 0BSD", "0bsd"),
    ("an elastic band, a server side script, a business source", ""),
])
def test_names_and_what_only_looks_like_one(spark, text, labels):
    assert scan(spark, [text])[0].labels == labels


def test_contained_finds_are_suppressed(spark):
    df = spark.createDataFrame([(1, "licensed under the gnu lesser general public license version 3", "en", "s", 0)], DOCUMENTS)
    assert [(r.label, r.start, r.end) for r in licenses.detections(df).collect()] == [("lgpl-3", 0, 10)]
