"""License scans: phrase places against a plain search, rules on lines, suppression."""

import itertools
import random
import re
import time
from re import _parser

from exonloom.llm import licenses as L


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), sorted((i, lab) for p, lab in L.PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
    "Released under the MIT License.": {"mit"},
    "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
    "// SPDX-License-Identifier: GPL-2.0": {"gpl-2.0"},
    "distributed under the Mozilla Public License v2.0": {"mpl-2.0"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy": {"mit"},
    "the mitigation of licences": set(),
    "": set(),
}


def test_rules_on_lines():
    assert len(L.rules()) > 600 and sum(map(len, L.SIGNATURES.values())) >= 240
    for line, labels in LINES.items():
        assert {d.label for d in L.scan(line)[2]} == labels, line


def test_inner_detections_are_suppressed():
    found = L.scan("licensed under the GNU Lesser General Public License version 2.1 and the MIT license")[2]
    assert [d.label for d in found] == ["lgpl-2.1", "mit"]
    assert all(not (a is not b and b.start <= a.start and a.end <= b.end) for a in found for b in found)


def test_places_and_digest(spark, docs):
    texts = ["MIT license mit LICENSE", "x Apache-License general public\nlicense", "mité license", None, "", *LINES]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    for r in L.digest(L.scanned(df)).collect():
        n, places = plain(texts[r.doc_id])
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert L.digest(L.scanned(docs)).count() == docs.count()
    assert L.digest(L.scanned(docs.limit(0))).count() == 0


def texts_of(parsed):
    """A text for every choice of a pattern's alternatives, its optional parts left out."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
        elif name == "BRANCH":
            more = [t for way in arg[1] for t in texts_of(way)]
        elif name == "SUBPATTERN":
            more = texts_of(arg[3])
        elif name == "MAX_REPEAT":
            more = ["".join(c) for c in itertools.product(texts_of(arg[2]), repeat=arg[0])]
        else:
            assert name.startswith("ASSERT")
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_alternative_passes_the_prefilter():
    for r in L.rules():
        for text in texts_of(_parser.parse(r.pattern.pattern)):
            line = b" " + text.encode() + b" "
            assert r.pattern.search(line), (r, text)
            assert any(k in line for k in r.keywords), (r, text)


def test_names_without_the_first_keyword():
    for line, label in {
        "GNU Library General Public License version 2": "lgpl-2.1",
        "Expat license": "mit",
        "X11 license": "mit",
        "BSD Zero Clause License": "0bsd",
        "Do What The Fuck You Want To Public License": "wtfpl",
        "subject to the terms of the zlib": "zlib",
        "Creative  Commons - Attribution": "cc-by",
    }.items():
        assert {d.label for d in L.scan(line)[2]} == {label}, line


def test_signatures_are_found_with_their_labels():
    texts = {
        "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "mpl-2.0": "If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "gpl-3.0": "either version 3 of the License, or (at your option) any later version.",
        "zlib": "3. This notice may not be removed or altered from any source distribution.",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited",
    }
    for label, text in texts.items():
        assert label in {d.label for d in L.scan(text)[2]}, label


def one_by_one(found):
    """Detections in the order of the rules; one that lies inside a kept one goes."""
    kept = []
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_suppression_equals_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(25)):
            start = rng.randrange(20)
            found.append(L.Detection(rng.choice("abcd"), start, start + rng.randrange(1, 8), 0.5, rng.randrange(3)))
        assert L.taken(found) == one_by_one(found)


def test_long_text_full_of_matches():
    began = time.time()
    n, base, found = L.scan("released under the MIT license, " * 100_000)
    assert n == 500_000 and len(base) == 100_000 and len(found) == 100_000
    assert time.time() - began < 10
