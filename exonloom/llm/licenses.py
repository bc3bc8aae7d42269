"""License scans by ordered signature rules.

A text is folded to words (A-Z lower-cased; ASCII other than letters and digits separates) and the rules' regular
expressions look at the words joined by single spaces.  Every rule has keywords of which each match holds one; one
pass of an Aho-Corasick automaton finds the keywords of a text, and only their rules are tried.  Detections are
intervals of words; they are taken by priority, longer before shorter, and one that lies inside a taken one is
suppressed.

There are two kinds of rules: hand-written signatures, the telling sentences of license texts (license_texts.py and
SENTENCES below), and the names of licenses in the ways in which they are referred to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.llm.license_texts import SIGNATURES
from exonloom.llm.toxicity import FOLD

#: Phrases that are counted wherever their words stand consecutively, with their labels (fixed by the contract).
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: label: (keywords of which every match holds one, pattern of the name in folded words)
NAMES = {
    "0bsd": ("0bsd|bsd zero", r"(?:0bsd|bsd zero clause)"),
    "afl-3.0": ("academic", r"academic free license(?: version)?(?: v? ?3(?: 0)?)?"),
    "agpl-3.0": ("affero", r"(?:gnu )?affero general public license(?: version)?(?: v? ?3(?: 0)?)?"),
    "apache-1.1": ("apache", r"apache(?: software)? license version 1 1"),
    "apache-2.0": ("apache", r"apache(?: software)? (?:license (?:version |v)?|v)?2(?: 0)?"),
    "apsl-2.0": ("apple", r"apple public source license(?: version)?(?: 2(?: 0)?)?"),
    "artistic-1.0": ("artistic", r"artistic license(?: version)? 1(?: 0)?"),
    "artistic-2.0": ("artistic", r"artistic license(?: version)? 2(?: 0)?"),
    "bsd-2-clause": ("bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "bsl-1.0": ("boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    "busl-1.1": ("business", r"business source license(?: version)?(?: 1 1)?"),
    "cc-by-4.0": ("cc", r"cc by 4 0"),
    "cc-by-3.0": ("cc", r"cc by 3 0"),
    "cc-by-nc-4.0": ("cc", r"cc by nc 4 0"),
    "cc-by-nc-3.0": ("cc", r"cc by nc 3 0"),
    "cc-by-nc-nd-4.0": ("cc", r"cc by nc nd 4 0"),
    "cc-by-nc-sa-4.0": ("cc", r"cc by nc sa 4 0"),
    "cc-by-nd-4.0": ("cc", r"cc by nd 4 0"),
    "cc-by-sa-3.0": ("cc", r"cc by sa 3 0"),
    "cc-by-sa-4.0": ("cc", r"cc by sa 4 0"),
    "cc-by": ("creative", r"creative commons attribution(?: [1-4] [0-9])?(?: international| unported| generic)?"),
    "cc-by-sa": ("creative", r"creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international| unported)?"),
    "cc-by-nc": ("creative", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international| unported)?"),
    "cc-by-nc-sa": ("creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?(?: international| unported)?"),
    "cc-by-nd": ("creative", r"creative commons attribution no ?deriv(?:ative|ative work)?s?(?: [1-4] [0-9])?(?: international| unported)?"),
    "cc0-1.0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "cddl-1.0": ("common", r"common development and distribution license(?: version)?(?: 1 0)?"),
    "cecill-2.1": ("cecill", r"cecill(?: version)?(?: 2 1)?"),
    "cpal-1.0": ("common", r"common public attribution license(?: version)?(?: 1 0)?"),
    "cpl-1.0": ("common", r"common public license(?: version)?(?: 1 0)?"),
    "ecl-2.0": ("educational", r"educational community license(?: version)?(?: 2 0)?"),
    "epl-1.0": ("eclipse", r"eclipse public license(?: version)? v? ?1(?: 0)?"),
    "epl-2.0": ("eclipse", r"eclipse public license(?: version)? v? ?2(?: 0)?"),
    "eupl-1.2": ("european", r"european union public licen[cs]e(?: version)?(?: v? ?1 2)?"),
    "gfdl-1.3": ("documentation", r"(?:gnu )?free documentation license(?: version)?(?: 1 [0-3])?"),
    "gpl-1.0": ("general", r"(?:gnu )?general public license(?: version)? v? ?1(?: 0)?"),
    "gpl-2.0": ("general", r"(?:gnu )?general public license(?: version)? v? ?2(?: 0)?"),
    "gpl-3.0": ("general", r"(?:gnu )?general public license(?: version)? v? ?3(?: 0)?"),
    "isc": ("isc", r"isc"),
    "lgpl-2.1": ("lesser|library", r"(?:gnu )?(?:lesser|library) general public license(?: version)? v? ?2(?: [01])?"),
    "lgpl-3.0": ("lesser", r"(?:gnu )?lesser general public license(?: version)? v? ?3(?: 0)?"),
    "lppl-1.3c": ("latex", r"latex project public license(?: version)?(?: 1 3[abc]?)?"),
    "mit": ("mit|expat|x11", r"(?:mit|expat|mit x11|x11)"),
    "mit-0": ("attribution", r"mit no attribution"),
    "mpl-1.1": ("mozilla", r"mozilla public license(?: version)? v? ?1 1"),
    "mpl-2.0": ("mozilla", r"mozilla public license(?: version)? v? ?2(?: 0)?"),
    "ms-pl": ("microsoft", r"microsoft public license"),
    "ms-rl": ("microsoft", r"microsoft reciprocal license"),
    "ncsa": ("illinois", r"university of illinois(?: ncsa)? open source license"),
    "odbl-1.0": ("database", r"open (?:data commons open )?database license(?: version)?(?: v? ?1 0)?"),
    "ofl-1.1": ("font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    "osl-3.0": ("open", r"open software license(?: version)?(?: v? ?3(?: 0)?)?"),
    "postgresql": ("postgresql", r"postgresql"),
    "psf-2.0": ("python", r"python software foundation license(?: version)?(?: 2)?"),
    "qpl-1.0": ("public", r"q public license(?: version)?(?: 1 0)?"),
    "sspl-1.0": ("server", r"server side public license(?: version)?(?: 1)?"),
    "unlicense": ("unlicense", r"unlicense"),
    "upl-1.0": ("universal", r"universal permissive license(?: version)?(?: v? ?1 0)?"),
    "wtfpl": ("wtfpl|what the fuck", r"(?:wtfpl|do what the fuck you want to public license)"),
    "zlib": ("zlib", r"zlib"),
    "zpl-2.1": ("zope", r"zope public license(?: version)?(?: 2(?: [01])?)?"),
}

#: (priority, score, pattern around a name): the ways in which a license is referred to.
REFERENCES = [
    (90, 0.98, r"spdx license identifiers? (?:is )?{}"),
    (70, 0.95, r"(?:re)?licensed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (70, 0.95, r"(?:released|distributed|published|available|provided|made available) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (65, 0.9, r"(?:under|subject to) (?:the )?(?:terms|conditions|terms and conditions) of (?:the )?{}(?: licen[cs]e)?"),
    (50, 0.8, r"{} licen[cs]e"),
]
#: Labels whose name stands for the license by itself; of the others, a bare name is too common a word.
BARE = {label for label, (_, name) in NAMES.items() if "licen" in name or label.startswith("cc")}

#: (label, priority, score, keyword, telling sentence)
SENTENCES = [
    ("mit", 80, 0.95, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 60, 0.7, "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", 80, 0.95, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", 75, 0.9, "permission", r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", 80, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", 85, 0.95, "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 85, 0.95, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 85, 0.97, "compliance", r"you may not use this (?:file|software) except in compliance with the license"),
    ("apache-2.0", 75, 0.9, "apache", r"www apache org licenses license 2 0"),
    ("gpl", 80, 0.9, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 60, 0.7, "gnu", r"www gnu org licenses(?: gpl)?"),
    ("lgpl", 80, 0.9, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 80, 0.9, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", 85, 0.95, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", 80, 0.9, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", 80, 0.95, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", 85, 0.97, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 60, 0.7, "domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("cc0-1.0", 80, 0.9, "waived", r"has waived all copyright and related or neighboring rights"),
    ("proprietary", 70, 0.8, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 40, 0.5, "reserved", r"all rights reserved"),
    ("beerware", 80, 0.95, "beer", r"you can buy me a beer in return"),
    ("json", 80, 0.95, "evil", r"shall be used for good not evil"),
    ("ofl-1.1", 75, 0.9, "reserved", r"with reserved font name"),
    ("bsl-1.0", 80, 0.9, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
]
#: Priority and score of a signature: it tells more than a name, but less than a sentence with a priority of its own.
SIGNATURE = (78, 0.95)


@dataclass(frozen=True)
class Rule:
    """A signature: its place in the order, what it says, and what it looks for."""

    priority: int
    label: str
    score: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def keyword_of(sentence: str) -> str:
    """The longest word of a sentence that every match has; the first at a tie."""
    plain = re.sub(r"\([^()]*\)\??", " ", sentence)
    return max((w for w in plain.split() if w.isalnum()), key=len)


def rules() -> list[Rule]:
    """All rules, highest priority first, then by label and pattern."""
    out = []
    whole = lambda p: re.compile(rb"(?<= )" + p.encode() + rb"(?= )")
    several = lambda k: tuple(k.encode().split(b"|"))
    for label, (keyword, name) in NAMES.items():
        out += [Rule(p, label, s, several(keyword), whole(form.format(name))) for p, s, form in REFERENCES]
        out.append(Rule(90, label, 0.98, (b"spdx",), whole(r"spdx license identifiers? (?:is )?" + re.sub(r"[.-]", " ", label))))
        if label in BARE:
            out.append(Rule(45, label, 0.75, several(keyword), whole(name)))
    out += [Rule(p, label, s, several(keyword), whole(text)) for label, p, s, keyword, text in SENTENCES]
    out += [Rule(SIGNATURE[0], label, SIGNATURE[1], (keyword_of(t).encode(),), whole(t)) for label, own in SIGNATURES.items() for t in own]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


@dataclass(frozen=True)
class Detection:
    """A rule's match over the words start..end-1."""

    label: str
    start: int
    end: int
    score: float
    priority: int


def taken(found: list[Detection]) -> list[Detection]:
    """Detections that lie inside no other of a higher priority, or of the same and longer, by place.

    What lies inside a suppressed detection lies inside the one that suppressed it as well, so all are compared with
    all by running maxima over the sorted intervals, one for each priority.
    """
    found = sorted(set(found), key=lambda d: (d.start, -d.end, -d.priority, d.label))
    end, priority = np.array([d.end for d in found]), np.array([d.priority for d in found])
    keep = np.ones(len(found), bool)
    for p in set(priority.tolist()):
        reach = np.maximum.accumulate(np.where(priority >= p, end, -1))
        keep[1:] &= (priority[1:] != p) | (reach[:-1] < end[1:])
    return sorted((found[k] for k in np.flatnonzero(keep)), key=lambda d: (d.start, d.end, d.label))


class Scanner:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self):
        self.rules = rules()
        of: dict[bytes, list[int]] = {}
        for k, r in enumerate(self.rules):
            for word in r.keywords:
                of.setdefault(word, []).append(k)
        self.words = ahocorasick.Automaton()
        for word, own in of.items():
            self.words.add_word(word.decode(), (word, tuple(own)))
        self.words.make_automaton()

    def detections(self, folded: bytes) -> list[Detection]:
        """Kept detections in a text of folded words, each with one space on either side, by place."""
        tried = sorted({k for _, own in {v for _, v in self.words.iter(folded.decode("latin-1"))} for k in own})
        found, spaces = [], None
        for k in tried:
            r = self.rules[k]
            spans = [m.span() for m in r.pattern.finditer(folded)]
            if spans:
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
                for first, last in np.searchsorted(spaces, spans).tolist():
                    found.append(Detection(r.label, first - 1, last, r.score, r.priority))
        return taken(found)


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively, ascending."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        for phrase, label in PHRASES.items():
            start = at + 1 - len(phrase)
            if start >= 0 and tuple(w.decode("utf-8", "replace") for w in words[start : at + 1]) == phrase:
                out.append((start, label))


_SCANNER: list[Scanner] = []


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """(number of words, phrase places, detections) of the whole text."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    words = folded.split()
    line = b" " + b" ".join(words) + b" "
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return len(words), places(words), _SCANNER[0].detections(line)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base: array of (start, label), detections: array of (label, start, end, score)) per row.

    A null or empty text has no words and nothing found.  Rows are on their own: ids may be null or repeat, and
    there is no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, base array<struct<start: bigint, label: string>>, detections array<struct<label: string, start: bigint, end: bigint, score: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                got = [scan(t.as_py()) for t in some.column(1)]
                base = [[{"start": s, "label": k} for s, k in g[1]] for g in got]
                found = [[{"label": d.label, "start": d.start, "end": d.end, "score": d.score} for d in g[2]] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                        pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                    ],
                    names=["id", "n_words", "base", "detections"],
                )

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def digest(scan_result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places, labels and a score per row.  The score is the chance that a detection is right, taken as
    independent; a phrase place counts 0.5."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, more = F.col("base.label"), F.col("detections.label")
    scores = F.concat(F.transform("base", lambda b: F.lit(0.5)), F.col("detections.score"))
    return scan_result.select(
        f"`{id_col}`",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        (F.lit(1.0) - F.aggregate(scores, F.lit(1.0), lambda a, s: a * (F.lit(1.0) - s))).alias("score"),
    )
