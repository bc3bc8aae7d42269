"""Sequences: translation, reading frames, peptides over junctions, domains; plain functions and pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard genetic code in TCAG order (fixed values).
BASES, AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODON = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def translated(nt: str) -> str:
    """Amino acids of whole codons; X for one that holds anything but TCAG."""
    nt = nt.upper().replace("U", "T")
    return "".join(CODON.get(nt[k : k + 3], "X") for k in range(0, len(nt) - 2, 3))


def longest_orf(nt: str, starts: tuple[int, ...] = ()) -> tuple[int, int]:
    """(start, end) of the longest ATG..stop frame, the stop included, the first at a tie; one that begins at a place of
    ``starts`` goes before all others.  (-1, -1) without any."""
    nt = nt.upper().replace("U", "T")
    best, key = (-1, -1), (False, 0, 0)
    for frame in range(3):
        open_ = -1
        for k in range(frame, len(nt) - 2, 3):
            codon = nt[k : k + 3]
            if codon == "ATG" and (open_ < 0 or (k in starts and open_ not in starts)):
                open_ = k
            elif open_ >= 0 and CODON.get(codon) == "*":
                new = (open_ in starts, k + 3 - open_, -open_)
                if new > key:
                    best, key = (open_, k + 3), new
                open_ = -1
    return best


def decays(stop: int, last_junction: int, least: int = 50) -> bool:
    """Whether a stop lies ``least`` bases or more upstream of the last junction, so that the message is decayed."""
    return 0 <= stop <= last_junction - least


def junction_peptides(left: str, right: str, size: int) -> list[str]:
    """Distinct peptides of ``size`` residues over the junction of two exons, in the three frames, before a stop."""
    out: dict[str, None] = {}
    for frame in range(3):
        protein = translated((left + right)[(len(left) - frame) % 3 :])
        at = (len(left) - (len(left) - frame) % 3) / 3  # residues before the junction
        for k in range(len(protein) - size + 1):
            word = protein[k : k + size]
            if k < at < k + size and "*" not in word and "*" not in protein[: k + 1][-1:]:
                out[word] = None
    return list(out)


def covered(domain: list[tuple[int, int]], coding: list[tuple[int, int]]) -> float:
    """Share of a domain's bases that coding spans hold; spans are half open and apart from each other."""
    size = sum(e - s for s, e in domain)
    held = sum(max(0, min(e, y) - max(s, x)) for s, e in domain for x, y in coding)
    return held / size if size else 0.0


def termini_changed(a: str, b: str, residues: int = 5) -> tuple[bool, bool]:
    """Whether the first and the last ``residues`` of two proteins differ."""
    return a[:residues] != b[:residues], a[-residues:] != b[-residues:]


def hla_name(allele: str) -> str:
    """HLA-A*02:01 from A0201, A*02:01, HLA-A02:01 and HLA-A*02:01:01 alike; anything else as it is."""
    m = re.match(r"(?:HLA-)?(?:([A-Z]+\d?)\*|([A-G]|D[A-Z]{2}\d))(\d{2}):?(\d{2})", allele.upper())
    return f"HLA-{m[1] or m[2]}*{m[3]}:{m[4]}" if m else allele


def farthest_points(sets: list[frozenset], n: int) -> list[int]:
    """Greedy selection of ``n`` sets, each with the largest least Jaccard distance to those before; starts at 0."""
    if not sets:
        return []
    distance = lambda a, b: 1 - len(a & b) / len(a | b) if a | b else 0.0
    chosen, near = [0], [distance(sets[0], s) for s in sets]
    while len(chosen) < min(n, len(sets)):
        k = max((k for k in range(len(sets)) if k not in chosen), key=lambda k: (near[k], -k))
        chosen.append(k)
        near = [min(d, distance(sets[k], s)) for d, s in zip(near, sets)]
    return chosen


@F.pandas_udf(T.StringType())
def translate_udf(nt: pd.Series) -> pd.Series:
    """translated() for a column; null stays null."""
    return nt.map(translated, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
def longest_orf_udf(nt: pd.Series) -> pd.DataFrame:
    """longest_orf() for a column; null is a text without a frame."""
    return pd.DataFrame([longest_orf(x or "") for x in nt], columns=["start", "end"])
