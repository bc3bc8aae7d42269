"""Columns on exon tokens, structures, identifiers and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uid(chrom: Column, start: Column, end: Column) -> Column:
    """chr:start-end, without a strand."""
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def with_chr(c: Column) -> Column:
    """A contig's name with the chr prefix."""
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def numeric_or_null(c: Column) -> Column:
    """Digits with at most one point as a number; signs, exponents and all else are null."""
    return F.when(c.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), c.try_cast("double"))


def without_version(c: Column) -> Column:
    """Ensembl gene, transcript and protein ids up to the first point."""
    return F.regexp_replace(c, r"^(ENS[A-Z]*[GTP][0-9]+)\..*$", "$1")


def blocks(tokens: Column) -> Column:
    """Number of distinct exon blocks: E12.3 is of block E12; introns don't count."""
    exons = F.filter(tokens, lambda t: t.startswith("E"))
    return F.size(F.array_distinct(F.transform(exons, lambda t: F.split_part(F.split_part(t, F.lit("_"), F.lit(1)), F.lit("."), F.lit(1)))))


def regions(tokens: Column) -> Column:
    """Number of distinct exon regions, novel coordinates cut off."""
    exons = F.filter(tokens, lambda t: t.startswith("E"))
    return F.size(F.array_distinct(F.transform(exons, lambda t: F.split_part(t, F.lit("_"), F.lit(1)))))


def deduped(tokens: Column) -> Column:
    """Tokens without those that repeat the one before."""
    kept = F.filter(tokens, lambda t, i: (i == 0) | (t != F.element_at(tokens, F.greatest(i, F.lit(1)))))
    return kept


def adjacent(tokens: Column) -> Column:
    """Pairs first-second of neighbouring tokens."""
    n = F.size(tokens)
    pairs = F.transform(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit("-"), F.element_at(tokens, i + 2)))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def contains_run(long: Column, short: Column) -> Column:
    """Whether ``short`` is a consecutive part of ``long``."""
    d = lambda c: F.concat(F.lit("|"), F.array_join(c, "|"), F.lit("|"))
    return F.contains(d(long), d(short))


def match_class(a: Column, b: Column) -> Column:
    """exact, contained_in, superset_of or none."""
    return F.when(F.array_join(a, "|") == F.array_join(b, "|"), "exact").when(contains_run(b, a), "contained_in").when(contains_run(a, b), "superset_of").otherwise("none")


def reverse_complement(c: Column) -> Column:
    """The part before the only dash, reversed and complemented; the suffix stays.  Null without exactly one dash."""
    parts = F.split(c, "-")
    return F.when(F.size(parts) == 2, F.concat(F.reverse(F.translate(parts[0], "ACGTacgt", "TGCAtgca")), F.lit("-"), parts[1]))


def geometric_mean(values: Column) -> Column:
    """exp of the mean log; 0 if a member is null or not positive, or there is none."""
    bad = F.exists(values, lambda v: v.isNull() | (v <= 0)) | (F.size(values) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(F.exp(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.ln(v.cast("double"))) / F.size(values)))


def cigar_blocks(cigar: Column, start: Column) -> Column:
    """Aligned blocks (start, end), half open: N splits; M, D, = and X go on along the reference."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.substring(o, -1, 1).alias("op"), F.regexp_extract(o, r"^([0-9]+)", 1).cast("bigint").alias("n")))
    block = "struct<start: bigint, end: bigint>"
    state = F.struct(start.cast("bigint").alias("at"), start.cast("bigint").alias("from"), F.array().cast(f"array<{block}>").alias("done"))
    made = lambda s: F.when(s["at"] > s["from"], F.array_append(s["done"], F.struct(s["from"].alias("start"), s["at"].alias("end")))).otherwise(s["done"])
    step = lambda s, o: (
        F.when(o["op"].isin("M", "D", "=", "X"), F.struct((s["at"] + o["n"]).alias("at"), s["from"].alias("from"), s["done"].alias("done")))
        .when(o["op"] == "N", F.struct((s["at"] + o["n"]).alias("at"), (s["at"] + o["n"]).alias("from"), made(s).alias("done")))
        .otherwise(s)
    )
    return F.aggregate(ops, state, step, made)


def event_class(donor: Column, acceptor: Column, donor_alt: Column, acceptor_alt: Column, retained: Column, other_gene: Column) -> Column:
    """The kind of a splicing event from what differs; the first rule that holds wins."""
    return F.when(other_gene, "trans-splicing").when(retained, "intron-retention").when(donor_alt & acceptor_alt, "alt5'-alt3'").when(donor_alt, "alt-5'").when(acceptor_alt, "alt-3'").when(donor == acceptor, "cassette-exon").otherwise("other")


def geometric_mean_of(value: str) -> Column:
    """The same as an aggregate over rows: sums only, no list of a group."""
    bad = (F.count_if(F.col(value).isNull() | (F.col(value) <= 0)) > 0) | (F.count("*") == 0)
    return F.when(bad, 0.0).otherwise(F.exp(F.avg(F.ln(F.when(F.col(value) > 0, F.col(value))))))


def junction_core(tokens: Column) -> Column:
    """Tokens from the donor of the first splice junction to the acceptor of the last, without coordinates of their own
    and repeats that this makes.  A junction is where the exon block changes; without one, the tokens as they are."""
    block = lambda x: F.substring_index(x, ".", 1)
    junctions = lambda p: F.filter(F.sequence(F.lit(1), F.size(p) - 1), lambda k: block(F.element_at(p, k)) != block(F.element_at(p, k + 1)))
    between = lambda p, first, last: F.slice(p, first, last - first + 2)
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  # a lambda's argument is evaluated once
    plain = deduped(F.transform(tokens, lambda x: F.substring_index(x, "_", 1)))
    core = once(plain, lambda p: F.when(F.size(p) > 1, once(junctions(p), lambda j: between(p, F.array_min(j), F.array_max(j)))))
    return F.coalesce(core, tokens)
