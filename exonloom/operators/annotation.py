"""Names and classes of junctions, exons, genes, variants and reads; each works row by row unless it says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Symbols that clustering leaves out: ribosomal, mitochondrial, dotted, and such (fixed values, upper case).
NUISANCE = r"^(RPL|RPS|MT-|GM|XIS|TSI|RSP|HLA)|\.|Y$"
#: Symbols that pseudobulk programs leave out; genes of chromosome Y stay (fixed values, upper case).
UDON_NUISANCE = r"^(RPL|RPS)|^(XIST|TSIX)$"
#: What separates the members of a complex.
MEMBERS = r"[+|;,]"
#: Artifact classes that a criterion keeps out of the artifacts; criteria from 4 on do call cell-cycle genes artifacts.
SPARED = {
    1: [],
    2: ["cellcycle"],
    3: ["cellcycle", "ribosome"],
    4: ["ribosome", "mitochondrial"],
    5: ["ribosome", "mitochondrial", "antisense"],
    6: ["ribosome", "mitochondrial", "antisense", "predict_gene"],
}


def junction_feature(feature: Column) -> dict[str, Column]:
    """Parts of 'GENE:name=chrom:start-end'; the strand follows from the order of the numbers.  The uid is all of it."""
    part = lambda k: F.regexp_extract(feature, r"^([^:=]*)[^=]*=([^:]*):(-?\d+)-(-?\d+)$", k)
    number = lambda k: part(k).try_cast("bigint")
    return {
        "gene": part(1),
        "chrom": part(2),
        "start": number(3),
        "end": number(4),
        "strand": F.when(number(3).isNull(), F.lit(None)).when(number(3) < number(4), "+").otherwise("-"),
    }


def junction_exons(junction: Column) -> dict[str, Column]:
    """Genes and exons of 'GENE:E1-E2' or 'GENE:E1-GENE2:E3'; null for what is neither."""
    gene, rest = F.substring_index(junction, ":", 1), F.regexp_extract(junction, r"^[^:]*:(.*)$", 1)
    left, right = F.substring_index(rest, "-", 1), F.regexp_extract(rest, r"^[^-]*-(.*)$", 1)
    ok = F.contains(junction, F.lit(":")) & F.contains(rest, F.lit("-"))
    trans = F.contains(right, F.lit(":"))
    return {
        "gene1": F.when(ok, gene),
        "exon1": F.when(ok, left),
        "gene2": F.when(ok, F.when(trans, F.substring_index(right, ":", 1)).otherwise(gene)),
        "exon2": F.when(ok, F.when(trans, F.regexp_extract(right, r"^[^:]*:(.*)$", 1)).otherwise(right)),
    }


def without_nuisance(genes: DataFrame, symbol: str, biotype: str, pattern: str = NUISANCE) -> DataFrame:
    """Protein-coding genes whose symbol, in upper case, the pattern doesn't match."""
    return genes.filter((F.col(biotype) == "protein_coding") & ~F.upper(symbol).rlike(pattern))


def without_artifacts(genes: DataFrame, artifacts: DataFrame, criterion: int) -> DataFrame:
    """genes (gene, ...) without the artifacts (gene, class) that the criterion counts."""
    counted = artifacts.filter(~F.col("class").isin(SPARED[criterion])) if SPARED[criterion] else artifacts
    return genes.join(counted.select("gene").distinct(), "gene", "left_anti")


def undocumented(junctions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """junctions (gene, e1, e2, ...) that are no adjacent pair of any transcript (gene, tokens) of the gene; what has a
    novel, untranslated, intronic or foreign part stays in any case."""
    t = F.col("tokens")
    pairs = F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda x, k: F.struct(x.alias("e1"), F.element_at(t, k + 2).alias("e2")))
    known = transcripts.select("gene", F.explode(pairs).alias("_p")).select("gene", "_p.e1", "_p.e2").distinct()
    odd = F.concat("e1", F.lit("-"), "e2").rlike("_|U|I|ENSG")
    return junctions.filter(odd).unionByName(junctions.filter(~odd).join(known, ["gene", "e1", "e2"], "left_anti").select(*junctions.columns))


def without_novel_ends(tokens: Column) -> Column:
    """Tokens without a first or last exon token that carries a coordinate of its own."""
    last = F.size(tokens) - 1
    return F.filter(tokens, lambda x, k: ~(((k == 0) | (k == last)) & x.rlike("^(.*:)?E[^_]*_")))


def annotated_tokens(tokens: Column) -> Column:
    """Exon and intron tokens, without exons that carry a coordinate."""
    return F.filter(tokens, lambda x: x.rlike("^(.*:)?[EI]") & ~x.rlike("^(.*:)?E.*_"))


def site_names(sites: DataFrame, regions: DataFrame, near: int = 50) -> DataFrame:
    """sites (gene, pos) with ``name``, from regions (gene, start, end, region, strand), both ends included.

    Regions are taken in transcript order.  Before the first: U1.1_pos.  In an intron's first region, within ``near`` of
    its beginning the region before, of its end the one after it, else the intron itself; in any other region that
    region.  Elsewhere, the block after the last region's: U(n+1).1_pos.

    A site is looked up by its bin.  A gene's bins are as wide as its regions are on average, so that regions fall into
    three bins each at most, taken together, however long they are.
    """
    plus = F.col("strand") == "+"
    order = Window.partitionBy("gene").orderBy(F.when(plus, F.col("start")).otherwise(-F.col("end")))
    r = regions.withColumns({"_n": F.row_number().over(order), "_before": F.lag("region").over(order), "_after": F.lead("region").over(order)})
    ends = r.groupBy("gene").agg(
        F.min("start").alias("_low"), F.max("end").alias("_high"), F.max_by("region", "_n").alias("_last"), F.max("strand").alias("_strand"),
        F.greatest(F.lit(1), F.ceil(F.avg(F.col("end") - F.col("start") + 1))).alias("_width"),
    )
    bin_of = lambda x: F.floor(F.col(x) / F.col("_width"))
    r = r.join(ends.select("gene", "_width"), "gene")
    binned = r.withColumn("_bin", F.explode(F.sequence(bin_of("start"), bin_of("end")))).drop("_width")
    asked = sites.select("gene", "pos").distinct().join(ends, "gene")
    hits = asked.select("gene", "pos", bin_of("pos").alias("_bin")).join(binned, ["gene", "_bin"]).filter(F.col("pos").between(F.col("start"), F.col("end")))
    from_begin = F.when(plus, F.col("pos") - F.col("start")).otherwise(F.col("end") - F.col("pos"))
    from_end = F.when(plus, F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    intron = F.contains("region", F.lit("I")) & F.endswith("region", F.lit(".1"))
    own = F.when(intron & (from_begin < near), F.col("_before")).when(intron & (from_end < near), F.col("_after"))
    found = hits.groupBy("gene", "pos").agg(F.min_by(F.coalesce(own, "region"), "_n").alias("_region"))
    early = F.when(F.col("_strand") == "+", F.col("pos") < F.col("_low")).otherwise(F.col("pos") > F.col("_high"))
    later = F.concat(F.lit("U"), (F.regexp_extract("_last", r"^.(\d+)", 1).cast("int") + 1).cast("string"), F.lit(".1"))
    region = F.when(early, "U1.1").otherwise(F.coalesce("_region", later))
    named = asked.join(found, ["gene", "pos"], "left").select("gene", "pos", F.concat(region, F.lit("_"), F.col("pos").cast("string")).alias("name"))
    return sites.join(named, ["gene", "pos"])


#: What a negative sign turns round.
OPPOSITES = {"proximal": "distal", "distal": "proximal", "inclusion": "exclusion", "exclusion": "inclusion"}


def by_sign(label: Column, sign: Column) -> Column:
    """The label, or its opposite where the sign is -1."""
    turned = reduce(lambda c, kv: c.when(label == kv[0], kv[1]), list(OPPOSITES.items())[1:], F.when(label == "proximal", "distal"))
    return F.when(sign == -1, turned.otherwise(label)).otherwise(label)


def summary_event(e1: Column, e2: Column, c1: Column, c2: Column) -> Column:
    """Event of two junctions 'GENE:A-B' with coordinates 'start-end', by the first rule that holds.

    The promoter rule looks at the first exon's block number, so that block 10 is no promoter.
    """
    block = lambda e: F.regexp_extract(e, r"^(?:[^:]*:)?([EU]\d+)\.", 1)
    first = block(e1).isin("U1", "E1") | block(e2).isin("U1", "E1")
    novel = F.contains(e1, F.lit("_")) | F.contains(e2, F.lit("_"))
    both_novel = F.contains(e1, F.lit("_")) & F.contains(e2, F.lit("_"))
    intron = e1.rlike(r"(:|-)I\d") | e2.rlike(r"(:|-)I\d")
    apart = F.abs(F.split_part(c1, F.lit("-"), F.lit(2)).try_cast("bigint") - F.split_part(c2, F.lit("-"), F.lit(1)).try_cast("bigint"))
    parts = lambda e: F.split(F.element_at(F.split(e, ":"), -1), "-")
    root = lambda x: F.substring_index(x, ".", 1)
    a, b = parts(e1), parts(e2)
    ends = lambda k: (root(F.element_at(a, k)) == root(F.element_at(b, k))) & (F.element_at(a, k) != F.element_at(b, k))
    return (
        F.when(first, "Alternative Promoter")
        .when(both_novel & (F.substring_index(e1, "_", 1) == F.substring_index(e2, "_", 1)), "Alternative Polyadenylation")
        .when(F.substring_index(e1, ":", 1) != F.substring_index(e2, ":", 1), "Trans-Splicing")
        .when(intron & ~novel & (apart == 1), "Intron Retention")
        .when(intron & novel, "Novel Cassette Exon")
        .when(ends(1), "Alternative 5' Splice Site")
        .when(ends(-1), "Alternative 3' Splice Site")
        .when(F.size(a) != F.size(b), "Cassette Exon")
    )


def members(name: Column) -> Column:
    """Members of a complex, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(name, MEMBERS), lambda x: F.trim(x)), lambda x: x != "")


def read_strand(xs: Column, ts: Column, reverse: Column, oriented: Column) -> Column:
    """XS if there is one; else ts, which is relative to the read; else the read's own strand in an oriented library."""
    along = F.when((ts == "+") != reverse, "+").otherwise("-")
    return F.when(xs.isNotNull(), xs).when(ts.isin("+", "-"), along).when(oriented, F.when(reverse, "-").otherwise("+")).otherwise(".")


def strand_allows(mode: str, xs: Column, intron: Column, read: Column) -> Column:
    """Whether a single read counts for an intron: 'auto' asks that the read's XS strand, if any, is the intron's;
    'forward' and 'reverse' that intron and read are of that strand; 'unstranded' nothing."""
    if mode == "auto":
        return xs.isNull() | F.coalesce(xs == intron, F.lit(False))
    if mode == "unstranded":
        return F.lit(True)
    sign = {"forward": "+", "reverse": "-"}[mode]
    return F.coalesce((intron == sign) & (read == sign), F.lit(False))


def indel_class(label: Column) -> Column:
    """'ins', 'del', 'any' or null: what kind of indel an HGVS label is about."""
    s = F.lower(label)
    ins, gone = s.rlike("ins|dup"), F.contains(s, F.lit("del"))
    return F.when(s.rlike("delins|fs"), "any").when(ins & gone, "any").when(ins, "ins").when(gone, "del")


def arm(chrom: str, middle: Column, centromere: Column) -> Column:
    """chromosome and arm: p before the centromere, q from it on; empty without a centromere."""
    return F.when(centromere.isNull(), "").otherwise(F.concat(chrom, F.when(middle < centromere, "p").otherwise("q")))


def length_change(before: Column, after: Column, id_before: Column, id_after: Column, direction: Column) -> Column:
    """'(sign)AA:len(id)->len(id)': how a protein's length changes; '~' if it doesn't."""
    sign = F.when(before == after, "~").otherwise(direction)
    return F.concat(F.lit("("), sign, F.lit(")AA:"), before.cast("string"), F.lit("("), id_before, F.lit(")->"), after.cast("string"), F.lit("("), id_after, F.lit(")"))
