"""Gene models and isoform structures: segments, junctions, collapse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators.tokens import adjacent, junction_core
from exonloom.sources.shared import cut, merged


def gene_model(exons: DataFrame, gene: str) -> DataFrame:
    """(gene, start, end, name): a gene cut at every boundary of its exons; a segment that an exon covers is E, others
    are I, numbered by block and within the block."""
    steps = exons.select(gene, F.explode(F.array(F.struct(F.col("start").alias("x"), F.lit(1).alias("d")), F.struct(F.col("end").alias("x"), F.lit(-1).alias("d")))).alias("s")).groupBy(gene, F.col("s.x").alias("start")).agg(F.sum("s.d").alias("_d"))
    own = Window.partitionBy(gene).orderBy("start")
    seg = steps.withColumns({"_depth": F.sum("_d").over(own), "end": F.lead("start").over(own)}).filter("end is not null").withColumn("_exon", F.col("_depth") > 0)
    seg = seg.withColumn("_opens", (F.col("_exon") & ~F.coalesce(F.lag("_exon").over(own), F.lit(False))).cast("int"))
    seg = seg.withColumn("_block", F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(gene, "_block", "_exon").orderBy("start"))
    return seg.select(gene, "start", "end", F.concat(F.when(F.col("_exon"), "E").otherwise("I"), F.col("_block").cast("string"), F.lit("."), n.cast("string")).alias("name"))


def junction_decomposition(isoforms: DataFrame, tokens: str, reads: str) -> DataFrame:
    """(junction, reads, isoforms): each isoform's reads count for each of its distinct junctions."""
    j = isoforms.select(F.explode(F.array_distinct(adjacent(F.col(tokens)))).alias("junction"), F.col(reads).alias("_n"))
    return j.groupBy("junction").agg(F.sum("_n").alias("reads"), F.count("*").alias("isoforms"))


def collapse(structures: DataFrame) -> DataFrame:
    """(gene, structure, reads, is_ref, parent): isoforms folded into one that has their tokens as a consecutive part.

    Input is (gene, structure 'a|b|c', reads, is_ref).  References never fold; a parent is a reference before a novel
    one, then the longest, then the one with most reads, then the first by name.  A gene's structures are one task's;
    reads are summed up per structure before, so the group is as large as the gene has different structures.
    """
    one = structures.groupBy("gene", "structure").agg(F.sum("reads").alias("reads"), F.max("is_ref").alias("is_ref"))
    kind = structures.schema["gene"].dataType.simpleString()

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(df.itertuples(index=False), key=lambda r: (not r.is_ref, -r.structure.count("|"), -r.reads, r.structure))
        by_token: dict[str, list] = {}
        parent = {}
        for r in rows:
            tokens = r.structure.split("|")
            inside = f"|{r.structure}|"
            near = min((by_token.get(t, []) for t in tokens), key=len)
            up = None if r.is_ref else next((p for p in near if inside in f"|{p}|"), None)
            parent[r.structure] = up or r.structure
            if up is None:
                for t in set(tokens):
                    by_token.setdefault(t, []).append(r.structure)
        return df.assign(parent=df.structure.map(parent))

    return one.groupBy("gene").applyInPandas(fold, f"gene {kind}, structure string, reads bigint, is_ref boolean, parent string")


def _totals(structures: DataFrame) -> DataFrame:
    return structures.groupBy("gene", "structure").agg(F.sum("reads").alias("reads"), F.max("is_ref").alias("is_ref"))


def _contained(cores: DataFrame) -> DataFrame:
    """(gene, core, outer): distinct cores (gene, core: 'a|b') and those of the gene that hold them, themselves included.

    A core's consecutive parts, n * (n + 1) / 2 of n tokens, are hashed with the gene and meet the cores of that hash, so
    that only pairs that hold each other are made, however common their tokens; hashes are confirmed on the texts."""
    distinct = cut(cores.select("gene", "core").distinct())
    one = distinct.select("gene", "core", F.xxhash64("gene", "core").alias("_h"))
    t, size = F.split("core", r"\|"), F.size(F.split("core", r"\|"))
    runs = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.xxhash64("gene", F.array_join(F.slice(t, i, n), "|"))))
    parts = distinct.select(F.xxhash64("gene", "core").alias("_o"), F.explode(F.array_distinct(F.flatten(runs))).alias("_h"))
    outer = one.select(F.col("gene").alias("_g"), F.col("core").alias("outer"), F.col("_h").alias("_o"))
    ends = lambda c: F.concat(F.lit("|"), F.col(c), F.lit("|"))
    return parts.join(merged(one), "_h").join(merged(outer), "_o").filter(F.col("gene").eqNullSafe(F.col("_g")) & F.contains(ends("outer"), ends("core"))).select("gene", "core", "outer")


def collapse_by_core(structures: DataFrame, least_reads: int = 1) -> DataFrame:
    """(gene, structure, reads, is_ref, parent): isoforms folded by their junction cores, whatever their ends.

    Structures (gene, structure 'a|b|c', reads, is_ref) with ``least_reads``, and all references, take part.  A reference
    folds only into a reference whose core properly holds its own, the longest structure, the last by name at a tie.
    Another structure folds into the longest reference left whose core holds or equals its own; of the rest, cores that
    hold more tokens come first, then more reads, then names, and the first whose core holds or equals a structure's is
    its parent.  What holds a folded one's core also holds what it held, so nothing depends on the order of folding but
    the choice among parents, and no gene is worked on one structure at a time.  Every table here grows with the
    structures, so no join broadcasts: the driver gathers nothing.
    """
    s = _totals(structures).filter((F.col("reads") >= least_reads) | F.col("is_ref"))
    t = F.split("structure", r"\|")
    s = s.withColumns({"core": F.array_join(junction_core(t), "|"), "flen": F.size(t)}).withColumn("n", F.size(F.split("core", r"\|")))
    s = cut(s)  # it is read many times below
    inside = cut(_contained(s))
    refs = s.filter("is_ref")
    side = lambda df: df.select("gene", F.col("core").alias("outer"), F.col("structure").alias("to"), F.col("flen").alias("to_flen"), F.col("n").alias("to_n"), F.col("reads").alias("to_reads"))
    over = refs.join(merged(inside), ["gene", "core"]).join(merged(side(refs)), ["gene", "outer"]).filter("to_n > n")
    lost = over.select("gene", "structure").distinct()
    left = refs.join(merged(lost), ["gene", "structure"], "left_anti")
    kept = over.join(merged(left.select("gene", F.col("structure").alias("to"))), ["gene", "to"], "left_semi")
    of_refs = kept.groupBy("gene", "structure").agg(F.max(F.struct("to_flen", "to")).alias("b")).select("gene", "structure", F.col("b.to").alias("parent"))

    novel = s.filter(~F.col("is_ref"))
    to_refs = novel.join(merged(inside), ["gene", "core"]).join(merged(side(left)), ["gene", "outer"])
    to_refs = to_refs.groupBy("gene", "structure").agg(F.min(F.struct((-F.col("to_flen")).alias("f"), "to")).alias("b")).select("gene", "structure", F.col("b.to").alias("parent"))
    to_refs = cut(to_refs)
    rest = novel.join(merged(to_refs), ["gene", "structure"], "left_anti")
    before = (F.col("to_n") > F.col("n")) | (F.col("to_reads") > F.col("reads")) | ((F.col("to_reads") == F.col("reads")) & (F.col("to") < F.col("structure")))
    pairs = rest.join(merged(inside), ["gene", "core"]).join(merged(side(rest)), ["gene", "outer"]).filter((F.col("to") != F.col("structure")) & (F.col("to_n") >= F.col("n")) & before)
    folded = pairs.select("gene", "structure").distinct()
    heads = pairs.join(merged(folded.withColumnRenamed("structure", "to")), ["gene", "to"], "left_anti")
    order = F.struct((-F.col("to_n")).alias("n"), (-F.col("to_reads")).alias("r"), "to")
    of_rest = heads.groupBy("gene", "structure").agg(F.min(order).alias("b")).select("gene", "structure", F.col("b.to").alias("parent"))
    parents = of_refs.unionByName(to_refs).unionByName(of_rest)
    return s.join(merged(parents), ["gene", "structure"], "left").select("gene", "structure", "reads", "is_ref", F.coalesce("parent", "structure").alias("parent"))


def longest_container(structures: DataFrame) -> DataFrame:
    """(gene, structure, parent): the longest other structure of the gene, by characters, that holds the structure as a
    consecutive part, the first by name at a tie; itself if none does."""
    s = _totals(structures).select("gene", "structure")
    pairs = _contained(s.withColumnRenamed("structure", "core")).filter(F.length("outer") > F.length("core"))
    best = pairs.groupBy("gene", F.col("core").alias("structure")).agg(F.min(F.struct((-F.length("outer")).alias("n"), "outer")).alias("b"))
    return s.join(merged(best), ["gene", "structure"], "left").select("gene", "structure", F.coalesce("b.outer", "structure").alias("parent"))


def em_shares(compatible: DataFrame, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """(gene, isoform, share): expectation maximisation over (gene, read_class, isoform, reads), where a class's reads
    fit each of its isoforms."""
    kind = compatible.schema["gene"].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        share = pd.Series(1.0, index=sorted(df.isoform.unique()))
        share /= len(share)
        total = df.drop_duplicates("read_class").reads.sum()
        for _ in range(rounds):
            w = df.isoform.map(share)
            got = (df.reads * w / w.groupby(df.read_class).transform("sum")).groupby(df.isoform).sum() / max(total, 1)
            done = (got - share).abs().max() < tolerance
            share = got
            if done:
                break
        return pd.DataFrame({"gene": df.gene.iloc[0], "isoform": share.index, "share": share.to_numpy()})

    return compatible.groupBy("gene").applyInPandas(run, f"gene {kind}, isoform string, share double")
