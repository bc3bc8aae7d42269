"""Readers of the field's text formats, as DataFrames; and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BED6 = "chrom string, start bigint, end bigint, name string, score bigint, strand string"
GTF = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"
GAF = "db string, gene_id string, symbol string, relation string, term string, reference string, evidence string, with_from string, aspect string, name string, synonyms string, type string, taxon string, date string, assigned_by string, extension string, product string"


def _tsv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Headerless BED6, with the sample that the file is named for: the stem less _juncounts or _intcounts."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_juncounts|_intcounts)?\.bed(?:\.gz)?$", 1)
    return _tsv(spark, path, BED6).withColumn("sample", stem)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF with gene and transcript ids taken from the attributes."""
    def attribute(key: str):
        quoted = F.regexp_extract("attributes", rf'\b{key} "([^"]*)"', 1)
        plain = F.regexp_extract("attributes", rf"\b{key}=([^;]*)", 1)
        return F.nullif(F.coalesce(F.nullif(quoted, F.lit("")), plain), F.lit(""))

    return _tsv(spark, path, GTF, "#").withColumns({k: attribute(k) for k in ("gene_id", "transcript_id", "exon_id")})


def transcripts(gtf: DataFrame) -> DataFrame:
    """(transcript_id, gene_id, chrom, strand, exons): exons ordered by place."""
    exons = gtf.filter("feature = 'exon' and transcript_id is not null")
    return exons.groupBy("transcript_id").agg(F.min("gene_id").alias("gene_id"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, parent) from [Term] stanzas; parents are is_a and part_of; a term without any has a null parent."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value").startswith("[Term]"))
    parents = F.array_union(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)), F.regexp_extract_all("value", F.lit(r"(?m)^relationship: part_of (\S+)"), F.lit(1)))
    rows = stanza.filter(~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("term"), F.regexp_extract("value", r"(?m)^name: (.*)$", 1).alias("name"), parents.alias("p"))
    return rows.select("term", "name", F.explode_outer("p").alias("parent"))


def read_gaf(spark: SparkSession, path: str, evidence: list[str] | None = None) -> DataFrame:
    """Distinct (gene_id, symbol, term) of a GAF file, of the given evidence codes if any."""
    rows = _tsv(spark, path, GAF, "!")
    if evidence:
        rows = rows.filter(F.col("evidence").isin(evidence))
    return rows.select("gene_id", "symbol", "term").distinct()


def read_het_sites(spark: SparkSession, path: str, depth: int = 10, quality: int = 20, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(chrom, pos, ref, alt, samples, depth): biallelic heterozygous SNVs of VCF files that pass the gates, over samples."""
    fields = "chrom string, pos bigint, id string, ref string, alt string, qual string, filter string, info string, format string, call string"
    v = _tsv(spark, path, fields, "#").filter("length(ref) = 1 and length(alt) = 1 and alt != '.'")
    v = v.withColumn("m", F.map_from_arrays(F.split("format", ":"), F.slice(F.concat(F.split("call", ":"), F.array_repeat(F.lit(""), F.size(F.split("format", ":")))), F.lit(1), F.size(F.split("format", ":")))))
    ad = F.transform(F.split(F.col("m")["AD"], ","), lambda x: x.try_cast("bigint"))
    v = v.withColumns({"gt": F.regexp_replace(F.col("m")["GT"], r"\|", "/"), "dp": F.col("m")["DP"].try_cast("bigint"), "gq": F.col("m")["GQ"].try_cast("double"), "af": F.try_divide(F.try_element_at(ad, F.lit(2)), F.try_element_at(ad, F.lit(1)) + F.try_element_at(ad, F.lit(2)))})
    ok = v.filter(F.col("gt").isin("0/1", "1/0") & (F.col("dp") >= depth) & (F.col("gq") >= quality) & F.col("af").between(low, high))
    return ok.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("samples"), F.max("dp").alias("depth"))


def read_mtx(spark: SparkSession, folder: str, reverse_complement: bool = False) -> DataFrame:
    """(cell, gene, value) from a MatrixMarket folder: matrix.mtx, features.tsv, barcodes.tsv; names end at a colon."""
    def names(file: str, name: str) -> DataFrame:
        rows = spark.read.text(f"{folder}/{file}", wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("i", "line"))
        return rows.select((F.col("i") + 1).cast("bigint").alias(f"_{name}"), F.split_part(F.split_part("line", F.lit("\t"), F.lit(1)), F.lit(":"), F.lit(1)).alias(name))

    lines = spark.read.text(f"{folder}/matrix.mtx").filter(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    entries = lines.select(parts[0].cast("bigint").alias("_gene"), parts[1].cast("bigint").alias("_cell"), parts[2].cast("double").alias("value"), F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_o"))
    entries = entries.filter(F.col("_o") > entries.agg(F.min("_o")).first()[0]) if not entries.isEmpty() else entries  # the first is the size
    cells = names("barcodes.tsv", "cell")
    if reverse_complement:
        cells = cells.withColumn("cell", F.reverse(F.translate("cell", "ACGT", "TGCA")))
    return entries.join(F.broadcast(names("features.tsv", "gene")), "_gene").join(cells, "_cell").select("cell", "gene", "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence)."""
    r = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.expr(r"substring(value, locate('\n', value) + 1)"), r"\s", "")
    return r.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), head.alias("description"), body.alias("sequence"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(feature, sample, value) from a dense table with features in the first column; zeros and text are left out."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    key, *samples = wide.columns
    q = lambda c: F.col(f"`{c}`")
    long = wide.select(q(key).alias("feature"), *(q(c).try_cast("double").alias(c) for c in samples)).unpivot("feature", [q(c) for c in samples], "sample", "value")
    return long.filter("value is not null and value != 0")


def write_bed(df: DataFrame, path: str) -> None:
    """BED6 rows, tab-separated, in order of place; an empty table is an error."""
    rows = df.select("chrom", "start", "end", "name", "score", "strand")
    if rows.isEmpty():
        raise ValueError("there are no junctions to write")
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end").write.option("sep", "\t").csv(path)


def write_matrix(df: DataFrame, path: str, by: str) -> None:
    """A long matrix as Parquet, in folders by ``by``."""
    df.repartition(by).write.partitionBy(by).parquet(path)


def write_wide(df: DataFrame, path: str, row: str, column: str, value: str, columns: list[str]) -> None:
    """A row per ``row`` with a column for each of ``columns``, absent values 0, tab-separated with a header."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)
    wide.orderBy(row).write.option("sep", "\t").option("header", True).csv(path)


def first_structures(df: DataFrame) -> DataFrame:
    """One row per (gene, structure), the first by ord: what an insert that ignores conflicts keeps."""
    w = Window.partitionBy("gene", "structure").orderBy("ord")
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
