"""Readers and writers on small files."""

import pytest

from exonloom.sources import files


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "s1_juncounts.bed", "chr1\t10\t20\tchr1:10-20\t3\t+\nchr1\t5\t9\tchr1:5-9\t1\t-\n")
    df = files.read_bed(spark, p)
    assert {(r.start, r.score, r.sample) for r in df.collect()} == {(10, 3, "s1"), (5, 1, "s1")}
    files.write_bed(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        files.write_bed(df.limit(0), str(tmp_path / "none"))


def test_gtf(spark, tmp_path):
    p = put(tmp_path, "a.gtf", '#c\nchr1\tx\texon\t30\t40\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\tx\texon\t1\t9\t.\t+\t.\tgene_id=g2;transcript_id=t2\n')
    got = {r.transcript_id: (r.gene_id, [(e.start, e.end) for e in r.exons]) for r in files.transcripts(files.read_gtf(spark, p)).collect()}
    assert got == {"t1": ("g1", [(1, 9), (30, 40)]), "t2": ("g2", [(1, 9)])}


def test_obo_and_gaf(spark, tmp_path):
    p = put(tmp_path, "a.obo", "format: 1\n\n[Term]\nid: T:1\nname: root\n\n[Term]\nid: T:2\nname: leaf\nis_a: T:1 ! root\nrelationship: part_of T:3 ! x\n\n[Typedef]\nid: part_of\n")
    assert sorted((r.term, r.parent or "") for r in files.read_obo(spark, p).collect()) == [("T:1", ""), ("T:2", "T:1"), ("T:2", "T:3")]
    line = "db\tG1\tSYM\t\tT:1\tr\tIDA" + "\t" * 10
    p = put(tmp_path, "a.gaf", f"!x\n{line}\n{line}\n{line.replace('IDA', 'IEA')}\n")
    assert [tuple(r) for r in files.read_gaf(spark, p, ["IDA"]).collect()] == [("G1", "SYM", "T:1")]


def test_vcf(spark, tmp_path):
    row = "chr1\t{}\t.\tA\tG\t9\tPASS\t.\tGT:AD:DP:GQ\t{}\n"
    p = put(tmp_path, "a.vcf", "##x\n" + row.format(5, "0|1:10,10:20:50") + row.format(6, "0/1:19,1:20:50") + row.format(7, "1/1:0,20:20:50") + row.format(8, "0/1:5"))
    assert [tuple(r) for r in files.read_het_sites(spark, p).collect()] == [("chr1", 5, "A", "G", 1, 20)]


def test_mtx_fasta_dense(spark, tmp_path):
    put(tmp_path, "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%c\n2 2 2\n1 1 5\n2 2 7\n")
    put(tmp_path, "features.tsv", "g1:x\tn\ng2\tn\n")
    put(tmp_path, "barcodes.tsv", "AAC\nGGT\n")
    assert sorted(map(tuple, files.read_mtx(spark, str(tmp_path)).collect())) == [("AAC", "g1", 5.0), ("GGT", "g2", 7.0)]
    assert {r.cell for r in files.read_mtx(spark, str(tmp_path), True).collect()} == {"GTT", "ACC"}
    p = put(tmp_path, "p.fa", ">a one\nMK\nLV\n>b\nGG\n")
    assert sorted((r.id, r.sequence) for r in files.read_fasta(spark, p).collect()) == [("a", "MKLV"), ("b", "GG")]
    p = put(tmp_path, "d.tsv", "uid\ts.1\ts2\nf1\t3\t0\nf2\tx\t4\n")
    assert sorted(map(tuple, files.read_dense(spark, p).collect())) == [("f1", "s.1", 3.0), ("f2", "s2", 4.0)]


def test_wide_and_first(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 3)], "row string, col string, v int")
    files.write_wide(df, str(tmp_path / "w"), "row", "col", "v", ["x", "y"])
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "w")).count() == 2
    s = spark.createDataFrame([("g", "E1", 2, "late"), ("g", "E1", 1, "early")], "gene string, structure string, ord int, x string")
    assert [r.x for r in files.first_structures(s).collect()] == ["early"]
