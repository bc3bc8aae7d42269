"""Streams against the batch result of the same files."""

from exonloom.sources import files
from exonloom.streaming import counts as S


def test_running_totals_go_on(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    for k in range(3):
        (folder / f"s{k}_juncounts.bed").write_text(f"chr1\t10\t20\tx\t{k + 1}\t+\nchr1\t10\t20\tx\t1\t-\n")
        S.into_table(S.running_totals(S.arriving_junctions(spark, str(folder))), out, mark, "complete").awaitTermination(120)
    got = sorted((r.sample, r["count"]) for r in S.latest(spark, out).collect())
    batch = files.read_bed(spark, str(folder)).groupBy("sample").sum("score").collect()
    assert got == sorted((r[0], r[1]) for r in batch) == [("s0", 2), ("s1", 3), ("s2", 4)]


def test_windows_close_by_watermark(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 2.0), ("2024-01-01 01:30:00", "b", 3.0), ("2024-01-01 05:00:00", "b", 1.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    S.into_table(S.windowed_events(stream, "t", "k", "v"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    got = sorted((str(r.window_start), r.kind, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 3.0)]
