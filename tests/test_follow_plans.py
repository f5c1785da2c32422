"""A batch of chunks costs few shuffles: small batches mostly wait for their jobs."""

from logwarden.streaming.follow import CHUNKS, TAILS, assemble_partial_lines


def test_a_batch_of_chunks_is_shuffled_few_times(spark, tmp_path):
    spark.createDataFrame([("s", "002", "b\r"), ("s", "003", "\nc\n\nd"), ("t", "001", "x\r")], CHUNKS).write.parquet(str(tmp_path / "chunks"))
    spark.createDataFrame([("s", 4, "a", "001"), ("idle", 2, "\r", "009")], TAILS).write.parquet(str(tmp_path / "tails"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines, left = assemble_partial_lines(*(spark.read.parquet(str(tmp_path / name)) for name in ("chunks", "tails")))
        shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for df in (lines, left)]
        assert sorted(map(tuple, lines.collect())) == [("s", 5, "ab"), ("s", 6, "c"), ("s", 7, "")]
        assert sorted(map(tuple, left.collect())) == [("idle", 2, "\r", "009"), ("s", 7, "d", "003"), ("t", 0, "x\r", "001")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # rows of a source once for the tails, and for the lines in both branches, beside the places of the chunks
    assert shuffles[1] == 1 and shuffles[0] <= 4
