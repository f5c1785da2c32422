"""Whole sets of op2_jaccard move as often for small inputs as for large ones, and are not written."""

import random
import re

import pytest
from pyspark.sql import DataFrameWriter

from logwarden.llm.op2_jaccard import near_duplicates


@pytest.mark.parametrize("threshold", ["10m", "-1"])  # slim sides small enough to broadcast, and not
def test_whole_sets_are_shuffled_twice_and_never_written(spark, monkeypatch, threshold):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 80, 9)] + ["a text that is like no other one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, written, write = [], [], DataFrameWriter.parquet

    def watch(self, path, *args, **options):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans.append(self._df._jdf.queryExecution().explainString(mode))
        written.extend(self._df.columns)
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: 0 if i < len(texts) - 1 else i for i in range(len(texts))}
    assert len(re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[[^\]]*shingles", "\n".join(plans))) == 2
    assert "shingles" not in written
