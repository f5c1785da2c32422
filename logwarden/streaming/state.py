"""Keyed state of a live run: rows by (rule, ip) in hash buckets, of which a batch touches only those that its keys fall into.

A batch appends its own rows as one piece for each bucket it hits, so what it writes follows the batch and not the run. A bucket
that has gathered ``fold_after`` pieces is folded into one when a batch hits it again: rows that say the same are merged and
rows that no window can need are dropped. Pieces are never changed once written, and each batch leaves the list of pieces that
are valid after it, so a batch that is run again replaces its own pieces and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from logwarden.streaming.live import LiveRun

KEY = ["rule", "ip"]
PIECES = "bucket INT, batch BIGINT"


class KeyedLog:
    """One keyed table of a run; ``schema`` begins with ``rule INT, ip STRING``.

    The list of pieces has at most ``buckets * fold_after`` rows, two numbers each, whatever the run's length.
    """

    def __init__(self, run: LiveRun, name: str, schema: str, *, buckets: int = 64, fold_after: int = 8) -> None:
        self.run = run
        self.name = name
        self.schema = schema
        self.buckets = buckets
        self.fold_after = fold_after

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}  # at most ``buckets`` rows

    def _pieces(self, batch_id: int) -> set[tuple[int, int]]:
        """(bucket, batch) of the pieces that are valid after a batch."""
        return {(r["bucket"], r["batch"]) for r in self.run._left_by(f"{self.name}_pieces", PIECES, batch_id + 1).collect()}

    def _path(self, piece: tuple[int, int]) -> str:
        return f"{self.run._path(self.name, piece[1])}/bucket={piece[0]}"

    def _rows(self, pieces: set[tuple[int, int]]) -> DataFrame:
        spark = self.run.spark
        if not pieces:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self._path(p) for p in sorted(pieces)])

    def read(self, batch_id: int, hit: set[int]) -> DataFrame:
        """Rows that the batches before left in the buckets ``hit``; keys beside those of the batch are among them."""
        return self._rows({p for p in self._pieces(batch_id - 1) if p[0] in hit})

    def append(self, rows: DataFrame, batch_id: int, hit: set[int], fold: Callable[[DataFrame], DataFrame], *, sweep: bool = False) -> None:
        """Leave ``rows`` for later batches; ``hit`` holds at least their buckets.

        ``sweep``: fold one more bucket in turn, so that each is folded within ``buckets`` batches though no key of it comes again.
        """
        before = self._pieces(batch_id - 1)
        many = {b for b in hit if sum(p[0] == b for p in before) >= self.fold_after}
        if sweep:
            many |= {batch_id % self.buckets} & {p[0] for p in before}
        old = {p for p in before if p[0] in many}
        placed = rows.select("*", self.bucket().alias("bucket"))
        if many:
            again = fold(self._rows(old).unionByName(placed.where(F.col("bucket").isin(many)).drop("bucket")))
            placed = placed.where(~F.col("bucket").isin(many)).unionByName(again.select("*", self.bucket().alias("bucket")))
        path = self.run._path(self.name, batch_id)
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        # a bucket whose rows all fell away has no folder
        written = {(b, batch_id) for b in (hit | many) if self.run._exists(f"{path}/bucket={b}")}
        after = (before - old) | written
        self.run._write(self.run.spark.createDataFrame(sorted(after), PIECES).coalesce(1), f"{self.name}_pieces", batch_id)

    def forget(self, batch_id: int) -> None:
        """Delete pieces that no batch can ask for again."""
        # a batch that is run again may have deleted them before
        if batch_id >= 2 and self.run._exists(self.run._path(f"{self.name}_pieces", batch_id - 2)):
            for piece in self._pieces(batch_id - 2) - self._pieces(batch_id - 1) - self._pieces(batch_id):
                self.run._delete(self._path(piece))
            self.run._forget(f"{self.name}_pieces", batch_id)
