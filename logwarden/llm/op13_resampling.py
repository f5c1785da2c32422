"""Importance resampling towards a target distribution, with segments deduplicated.

Features are the words of a text and its pairs of consecutive words, hashed into buckets. A bucket's gain is the logarithm of how much more often the target has it than the documents; a document's
weight is the mean of its features' gains, and a draw without replacement follows from weights plus noise (the highest scores of ``weight + Gumbel``).

1. A newline separates words, so no feature crosses one but the pair of the last word before it and the first word behind it. Texts are cut into lines, equal lines are counted (each task sums up what
   it has seen before anything moves), and the features of each different line are hashed once and kept.
2. Counts of buckets are those of the different lines times their occurrences, plus the pairs that cross lines, which are hashed for each document apart.
3. Gains are made from the counts of buckets, a table of fixed size. Each different line has one sum of gains, and documents add up those of their lines and of their crossing pairs. Lines
   that a thousandth of all lines or more repeat are sent to the documents, all others meet by digest, so no task holds one line's documents.
4. Scores are ranked by ranges: sorted in many tasks, with the number of rows before each range added.

Cases: null and empty texts and texts without a word have no features and weight 0; a null id is hashed as an empty one and sorts behind all others of its score; repeated rows are ranked one by one; ties
go to the smaller id; texts and lines may be of any length; an empty table gives no rows and an empty target makes all its counts 0; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import join_spread, ship, table
from logwarden.llm.text import text_of
from logwarden.session import materialise

BUCKETS = 10_000
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: Rows of a table that are hashed together.
ROWS = 500
#: Longer words are hashed one by one.
LONG_WORD = 48

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of UTF-8: its bytes beyond ASCII are all of words
_FIRST = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
_SOLID = np.array([bool(_FIRST.match(bytes([b]))) for b in range(256)])

_POLYNOMIAL = 0xEDB88320


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The step of a crc32 register by one byte, and for each number of bytes up to ``LONG_WORD`` what each byte of a crc becomes when so many zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
    shift = np.empty((LONG_WORD + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONG_WORD + 1):
        shift[n] = step[shift[n - 1] & 255] ^ (shift[n - 1] >> np.uint32(8))
    return step, shift


_STEP, _SHIFT = _crc_tables()


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word ``data[start:end]``."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], length[order]
    register = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-left, -LONG_WORD, "left"))  # words longer than that come first
    for r in range(long):
        register[r] = zlib.crc32(data[at[r] : at[r] + left[r]].tobytes()) ^ 0xFFFFFFFF
    for k in range(LONG_WORD):
        live = int(np.searchsorted(-left, -k, "left"))  # words of more than k bytes
        if live <= long:
            break
        own = register[long:live]
        register[long:live] = _STEP[(own ^ data[at[long:live] + k]) & 255] ^ (own >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def pair_crcs(data: np.ndarray, crcs: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """crc32 of the words ``left`` and ``right`` (places in ``crcs``) with a space between them, put together from their own."""
    inner = crcs[left] ^ np.uint32(0xFFFFFFFF)
    spaced = _STEP[(inner ^ np.uint32(32)) & 255] ^ (inner >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    length = ends[right] - starts[right]
    short = np.minimum(length, LONG_WORD)
    moved = _SHIFT[short, 0, spaced & 255] ^ _SHIFT[short, 1, (spaced >> np.uint32(8)) & 255] ^ _SHIFT[short, 2, (spaced >> np.uint32(16)) & 255] ^ _SHIFT[short, 3, spaced >> np.uint32(24)]
    out = moved ^ crcs[right]
    for i in np.flatnonzero(length > LONG_WORD):
        r = right[i]
        out[i] = zlib.crc32(data[starts[r] : ends[r]].tobytes(), int(spaced[i]))
    return out


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one byte array, start and end of each word, and for each text the place of its first word (n + 1 values)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    solid = np.concatenate([[False], _SOLID[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in texts])))
    return data, starts, ends, first


def line_features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each lower-cased line: its words, and the buckets of its words and pairs."""
    data, starts, ends, first = _cut(texts)
    crcs = word_crcs(data, starts, ends)
    pairs = pair_crcs(data, crcs, starts, ends, np.arange(len(crcs) - 1), np.arange(1, len(crcs))) if len(crcs) > 1 else np.empty(0, np.uint32)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield b - a, np.concatenate([crcs[a:b], pairs[a : max(b - 1, a)]]) % np.uint32(buckets)


def crossing_features(text: bytes, buckets: int = BUCKETS) -> tuple[list[bytes], list[int]]:
    """The text's lines that hold a word, and the buckets of the pairs of words on either side of their ends."""
    lines, found, last = [], [], None
    for line in text.split(b"\n"):
        first = _WORDS.search(line)
        if first is None:
            continue
        if last is not None:
            found.append(zlib.crc32(last + b" " + first[0]) % buckets)
        stop = len(line)
        while not _SOLID[line[stop - 1]]:
            stop -= 1
        start = stop
        while start and _SOLID[line[start - 1]]:
            start -= 1
        last = line[start:stop]
        lines.append(line)
    return lines, found


def packed_as(buckets: int) -> str:
    """Bytes of a bucket's number in the tables of features."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


class Segments:
    """The different lines of a table and what its rows hold of them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, buckets: int) -> None:
        self.spark = docs.sparkSession
        ship(self.spark)
        self.buckets = buckets
        text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
        seen = docs.select(F.explode(F.split(text, "\n")).alias("line"))
        counted = seen.where(F.col("line").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).groupBy("line").agg(F.count("*").alias("times"))
        #: digest, times, words, n, buckets of each different line
        self.lines = materialise(counted.mapInArrow(_hash_lines(buckets), "digest binary, times long, words int, n int, buckets binary"), "segment-lines")
        keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        #: row, doc_id, digests and times of its lines, buckets of crossing pairs
        self.rows = materialise(keyed.mapInArrow(_cut_rows(buckets), "row long, doc_id long, digests array<binary>, times array<int>, crossing binary"), "segment-rows")

    def counts(self) -> np.ndarray:
        """How often the table has each bucket."""
        buckets, kind = self.buckets, packed_as(self.buckets)

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                for packed, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if packed:
                        np.add.at(total, np.frombuffer(packed, kind), times)
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

        parts = self.lines.select("buckets", "times").unionByName(self.rows.select(F.col("crossing").alias("buckets"), F.lit(1).cast("long").alias("times")))
        out = np.zeros(buckets, np.int64)
        for r in parts.mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
            out[r["bucket"]] = r["n"]
        return out

    def sums(self, gains: np.ndarray) -> DataFrame:
        """Per row: row, doc_id, n_words, n_features, total (of the gains of its features)."""
        shared, kind = self.spark.sparkContext.broadcast(gains), packed_as(self.buckets)

        def gained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = [int(shared.value[np.frombuffer(x, kind)].sum()) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), *batch.columns[1:]], names=["total", *batch.schema.names[1:]])

        lines = self.lines.select("buckets", "digest", "times", "words", "n").mapInArrow(gained, "total long, digest binary, times long, words int, n int")
        held = self.rows.select("row", F.inline(F.arrays_zip("digests", "times"))).select("row", F.col("digests").alias("digest"), F.col("times").alias("here"))
        facts = materialise(lines, "segment-gains")
        every = facts.agg(F.sum("times")).first()[0] or 0
        met = join_spread(held, facts, "digest", "times", every)
        of_lines = met.groupBy("row").agg(*[F.sum(F.col(c) * F.col("here")).alias(c) for c in ("words", "n", "total")])
        own = self.rows.select("crossing", "row", "doc_id").mapInArrow(gained, "total long, row long, doc_id long").withColumnRenamed("total", "own")
        crossed = own.join(self.rows.select("row", (F.length("crossing") / F.lit(np.dtype(kind).itemsize)).cast("long").alias("pairs")), "row").join(of_lines, "row", "left")
        none = F.lit(0).cast("long")
        return crossed.select(
            "row", "doc_id", F.coalesce("words", none).alias("n_words"), (F.coalesce("n", none) + F.col("pairs")).alias("n_features"), (F.coalesce("total", none) + F.col("own")).alias("total")
        )


def _hash_lines(buckets: int):  # noqa: ANN202
    kind = packed_as(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = [t.encode() for t in part.column(0).to_pylist()]
                words, sizes, packed = [], [], []
                for n, found in line_features(texts, buckets):
                    words.append(n)
                    sizes.append(len(found))
                    packed.append(found.astype(kind).tobytes())
                digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, part.column(1), pa.array(words, pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["digest", "times", "words", "n", "buckets"])

    return run


def _cut_rows(buckets: int):  # noqa: ANN202
    kind = packed_as(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                digests, times, crossing = [], [], []
                for text in text_of(part.column(2)):
                    lines, found = crossing_features(text.encode(), buckets)
                    held: dict[bytes, int] = {}
                    for line in lines:
                        key = hashlib.blake2b(line, digest_size=16).digest()
                        held[key] = held.get(key, 0) + 1
                    digests.append(list(held))
                    times.append(list(held.values()))
                    crossing.append(np.array(found, kind).tobytes())
                columns = [part.column(0), part.column(1), pa.array(digests, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), pa.array(crossing, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "digests", "times", "crossing"])

    return run


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the source, one added to each count."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target)], np.int64)


def ranked(scores: DataFrame) -> DataFrame:
    """Rows of ``scores`` (score, doc_id, row) with ``rank`` from 1, highest score first, then smallest id (null last): sorted in ranges."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    # numbers of this function count up within a task and tell it
    placed = scores.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed.selectExpr("*", "shiftright(place, 33) AS part", f"place & {(1 << 33) - 1}L AS nth"), "ranges")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part AS _part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")
    return placed.join(F.broadcast(before), F.col("part") == F.col("_part")).selectExpr(*scores.columns, "before + nth + 1 AS rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    *,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; of those with ``min_words`` words ``percent`` of a hundred are drawn and ranked."""
    own = Segments(docs, id_col, text_col, buckets)
    wanted = Segments(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", buckets)
    sums = own.sums(gains_of(own.counts(), wanted.counts()))
    # sums and features are whole numbers; ``div`` cuts towards zero, the remainder brings it down
    mean = F.expr("if(n_features = 0, 0L, total div n_features - if(pmod(total, n_features) <> 0 AND total < 0, 1, 0))")
    h = F.expr(f"cast(conv(left(sha2(concat('{seed}:', coalesce(cast(doc_id AS STRING), '')), 256), 8), 16, 10) AS DOUBLE)")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(sums.withColumn("weight", mean).withColumn("score", F.col("weight") + noise), "scores")
    entered = scored.where(F.col("n_words") >= min_words)
    take = percent * entered.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(entered.select("row", *columns)).select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: ``documents`` drawn towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
