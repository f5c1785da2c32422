"""Mixing sources to target weights by the cube method.

A source's share of the mix over its size is r, between 0 and 2. Each of its documents is taken floor(r) times, and once more with
probability r - floor(r). These probabilities are moved by the cube method: among three undecided documents, along the
direction that keeps both the sum of probabilities and the sum of words, until one of them is 0 or 1. What remains is
at most two undecided documents in each chunk; they are chunked again, round by round, until one chunk for each source
is left, and its last documents are landed on the choice nearest to the word total.

Chunks are dealt by a hash of the id and hold about ``CHUNK`` rows of two numbers each, so a source of any size is many
small groups; only round totals reach the driver. Random steps are seeded by source, chunk and round: reruns agree.

Cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, the last one; equal rows are decided each on
its own; sizes all 0 give targets 0; an empty table gives no rows; other columns are not read by ``mix``; ``repeat_taken`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import ship, table
from logwarden.session import materialise

#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
CHUNK = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Per source (``key``: a null flag and the name): place, source_size, n_docs, target.

    Targets above ``most`` times the size stop there, and the excess is shared again by weight; each such round is one aggregate.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = totals.sort("key").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    places = materialise(spark.createDataFrame(ordered, "key struct<missing:boolean,name:string>, source_size long, n_docs long, place long").withColumn("weight", weight), "sources")
    cap = F.col("source_size") * float(most)
    total = places.agg(F.sum("source_size")).first()[0] or 0
    factor, left = 0.0, share * float(total)
    while total:
        # sources that stop at the factor so far keep their cap; the rest shares what the caps leave
        full = F.col("weight") * F.lit(factor) >= cap
        row = places.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            factor = float("inf")
            break
        new = (left - (row["capped"] or 0.0)) / row["open"]
        if new <= factor * (1 + 1e-12):
            break
        factor = new
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.lit(factor), cap))
    return places.withColumn("target", target)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities until at most two are undecided; their sum and the sum of p * size stay."""
    p = [float(x) for x in p]
    scale = float(max(size.max(initial=0), 1))
    a = [float(x) / scale for x in size]
    draws = iter(rng.random(len(p) + 8).tolist())
    waiting = iter([i for i, x in enumerate(p) if 0 < x < 1])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) < 3:
            return np.array(p)
        i, j, k = active
        u = (a[k] - a[j], a[i] - a[k], a[j] - a[i])  # null vector of the rows (1, 1, 1) and (a_i, a_j, a_k)
        if max(map(abs, u)) < 1e-15:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for x, d in zip(active, u):
            p[x] += step * d
            p[x] = 0.0 if p[x] < 1e-9 else 1.0 if p[x] > 1 - 1e-9 else p[x]
        active = [x for x in active if 0 < p[x] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The choice of the at most two undecided ones that is nearest to the word total, then to the number of documents.

    Where they are large, single documents of the last chunk change sides while that brings the word total nearer.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for choice in range(1 << len(open_)):
        picks = np.array([choice >> i & 1 for i in range(len(open_))], float)
        off = (abs(((picks - p[open_]) * size[open_]).sum()), abs((picks - p[open_]).sum()), choice)
        if best is None or off < best[0]:
            best = (off, picks)
    aim = (p * size).sum()
    p = p.copy()
    p[open_] = best[1]
    while len(p):
        off = (p * size).sum() - aim
        flipped = np.abs(off + np.where(p > 0, -size, size))
        if flipped.min() > abs(off) - 0.5:
            break
        p[flipped.argmin()] = 1 - p[flipped.argmin()]
    return p


def _mover(turn: int, last: bool, columns: list[str]):
    """The flight of one chunk, and in the last turn its landing."""

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        # large ones first: what is left to land is small
        rows = rows.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng([int(rows["place"].iloc[0]), int(rows["chunk"].iloc[0]), turn])
        size = rows["size"].to_numpy(float)
        p = flight(rows["p"].to_numpy(float), size, rng)
        return rows.assign(p=land(p, size) if last else p)[columns]

    return move


def balanced_sample(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``units`` (place, doc_id, size, n_docs, p) with each p moved to 0 or 1 so that each place keeps its sums of p and of p * size."""
    ship(units.sparkSession)
    columns = units.columns
    decided: list[DataFrame] = []
    left, count, turn = units, F.col("n_docs"), 0
    while True:
        chunks = F.greatest(F.ceil(count / F.lit(chunk)), F.lit(1))
        last = units.agg(F.max(chunks)).first()[0] in (None, 1)
        dealt = left.withColumn("chunk", F.when(chunks == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(turn)), chunks)).cast("long"))

        move = _mover(turn, last, columns)
        moved = materialise(dealt.withColumn("h", F.xxhash64("doc_id")).groupBy("place", "chunk").applyInPandas(move, left.schema), "flight")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(moved.where(~undecided))
        if last:
            out = decided[0]
            for df in decided[1:]:
                out = out.unionByName(df)
            return out
        left, count, turn = moved.where(undecided), 2 * chunks, turn + 1


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken."""
    source = F.col(source_col).cast("string")
    key = F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name")).alias("key")
    sizes = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), key, word_count(text_col).alias("size")), "sizes")
    targets = materialise(source_targets(sizes, weights, share), "targets")
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    whole = F.floor(rate + F.lit(1e-12))
    rows = sizes.join(targets, "key").select("place", "doc_id", "size", "n_docs", "source_size", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("p"))
    picked = balanced_sample(rows)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return picked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_taken(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` with all their columns, each as often as the mix takes it.

    The slim table of copies is hashed for each partition, and the texts stream past it. Only where an id occurs more than once
    are the rows of an id numbered, so that each finds its own decision.
    """
    taken = mixed.select("doc_id", "size", "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("size"))
    names = [F.col("row")[c].alias(c) for c in docs.columns]
    if taken.groupBy("doc_id").count().where("count > 1").isEmpty():
        copies = taken.select(F.col("doc_id").alias("taken_id"), "copies").where("copies > 0")
        joined = rows.join(copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("taken_id")))
    else:
        number = lambda order: F.row_number().over(Window.partitionBy("doc_id", "size").orderBy(order))
        copies = taken.withColumn("number", number("copies")).select(F.col("doc_id").alias("taken_id"), F.col("size").alias("taken_size"), F.col("number").alias("taken_number"), "copies")
        rows = rows.withColumn("number", number(F.hash("row")))
        joined = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("size") == F.col("taken_size")) & (F.col("number") == F.col("taken_number")))
    return joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the mix of all ``documents`` by source weights."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
