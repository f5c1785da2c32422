"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate so that all have the length of the longest one; nearest in distance is then best
in inner product. Each vector is keyed by its nearest pivot and its distance to it, and the keys of a pivot are cut into
sorted annuli. A query visits annuli in the order of the least distance that the triangle inequality leaves, in
growing rounds, and stops when that distance is above its k-th best so far. All rows are indexed; only the pivots and the cuts come
from a bounded sample (``SAMPLE`` rows of smallest id hash for each of at most ``PIVOTS`` pivots), and what reaches the driver is one row for each annulus.

Annuli that follow each other are stored together as shelves of bounded bytes; a large annulus is several shelves. A query goes once to each shelf that it visits in a round, with a bit for each
annulus of the shelf, so what moves follows queries times shelves, not queries times annuli. Queries meet a shelf in packets of bounded bytes, and products are made for bounded pieces of a packet,
so a hot pivot or a vector that a third of the rows share is many small tasks. Vectors are kept in 2, 4 or 8 bytes a component, as the largest one needs. Of equal vectors only the k + 1 smallest ids can
be among the best, so the others are not indexed; no result is lost.

Scores are exact integers. Cases: rows with a null id, or a vector that is null or holds a null or a non-finite component, take no part;
equal rows count once; an id with two vectors is searched by each and has the best of both, and none of its rows is its candidate; vectors of other lengths count as ended by zeros; fewer than k
candidates are all returned; an empty table gives no rows; a component or a score that does not fit a signed 64-bit integer is an error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import hash_share, map_batches, ship, table, written_once

K = 5
SCALE = 256.0
#: Least and most pivots; between them a quarter of the square root of the rows.
PIVOTS = (48, 512)
ANNULI = 12
#: Rows of the sample for each pivot.
SAMPLE = 125
#: Shelves of a table whose shelves are smaller than ``SHELF_BYTES``, and the least vectors of such a shelf.
SHELVES = 64
SHELF_ROWS = 512
SHELF_BYTES = 1 << 22
#: Bytes of the queries that meet a shelf together.
PACKET_BYTES = 1 << 22
#: Bytes of queries that one batch of probes may hold.
PROBE_BYTES = 1 << 24
#: Products that are made at once.
CELLS = 1 << 20
#: Annuli that a query visits in each round; the last round takes all that are left.
ROUNDS = (4, 24)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id and the vector's floor(scale * x) as packed 64-bit integers, without rows that take no part."""

    def pack(batch: pa.RecordBatch) -> dict:
        ids, packed = [], []
        column = batch.column(1)
        for i, at in zip(batch.column(0).to_pylist(), range(len(column))):
            v = column[at].values
            if v is None or v.null_count:
                continue
            x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                if len(x) and not -(2.0**63) <= x.min() <= x.max() < 2.0**63:
                    raise OverflowError(f"vector {i} has a component beyond 64 bits")
                x = np.trim_zeros(x, "b").astype("<i8")
                ids.append(i)
                packed.append(x.tobytes())
        return {"vec_id": pa.array(ids, pa.int64()), "v": pa.array(packed, pa.binary())}

    known = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    return map_batches(known, pack, "vec_id long, v binary")


def _matrix(packed: Iterable[bytes], width: int, kind: type | str = float, stored: str = "<i8") -> np.ndarray:
    rows = [np.frombuffer(x, stored) for x in packed]
    out = np.zeros((len(rows), width), kind)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x[:width]
    return out


def _stored(most: int) -> str:
    """The smallest type for integers of absolute value ``most``."""
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _kind(most: int) -> type:
    """A type whose products and sums are exact while their absolute values add up to ``most`` at most."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = q @ x.T
    if s.dtype == object and s.size:
        if int(s.max()) >= 2**63 or int(s.min()) < -(2**63):
            raise OverflowError(f"a score is beyond 64 bits: {s.max()}, {s.min()}")
        return s.astype(np.int64)
    return s


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of 64-bit integers, as 64-bit integers."""
    kind = _kind(_most(q) * _most(x) * q.shape[1])
    return _exact(q.astype(kind), x.astype(kind)).astype(np.int64)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, the smaller id first where scores are equal."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def best_of_shelf(query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, needed: np.ndarray, ids: np.ndarray, x: np.ndarray, annuli: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k best of each query in its annuli of a shelf, none below its ``least``.

    ``needed``: for each query and annulus of the shelf whether it is visited; ``annuli``: the annulus of each vector, counted from the first one of the shelf, in order.
    """
    kind = _kind(_most(q) * _most(x) * q.shape[1])
    q, x = q.astype(kind), x.astype(kind)
    edges = np.searchsorted(annuli, np.arange(needed.shape[1] + 1))
    found = [(np.empty(0, np.int64),) * 3]
    for j, (start, stop) in enumerate(zip(edges[:-1], edges[1:])):
        chosen = np.flatnonzero(needed[:, j]) if stop > start else np.empty(0, np.int64)
        own_ids, own = ids[start:stop], x[start:stop]
        step = max(1, CELLS // max(stop - start, 1))
        for lo in range(0, len(chosen), step):
            rows = chosen[lo : lo + step]
            s = _exact(q[rows], own)
            at_least = least[rows].astype(s.dtype)
            if stop - start > 4 * k and (least[rows] == -(2**63)).any():  # without a bound from before: the k-th best here
                others = np.where(query_ids[rows][:, None] == own_ids[None, :], at_least.min(), s)
                at_least = np.maximum(at_least, np.partition(others, -k, axis=1)[:, -k])
            a, b = np.nonzero(s >= at_least[:, None])
            other = query_ids[rows[a]] != own_ids[b]
            a, b = a[other], b[other]
            found.append(_first(rows[a], own_ids[b], s[a, b].astype(np.int64), k))
    return _first(*[np.concatenate(c) for c in zip(*found)], k)


def slack(longest: float, width: int) -> float:
    """How far a distance can be off: the roundings of its square, at most the sum of ``width`` + 8 terms of squared length ``longest``, for each distance of a bound."""
    return 6.0 * np.sqrt(np.finfo(float).eps * (width + 8) * longest)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that each row has the squared length ``longest``."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))


def choose_pivots(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centres of a few rounds of k-means, started from rows far from each other."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(5)
    centres = x[:1]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(n, len(x)) and near.max() > 0:
        pick = rng.choice(len(x), p=near / near.sum())
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    for _ in range(rounds):
        own = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


class PivotIndex:
    """Shelves of vectors by annulus, and the directory of the annuli."""

    def __init__(self, vectors: DataFrame, k: int = K, pivots: int | None = None, annuli: int = ANNULI, sample: int = SAMPLE):
        spark = vectors.sparkSession
        ship(spark)
        self.k, self.spark = k, spark
        longest, self.width, rows, most = _bounds(vectors)
        self.longest, self.width, self.stored = longest, max(self.width, 1), _stored(most)
        pivots = pivots or min(max(PIVOTS[0], int(rows**0.5 / 4)), PIVOTS[1])
        sample *= pivots
        some = hash_share(vectors, "vec_id", sample, rows).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v").to_pylist()
        lifted = _lift(_matrix(dict.fromkeys(some), self.width), self.longest)
        self.pivots = choose_pivots(lifted, pivots)
        near = _distances(lifted, self.pivots)
        own, dist = near.argmin(1), near.min(1)
        self.cuts = [np.unique(np.quantile(dist[own == p], np.linspace(0, 1, annuli + 1)[1:-1])) if (own == p).any() else np.empty(0) for p in range(len(self.pivots))]
        copies = Window.partitionBy("v").orderBy("vec_id")
        self._deal(vectors.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1))

    def _deal(self, vectors: DataFrame) -> None:
        width, longest, stored = self.width, self.longest, self.stored
        shared = self.spark.sparkContext.broadcast((self.pivots, self.cuts))

        def key(batch: pa.RecordBatch) -> dict:
            pivots, cuts = shared.value
            packed = batch.column(1).to_pylist()
            near = _distances(_lift(_matrix(packed, width), longest), pivots)
            own, dist = near.argmin(1), near.min(1)
            ring = [int(np.searchsorted(cuts[p], d)) for p, d in zip(own, dist)]
            return {"pivot": pa.array(own, pa.int32()), "ring": pa.array(ring, pa.int32()), "dist": pa.array(dist), "vec_id": batch.column(0), "v": _narrowed(packed, stored)}

        keyed = written_once(map_batches(vectors.select("vec_id", "v"), key, "pivot int, ring int, dist double, vec_id long, v binary", rows=1000), "keyed")
        found = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).orderBy("pivot", "ring").collect()
        #: one row for each annulus: pivot, least and largest distance
        self.directory = [(r["pivot"], r["near"], r["far"]) for r in found]
        #: the annuli of each shelf: the first, and the one after the last
        self.shelves, first = shelves_of([r["n"] for r in found], width * np.dtype(stored).itemsize)
        slots = [(r["pivot"], r["ring"], i, *first[i]) for i, r in enumerate(found)]
        slots = self.spark.createDataFrame(slots, "pivot int, ring int, annulus int, shelf int, parts int")

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["annulus", "vec_id"])
            x = _matrix(rows["v"], width, stored, stored)
            return pd.DataFrame({"shelf": rows["shelf"].iloc[:1].to_numpy(), "annuli": [rows["annulus"].to_numpy("<i4").tobytes()], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "vectors": [x.tobytes()]})

        dealt = keyed.join(F.broadcast(slots), ["pivot", "ring"]).withColumn("shelf", F.col("shelf") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        packed = dealt.select("shelf", "annulus", "vec_id", "v").groupBy("shelf").applyInPandas(pack, "shelf int, annuli binary, ids binary, vectors binary")
        self.blocks = written_once(packed, "blocks")

    def search(self, queries: DataFrame) -> DataFrame:
        """Per query (vec_id, v) its best candidates with another id: query_id, rank, vec_id, score."""
        k, width, longest, stored = self.k, self.width, self.longest, self.stored
        queries = queries.select(F.col("vec_id").alias("query_id"), "v").distinct()
        sent = _stored(_bounds(queries)[3])
        row_bytes = width * np.dtype(sent).itemsize
        shared = self.spark.sparkContext.broadcast((self.pivots, np.array(self.directory, float).reshape(-1, 3), self.shelves))
        best: DataFrame | None = None
        for lo, hi in zip((0, *ROUNDS), (*ROUNDS, len(self.directory))):
            if lo >= len(self.directory):
                break
            # the k-th best score so far bounds the distance of what can still be among the best
            if best is None:
                todo = queries.withColumn("least", F.lit(None).cast("long"))
            else:
                todo = queries.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left")

            def probe(batch: pa.RecordBatch, lo: int = lo, hi: int = hi) -> dict:
                pivots, directory, shelves = shared.value
                packed, least = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                q = _matrix(packed, width)
                needed = np.zeros((len(q), len(directory)), bool)
                for i in range(len(q)):
                    # row by row, so that the order is the same in each round
                    d = np.sqrt(((pivots - np.append(q[i], 0)) ** 2).sum(1))[directory[:, 0].astype(int)]
                    bound = np.maximum(np.maximum(d - directory[:, 2], directory[:, 1] - d), 0)
                    order = np.lexsort((np.abs(d), bound))[lo:hi]
                    if least[i] is not None:
                        reach = np.sqrt(max((q[i] ** 2).sum() + longest - 2.0 * least[i], 0))
                        order = order[bound[order] <= reach + slack(longest, width)]
                    needed[i, order] = True
                rows, places, masks = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
                for s, (a, z) in enumerate(shelves):
                    own = np.flatnonzero(needed[:, a:z].any(1))
                    rows.append(own)
                    places.append(np.full(len(own), s))
                    masks += [x.tobytes() for x in np.packbits(needed[own, a:z], axis=1, bitorder="little")]
                at = pa.array(np.concatenate(rows))
                return {"shelf": pa.array(np.concatenate(places), pa.int32()), "query_id": batch.column(0).take(at), "v": _narrowed(packed, sent).take(at), "least": batch.column(2).take(at), "mask": pa.array(masks, pa.binary())}

            together = max(1, min(1000, PROBE_BYTES // (row_bytes * len(self.shelves))))
            probes = written_once(map_batches(todo.select("query_id", "v", "least"), probe, "shelf int, query_id long, v binary, least long, mask binary", rows=together), "probes")
            load = probes.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(max(1, PACKET_BYTES // row_bytes))).alias("packets"))  # at most one row for each shelf
            packets = probes.join(F.broadcast(load), "shelf").withColumn("packet", F.pmod(F.xxhash64("query_id"), F.col("packets"))).drop("packets")
            # a shelf goes to each of its packets, so a shelf that many queries visit is as many keys
            blocks = self.blocks.join(F.broadcast(load), "shelf").withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packets") - 1))).drop("packets")

            def score(packet: pa.Table, block: pa.Table) -> pa.Table:
                out = [(np.empty(0, np.int64),) * 3]
                if packet.num_rows and block.num_rows:
                    first, after = shared.value[2][packet.column("shelf")[0].as_py()]
                    query_ids = packet.column("query_id").to_numpy()
                    q = _matrix(packet.column("v").to_pylist(), width, sent, sent)
                    least = packet.column("least").fill_null(-(2**63)).to_numpy()
                    masks = np.frombuffer(b"".join(packet.column("mask").to_pylist()), np.uint8).reshape(len(q), -1)
                    needed = np.unpackbits(masks, axis=1, count=after - first, bitorder="little").astype(bool)
                    annuli, ids, vectors = (block.column(c)[0].as_py() for c in ("annuli", "ids", "vectors"))
                    x = np.frombuffer(vectors, stored).reshape(-1, width)
                    row, near, s = best_of_shelf(query_ids, q, least, needed, np.frombuffer(ids, "<i8"), x, np.frombuffer(annuli, "<i4") - first, k)
                    out.append((query_ids[row], near, s))
                return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)))))

            found = packets.groupBy("shelf", "packet").cogroup(blocks.groupBy("shelf", "packet")).applyInArrow(score, "query_id long, vec_id long, score long")
            if best is not None:
                found = found.unionByName(best.select("query_id", "vec_id", "score"))
            ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            best = written_once(found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k), "best")
        if best is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        return best.select("query_id", "rank", "vec_id", "score")


def _bounds(vectors: DataFrame) -> tuple[float, int, int, int]:
    """Of rows with a vector v: the largest squared length, the most components, the number of rows, the largest absolute value of a component."""

    def bounds(batch: pa.RecordBatch) -> dict:
        x = [np.frombuffer(v, "<i8") for v in batch.column(0).to_pylist()]
        most = [min(_most(v), 2**63 - 1) for v in x]
        return {"norm": pa.array([float((v.astype(float) ** 2).sum()) for v in x], pa.float64()), "width": pa.array([len(v) for v in x], pa.int32()), "most": pa.array(most, pa.int64())}

    r = map_batches(vectors.select("v"), bounds, "norm double, width int, most long").agg(F.max("norm"), F.max("width"), F.count("*"), F.max("most")).first()
    return r[0] or 0.0, r[1] or 0, r[2], r[3] or 0


def _narrowed(packed: list[bytes], stored: str) -> pa.Array:
    return pa.array([np.frombuffer(v, "<i8").astype(stored).tobytes() for v in packed], pa.binary())


def shelves_of(sizes: list[int], row_bytes: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The range of annuli of each shelf, and for each annulus its first shelf and their number; annuli share a shelf or have several for themselves."""
    rows = max(1, min(max(SHELF_ROWS, -(-sum(sizes) // SHELVES)), SHELF_BYTES // row_bytes))
    shelves: list[tuple[int, int]] = []
    first, held = [], 0
    for i, n in enumerate(sizes):
        if n > rows:
            parts = -(-n // rows)
            first.append((len(shelves), parts))
            shelves += [(i, i + 1)] * parts
            held = rows  # the next annulus begins a shelf
            continue
        if not shelves or held + n > rows:
            shelves.append((i, i))
            held = 0
        held += n
        shelves[-1] = (shelves[-1][0], i + 1)
        first.append((len(shelves) - 1, 1))
    return shelves, first


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the five best inner products of each vector whose id is divisible by 50, among all other rows."""
    ship(spark)
    vectors = written_once(integer_vectors(table(spark, sf_dir, "embeddings")).distinct(), "vectors")
    return PivotIndex(vectors).search(vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
