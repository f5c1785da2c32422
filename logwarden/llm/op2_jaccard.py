"""N-gram Jaccard join by grouped prefixes, and its classes of near duplicates.

A document is the set of its word shingles (64-bit hashes). Sets are ordered by one rule for all: shingles of rarer
hash slots first (slots are counted over all documents in a sketch of fixed size), then by hash. Two sets of similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, their prefixes.

1. Equal sets become one node; nodes with the same prefix and size become one group.
2. Prefix shingles of groups travel in packets to their hash bucket. Groups that share a shingle are a list; equal lists count once.
3. A group stays in a list only if, by the sizes in the list and the prefix shingles that it shares at all, a pair of it can be similar enough.
   Members of the groups that are left are verified in blocks of about ``BLOCK`` nodes, every pair of a block by exact counts of common shingles, and a block gives one link for each node at
   most. What lists connect is a cluster; a cluster of one
   block is done, a larger one is cut into blocks by two hashes. What links do not join then is checked
   list by list, or over the whole cluster where that moves fewer rows: each node outside the largest class meets every node in some block. Pairs inside a class need no check.
4. Prints go to a block before sets do. A print has a bit for each place of a map of n to 2 n places (64 at least) that an odd number of the n shingles fall on, so two prints differ in no more places than
   their sets do in shingles. Pairs whose prints differ in too many are out, and a node without a pair in its block leaves it: texts that share shingles by chance, whose number grows faster than the
   texts, cost a fortieth of their sets.
5. Whole sets are made again, for nodes that are left; they meet the places of their nodes once, whatever the size of either side, and go to their blocks without being written.

So no link between different texts is lost, and a group of many near copies costs a few blocks, not all its pairs. Driver: the levels of the sketch and a bitmap
of fixed size; everything else stays in tables.

Cases: texts without a word are empty sets, linked with nothing; with fewer words than a shingle has, the whole sequence is one; a null id has n_shingles, no component,
and links nothing; equal rows are copies of each other; where rows of one id hold different texts, each is a node and they belong together, so what one of them links to is in the class of all;
texts may be of any length; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import ship, table, written_once
from logwarden.llm.text import hash_words, mix, utf8

WORDS = 5
#: Least similarity in hundredths.
PERCENT = 80
#: Least and most slots of the sketch that orders shingles, as powers of two; one byte each reaches the tasks.
SKETCH_BITS = (16, 24)
_SKETCH_PARTS = 64
#: Bits of the map of documents that need their sets again, as a power of two.
MAP_BITS = 23
#: Rows whose prefixes make one set of packets.
PACKET_ROWS = 20_000
#: Nodes that are checked together.
BLOCK = 400


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    hashes, firsts = hash_words(*utf8(column))
    joined = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(joined)] + np.uint64(k + 1))
    for a, b in zip(firsts[:-1], firsts[1:]):
        n = int(b - a)
        if n >= words:
            yield np.unique(joined[a : b - words + 1])
        elif n:
            h = np.full(1, n, np.uint64)
            for x in hashes[a:b]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
            yield h
        else:
            yield np.empty(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The set's first shingles in the common order."""
    n = prefix_length(len(shingles), percent)
    bits = len(levels).bit_length() - 1
    own = levels[(shingles >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    # one number to sort by: the level, then the hash without its last bits
    order = np.argsort((own << np.uint64(56)) | (mix(shingles) >> np.uint64(8)), kind="stable")
    return shingles[order[:n]]


def parity_print(shingles: np.ndarray) -> bytes:
    """The places (last bits of the hash) that an odd number of shingles fall on; n to 2 n places, 64 at least."""
    width = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    times = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def possible_pairs(sizes: np.ndarray, prints: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """For each pair of sets whether their prints and sizes leave it possible that they are similar enough."""
    m, words = len(sizes), [np.frombuffer(x, "<u8") for x in prints]
    width = np.array([len(x) for x in words])
    out = np.zeros((m, m), bool)
    for w in np.unique(width):  # a longer print is folded to the shorter one's places
        own = np.flatnonzero(width == w)
        other = np.flatnonzero((width >= w) & (percent * sizes <= 100 * sizes[own].max()))
        folded = np.stack([np.bitwise_xor.reduce(words[i].reshape(-1, w), 0) for i in other])
        for i in own:
            both = sizes[i] + sizes[other]
            need = -(-percent * both // (100 + percent))
            near = np.bitwise_count(folded ^ words[i]).sum(1, dtype=np.int64) <= both - 2 * need
            near &= need <= np.minimum(sizes[i], sizes[other])
            out[i, other] |= near
            out[other, i] |= near
    np.fill_diagonal(out, False)
    return out


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that links reach."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)), label)
        new = np.minimum(new[new], new)
        if (new == label).all():
            return label
        label = new


def _sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slot_levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Level of each slot: four times the binary logarithm of the documents' distinct shingles in it.

    There are 64 slots for each document, within the bounds of ``SKETCH_BITS``. A task's count of a slot stops at 255: levels
    only order the shingles, and any order gives the same classes.
    """
    ship(docs.sparkSession)
    low, high = SKETCH_BITS
    bits = min(max((64 * docs.count()).bit_length(), low), high)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in _sliced(batches):
            for s in shingle_sets(batch.column(0), words):
                total[(s >> np.uint64(64 - bits)).astype(np.int64)] += 1  # twice in one slot counts once
        if total.any():
            parts = np.minimum(total, 255).astype(np.uint8).reshape(_SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // _SKETCH_PARTS, np.uint32)
        for x in rows["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "levels": [(4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    counted = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, levels binary")
    got = {r["part"]: np.frombuffer(r["levels"], np.uint8) for r in counted.collect()}
    empty = np.zeros((1 << bits) // _SKETCH_PARTS, np.uint8)
    return np.concatenate([got.get(p, empty) for p in range(_SKETCH_PARTS)])


def _prefixes(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per document: its size, digests of its set and prefix, its print, and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sizes, digests, keys, prints, prefixes = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                p = prefix(s, shared.value, percent).astype("<u8").tobytes()
                sizes.append(len(s))
                digests.append(_digest(s))
                keys.append(hashlib.blake2b(p, digest_size=16).digest())
                prints.append(parity_print(s))
                prefixes.append(p)
            columns = [pa.array(x, pa.binary()) for x in (digests, keys, prints, prefixes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], names=["doc_id", "n", "digest", "prefix_key", "print", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n long, digest binary, prefix_key binary, print binary, prefix binary")


def _lists(groups: DataFrame) -> DataFrame:
    """(list_id, gid, tokens): groups that share a prefix shingle with another group; equal lists once, with the number of their shingles.

    ``groups``: gid, n, prefix.
    """
    buckets = max(32, 4 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, PACKET_ROWS):
            ids = batch.column(0).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            raw = batch.column(2).take(pa.array(by_id)).to_pylist()
            token = np.frombuffer(b"".join(raw), "<u8")
            times = np.array([len(x) // 8 for x in raw], np.int64)
            gid = np.repeat(ids[by_id], times)
            own = (mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(buckets + 1))
            # ids rise within a packet: their steps are small numbers, which the shuffle's compression makes short
            rows = [(b, token[order[lo:hi]].tobytes(), np.diff(gid[order[lo:hi]], prepend=np.int64(0)).astype("<i8").tobytes()) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "gids"])

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([np.frombuffer(x, "<u8") for x in rows["tokens"]])
        gid = np.concatenate([np.cumsum(np.frombuffer(x, "<i8")) for x in rows["gids"]])
        order = np.lexsort((gid, token))
        token, gid = token[order], gid[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        stop = np.append(start[1:], len(token))
        found: dict[int, np.ndarray] = {}
        tokens: dict[int, int] = {}
        for a, b in zip(start[stop - start > 1], stop[stop - start > 1]):
            key = int.from_bytes(hashlib.blake2b(gid[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
            found[key] = gid[a:b]
            tokens[key] = tokens.get(key, 0) + 1
        if not found:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("list_id", "gid", "tokens")})
        sizes = [len(x) for x in found.values()]
        return pd.DataFrame({"list_id": np.repeat(list(found), sizes), "gid": np.concatenate(list(found.values())), "tokens": np.repeat(list(tokens.values()), sizes)})

    dealt = groups.select("gid", "n", "prefix").mapInArrow(packets, "bucket int, tokens binary, gids binary")
    shared = dealt.groupBy("bucket").applyInPandas(share, "list_id long, gid long, tokens long")
    return shared.groupBy("list_id", "gid").agg(F.sum("tokens").alias("tokens"))


def _least_common(a: F.Column, b: F.Column, percent: int) -> F.Column:
    """How many shingles the prefixes of sets of a and b shingles must share.

    Behind the prefix that ends first in the common order its set has n - p shingles left, so the sets share at most that many more.
    """
    need = F.floor((percent * (a + b) + (99 + percent)) / (100 + percent))  # of the whole sets
    left = lambda n: F.floor((percent * n + 99) / 100) - 1  # noqa: E731  n less the length of its prefix
    return need - F.greatest(left(a), left(b))


def _possible(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Group pairs are filtered: a group stays in a list only if some size among the list's lets it share enough prefix shingles."""
    own = written_once(lists.join(sizes, "gid"), "shared")
    total = own.groupBy("gid").agg(F.sum("tokens").alias("common"))
    own = own.join(total, "gid")
    of_list = own.groupBy("list_id").agg(F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("common").alias("least"))
    own = own.join(of_list, "list_id")
    n = F.col("n")
    shortest, longest = F.floor((percent * n + 99) / 100), F.floor(100 * n / percent)  # of the sizes that can be similar enough
    other = F.col("lo") + F.col("hi") - n
    pair = other.between(shortest, longest) & (F.col("least") >= _least_common(n, other, percent))
    # the further the sizes, the fewer shingles are needed, so the ends of the range decide; by the roundings the need can be one less at a size just below the upper end
    low, high = F.greatest("lo", shortest), F.least("hi", longest)
    steps = 100 * (100 + percent) // percent**2  # further below it is never less
    several = F.col("common") >= F.least(_least_common(n, low, percent), *[_least_common(n, F.greatest(low, high - d), percent) for d in range(steps + 1)])
    kept = own.where(F.when(F.col("m") == 2, pair).otherwise(several)).select("list_id", "gid")
    return kept.join(kept.groupBy("list_id").count().where("count > 1").select("list_id"), "list_id", "left_semi")


def _id_map(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** MAP_BITS`` bits of the hashes of ids."""
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << MAP_BITS))
    bits = ids.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8 + 4096, np.uint8)
    for r in bits.collect():  # at most 2 ** MAP_BITS / 32768 rows of 4 KB, and one more
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, placed: DataFrame, words: int, repeated: bool) -> DataFrame:
    """``placed`` (node, rep, digest and others) with the shingles of the node: whole texts are read again, and rows that the bitmap excludes are left out before any shuffle.

    ``repeated``: some ids have several rows, which may be equal.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_id_map(placed.select(F.col("rep").alias("node"))))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in _sliced(batches):
            place = (batch.column(2).to_numpy() - 1) * 32768 + batch.column(3).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7)) & 1 == 1))
            if batch.num_rows:
                digests, sets = [], []
                for s in shingle_sets(batch.column(1), words):
                    digests.append(_digest(s))
                    sets.append(s.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["rep", "digest", "shingles"])

    made = keyed.mapInArrow(make, "rep long, digest binary, shingles binary")
    if repeated:
        made = made.dropDuplicates(["rep", "digest"])  # dealt as the join needs it
    return made.hint("merge").join(placed, ["rep", "digest"])


def block_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Every pair of a block is checked; returns for each class of the block links of its first node to the others."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), sizes)
    shared, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.cumsum(times > 1) - 1
    use = (times > 1)[place]
    owner, column = owner[use], kept[place[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        start, stop = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)  # counts below 4096 are exact
        x[owner[start:stop], column[start:stop] - lo] = 1
        common += (x @ x.T).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    return [(int(nodes[i]), int(nodes[j])) for j, i in enumerate(_least_reached(linked)) if i != j]


def _narrowed(blocks: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Of blocks (list_id, part, node, comp) the nodes that prints leave a pair with a node of another ``comp``; ``sub`` is the least node that such pairs reach in the block."""

    def narrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, {}

        def left() -> list[tuple[int, int, int, int]]:
            if len(own) < 2:
                return []
            nodes = sorted(own)
            comp, sizes, found = zip(*[own[x] for x in nodes])
            pairs = possible_pairs(np.array(sizes, np.int64), list(found), percent) & np.not_equal.outer(np.array(comp), np.array(comp))
            least = _least_reached(pairs)
            return [(*key, nodes[i], nodes[least[i]]) for i in np.flatnonzero(pairs.any(1))]

        for batch in batches:
            rows = []
            for list_id, part, *one in zip(*[c.to_pylist() for c in batch.columns]):
                if (list_id, part) != key:
                    rows += left()
                    key, own = (list_id, part), {}
                own[one[0]] = one[1:]
            if rows:
                yield _longs(rows, ("list_id", "part", "node", "sub"))
        if rows := left():
            yield _longs(rows, ("list_id", "part", "node", "sub"))

    rows = blocks.join(prints, "node").select("list_id", "part", "node", "comp", "n", "print")
    dealt = rows.repartition("list_id", "part").sortWithinPartitions("list_id", "part")
    return dealt.mapInArrow(narrow, "list_id long, part long, node long, sub long")


def _linked(blocks: DataFrame, docs: DataFrame, prints: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) found in blocks (list_id, part, node, comp) of at most a few hundred nodes each, those inside a ``comp`` aside."""
    narrowed = _narrowed(blocks, prints.select("node", "n", "print"), percent)
    placed = written_once(narrowed.join(prints.select("node", "rep", "digest"), "node"), "blocks")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own = None, [], []

        def links() -> list[tuple[int, int]]:
            place = np.unique(np.array(nodes, np.int64), return_index=True)[1] if nodes else []
            return block_links(np.array(nodes, np.int64)[place], [own[i] for i in place], percent) if len(place) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for *block, node, shingles in zip(*[c.to_pylist() for c in batch.columns]):
                if block != key:
                    found += links()
                    key, nodes, own = block, [], []
                nodes.append(node)
                own.append(np.frombuffer(shingles, "<u8"))
            if found:
                yield _longs(found, ("a", "b"))
        if found := links():
            yield _longs(found, ("a", "b"))

    block = ["list_id", "part", "sub"]
    rows = _sets(docs, placed, words, repeated).select(*block, "node", "shingles")
    dealt = rows.repartition(*block).sortWithinPartitions(*block)
    return dealt.mapInArrow(check, "a long, b long")


def _longs(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=list(names))


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that can be reached, for each node of a link. Turns of minima over neighbours and of their labels."""
    both = written_once(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written_once(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        # hooking: the old label learns of the least new label among its nodes, and passes it on to all of them
        hooks = least.groupBy("comp").agg(F.min("new").alias("hook"))
        stepped = least.join(hooks, "comp").select("node", F.least("new", "hook").alias("new"), (F.least("new", "hook") < F.col("comp")).alias("moved"))
        done = written_once(stepped, "labels")
        labels = done.select("node", F.col("new").alias("comp"))
        if done.where("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    described = written_once(_prefixes(rows, slot_levels(rows, words), words, percent), "prefixes")
    slim = described.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest", "prefix_key")
    # numbers once written stay; a text's first id finds it again
    nodes = slim.groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.min("prefix_key").alias("prefix_key"))
    nodes = written_once(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = nodes.groupBy("n", "prefix_key").agg(F.min(F.struct("node", "rep", "digest")).alias("first"), F.count("*").alias("members"))
    groups = groups.select("n", "prefix_key", F.col("first.node").alias("gid"), F.col("first.rep").alias("rep"), F.col("first.digest").alias("own"), "members")
    member = written_once(nodes.join(groups.select("n", "prefix_key", "gid", "members"), ["n", "prefix_key"]).select("gid", "node", "n", "members"), "members")

    # one row for each group: that of its first node; the slim side is hashed and the prefixes stream past it
    first = groups.select("gid", "rep", "own").hint("shuffle_hash")
    grouped = described.join(first, F.col("doc_id") == F.col("rep")).where("digest = own").select("gid", "n", "prefix")
    several = slim.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("digest").alias("a"), F.max("digest").alias("z"))
    several = written_once(several.where("rows > 1").select("doc_id", F.col("a") != F.col("z")).toDF("doc_id", "differ"), "repeated")
    repeated = not several.isEmpty()
    if repeated:
        grouped = grouped.dropDuplicates(["gid"])
    # texts of one id belong together
    of_id = slim.join(several.where("differ"), "doc_id", "left_semi").select("doc_id", "n", "digest").distinct().join(nodes, ["n", "digest"]).select("doc_id", "node")
    same = of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    lists = written_once(_possible(_lists(grouped), groups.select("gid", "n"), percent), "possible")
    # a group of several sets is a list of its own
    own = member.where("members > 1").select(F.xxhash64("gid", F.lit("group")).alias("list_id"), "node")
    listed = lists.join(member, "gid").select("list_id", "node").unionByName(own)
    listed = written_once(listed, "lists")
    return _classes(rows, described, nodes, listed, same, words, percent, repeated)


def _classes(rows: DataFrame, described: DataFrame, nodes: DataFrame, listed: DataFrame, same: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    # what lists connect is a cluster, in which each set moves once or twice however many lists it is in
    star = listed.join(listed.groupBy("list_id").agg(F.min("node").alias("hub")), "list_id").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    cluster = components(star.where("a <> b")).withColumnRenamed("comp", "cluster")
    cluster = written_once(cluster.join(cluster.groupBy("cluster").agg(F.count("*").alias("nodes")), "cluster"), "clusters")

    # what blocks need to know of a node; its print is that of any row with its text
    wanted = nodes.join(cluster.select("node"), "node", "left_semi").select("node", "rep", "digest", "n")
    printed = described.select(F.col("doc_id").alias("rep"), "digest", "print")
    if repeated:
        printed = printed.dropDuplicates(["rep", "digest"])
    prints = written_once(printed.join(wanted, ["rep", "digest"]), "prints")

    # first turn: every pair of each block of a cluster; a cluster of one block is done with, others are cut in two ways
    cuts = F.explode(F.when(F.col("nodes") > BLOCK, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    parts = F.ceil(F.col("nodes") / F.lit(BLOCK))
    blocks = cluster.withColumn("cut", cuts).select(F.col("cluster").alias("list_id"), "node", (F.col("cut") * F.lit(1 << 40) + F.pmod(F.xxhash64("node", "cut"), parts)).alias("part"), F.col("node").alias("comp"))
    links = written_once(_linked(blocks, rows, prints, words, percent, repeated).unionByName(same), "links")
    label = components(links)

    # second turn: what is left open in large clusters; all but the largest class against all, in each list or, where that moves fewer sets, in the cluster
    large = cluster.where(F.col("nodes") > BLOCK).join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    large = written_once(large, "large")
    if large.isEmpty():
        return _named(described, nodes, label)
    in_lists = listed.join(large, "node").select("list_id", "node", "comp", "cluster")
    mixed = in_lists.groupBy("list_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list_id")
    in_lists = written_once(in_lists.join(mixed, "list_id", "left_semi"), "open")
    by_list = in_lists.groupBy("cluster").agg(F.count("*").alias("by_list"))
    classes = large.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("all"), F.max("n").alias("main"))
    by_cluster = F.col("all") * F.ceil((F.col("all") - F.col("main")) / F.lit(BLOCK)) + (F.col("all") - F.col("main")) * F.ceil(F.col("all") / F.lit(BLOCK))
    whole = written_once(classes.join(by_list, "cluster").select("cluster", (by_cluster <= F.col("by_list")).alias("whole")), "ways")
    several = in_lists.join(whole.where("not whole"), "cluster", "left_semi").select("list_id", "node", "comp")
    several = several.unionByName(large.join(whole.where("whole"), "cluster", "left_semi").select(F.col("cluster").alias("list_id"), "node", "comp"))
    several = written_once(several, "several")
    counts = several.groupBy("list_id", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("list_id").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"))
    open_ = several.join(main.where(F.col("all") > F.col("main.n")), "list_id")
    outer, inner = F.ceil((F.col("all") - F.col("main.n")) / F.lit(BLOCK)), F.ceil(F.col("all") / F.lit(BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    # where all are one part, the inside alone has every node
    outside = open_.where((F.col("comp") != F.col("main.comp")) & (inner > 1)).select("list_id", "node", "comp", own(outer).alias("o"), every(inner).alias("i"))
    inside = open_.select("list_id", "node", "comp", own(inner).alias("i"), every(outer).alias("o"))
    crossed = outside.select("list_id", "node", "comp", "o", "i").union(inside.select("list_id", "node", "comp", "o", "i"))
    crossed = crossed.select("list_id", "node", "comp", (F.col("o") * F.lit(1 << 31) + F.col("i")).alias("part"))
    if not several.isEmpty():
        more = written_once(_linked(crossed, rows, prints, words, percent, repeated), "links")
        if not more.isEmpty():
            label = components(links.unionByName(more))
    return _named(described, nodes, label)


def _named(described: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Rows with their classes, named by the least id."""
    known = nodes.join(label, "node").select("n", "digest", "rep", "comp")
    known = known.join(known.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("n", "digest", "least")
    own = nodes.join(known, ["n", "digest"], "left").select("n", "digest", F.coalesce("least", "rep").alias("comp"))
    out = described.select("doc_id", "n", "digest").join(own, ["n", "digest"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: size and class of every whole text of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sized AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingles
    FROM w
), flat AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sized
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common
    FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY ALL
), links AS (
    SELECT a, b FROM shared WHERE 100 * common >= 80 * (total - common)
    UNION ALL SELECT b, a FROM shared WHERE 100 * common >= 80 * (total - common)
), reach AS (
    SELECT doc_id, doc_id AS other FROM sized
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT sized.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM sized JOIN least_of USING (doc_id)
"""
