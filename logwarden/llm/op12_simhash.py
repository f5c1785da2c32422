"""SimHash near duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits; a bit is one if it is set in over half the hashes of the document's word shingles, repeats included.

1. Equal fingerprints are one node, so exact copies cost one row whatever their number.
2. A fingerprint is eight positional bytes. Fingerprints that differ in ``BITS`` bits differ in at most as many bytes, so they share the other positions: at least ``8 - BITS`` matches
   are guaranteed. Lists of single bytes would hold a 256th of all rows each, so the index keeps lists of four positions and their bytes: the eight positions are four blocks of two, and
   two differing bytes leave two blocks whole.
3. Within a list the shared positional bytes of each pair are tallied over a block of nodes, pairs below the guaranteed number are dropped, and those that are left are verified by their differing
   bits. A list gives one link for each node at most, so a list of n nodes never gives its pairs.
4. A list of more than ``LIST`` nodes is refined: its pairs share further positions, so its nodes are listed again by each choice of all ``8 - BITS`` positions that hold the list's own.
   The bytes that such a list leaves open bound it: it has 2**16 nodes at most, for any input. There the bits that may differ are tried against the nodes at hand, which needs no pairs.
5. Classes are the components of the links.

Cases: null, empty and wordless texts have fingerprint zero and link like any other; with fewer words than a shingle has, the whole sequence is one; a row without an id has a fingerprint, no class, and
links nothing; equal rows are copies; rows of one id with different texts are one document, so what each is near to is one class; texts may be of any length; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import join_spread, ship, table
from logwarden.llm.op2_jaccard import components
from logwarden.llm.text import text_of
from logwarden.session import materialise

WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
BITS = 2
#: Nodes of a list that are compared together; a longer list is refined.
LIST = 2048
#: Rows of one task of lists.
LIST_ROWS = 200_000

_HASHES = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    w = text.encode("utf-8", "replace").lower().split()  # of bytes: lower() changes A-Z alone, split() cuts at \x20 and \x09-\x0D
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(len(w) - words + 1, 1)].tolist()
    ends = ends[min(words, len(w)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), _HASHES):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + _HASHES], ends[lo : lo + _HASHES])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, node) of each row; the node is the fingerprint as a signed number."""
    ship(docs.sparkSession)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = np.array([fingerprint(t, words) for t in text_of(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=["doc_id", "node"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id long, node long")


def _masks(positions: Iterable[tuple[int, ...]]) -> list[int]:
    """For each choice of positions the signed number whose bytes there are all ones."""
    made = [sum(0xFF << (8 * p) for p in chosen) for chosen in positions]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def list_positions() -> list[tuple[int, ...]]:
    """Choices of four positions, made of two of four blocks: two differing bytes leave two blocks whole, so one choice is shared."""
    return [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each of ``a`` shares with each of ``b``."""
    one, two = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    total = np.zeros((len(a), len(b)), np.uint8)
    for p in range(8):
        total += one[:, p, None] == two[None, :, p]
    return total


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of the pairs (i, j); labels end as the least place of each class."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label[:] = label[label]
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]


def _settle(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def tally_links(nodes: np.ndarray, bits: int = BITS, rows: int = 512) -> list[tuple[int, int]]:
    """Links of a list: shared bytes are tallied for every pair, block by block, and pairs of enough matches are verified."""
    label = np.arange(len(nodes))
    for a in range(0, len(nodes), rows):
        for b in range(a, len(nodes), rows):
            x, y = nodes[a : a + rows], nodes[b : b + rows]
            i, j = np.nonzero(_shared_bytes(x, y) >= 8 - bits)
            i, j = i[a + i < b + j], j[a + i < b + j]
            near = np.bitwise_count(x[i] ^ y[j]) <= bits
            _merge(label, a + i[near], b + j[near])
            label = _settle(label)
    return [(int(nodes[i]), int(nodes[j])) for j, i in enumerate(label) if i != j]


def open_links(nodes: np.ndarray, places: tuple[int, ...], bits: int = BITS) -> list[tuple[int, int]]:
    """Links of sorted nodes that differ only in the bytes at ``places``: each change of at most ``bits`` bits there is looked up among them."""
    label = np.arange(len(nodes))
    single = [np.uint64(1) << np.uint64(8 * p + k) for p in places for k in range(8)]
    for size in range(1, bits + 1):
        for chosen in combinations(single, size):
            other = nodes ^ np.bitwise_or.reduce(np.array(chosen, np.uint64))
            at = np.minimum(np.searchsorted(nodes, other), len(nodes) - 1)
            i = np.flatnonzero((nodes[at] == other) & (nodes < other))
            _merge(label, i, at[i])
            label = _settle(label)
    return [(int(nodes[i]), int(nodes[j])) for j, i in enumerate(label) if i != j]


def _listed_links(rows: DataFrame, links_of, count: int) -> DataFrame:  # noqa: ANN001
    """Links (a, b) of the lists (choice, key, node); each list is met once, in one task, by ``links_of`` (choice, sorted nodes)."""
    spark = rows.sparkSession

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        made = np.array(found, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key: tuple[int, int] | None = None

        def done() -> list[tuple[int, int]]:
            nodes = np.unique(np.concatenate(held).view(np.uint64)) if held else ()
            return links_of(key[0], nodes) if len(nodes) > 1 else []

        for batch in batches:
            choice, keys, nodes = (c.to_numpy() for c in batch.columns)
            if not len(nodes):
                continue
            cuts = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (keys[1:] != keys[:-1])))
            found: list[tuple[int, int]] = []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(nodes)]):
                if (choice[lo], keys[lo]) != key:
                    found += done()
                    key, held = (choice[lo], keys[lo]), []
                held.append(nodes[lo:hi])
            if found:
                yield pairs(found)
        if found := done():
            yield pairs(found)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // LIST_ROWS))
    dealt = rows.select("choice", "key", "node").repartition(tasks, "choice", "key").sortWithinPartitions("choice", "key")
    return dealt.mapInArrow(check, "a long, b long")


def near_fingerprints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between different numbers of ``nodes`` (node) that differ in at most ``bits`` bits; what links connect is whole, pairs within it may be missing."""
    if not 0 < bits <= 2:
        raise ValueError("an open list is bounded for one or two differing bits")
    ship(nodes.sparkSession)
    choices, width = list_positions(), 8 - bits
    masks = _masks(choices)
    listed = nodes.select("node", F.inline(F.array(*[F.struct(F.lit(c).alias("choice"), F.col("node").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])))
    sizes = listed.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialise(listed.join(sizes, ["choice", "key"]), "simhash-lists")
    short, long = met.where(F.col("size") <= LIST), met.where(F.col("size") > LIST)
    links = _listed_links(short, lambda c, found: tally_links(found, bits), short.count())

    wide = list(combinations(range(8), width))
    wide_masks = _masks(wide)
    under = F.expr("CASE choice " + " ".join(f"WHEN {c} THEN array({', '.join(str(w) for w, all_ in enumerate(wide) if set(own) <= set(all_))})" for c, own in enumerate(choices)) + " END")
    mask = F.expr("element_at(array(" + ", ".join(f"{m}L" if m > -(2**63) else "(-9223372036854775807L - 1L)" for m in wide_masks) + "), choice + 1)")
    refined = long.select("node", F.explode(under).alias("choice")).select("choice", F.col("node").bitwiseAND(mask).alias("key"), "node").distinct()
    refined = materialise(refined, "simhash-refined")
    n = refined.count()
    if n:
        free = [tuple(p for p in range(8) if p not in own) for own in wide]
        links = links.unionByName(_listed_links(refined, lambda c, found: open_links(found, free[c], bits), n))
    return links


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach)."""
    rows = materialise(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    named = rows.where("doc_id is not null")
    nodes = materialise(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "simhash-nodes")
    links = near_fingerprints(nodes.select("node"), bits)
    # fingerprints of one id belong together
    of_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = materialise(links.unionByName(of_id.join(named, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()), "simhash-links")
    known = nodes.join(components(links), "node")
    least = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    label = nodes.join(known.select("node", "comp").join(least, "comp").select("node", "component_id"), "node", "left")
    label = materialise(label.select("node", "times", F.coalesce("component_id", "least").alias("component_id")), "simhash-labels")
    out = join_spread(rows, label, "node", "times", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and class of every whole text of ``documents``."""
    return simhash_classes(table(spark, sf_dir, "documents"))
