"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line with its line end; its leaves are sentences, cut after ``LEAF_CHARS`` code points. A section ends with a
paragraph whose digest says so, so an edit moves no other section. A node's digest covers its children's full
digests, hence equal roots mean equal texts; differing branches locate edits (``differences``). The fingerprint text
holds the root, and for each section and paragraph a short digest, and for each leaf a short digest and its length.

Likeness is twice the length of leaves that both trees have over the length of both.

Cases: a null text is empty; two empty texts have likeness 1, an empty and another one 0; texts of any length are covered
whole; rows with the same id follow each other by text; a null id comes before all others; the only row of a table is its own next one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import keyed_text, ship, table

LEAF_CHARS = 80
#: A section has about so many paragraphs.
SECTION_PARAGRAPHS = 8

_LEAF = re.compile(r"[^.!?\n]{0,%d}(?:[.!?]+ ?\n?|\n)|[^.!?\n]{1,%d}" % (LEAF_CHARS, LEAF_CHARS))


class Tree:
    """Merkle tree of a text: ``root`` (hex), ``sections`` of paragraphs of (digest, length) leaves."""

    __slots__ = ("root", "sections", "_leaves")

    def __init__(self, text: str, known: dict[str, bytes] | None = None):
        known = {} if known is None else known
        digest = lambda raw: hashlib.blake2b(raw, digest_size=16).digest()
        self.sections: list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]] = []
        section, paragraph = [], []

        def end_paragraph() -> None:
            nonlocal paragraph
            if paragraph:
                own = digest(b"p" + b"".join([x[0] for x in paragraph]))
                section.append((own, paragraph))
                paragraph = []
                if own[0] % SECTION_PARAGRAPHS == 0:
                    end_section()

        def end_section() -> None:
            nonlocal section
            if section:
                self.sections.append((digest(b"s" + b"".join([x[0] for x in section])), section))
                section = []

        for leaf in _LEAF.findall(text):
            got = known.get(leaf)
            if got is None:
                got = known[leaf] = digest(b"l" + leaf.encode("utf-8", "surrogatepass"))
            paragraph.append((got, len(leaf)))
            if leaf[-1] == "\n":
                end_paragraph()
        end_paragraph()
        end_section()
        self.root = digest(b"r" + b"".join([x[0] for x in self.sections])).hex()
        self._leaves: Counter | None = None

    def __str__(self) -> str:
        return ";".join([
            self.root,
            *[
                own.hex()[:8] + ":" + "/".join([p.hex()[:8] + "=" + ",".join([f"{d.hex()[:8]}{n:02x}" for d, n in leaves]) for p, leaves in paragraphs])
                for own, paragraphs in self.sections
            ],
        ])

    def leaves(self) -> Counter:
        """Length of the text below each leaf digest."""
        if self._leaves is None:
            self._leaves = Counter()
            for _, paragraphs in self.sections:
                for _, leaves in paragraphs:
                    for d, n in leaves:
                        self._leaves[d[:4]] += n
        return self._leaves


def _likeness(a: Counter, b: Counter) -> float:
    if len(b) < len(a):
        a, b = b, a
    shared = sum([min(n, b[d]) for d, n in a.items() if d in b])
    total = sum(a.values()) + sum(b.values())
    return 2 * shared / total if total else 1.0


def tree_likeness(a: Tree, b: Tree) -> float:
    """Likeness of two trees, from 0 to 1."""
    return 1.0 if a.root == b.root else _likeness(a.leaves(), b.leaves())


def _parse(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[tuple[str, int]]]]]]]:
    root, *sections = fingerprint.split(";")
    out = []
    for section in sections:
        own, _, paragraphs = section.partition(":")
        out.append((own, [(p[:8], [(x[:8], int(x[8:], 16)) for x in p[9:].split(",")]) for p in paragraphs.split("/")]))
    return root, out


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    if a.split(";", 1)[0] == b.split(";", 1)[0]:
        return 1.0
    counts = []
    for text in (a, b):
        own: Counter = Counter()
        for _, paragraphs in _parse(text)[1]:
            for _, leaves in paragraphs:
                for d, n in leaves:
                    own[d] += n
        counts.append(own)
    return _likeness(*counts)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges of code points of a's text whose branches b lacks; equal branches are not entered."""
    (root_a, tree_a), (root_b, tree_b) = _parse(a), _parse(b)
    if root_a == root_b:
        return []
    sections = {own for own, _ in tree_b}
    paragraphs = {p for _, ps in tree_b for p, _ in ps}
    leaves = {d for _, ps in tree_b for _, ls in ps for d, _ in ls}
    out: list[tuple[int, int]] = []
    at = 0
    for own, ps in tree_a:
        for p, ls in ps:
            for d, n in ls:
                if own not in sections and p not in paragraphs and d not in leaves:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], at + n)
                    else:
                        out.append((at, at + n))
                at += n
    return out


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of ids (``part``), each sorted and ended by a copy of the row that follows the range (``tail``).

    Only the cuts and the first id of each range reach the driver; there are four ranges for each shuffle partition.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col("doc_id").cast("double").alias("key"))
    cuts = sorted(set(ids.where("key is not null").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)))
    if cuts:
        dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="key", outputCol="bucket", handleInvalid="keep")
        rows = dealt.transform(rows.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))).withColumn("part", F.col("bucket").cast("int"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).orderBy("part").collect()
    before = [(r["first"]["doc_id"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    tails = spark.createDataFrame(before, "first_id long, before int")
    rows = rows.select("doc_id", "text", "part").join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail")))
    )
    return rows.withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.tail")


def fingerprint_chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row's text and of its edited text, whose second half comes from the next row's start."""
    ship(docs.sparkSession)

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # part, id, text and tree of the row that waits for its next one
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, tail in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if last is not None and last[0] != part:
                    raise ValueError("a range of ids without its tail")
                if last is None and tail:
                    continue
                tree, known = Tree(text), {}
                if last is not None:
                    _, before_id, before, before_tree = last
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    edited_tree = Tree(edited, known)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before), sha, str(before_tree), str(edited_tree), tree_likeness(before_tree, edited_tree), tree_likeness(before_tree, tree)))
                last = None if tail else (part, doc_id, text, tree)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows = in_order(docs, id_col, text_col).repartition("part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")
    return rows.select("doc_id", "text", "part", "tail").mapInArrow(
        chain, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprint_chain(table(spark, sf_dir, "documents"))
