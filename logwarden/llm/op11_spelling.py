"""Spelling variants: words one edit apart, each word's more frequent form, and the root of its forms.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased. All of them have code points below 256, so a block of words is a matrix of bytes.

1. Words are counted over whole texts; each task sums up what it has seen before anything moves.
2. Dense prefix-suffix tiling: words of a block stand in two padded matrices, one flush left and one flush right. A tile compares every word of a block with every word of another:
   two words whose longer one has L code points are one edit apart if their common prefix and common suffix together reach L - 1.
3. Only blocks that can hold such pairs meet. The L places of the longer word fall into ``SEGMENTS`` parts; an edit in one part leaves the prefix before it and the suffix
   behind it equal, so words are grouped by (L, part, that prefix, that suffix), the shorter word of a pair by the L of the longer. A pair counts only in the part in which its common prefix
   ends, so it counts once. Small groups share a tile, with the pairs of different groups masked. A group beyond ``BLOCK`` words is cut into
   blocks by hash and each pair of its blocks is a tile of its own task row, so no group is gathered whole.
4. A tile sends one row for each word: its number of near words and the best of them. Roots follow by pointer doubling: the frequency at least doubles from form to form, so chains are short.

Cases: null and empty texts hold no word; a null id counts as an empty one where ids are hashed; repeated rows count each; ties go to the smaller word in code-point order; words and texts may be
of any length (tiles of long words have fewer rows); an empty table gives no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import ship, table
from logwarden.llm.text import text_of
from logwarden.session import materialise

MIN_LENGTH = 5
MIN_COUNT = 3
SEGMENTS = 3
#: Words of a group that are compared as one block, and the bytes of a block's matrix; beyond either, a group is cut.
BLOCK = 1024
BLOCK_BYTES = 1 << 22
#: Rows that small groups fill together.
SHARED_ROWS = 128
#: Different words a task holds before it hands on their counts.
HELD_WORDS = 200_000
#: Rows of one task of tiles.
TILE_ROWS = 40_000

_LONG_TEXT = 1 << 20
_LETTERS = re.compile(rb"[a-z\xC0-\xFF]+")


def letter_runs(text: str) -> Iterable[bytes]:
    """Maximal runs of letters as latin-1 bytes, A-Z lower-cased."""
    data = text.encode("latin-1", "replace").lower()  # what latin-1 lacks becomes "?", which is no letter; lower() of bytes changes A-Z alone
    if len(data) > _LONG_TEXT:
        return (m[0] for m in _LETTERS.finditer(data))
    return _LETTERS.findall(data)


def dropped(run: bytes, seed: int, every: int) -> bytes:
    """The run, less one code point where ``every`` divides the crc32 that goes on from ``seed``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n) of words of at least ``min_length`` code points and ``min_count`` occurrences.

    ``drop_every``: delete a code point of each run whose crc32 with its document's id this number divides.
    """
    ship(docs.sparkSession)

    def handed(total: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), text_of(part.column(1))):
                    own = Counter(letter_runs(text))
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in own.items():
                        if len(run) >= min_length:
                            word = dropped(run, seed, drop_every) if drop_every else run
                            if len(word) >= min_length:
                                total[word] += n
                    if len(total) >= HELD_WORDS:
                        yield handed(total)
                        total = Counter()
        if total:
            yield handed(total)

    seen = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _groups(words: DataFrame) -> DataFrame:
    """(lg, part, key, word, n, own, i, j): words by group, with the block pair (i, j) of the group and the word's own block."""
    role = lambda r: f"transform(sequence(0, {SEGMENTS - 1}), p -> struct(length(word) + {r} AS lg, p AS part, {r} AS shorter))"
    placed = words.selectExpr("word", "n", f"inline(concat({role(0)}, {role(1)}))")
    start, stop = f"(lg * part) div {SEGMENTS}", f"(lg * (part + 1)) div {SEGMENTS}"
    keyed = placed.selectExpr("lg", "part", f"xxhash64(lg, part, left(word, cast({start} AS INT)), right(word, cast(lg - {stop} AS INT))) AS key", "word", "n", "shorter")
    sizes = keyed.groupBy("lg", "part", "key").agg(F.count("*").alias("size"), F.min("shorter").alias("all_shorter"))
    sizes = sizes.where("size > 1 and all_shorter = 0").drop("all_shorter")
    blocks = f"ceil(size / greatest(1, least({BLOCK}, {BLOCK_BYTES} div lg)))"
    dealt = keyed.join(sizes, ["lg", "part", "key"]).selectExpr("*", f"{blocks} AS blocks").selectExpr("*", "pmod(xxhash64(word), blocks) AS own")
    dealt = dealt.selectExpr("lg", "part", "key", "word", "n", "own", "explode(sequence(0L, blocks - 1)) AS other")
    return dealt.selectExpr("lg", "part", "key", "word", "n", "own", "least(own, other) AS i", "greatest(own, other) AS j")


class Block:
    """Words of one length and the length less one, flush left and flush right."""

    def __init__(self, words: list[bytes], lg: int) -> None:
        self.n = len(words)
        flat = np.array(words, f"S{lg}")
        self.order = np.argsort(flat, kind="stable")
        self.left = flat.view(np.uint8).reshape(-1, lg)
        self.right = np.array([b"\0" * (lg - len(w)) + w for w in words], f"S{lg}").view(np.uint8).reshape(-1, lg)
        self.whole = np.array([len(w) == lg for w in words])


def _common(a: np.ndarray, b: np.ndarray, places: Iterable[int], kind: type) -> np.ndarray:
    """For each row of ``a`` and each of ``b``, in how many of the places they agree before they first differ."""
    alive = np.ones((len(a), len(b)), bool)
    total = np.zeros(alive.shape, kind)
    for k in places:
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(a: Block, b: Block, lg: int, part: np.ndarray) -> np.ndarray:
    """Which words of ``a`` and ``b`` are one edit apart, by the part (one of each row of ``a``) in which their common prefix ends."""
    kind = np.uint16 if 2 * lg < 65536 else np.uint32
    before = _common(a.left, b.left, range(lg), kind)
    behind = _common(a.right, b.right, range(lg - 1, -1, -1), kind)
    near = (before + behind >= lg - 1) & (before < lg) & (a.whole[:, None] | b.whole[None, :])
    bounds = np.array([lg * p // SEGMENTS for p in range(1, SEGMENTS)], kind)
    ends_in = np.searchsorted(bounds, np.arange(lg + 1), "right")  # the part of each place
    return near & (ends_in[before] == part[:, None])


def _best(near: np.ndarray, b: Block, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of each row, and the column of the most frequent (ties: smallest)."""
    order = b.order[np.argsort(-n[b.order], kind="stable")]
    return near.sum(1), order[near[:, order].argmax(1)]


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lg, part, key, i, j, own, word, n) sorted by all but the last two; gives (word, near, best_n, best)."""
    out: list[tuple] = []

    def compare(a: list[tuple], b: list[tuple], lg: int, same: bool) -> None:
        one = Block([x[0] for x in a], lg)
        two = one if same else Block([x[0] for x in b], lg)
        near = near_pairs(one, two, lg, np.array([x[2] for x in a]))
        if same:
            group = np.array([x[3] for x in a])
            near &= group[:, None] == group[None, :]
        for own, other, there, table_ in ((a, b, two, near), *(() if same else ((b, a, one, near.T),))):
            if not table_.any():
                continue
            count, best = _best(table_, there, np.array([x[1] for x in other]))
            out.extend((own[r][0], int(count[r]), other[best[r]][1], other[best[r]][0]) for r in np.flatnonzero(count))

    def finish(key: tuple | None, rows: list[tuple], owners: list[int]) -> None:
        """A group, or one pair of its blocks, is complete."""
        nonlocal shared, shared_lg
        if key is None:
            return
        lg, i, j = key[0], key[3], key[4]
        if i < j:
            compare([r for r, o in zip(rows, owners) if o == i], [r for r, o in zip(rows, owners) if o == j], lg, False)
        elif len(rows) > SHARED_ROWS:
            compare(rows, rows, lg, True)
        else:
            if shared and (lg != shared_lg or len(shared) + len(rows) > SHARED_ROWS):
                compare(shared, shared, shared_lg, True)
                shared = []
            shared_lg = lg
            shared += rows

    def handed() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        text = lambda c: pa.array([w.decode("latin-1") for w in c], pa.string())
        return pa.RecordBatch.from_arrays([text(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), text(columns[3])], names=["word", "near", "best_n", "best"])

    shared: list[tuple] = []
    shared_lg = 0
    key, rows, owners = None, [], []
    number = 0
    for batch in batches:
        for lg, part, group, i, j, own, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (lg, part, group, i, j) != key:
                finish(key, rows, owners)
                key, rows, owners = (lg, part, group, i, j), [], []
                number += 1
            rows.append((word.encode("latin-1"), n, part, number))
            owners.append(own)
        if out:
            yield handed()
    finish(key, rows, owners)
    if shared:
        compare(shared, shared, shared_lg, True)
    if out:
        yield handed()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each word of ``words`` (word, n) that has near words."""
    spark = words.sparkSession
    ship(spark)
    groups = materialise(_groups(words), "spelling-groups")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // TILE_ROWS))
    dealt = groups.select("lg", "part", "key", "i", "j", "own", "word", "n").repartition(tasks, "lg", "part", "key", "i", "j")
    told = dealt.sortWithinPartitions("lg", "part", "key", "i", "j").mapInArrow(_tiles, "word string, near long, best_n long, best string")
    best = told.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first"))
    return best.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are followed twice as far in each turn."""
    links = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = links.join(further, links["root"] == further["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "spelling-roots")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``words`` (word, n): its form is its near word of largest n if that is ``factor`` times its own or more."""
    words = materialise(words.select("word", "n"), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    enough = F.col("best_n") >= factor * F.col("n")
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    forms = materialise(forms, "spelling-forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the variants among the words of all ``documents``, one run in 97 less a code point."""
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), drop_every=97))
