"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring.

The order is a parameter (``ORDER``). Below the highest order a word sequence counts the different words before it, or its occurrences where it
begins with the start sign; below order 1 is a uniform share for unknown words. Tokens are lower-cased words and one end for each
text; one start sign stands before the first word, so the first tokens have shorter contexts. An unknown context leaves the next lower order.

Counting. A task counts its own distinct word sequences of full order first and sends them as packets of packed numbers, one for each shard. They are
dealt by the last word of the context: all contexts and lower orders that end in it are then in one shard, which derives them from the full
sequences. After a frequent word (from a bounded sample; there are at most shards / ``FREQUENT`` such words) they are dealt by the last two words of the context,
and only the pairs after it are added up in a second round, dealt by pair. For each word, the sums of its followers and of the words it
follows are added up by word shard. A shard sends at most ``FAN`` packets of each kind: where there are more shards to send to, a packet is for several of them, and the packets of
several senders are cut finer in a step between, so packets grow with the shards and not with their square. Only totals reach the driver. The texts are read in ``ROUNDS`` rounds, each for a part of the shards, and the shuffle files
of a round go when its sums are written: what lies on disk at once is that much less. The number of shards follows the bytes of the texts (``SHARD_BYTES``).

Storage. A table is a sorted array of hashes: an index of buckets by the upper bits and the rest in five bytes, so that 48 to 56 bits of
a sequence's hash count in its shard. A shard is bounded in size, and beyond 65,536 sequences has the 56. Values are one byte, a number in a list of the shard's
most usual values; others stand apart.

Scoring. A worker maps the files and looks up the distinct sequences of a batch of whole texts; no shuffle, and pages that are
not touched are not read. Where the shared folder is no mounted path, a worker fetches a shard to a temporary file, maps it and unlinks it.

Cases: a null text is empty and has one token, its end; without training rows the model is uniform over the unknown; a null id is neither held
out nor learned from; repeated rows count as often as they are there; texts of any length are counted and scored whole; other columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import fold, map_batches, ship, table, written_once
from logwarden.llm.text import hash_words, mix, utf8
from logwarden.session import scratch_path

#: Words of the longest sequences, the scored one included.
ORDER = 3
#: Words that a task counts together.
CHUNK_WORDS = 1_000_000
#: Rounds in which the texts are read and a part of the shards is counted, so that only this part of the sequences lies in shuffle files at once.
ROUNDS = 3
#: Bytes of text for each shard of sequences.
SHARD_BYTES = 12 << 20
#: Most packets of a kind that a shard sends; beyond it a packet is for a run of shards.
FAN = 64
#: A word that would fill this part of a shard by itself, by its share of the sampled words, is frequent.
FREQUENT = 0.5
SAMPLE = 1000
#: Bytes of text that are scored together; a longer text is scored alone.
SCORE_BYTES = 2 << 20

START, END = np.uint64(0x5354415254000000), np.uint64(0x454E440000000000)
NONE = np.uint64(0)  # no word: before the start sign
_ODD = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row ended by ``END``, and for each row the index of its first token (n + 1 values)."""
    hashes, firsts = hash_words(*utf8(column))
    n = len(firsts) - 1
    out = np.full(len(hashes) + n, END, np.uint64)
    row = np.repeat(np.arange(n), np.diff(firsts))
    out[np.arange(len(hashes)) + row] = hashes
    return out, firsts + np.arange(n + 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct keys in their order: a place and the number of occurrences of each; and for each key the number of its distinct one.

    Unlike ``np.unique`` it takes any of the places, so a faster sort does.
    """
    order = np.argsort(keys)
    new = np.append(True, np.diff(keys[order]) != 0) if len(keys) else np.empty(0, bool)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], np.diff(first, append=len(keys)), which


def sequences(tokens: np.ndarray, firsts: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct sequences of full order that end in each token, by context's last word.

    Returns the words (``NONE`` and ``START`` first), the places in them of each sequence's last word, the word before it and so on, and the number of the sequence of each token.
    """
    words, index = np.unique(tokens, return_inverse=True)
    names = np.concatenate([np.array([NONE, START]), words])
    here = np.arange(len(tokens)) - np.repeat(firsts[:-1], np.diff(firsts))
    back = [index + 2]
    for k in range(1, order):
        before = np.zeros(len(tokens), np.int64)
        before[k:] = index[:-k] + 2
        back.append(np.where(here >= k, before, (here == k - 1).astype(np.int64)))
    code, span = np.zeros(len(back[0]), np.int64), 1
    for k in [*range(1, order), 0]:
        if span * len(names) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max(initial=0)) + 1
        code, span = code * len(names) + back[k], span * len(names)
    at, _, which = distinct(code)
    return names, [b[at] for b in back], which


def chain(words: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the last word, the last two and so on; ``words`` go from the last to the first."""
    out = [mix(words[0] + _ODD)]
    for w in words[1:]:
        out.append(mix(out[-1] * _ODD + w))
    return out


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words) % np.uint64(shards)).astype(np.int64)


def is_frequent(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(words), bool)
    return frequent[np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)] == words


def deal(words: list[np.ndarray], frequent: np.ndarray, shards: int) -> np.ndarray:
    """Shard of sequences given from the last word to the first: by the word before the last, after a frequent one by it and a neighbour."""
    out = word_shard(words[1], shards)
    hot = is_frequent(words[1], frequent)
    if hot.any():
        pair = chain([w[hot] for w in words[:2]])[1]
        if len(words) > 2:
            older = words[2][hot]
            pair = np.where(older == NONE, pair, chain([words[1][hot], older])[1])
        out[hot] = (pair % np.uint64(shards)).astype(np.int64)
    return out


def _small(counts: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, which the first byte says; all lowest bytes first, as they compress best."""
    width = 1 if counts.max(initial=0) < 1 << 8 else 2 if counts.max() < 1 << 16 else 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_small(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").reshape(-1).astype(np.int64)


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


# ---- packets

SEQUENCES = "shard int, a binary, b binary"
PACKET = "kind int, shard int, a binary, b binary, c binary"
SUMS, TOTALS, HOT = range(3)  # kinds of packets; those of sequences have none


def _shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _grown(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _pack_columns(columns: list[np.ndarray]) -> bytes:
    packed = [_small(c) for c in columns]
    return _shrunk(b"".join(len(p).to_bytes(8, "little") + p for p in packed))


def _unpack_columns(raw: bytes) -> list[np.ndarray]:
    raw, out, at = _grown(raw), [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(_from_small(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _cut(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, with the places of its rows in their order."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


def _packets(tokens: np.ndarray, firsts: np.ndarray, frequent: np.ndarray, order: int, shards: int, nth: int, rounds: int) -> pa.RecordBatch:
    """Sequences by shard, of the shards of one round: a list of words, the usual ones first, then the places in it of each column, and the counts."""
    here = np.arange(len(tokens)) - np.repeat(firsts[:-1], np.diff(firsts))
    words = [tokens]  # of the sequence that ends in each token, from the last word to the first
    for k in range(1, order):
        before = np.where(here == k - 1, START, NONE)
        inside = np.flatnonzero(here >= k)
        before[inside] = tokens[inside - k]
        words.append(before)
    shard = deal(words, frequent, shards)
    taken = np.flatnonzero(shard % rounds == nth)
    words, shard = [w[taken] for w in words], shard[taken]
    at, counts, _ = distinct(chain(words)[-1])
    columns = [w[at] for w in words]
    out = []
    for s, part in _cut(shard[at], shards):
        used, places, times = np.unique(np.concatenate([c[part] for c in columns]), return_inverse=True, return_counts=True)
        usual = np.argsort(-times, kind="stable")
        rank = np.empty(len(used), np.int64)
        rank[usual] = np.arange(len(used))
        out.append((s, used[usual].tobytes(), _pack_columns([*np.split(rank[places], order), counts[part]])))
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate([pa.int32(), pa.binary(), pa.binary()])], names=["shard", "a", "b"])


COLUMNS = ["kind", "shard", "a", "b", "c"]
WORD_STATS = 6  # count, times as a one-word context, followers seen once, twice, more often; different words before it


def follower_sums(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each different context: occurrences of its followers, and how many of them are seen once, twice, more often."""
    return _added(context, np.stack([counts, counts == 1, counts == 2, counts >= 3], 1).astype(np.int64))


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [len(counts), *[int((counts == i).sum()) for i in (1, 2, 3, 4)]]


def _dealt(target: np.ndarray, targets: int, fan: int, sender: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows for each of the ``targets``; where there are more than ``fan``, for each run of them, numbered by it and the run of the sender."""
    run = -(-targets // fan)
    for s, part in _cut(target // run, -(-targets // run)):
        yield (s if run == 1 else s + fan * (sender // run)), part


def _sum_packets(words: np.ndarray, sums: np.ndarray, word_shards: int, fan: int, sender: int = 0) -> Iterator[tuple]:
    for s, part in _dealt(word_shard(words, word_shards), word_shards, fan, sender):
        yield SUMS, s, words[part].tobytes(), _pack_columns(list(sums[part].T)), b""


def _sums_in(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words with the rows of their sums, added up."""
    words = np.concatenate([np.frombuffer(x, "<u8") for x in group["a"]])
    return _added(words, np.concatenate([np.stack(_unpack_columns(x), 1) for x in group["b"]]))


def _hot_packets(second: np.ndarray, first: np.ndarray, counts: np.ndarray, shards: int, fan: int, sender: int = 0) -> Iterator[tuple]:
    """Packets of the pairs after frequent words, which are few and told by their places in a list."""
    own = (chain([second, first])[-1] % np.uint64(shards)).astype(np.int64)
    for s, part in _dealt(own, shards, fan, sender):
        names, places = np.unique(first[part], return_inverse=True)
        yield HOT, s, second[part].tobytes(), names.tobytes(), _pack_columns([places, counts[part]])


def _hot_in(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs after frequent words, the second word first, with their counts; a pair may be there several times."""
    second = np.concatenate([np.frombuffer(x, "<u8") for x in group["a"]])
    places = [_unpack_columns(x) for x in group["c"]]
    first = np.concatenate([np.frombuffer(x, "<u8")[p[0]] for x, p in zip(group["b"], places)])
    return second, first, np.concatenate([p[1] for p in places])


def _word_sums(first: np.ndarray, second: np.ndarray, counts: np.ndarray, said: np.ndarray, times: np.ndarray, word_shards: int, fan: int, sender: int) -> Iterator[tuple]:
    """Packets of what distinct pairs say about their words, and of how often words occur."""
    b, sums = follower_sums(first, counts)
    c, before = _added(second, np.ones((len(second), 1), np.int64))
    at = [((0, 0), x) for x in ((1, 1), (5, 0), (0, 5))]
    words, sums = _added(np.concatenate([b, c, said]), np.concatenate([np.pad(x, p) for x, p in zip((sums, before, times), at)]))
    yield from _sum_packets(words, sums, word_shards, fan, sender)


def _totals(rows: list[tuple[int, list[int]]]) -> tuple:
    """A packet of (order, number of sequences, of those with count 1, 2, 3, 4)."""
    return TOTALS, -1, np.array([[k, *n] for k, n in rows], "<i8").tobytes(), b"", b""


# ---- files in the shared folder


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark's file system names it, with its scheme as Arrow writes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:"):
        return "file:///" + full.removeprefix("file:").lstrip("/")
    return "s3://" + full.removeprefix("s3a://") if full.startswith("s3a://") else full


USUAL = 255  # values that a byte tells; the byte 255 sends to those apart
_HEAD = 5


class HashTable:
    """Sorted hashes with rows of integers: buckets by the upper bits, five more bytes of each hash, one byte for its row."""

    def __init__(self, raw: np.ndarray):
        raw = raw.view(np.ndarray)  # a mapped file's own slices are slow to make
        self.n, self.bits, usual, far, self.width = np.frombuffer(raw[: 8 * _HEAD], "<i8").tolist()
        at = 8 * _HEAD

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            got = raw[at : at + size].view(dtype)
            at += -(-size // 8) * 8
            return got

        self.buckets = take((1 << self.bits) + 1, "<u4")
        self.high, self.low, self.code = take(self.n, "<u4"), take(self.n, "u1"), take(self.n, "u1")
        self.usual = take(usual * self.width, "<i8").reshape(-1, self.width)
        self.far_at, self.far = take(far, "<i8"), take(far * self.width, "<i8").reshape(-1, self.width)

    @staticmethod
    def bytes_of(keys: np.ndarray, values: np.ndarray) -> bytes:
        """The file of distinct keys and their rows of values."""
        bits = 16 if len(keys) > 1 << 16 else 8
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        names = chain([c.astype(np.uint64) for c in values.T])[-1]
        kinds, at, which, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(kinds))
        code = np.minimum(rank[which], USUAL).astype(np.uint8)
        usual = np.empty((min(len(kinds), USUAL), values.shape[1]), np.int64)
        usual[rank[rank < USUAL]] = values[at[rank < USUAL]]
        far = np.flatnonzero(code == USUAL)
        rest = keys >> np.uint64(24 - bits)
        buckets = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        head = np.array([len(keys), bits, len(usual), len(far), values.shape[1]], "<i8")
        high, low = (rest >> np.uint64(8)).astype("<u4"), rest.astype("u1")
        parts = [head, buckets.astype("<u4"), high, low, code, usual.astype("<i8"), far.astype("<i8"), values[far].astype("<i8")]
        return b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Rows of the wanted hashes, zeros for those not there."""
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = (wanted >> np.uint64(24 - self.bits)) & np.uint64((1 << 40) - 1)
        lo, end = self.buckets[bucket].astype(np.int64), self.buckets[bucket + 1].astype(np.int64)
        high, low = (rest >> np.uint64(8)).astype(np.uint32), rest.astype(np.uint8)
        left = end - lo
        while left.max(initial=0):  # all at once: buckets are small and about equal
            half = left >> 1
            mid = lo + half
            less = (self.high[np.minimum(mid, self.n - 1)] < high) & (left > 0)
            lo = np.where(less, mid + 1, lo)
            left = np.where(less, left - half - 1, half)
        active = np.flatnonzero(lo < end)
        while len(active):  # equal upper bytes are rare, so the last one is compared afterwards
            at = lo[active]
            active = active[(self.high[at] == high[active]) & (self.low[at] < low[active])]
            lo[active] += 1
            active = active[lo[active] < end[active]]
        out = np.zeros((len(wanted), self.width), np.int64)
        there = np.flatnonzero(lo < end)
        there = there[(self.high[lo[there]] == high[there]) & (self.low[lo[there]] == low[there])]
        at = lo[there]
        code = self.code[at]
        near = code < USUAL
        out[there[near]] = self.usual[code[near]]
        if not near.all():
            out[there[~near]] = self.far[np.searchsorted(self.far_at, at[~near])]
        return out


def _store(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Write a table under its final name only when it is whole: a task that runs again replaces an equal file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(HashTable.bytes_of(keys, values))
    system.move(part, f"{path}/{name}")


def _map(folder: str, name: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    full = f"{path}/{name}"
    size = system.get_file_info(full).size
    if not size:
        return np.empty(0, np.uint8)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(full, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as local, system.open_input_stream(full) as source:
        while piece := source.read(1 << 24):
            local.write(piece)
        local.flush()
        return np.memmap(local.name, np.uint8, "r")  # the mapping outlives the name


@dataclass
class Totals:
    """All that scoring needs besides the files."""

    folder: str
    order: int
    shards: int  # of sequences
    word_shards: int
    frequent: np.ndarray
    words: int  # different tokens
    tokens: int
    pairs: int  # different pairs
    discounts: dict[int, tuple[float, float, float]]  # by order
    lower_left: float  # share of order 1 that is left for the uniform one


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and above, from how many counts are 1, 2, 3 and 4; 0.75 of what cannot be estimated."""
    if n[0] == 0:
        return (0.0, 0.0, 0.0)
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.75
        out.append(float(min(max(d, 0.0), i)))
    return out[0], out[1], out[2]


class Model:
    """The mapped files, with probabilities for sequences of word hashes."""

    def __init__(self, totals: Totals):
        self.t = totals
        self._maps: dict[str, HashTable | None] = {}

    def look_up(self, kind: str, keys: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
        """Rows of values for keys that are dealt to shards."""
        out = np.zeros((len(keys), width), np.int64)
        if not self.t.pairs:
            return out
        order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = order[lo:hi]
            name = f"{kind}-{shard[part[0]]}"
            if name not in self._maps:
                raw = _map(self.t.folder, name)
                self._maps[name] = HashTable(raw) if len(raw) else None
            if self._maps[name] is not None:
                out[part] = self._maps[name].find(keys[part])
        return out

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        """Rows of ``WORD_STATS`` numbers for distinct words."""
        return self.look_up("word", mix(words), word_shard(words, self.t.word_shards), WORD_STATS)

    def counts(self, k: int, words: list[np.ndarray]) -> np.ndarray:
        """Counts of distinct sequences of ``k`` words, from the last to the first."""
        keys = chain(words[:k])[-1]
        shard = deal(words[:k], self.t.frequent, self.t.shards)
        if k > 2 or self.t.order == 2:
            return self.look_up(f"gram{k}", keys, shard, 1)[:, 0]
        out = np.zeros(len(keys), np.int64)
        hot = is_frequent(words[1], self.t.frequent)
        for kind, rows in (("hot", hot), ("gram2", ~hot)):
            if rows.any():
                out[rows] = self.look_up(kind, keys[rows], shard[rows], 1)[:, 0]
        return out

    def probabilities(self, names: np.ndarray, columns: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        """Probability of the last word of each sequence; columns are places in ``names``, ``stats`` its words' numbers."""
        t = self.t
        uniform = 1.0 / (t.words + 1)
        if not t.pairs:
            return np.full(len(columns[0]), uniform)
        cut = {k: np.array([0.0, *d]) for k, d in t.discounts.items()}
        seen = stats[:, 5]
        p = (np.maximum(seen - cut[1][np.minimum(seen, 3)], 0) / t.pairs + t.lower_left * uniform)[columns[0]]
        words = [names[c] for c in columns]
        hashes = chain(words)
        contexts = chain(words[1:])
        for k in range(2, t.order + 1):
            whole = np.flatnonzero(words[k - 1] != NONE)
            at, _, which = distinct(hashes[k - 1][whole])
            count = self.counts(k, [w[whole[at]] for w in words])
            gain = np.maximum(count - cut[k][np.minimum(count, 3)], 0)[which]
            if k == 2:
                sums, which = stats[:, 1:5], columns[1][whole]
            else:
                at, _, which = distinct(contexts[k - 2][whole])
                own = deal([w[whole[at]] for w in words[:k]], t.frequent, t.shards)
                sums = self.look_up(f"context{k - 1}", contexts[k - 2][whole[at]], own, 4)
            left, total = (sums[:, 1:] @ cut[k][1:])[which], sums[:, 0][which]
            p[whole] = np.where(total > 0, (gain + left * p[whole]) / np.maximum(total, 1), p[whole])
        return p

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each row."""
        t = self.t
        tokens, firsts = token_hashes(column)
        names, columns, which = sequences(tokens, firsts, t.order)
        stats = self.word_stats(names)
        index = columns[0][which]
        logs = np.log10(self.probabilities(names, columns, stats))[which]
        base = np.log10((stats[:, 0] + 1.0) / (t.tokens + t.words + 1.0))[index]
        return {
            "n_tokens": np.diff(firsts),
            "n_known": np.add.reduceat((stats[:, 0] > 0)[index].astype(np.int64), firsts[:-1]),
            "base_score": np.add.reduceat(base, firsts[:-1]),
            "score": np.add.reduceat(logs, firsts[:-1]),
        }


# ---- counting in Spark


def fit_lm(docs: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, order: int = ORDER, rounds: int = ROUNDS, fan: int = FAN) -> Totals:
    """Counts the texts of the rows where ``usable`` holds and stores the model of an order of 2 or more in the shared folder."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    folder = _qualified(spark, scratch_path(spark, "lm"))
    rows = docs.where(usable).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(32, -(-size // SHARD_BYTES))  # by the texts alone: shards send to shards, and a session may have any number of partitions
    word_shards = max(8, shards // 4)

    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def sampled(batch: pa.RecordBatch) -> dict:
        words, counts = np.unique(token_hashes(batch.column(0))[0], return_counts=True)
        return {"w": pa.array(words.view(np.int64)), "n": pa.array(counts, pa.int64())}

    some = map_batches(rows.join(F.broadcast(ids), "doc_id").select("text"), sampled, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    all_sampled = some.agg(F.sum("n")).first()[0] or 0
    frequent = some.where(F.col("n") * shards >= FREQUENT * all_sampled).orderBy("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64)
    frequent = np.union1d(frequent, np.array([START]))

    def count(batches: Iterable[pa.RecordBatch], nth: int) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate([x[0] for x in waiting])
            starts = np.cumsum([0, *[len(x[0]) for x in waiting]])
            firsts = np.concatenate([x[1][:-1] + s for x, s in zip(waiting, starts)] + [[starts[-1]]])
            waiting.clear()
            return _packets(tokens, firsts, frequent, order, shards, nth, rounds)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                got = token_hashes(batch.column(0).slice(lo, 500))
                if len(got[0]):
                    waiting.append(got)
                if sum(len(x[0]) for x in waiting) >= CHUNK_WORDS:
                    yield packed()
        if waiting:
            yield packed()

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        pieces = []
        for used, places in zip(group["a"], group["b"]):
            names, (*places, n) = np.frombuffer(used, "<u8"), _unpack_columns(places)
            pieces.append([*[names[p] for p in places], n])
        columns = [list(x) for x in zip(*pieces)]
        del pieces
        *words, counts = [np.concatenate(columns.pop(0)) for _ in range(order + 1)]  # the pieces of a column go as soon as it is whole
        out, found = [], []
        for k in range(order, 1, -1):  # rows become distinct sequences of k words; shorter ones keep their occurrences
            keys = chain(words[:k])[-1]
            by_key = np.argsort(keys)
            keys = keys[by_key]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.add.reduceat(counts[by_key], first)
            keys, words = keys[first], [w[by_key[first]] for w in words[:k]]
            if k == order:
                said = _added(words[0], counts[:, None])
            whole = words[k - 1] != NONE
            if k == 2 < order:
                hot = is_frequent(words[1], frequent)
                out += _hot_packets(words[0][hot], words[1][hot], counts[hot], shards, fan, shard)
                whole &= ~hot
            found.append((k, counts_of_counts(counts[whole])))
            _store(folder, f"gram{k}-{shard}", keys[whole], counts[whole, None])
            if k == 2:
                out += _word_sums(words[1][whole], words[0][whole], counts[whole], *said, word_shards, fan, shard)
            else:
                _store(folder, f"context{k - 1}-{shard}", *follower_sums(chain([w[whole] for w in words[1:]])[-1], counts[whole]))
                counts = np.where(whole, 1, counts)
        return pd.DataFrame([*out, _totals(found)], columns=COLUMNS)

    def add_hot(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        second, first, counts = _hot_in(group)
        keys = chain([second, first])[-1]
        by_key = np.argsort(keys)
        start = np.flatnonzero(np.append(True, np.diff(keys[by_key]) != 0))
        counts = np.add.reduceat(counts[by_key], start)
        at = by_key[start]
        _store(folder, f"hot-{shard}", keys[at], counts[:, None])
        none = second[:0], np.empty((0, 1), np.int64)
        return pd.DataFrame([*_word_sums(first[at], second[at], counts, *none, word_shards, fan, shard), _totals([(2, counts_of_counts(counts))])], columns=COLUMNS)

    def add_words(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        keys, stats = _sums_in(group)
        _store(folder, f"word-{shard}", mix(keys), stats)
        counts, seen = stats[:, 0], stats[:, 5]
        return pd.DataFrame([(int((counts > 0).sum()), int(counts.sum()), *counts_of_counts(seen)[1:], int((seen >= 3).sum()))], columns=["words", "tokens", "n1", "n2", "n3", "n4", "more"])

    def to_shards(packets: DataFrame, targets: int, cut: Callable[[pd.DataFrame], Iterator[tuple]]) -> DataFrame:
        """Packets for runs of shards cut into those for one shard each."""
        if targets <= fan:
            return packets
        return packets.groupBy("shard").applyInPandas(lambda group: pd.DataFrame(cut(group), columns=COLUMNS), PACKET)

    parts = []
    for nth in range(rounds):
        packets = rows.select("text").mapInArrow(partial(count, nth=nth), SEQUENCES)
        parts.append(written_once(packets.groupBy("shard").applyInPandas(add_up, PACKET), "lm-sums"))
    summed = reduce(DataFrame.unionByName, parts)
    if order > 2:
        pairs_after = to_shards(summed.where(F.col("kind") == HOT), shards, lambda group: _hot_packets(*_hot_in(group), shards, shards))
        hot = written_once(pairs_after.groupBy("shard").applyInPandas(add_hot, PACKET), "lm-hot")
        summed = summed.where(F.col("kind") != HOT).unionByName(hot)
    found = {k: np.zeros(5, np.int64) for k in range(2, order + 1)}
    for row in summed.where(F.col("kind") == TOTALS).select("a").toLocalIterator():  # a few numbers for each shard
        for k, *n in np.frombuffer(row["a"], "<i8").reshape(-1, 6).tolist():
            found[k] += n
    sums = to_shards(summed.where(F.col("kind") == SUMS), word_shards, lambda group: _sum_packets(*_sums_in(group), word_shards, word_shards))
    by_word = sums.groupBy("shard").applyInPandas(add_words, "words long, tokens long, n1 long, n2 long, n3 long, n4 long, more long")
    got = written_once(by_word, "lm-totals").groupBy().sum().first()
    words, tokens, *seen, more = [int(x or 0) for x in got]
    pairs = int(found[2][0])
    by_order = {1: discounts(seen)} | {k: discounts(n[1:].tolist()) for k, n in found.items()}
    lower = by_order[1]
    left = (lower[0] * seen[0] + lower[1] * seen[1] + lower[2] * more) / pairs if pairs else 1.0
    if pairs:  # a shard without a sequence or a word has an empty file
        _fill(folder, order, shards, word_shards)
    return Totals(folder, order, shards, word_shards, frequent, words, tokens, pairs, by_order, left)


def _fill(folder: str, order: int, shards: int, word_shards: int) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    there = {f.base_name for f in system.get_file_info(fs.FileSelector(path))}
    kinds = [f"gram{k}" for k in range(2, order + 1)] + [f"context{k}" for k in range(2, order)] + ["hot"]
    for name in [f"{kind}-{s}" for kind in kinds for s in range(shards)] + [f"word-{s}" for s in range(word_shards)]:
        if name not in there:
            system.open_output_stream(f"{path}/{name}").close()


_models: dict[str, Model] = {}


def scored_together(column: pa.Array, limit: int = SCORE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of pieces of at most ``limit`` bytes of text each, or of one row: memory follows the words and not the rows."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo, before = 0, 0
    while lo < len(ends):
        hi = max(int(np.searchsorted(ends, before + limit, side="right")), lo + 1)
        yield lo, hi - lo
        lo, before = hi, int(ends[hi - 1])


def score_lm(docs: DataFrame, totals: Totals, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        model = _models.get(t.folder)
        if model is None:
            _models.clear()
            model = _models[t.folder] = Model(t)
        for whole in batches:
            for lo, n in scored_together(whole.column(1)):
                batch = whole.slice(lo, n)
                s = model.score(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array(np.full(batch.num_rows, t.tokens), pa.int64()), pa.array(s["base_score"]), pa.array(s["score"])],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the log probability of every whole text of ``documents``, learned from six sevenths of the ids."""
    docs = table(spark, sf_dir, "documents")
    totals = fit_lm(docs, fold("doc_id", 7) != 2)
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return score_lm(docs, totals).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
