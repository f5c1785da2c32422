"""Byte-pair encoding by a tokenization automaton, and decoding.

The automaton reads tokens. It starts as one state with a loop for each base symbol. Merges are taken in
order of rank; a merge gadget for (a, b) -> c does the following to every state p that an a-arc leaves for a state q
with a b-arc to s: the a-arc of p now ends in a copy of q without its b-arc, and p gets a c-arc to s.
The state that is reached by a token depends on that token alone, so states are kept factored: a state is that
of its last token, "cut" holds the arcs that gadgets removed, and arcs that a gadget added are found through
the left part of the new token at the time of its merge. Right after the construction the automaton has exactly
one path for each word, and its labels are the tokens of the word.

To encode, the arcs whose labels start the rest of a word are looked up in the transition tables, and taken if the
state has them; a position that leads nowhere is left again and never tried twice. To decode, the arc labels are emitted.

Cases: a null text is empty and has no token; special tokens found in a text are taken as their ids, as the vocabulary's library does;
repeated rows are encoded each on its own; very long texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from logwarden.llm.common import keyed_text, map_batches, ship, table
from logwarden.llm.text import text_of

#: Pre-split of the vocabulary's own file; fixed value.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words whose encoding a worker remembers; more only cost time.
REMEMBERED_WORDS = 200_000
#: Letter runs, numbers and sign runs, likewise.
REMEMBERED_PIECES = 500_000

_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL_WHITE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Automaton:
    """Tokenization automaton over token ids, built from a vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.born = [-1] * size  # rank of the merge that made the token; -1: base symbol
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}  # (token, next token) -> rank of the gadget that removed the arc
        self.known: dict[int, bool] = {}
        self.size = size
        for rank, (a, b) in enumerate(merges):
            i, j, c = vocab[a], vocab[b], vocab[a + b]
            if self.born[c] < 0 and self._arc(i, j, rank):
                self.cut[i * size + j] = rank
                self.born[c], self.left[c], self.right[c] = rank, i, j
        self._table(vocab)

    def _arc(self, t: int, u: int, now: int) -> bool:
        """Is there a u-arc at the state of t before the gadget of rank ``now``?"""
        while True:
            removed = self.cut.get(t * self.size + u)
            if removed is not None and removed < now:
                return False
            made_t, made_u = self.born[t], self.born[u]
            if made_t < 0 and made_u < 0:
                return True
            if made_u >= made_t:  # the gadget of u gave the arc to each state that kept an arc of its left part
                now, u = made_u + 1, self.left[u]
            else:  # the state of t is the one that its right part led to when t was made
                now, t = made_t, self.right[t]

    def _table(self, vocab: dict[str, int]) -> None:
        """Transition tables by label: one for arcs inside a word, one for arcs that end it."""
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            body = token.removesuffix(WORD_END)
            if body and all(c in byte_of for c in body) and (len(body) == 1 or self.born[i] >= 0):
                (self.final if token.endswith(WORD_END) else self.inner)[bytes(byte_of[c] for c in body)] = i
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)

    def allowed(self, t: int, u: int) -> bool:
        key = t * self.size + u
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[key] = self._arc(t, u, 1 << 60)
        return got

    def encode(self, word: bytes) -> list[int]:
        """Tokens of a word: the one path that reads all its bytes. A byte that the vocabulary lacks has no token and splits the word."""
        n, i, state = len(word), 0, -1
        inner, final, longest, allowed = self.inner, self.final, self.longest, self.allowed
        out: list[int] = []
        taken: list[tuple[int, int, int]] = []  # position, state and end of each arc on the path
        tried: set[tuple[int, int]] = set()
        j = n
        while i < n:
            j = min(j, i + longest)
            while j > i:
                u = (final if j == n else inner).get(word[i:j])
                if u is not None and (state < 0 or allowed(state, u)) and (j, u) not in tried:
                    break
                j -= 1
            if j > i:
                taken.append((i, state, j))
                tried.add((j, u))
                out.append(u)
                i, state, j = j, u, n
            elif taken:  # no arc leads on from here: the next shorter arc from the position before
                i, state, j = taken.pop()
                out.pop()
                j -= 1
            else:
                return self._without_unknown(word)
        return out

    def _without_unknown(self, word: bytes) -> list[int]:
        for at in range(len(word)):
            if word[at : at + 1] not in (self.final if at == len(word) - 1 else self.inner):
                return (self.encode(word[:at]) if at else []) + (self.encode(word[at + 1 :]) if at + 1 < len(word) else [])
        raise ValueError("the vocabulary has no path for a word of its own symbols")


class Encoder:
    """Encodes and decodes whole texts with a tokenizer file's vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.automaton = Automaton(vocab, merges)
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pre_split = regex.compile(PRE_SPLIT)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.decoder = Decoder(vocab | special)

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= REMEMBERED_PIECES:
            self.pieces.clear()
        ids = self.automaton.encode(piece.encode("utf-8", "surrogatepass"))
        got = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii():
            text = word.lower()
        else:
            text = unicodedata.normalize("NFC", word)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        pieces = self.pieces
        if text.isalpha() and text.isascii():
            got = pieces.get(text) or self._piece(text)
        else:
            got = b"".join([pieces.get(x) or self._piece(x) for x in self.pre_split.findall(text)])
        if len(self.words) >= REMEMBERED_WORDS:
            self.words.clear()
        self.words[word] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        words = text.split() if not _CONTROL_WHITE.search(text) else [w for w in _WHITE.split(text) if w]
        known = self.words
        return [known.get(w) or self._word(w) for w in words]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.at_special is None or not self.at_special.search(text):
            parts = self._plain(text)
        else:
            parts = []
            for piece in self.at_special.split(text):
                parts += [struct.pack("<I", self.special[piece])] if piece in self.special else self._plain(piece)
        return np.frombuffer(b"".join(parts), "<u4")


class Decoder:
    """Emits the labels of arcs, joined as a tokenizer file that names no decoder has it: by one space."""

    def __init__(self, labels: dict[str, int]):
        texts = [b""] * (max(labels.values(), default=-1) + 1)
        for label, i in labels.items():
            texts[i] = label.encode("utf-8", "surrogatepass") + b" "
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; ids without a label are left out."""
        out = []
        for lo in range(0, len(ids), 1 << 16):
            part = ids[lo : lo + (1 << 16)].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.lengths))]
            lengths = self.lengths[part]
            shift = np.repeat(self.starts[part] - (np.cumsum(lengths) - lengths), lengths)
            out.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)[:-1]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64).reshape(-1)).decode("utf-8", "surrogatepass")


def load(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}


_encoders: dict[str, Encoder] = {}


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, the ids (``with_ids``), ids_sha256, decoded_sha256.

    The driver reads the vocabulary file and broadcasts it (its size is that of the file); each worker compiles the automaton once.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(load(path))

    def encode(batch: pa.RecordBatch) -> dict:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(*spec.value)
        n, all_ids, shas, decoded = [], [], [], []
        for text in text_of(batch.column(1)):
            ids = encoder.encode(text)
            n.append(len(ids))
            if with_ids:
                all_ids.append(ids.astype(np.int32))
            shas.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(encoder.decoder.decode_bytes(ids)).hexdigest())
        out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
        if with_ids:
            out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
        return out | {"ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return map_batches(keyed_text(docs, id_col, text_col), encode, schema, rows=256)  # ids of few texts at a time


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text that its ids decode to (null ids: empty)."""
    spark = rows.sparkSession
    ship(spark)
    vocab, _, special = load(path)
    labels = spark.sparkContext.broadcast(vocab | special)

    def decode(batch: pa.RecordBatch) -> dict:
        decoder = Decoder(labels.value)
        return {"doc_id": batch.column(0), "text": pa.array([decoder.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())}

    return map_batches(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids")), decode, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents`` encoded and decoded."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
