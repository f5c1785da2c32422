"""Personal data: base patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss.

The network reads the whole text as characters; a run of letters is read as one sign, so most of prose is two signs for
each word and the digits, points and signs that tell personal data apart are read one by one. Texts longer than a window are read
in overlapping windows; each window is decoded by the CRF, and each sign takes its tag from the window in which
it lies farthest from an edge. Runs of one tag become spans. A span is added if it meets no base span and passes the same
kind of check as the base pattern (an address with ``@``, four parts up to 255, a Luhn sum, 9 to 15 digits); base spans always stay.

The network is trained in numpy on at most ``SAMPLE`` documents, those with the smallest id hash: their base spans are the labels, and written variants
of each kind are put between their words. Only training windows reach the driver.

Cases: a null text is empty and has no span; texts of any length are read whole; equal rows are read each on their own; an empty
table is not trained on and gives no rows; other columns are not read (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import keyed_text, map_batches, rewrite_batches, ship, table
from logwarden.llm.lstm import BiLSTM
from logwarden.llm.text import text_of, utf8

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1500
#: Training windows that a document gives at most; a fit needs only some of the labels.
SAMPLE_WINDOWS = 4
HIDDEN = 8
WINDOW = 256
#: Signs that two neighbouring windows share.
OVERLAP = 64
TOGETHER = 1024

# ---- base patterns (fixed values)

_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small_parts(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed in ``KINDS``."""
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _EMAIL_LEFT_CHARS:
            start -= 1
        right = _EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            end = right.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if _small_parts(m.group()):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- signs

_OTHER = "@.-+()_%,:;=/\"'!?#$&*|[]{}<>\\^`~"
PAD = 0
_SIGN = np.full(256, 5, np.uint8)  # 1 letters, 2 digits, 3 white space, 4 line ends, 5 control signs, then the others
_SIGN[65:91] = _SIGN[97:123] = _SIGN[128:] = 1
_SIGN[48:58] = 2
_SIGN[[9, 11, 12, 13, 32]] = 3
_SIGN[10] = 4
for _i, _c in enumerate(_OTHER):
    _SIGN[ord(_c)] = 6 + _i
SIGNS = 6 + len(_OTHER)


def signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of all rows, the byte at which each starts, and for each row the index of its first sign (n + 1 values)."""
    base = int(offsets[0])
    kind = _SIGN[data[base : int(offsets[-1])]]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != 1) | (kind[:-1] != 1)
    rel = offsets - base
    first[rel[:-1][rel[:-1] < len(kind)]] = True
    at = np.flatnonzero(first)
    return kind[at], at + base, np.searchsorted(at, rel)


def windows(firsts: np.ndarray) -> np.ndarray:
    """Rows (start, length, first own sign, end of own signs) that cover each row's signs; neighbours share ``OVERLAP`` signs."""
    out = []
    step, margin = WINDOW - OVERLAP, OVERLAP // 2
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts <= WINDOW))
    if len(short):
        out.append(np.stack([firsts[short], counts[short], firsts[short], firsts[short + 1]], 1))
    for row in np.flatnonzero(counts > WINDOW):
        lo, hi = firsts[row], firsts[row + 1]
        start = np.arange(lo, max(hi - OVERLAP, lo + 1), step)
        stop = np.minimum(start + WINDOW, hi)
        own = np.where(start == lo, lo, start + margin)
        out.append(np.stack([start, stop - start, own, np.append(own[1:], hi)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


class Tagger:
    """The network over signs; tag 0 is none, then ``KINDS``."""

    def __init__(self, net: BiLSTM):
        self.net = net

    def tags(self, sign: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """One tag for each sign."""
        out = np.zeros(len(sign), np.int8)
        todo = windows(firsts)
        todo = todo[np.argsort(todo[:, 1], kind="stable")]
        for lo in range(0, len(todo), TOGETHER):
            part = todo[lo : lo + TOGETHER]
            lengths = part[:, 1]
            place = np.arange(int(lengths[-1]))[:, None]
            index = part[:, 0][None, :] + np.minimum(place, lengths[None, :] - 1)
            ids = np.where(place < lengths[None, :], sign[index], PAD)
            got = self.net.viterbi(self.net.scores(Signs(ids), lengths), lengths)
            own = (index >= part[:, 2]) & (index < part[:, 3]) & (place < lengths[None, :])
            out[index[own]] = got[own]
        return out


class Signs:
    """Sign ids (time, sequence) that stand for one-hot features: a product with a matrix is a choice of its columns."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.shape = (ids.shape[0], SIGNS, ids.shape[1])

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, t):
        return Signs(self.ids[t]) if isinstance(t, slice) else _HOT[:, self.ids[t]]

    def project(self, w: np.ndarray, t: int, out: np.ndarray) -> None:
        np.take(w, self.ids[t], axis=1, out=out, mode="clip")


_HOT = np.eye(SIGNS, dtype=np.float32)


def spans_of(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tag) of each run of one tag."""
    if not tags.any():
        return []
    change = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    out = []
    for a, b in zip(change[:-1], change[1:]):
        if tags[a]:
            out.append((int(starts[a]), int(ends[b - 1]), int(tags[a])))
    return out


_EDGE = re.compile(r"^[^\w(+]+|[^\w)]+$")


def passes(kind: str, text: str) -> bool:
    """The check of a kind, for spans that its base pattern did not find."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text) is not None and _small_parts(text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", text) is not None and luhn(digits)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]+[0-9]", text) is not None and re.search(r"[ ()./-]", text) is not None and not _IP.fullmatch(text) and not is_date(text)


def is_date(text: str) -> bool:
    """A date or a range of numbers rather than a number to call."""
    return re.fullmatch(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}.*", text) is not None


def find_spans(batch: pa.Array, tagger: Tagger | None) -> list[tuple[str, list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each row its text, base spans, and all spans, in code points."""
    texts = text_of(batch)
    tags = None
    if tagger is not None:
        data, offsets = utf8(batch)
        sign, at, firsts = signs(data, offsets)
        tags = tagger.tags(sign, firsts)
        stops = np.append(at[1:], offsets[-1])
    out = []
    for row, text in enumerate(texts):
        base = base_spans(text)
        spans = base
        if tags is not None and tags[firsts[row] : firsts[row + 1]].any():
            lo, hi = firsts[row], firsts[row + 1]
            raw = data[offsets[row] : offsets[row + 1]]
            point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
            for a, b, tag in spans_of(tags[lo:hi], at[lo:hi] - offsets[row], stops[lo:hi] - offsets[row]):
                a, b = int(point[a]) - 1, int(point[b - 1])
                piece = text[a:b]
                left = len(piece) - len(re.sub(r"^[^\w(+]+", "", piece))
                piece = _EDGE.sub("", piece)
                a, b = a + left, a + left + len(piece)
                if piece and passes(KINDS[tag - 1], piece) and all(b <= s or e <= a for s, e, _ in base):
                    spans = [*spans, (a, b, KINDS[tag - 1])]
            spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
        out.append((text, base, spans))
    return out


# ---- training

TRAIN_SIGNS = 64


def _written(rng: random.Random) -> tuple[str, str]:
    """One made-up item of a kind, in one of its usual forms."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("aeilnorst") for _ in range(rng.randint(1, 7)))
    kind = rng.choice(KINDS)
    if kind == "email":
        user = rng.choice([name, name + "." + name, name + number(2), number(2), name + "_" + name, name + "+" + name])
        host = rng.choice([name, "mail" + number(1), name + "-" + name])
        return f"{user}@{host}{rng.choice(['.example', '.' + name, ''])}.{rng.choice(['com', 'org', 'net', 'fr', 'de'])}", kind
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        gap = rng.choice(["", " ", "-", ""])
        return gap.join(number(4) for _ in range(4)), kind
    local = rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}"])
    return f"+{rng.randint(1, 99)} {local}" if rng.random() < 0.7 else local, kind


def _other_number(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return rng.choice([number(rng.randint(1, 8)), f"{rng.randint(1900, 2030)}", f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.{number(1)}", f'token = "{token}"', f"{number(2)}%", f"{number(4)}-{number(2)}-{number(2)}", f"${number(3)}.{number(2)}", f"v{number(1)}.{number(2)}", f"{number(2)}:{number(2)}"])


def train(samples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, made: int = 1500) -> Tagger | None:
    """Network from labelled texts: (text, spans) pairs; spans in code points."""
    if not samples:
        return None
    rng = random.Random(17)
    labelled = list(samples)
    words = [w for text, _ in samples[:400] for w in text.split()[:60]] or ["a"]
    for _ in range(made):
        text, spans = "", []
        for _ in range(rng.randint(8, 20)):
            roll = rng.random()
            if roll < 0.15:
                item, kind = _written(rng)
                spans.append((len(text), len(text) + len(item), kind))
            else:
                item = _other_number(rng) if roll < 0.25 else rng.choice(words)
            text += item + rng.choice([" ", " ", " ", ", ", ". ", "\n", "!! ", "### "])
        labelled.append((text, spans))
    rows, marks = [], []
    for text, spans in labelled:
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            continue
        sign, at, _ = signs(data, np.array([0, len(data)]))
        points = np.cumsum((data & 0xC0) != 0x80) - 1
        tag = np.zeros(len(sign), np.int64)
        for a, b, kind in spans:
            tag[(points[at] >= a) & (points[at] < b)] = KINDS.index(kind) + 1
        centre = int(np.flatnonzero(tag)[0]) if tag.any() else rng.randrange(len(sign))
        lo = max(0, min(centre - rng.randint(5, TRAIN_SIGNS - 10), len(sign) - TRAIN_SIGNS))
        rows.append(sign[lo : lo + TRAIN_SIGNS].astype(np.int64))
        marks.append(tag[lo : lo + TRAIN_SIGNS])
    net = BiLSTM(SIGNS, HIDDEN, len(KINDS) + 1, crf=True)
    order = np.random.default_rng(2).permutation(len(rows))
    batches = []
    for lo in range(0, len(order), 256):
        part = sorted(order[lo : lo + 256], key=lambda i: len(rows[i]))
        lengths = np.array([len(rows[i]) for i in part])
        x, y = np.zeros((TRAIN_SIGNS, len(part)), np.int64), np.zeros((TRAIN_SIGNS, len(part)), np.int64)
        for j, i in enumerate(part):
            x[: lengths[j], j], y[: lengths[j], j] = rows[i], marks[i]
        batches.append((Signs(x), y, lengths))
    net.fit(batches, epochs, 0.05)
    return Tagger(net)


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """Network trained on the base spans of a bounded sample of documents."""
    ship(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batch: pa.RecordBatch) -> dict:
        out: list[str] = []
        for text in text_of(batch.column(0)):
            spans = base_spans(text)
            places = [s for s, _, _ in spans][:SAMPLE_WINDOWS] or [len(text) // 2]
            out += [text[max(0, p - 150) : p + 150] for p in places]
        return {"piece": pa.array([x for x in out if x], pa.string())}

    pieces = map_batches(rows.join(F.broadcast(ids), "doc_id").select("text"), cut, "piece string")
    got = sorted(pieces.toArrow().column("piece").to_pylist())
    return train([(x, base_spans(x)) for x in got])


# ---- DataFrames


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


def personal_data(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base spans and all spans, as kind:start:end joined by commas."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def find(batch: pa.RecordBatch) -> dict:
        found = find_spans(batch.column(1), shared.value)
        return {"doc_id": batch.column(0), "base": pa.array([_joined(b) for _, b, _ in found], pa.string()), "spans": pa.array([_joined(s) for _, _, s in found], pa.string())}

    return map_batches(keyed_text(docs, id_col, text_col), find, "doc_id long, base string, spans string", rows=1000)


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with each span replaced by its kind in angle brackets, and the number of code points corrected."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = []
        for i, (text, _, spans) in enumerate(find_spans(batch.column(at), shared.value)):
            out, last = [], 0
            for a, b, kind in spans:
                if a >= last:
                    out += [text[last:a], f"<{kind}>"]
                last = max(last, b)
            texts.append("".join([*out, text[last:]]) if batch.column(at)[i].is_valid else None)
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        n = batch.schema.get_field_index(chars_col) if chars_col else -1
        if n >= 0:
            columns[n] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rewrite_batches(docs, rewrite)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: personal data in every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit_tagger(docs))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
