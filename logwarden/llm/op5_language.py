"""Language identification by error-correcting output codes.

Each language has a codeword; a binary n-gram classifier predicts each bit. Decoding sums, for each codeword, the logistic losses
of the bits' margins, weighted by how well each bit did on the rows it was fitted on, and takes the word with the least
loss. Where the runner-up is too near, the prediction is flagged as ambiguous.

Fitting reads at most ``per_language`` rows of each language, those with the smallest hash of the id; only their n-gram counts
reach the driver. Prediction is one pass over whole texts without a shuffle.

Cases: a text that is null or has no letter is ``und`` with score 0 and not ambiguous; without any learned language all are; with one
language all others are that one with score 1; a null id is never fitted on and not held out; repeated rows and ties are each predicted
on their own, a tie of losses goes to the smaller language name; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import fold, keyed_text, map_batches, rewrite_batches, ship, table
from logwarden.llm.text import text_of

DIMENSIONS = 1024
PER_LANGUAGE = 600
#: A prediction is ambiguous if the best score is less than this much above the next one.
LEAST_LEAD = 0.02
UNDETERMINED = "und"

_CLEAN = np.arange(256, dtype=np.uint32)
_CLEAN[:128] = 32
_CLEAN[97:123] = np.arange(97, 123)


def ngram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of hashed two- and three-byte counts over the lower-cased letters, scaled to length 1."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    b = _CLEAN[raw]
    b = b[(b != 32) | (np.append(np.uint32(0), b[:-1]) != 32)]  # one space for a run of other signs
    if len(b) < 3:
        return np.zeros(dimensions, np.float32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - dimensions.bit_length() + 1)
    x = np.bincount((two * np.uint32(0x165667B1)) >> shift, minlength=dimensions) + np.bincount(three >> shift, minlength=dimensions)
    x = np.sqrt(x.astype(np.float32))
    return x / np.linalg.norm(x)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1: all different splits for up to 7 languages, else the best of 64 random codes by least distance."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(np.arange(n)[:, None] == 0, -1, np.where(splits[None, :] >> np.maximum(np.arange(n)[:, None] - 1, 0) & 1, 1, -1)).astype(np.int8)
    rng, best, best_gap = np.random.default_rng(7), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        same = code.astype(int) @ code.T.astype(int)
        gap = (code.shape[1] - (same - np.diag(np.diag(same)) - 10**6 * np.eye(n, dtype=int)).max()) // 2
        if gap > best_gap:
            best, best_gap = code, gap
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of each language, from the weighted losses of its codeword."""
        if not self.code.shape[1]:
            return np.ones((len(x), len(self.languages)))
        margin = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None].astype(np.float64)) @ self.bit_weight
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str], least_lead: float = LEAST_LEAD) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the prediction is ambiguous."""
        names, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return names, score, unsure
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        for lo in range(0, len(at), 512):
            rows = at[lo : lo + 512]
            share = self.scores(np.stack([ngram_counts(texts[i]) for i in rows]))
            best = share.argmax(1)
            top = share[np.arange(len(rows)), best]
            share[np.arange(len(rows)), best] = 0
            for i, b, s, second in zip(rows, best, top, share.max(1)):
                names[i], score[i], unsure[i] = self.languages[b], s, s - second < least_lead
        return names, score, unsure


def fit_codes(x: np.ndarray, labels: list[str], rounds: int = 300, penalty: float = 1e-4) -> LanguageModel:
    """One logistic classifier for each bit, by accelerated gradient steps; rows weigh as if languages were equally many."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = np.array([languages.index(v) for v in labels], int)
    bits = code.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return LanguageModel(languages, code, w, b, np.ones(0))
    share = (1.0 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)[:, None] / len(languages)
    target = code[y].astype(np.float32)
    vw, vb, step = w.copy(), b.copy(), np.float32(8.0)
    for k in range(rounds):
        g = -target * share / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30)))
        new_w, new_b = vw - step * (x.T @ g + penalty * vw), vb - step * g.sum(0)
        pull = np.float32(k / (k + 3))
        vw, vb, w, b = new_w + pull * (new_w - w), new_b + pull * (new_b - b), new_w, new_b
    right = ((target * (x @ w + b) > 0) * share).sum(0)
    bit_weight = np.clip(right - 0.5, 0.01, None)
    return LanguageModel(languages, code, w, b, (bit_weight / bit_weight.mean()).astype(np.float64))


def fit_languages(docs: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Model of the languages of the rows where ``usable`` holds and the language is not null."""
    ship(docs.sparkSession)
    rows = docs.where(usable).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    slim = rows.where("doc_id is not null and lang is not null").select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    chosen = slim.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= per_language).select("doc_id", "lang")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null")

    def count(batch: pa.RecordBatch) -> dict:
        counted = [ngram_counts(t).astype(np.float16).tobytes() if has_letter(t) else None for t in batch.column(1).to_pylist()]
        return {"lang": batch.column(0), "x": pa.array(counted, pa.binary())}

    got = map_batches(texts.select("lang", "text"), count, "lang string, x binary").where("x is not null").orderBy("lang", "x").toArrow().to_pydict()
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return fit_codes(x, got["lang"])


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> dict:
        names, score, unsure = shared.value.predict(text_of(batch.column(1)))
        return {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "ambiguous": pa.array(unsure)}

    return map_batches(keyed_text(docs, id_col, text_col), predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Rows, with all columns, whose language can be told: not ``und`` and not ambiguous. A model without languages rejects only texts without a letter."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_of(batch.column(batch.schema.get_field_index(text_col)))
        if not shared.value.languages:
            return batch.filter(pa.array([has_letter(t) for t in texts]))
        names, _, unsure = shared.value.predict(texts)
        return batch.filter(pa.array([n != UNDETERMINED and not u for n, u in zip(names, unsure.tolist())]))

    return rewrite_batches(docs, keep)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the language of every whole text of ``documents``, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")
