"""Shingle classes, fingerprints, encoding, personal data and the language model against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm.edge import edge_docs, empty_docs, prose, rows, words_of
from logwarden.llm import op2_jaccard
from logwarden.llm.common import fold
from logwarden.llm.op2_jaccard import OP2_SQL, near_duplicates, prefix_length
from logwarden.llm.op4_merkle import Tree, differences, fingerprint_chain, likeness
from logwarden.llm.op7_pii import KINDS, Tagger, base_spans, find_spans, fit_tagger, luhn, personal_data, redact, windows
from logwarden.llm.op8_bpe import Encoder, decode_ids, encode_texts, load
from logwarden.llm.op10_lm import HashTable, Model, fit_lm, score_lm
from logwarden.llm.text import hash_words, utf8

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_cut_and_hashed_like_the_pattern():
    texts = [r[1] for r in rows()] + ["A a\tB\x0bb\x0c\x0d É é", "x" * 3_000_000, "x" * 3_000_000 + " y"]
    hashes, firsts = hash_words(*utf8(pa.array(texts)))
    by_word: dict[str, set] = defaultdict(set)
    for i, text in enumerate(texts):
        words = words_of(text)
        assert firsts[i + 1] - firsts[i] == len(words)
        for w, h in zip(words, hashes[firsts[i] : firsts[i + 1]].tolist()):
            by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({h for v in by_word.values() for h in v}) == len(by_word)


# ---- near duplicates


def shingles(text: str | None) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in sets}
    changed = True
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_prefixes_hold_a_shared_shingle():
    for n in range(0, 200):
        need = -(-80 * n // 100)
        assert prefix_length(n) == (n - need + 1 if n else 0)


@pytest.mark.parametrize("block", [400, 16])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr("logwarden.llm.op2_jaccard.BLOCK", block)  # 16: clusters of many blocks, and the second turn
    rng = random.Random(4)
    base = prose(rng, 150).split()
    texts: list[str | None] = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    for _ in range(120):  # near copies of one text, more or less alike
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 99))
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 30 + [None, "", "a", "a", "a b", "A  B", "a b c d e", "a b c d e a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    want = plain_classes(list(enumerate(texts)))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(texts[i])) for i, r in got.items())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = con.sql(OP2_SQL).fetchall()
    assert {x[0]: x[2] for x in sql} == want


def test_classes_of_hard_rows(spark):
    got = near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    missing = [r for r in got if r["doc_id"] is None]
    assert [r["component_id"] for r in missing] == [None] and missing[0]["n_shingles"] == 1
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[64] == by_id[65] == by_id[66] == 64 and by_id[69] == 69
    assert {i: c for i, c in by_id.items() if i is not None} == plain_classes(sorted({(r[0], r[1]) for r in rows() if r[0] is not None}, key=lambda r: r[0]))
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_texts_of_one_id_lose_no_link(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    made = [(5, a), (5, b), (9, b + " word"), (9, b + " word"), (2, c), (7, a + " more"), (7, c), (30, prose(rng, 50)), (30, None)]
    got = near_duplicates(spark.createDataFrame([(*x, "x", 3) for x in made], "doc_id long, text string, digest string, node long")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, 30 if i == 30 else 2) for i, _ in made)


def test_sizes_whose_need_dips_by_rounding_stay_linked(spark):
    core = " ".join(f"core{i}" for i in range(95))  # 91 shingles
    texts = [core + "".join(f" own{n}x{i}" for i in range(n - 91)) for n in (100, 104, 105)]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = plain_classes(list(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in got} == want and want[1] == 0


def test_the_group_filter_asks_no_more_than_any_size_needs(spark):
    need = lambda a, b: -(-80 * (a + b) // 180) - max(-(-80 * a // 100), -(-80 * b // 100)) + 1
    rng = random.Random(9)
    lists = [sorted(rng.sample(range(a, a + 40), 3)) for a in range(20, 200)]
    # each group shares just what its least demanding partner in range needs
    asked = {(i, n): min((need(n, m) for m in own if m != n and 80 * max(m, n) <= 100 * min(m, n)), default=None) for i, own in enumerate(lists) for n in own}
    listed = spark.createDataFrame([(i, i * 1000 + n, x) for (i, n), x in asked.items() if x is not None], "list_id long, gid long, tokens long")
    sizes = spark.createDataFrame([(i * 1000 + n, n) for i, n in asked], "gid long, n long")
    kept = {(r["list_id"], r["gid"]) for r in op2_jaccard._possible(listed, sizes, 80).collect()}
    three = {i for i in range(len(lists)) if all(asked[i, n] is not None for n in lists[i])}
    assert three and {(i, i * 1000 + n) for i in three for n in lists[i]} <= kept


# ---- fingerprints


def test_fingerprints_of_a_chain(spark):
    got = fingerprint_chain(edge_docs(spark)).collect()
    data = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(data)
    want = []
    for k, (i, text) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = str(Tree(text)), str(Tree(edited)), str(Tree(after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 12), round(likeness(a, c), 12)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in got], key=key) == sorted(want, key=key)
    assert fingerprint_chain(empty_docs(spark)).count() == 0


def test_differences_locate_an_edit():
    rng = random.Random(8)
    text = "\n".join(prose(rng, 60).replace("\n", " ") for _ in range(40))
    at = 5000
    edited = text[:at] + "EDIT" + text[at:]
    a, b = str(Tree(text)), str(Tree(edited))
    assert a != b and 0.9 < likeness(a, b) < 1 and likeness(a, a) == 1.0
    (lo, hi), *rest = differences(b, a)
    assert not rest and lo <= at and at + 4 <= hi and hi - lo < 300
    assert differences(a, a) == [] and likeness(str(Tree("")), str(Tree(""))) == 1.0 and likeness(str(Tree("")), a) == 0.0


# ---- encoding


def test_encoding_equals_the_library():
    library, encoder = Tokenizer.from_file(TOKENIZER), Encoder(*load(TOKENIZER))
    rng = random.Random(3)
    letters = list("aabbccdehllooorsstt'''  .,!019-ÉéßñİΣσ一日本́　\x1c\x1f\x85😀🏽ﬁ½²Ⅷ٣") + ["<|endoftext|>", "<|", "aaa", "the", "ing", "ation"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [r[1] or "" for r in rows()] + ["a" * 5000, "ab" * 3000]
    for text, ref in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = encoder.encode(text)
        assert ids.tolist() == ref.ids, text
        assert encoder.decoder.decode(ids) == library.decode(ref.ids, skip_special_tokens=False)


def test_encoded_tables(spark):
    library = Tokenizer.from_file(TOKENIZER)
    got = encode_texts(edge_docs(spark), TOKENIZER)
    back = {(r["doc_id"], r["text"]) for r in decode_ids(got, TOKENIZER).collect()}
    data = got.collect()
    assert len(data) == len(rows())
    want = Counter()
    for i, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert (i, decoded) in back
    assert Counter((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in data) == want
    assert encode_texts(empty_docs(spark), TOKENIZER).count() == 0


# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if ok[kind]():
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    letters = list("ab09@@..--++() 1234567890") + ["4111111111111111", "10.0.0.1", "a@b.c", "+1 (017) 555-7713", "é", "\n", "4111 1111 1111 1111"]
    for _ in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert base_spans(text) == plain_spans(text), text


def test_windows_cover_each_sign_once():
    firsts = np.cumsum([0, 0, 1, 256, 257, 5000, 0, 192 * 3 + 64, 192 * 3 + 65])
    seen = np.zeros(firsts[-1], int)
    for start, length, a, b in windows(firsts):
        assert start <= a < b <= start + length and length <= 256
        seen[a:b] += 1
    assert (seen == 1).all()


@pytest.fixture(scope="module")
def tagger(spark) -> Tagger:
    return fit_tagger(edge_docs(spark))


def test_personal_data(spark, tagger):
    got = {r["doc_id"]: r for r in personal_data(edge_docs(spark), tagger).collect()}
    for i, text, *_ in rows():
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(text or ""))
        assert got[i]["base"] == base and set(base.split(",")) <= set(got[i]["spans"].split(","))
    kinds = [s.split(":")[0] for s in got[68]["base"].split(",")]
    assert sorted(kinds) == ["card", "email", "ip", "phone"]
    cleaned = {r["doc_id"]: r for r in redact(edge_docs(spark), tagger).collect()}
    assert "example.org" not in cleaned[68]["text"] and "<email>" in cleaned[68]["text"] and cleaned[68]["n_chars"] == len(cleaned[68]["text"])
    assert cleaned[60]["text"] is None and cleaned[5]["text"] == rows()[5][1] and cleaned[5]["spans"] == "s"
    assert fit_tagger(empty_docs(spark)) is None and personal_data(empty_docs(spark), None).count() == 0


def test_the_network_adds_what_the_patterns_miss(tagger):
    rng = random.Random(9)
    texts, found = [], 0
    for _ in range(100):
        texts.append(f"{prose(rng, 10)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} {prose(rng, 10)}")
    for text, base, spans in find_spans(pa.array(texts), tagger):
        assert not base
        found += any(k == "phone" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", text[a:b]) for a, b, k in spans)
    assert found >= 80
    clean = [prose(rng, 200) for _ in range(50)] + ["in 1999, 12 of 345 left. 50% at 10:30", "2024-01-02 v1.2.3"]
    assert all(not spans for _, _, spans in find_spans(pa.array(clean), tagger))


# ---- language model


def plain_model(texts: list[str], order: int):
    tokens = [words_of(t) + ["</s>"] for t in texts]
    words = Counter(w for t in tokens for w in t)
    seen = {k: Counter() for k in range(1, order + 1)}  # occurrences; a start sign may come first
    for t in tokens:
        t = ["<s>", *t]
        for k in seen:
            seen[k].update(tuple(t[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(t)))
    grams = {order: seen[order]}
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in seen[k + 1])
        grams[k] = {g: n if g[0] == "<s>" else before[g] for g, n in seen[k].items()}

    def cuts(values) -> list[float]:
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not n[0]:
            return [0.0] * 4
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) if n[k - 1] and n[k] else min(0.75, k) for k in (1, 2, 3)]

    cut = {k: cuts(list(g.values())) for k, g in grams.items()}
    follow = defaultdict(list)
    for g in grams.values():
        for gram, n in g.items():
            follow[gram[:-1]].append(n)

    def p(context: tuple[str, ...], w: str) -> float:
        """Contexts are cut to order - 1 words and begin with the start sign at the latest."""
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (len(words) + 1)
        if context not in follow:
            return lower
        n, d, total = grams[k].get((*context, w), 0), cut[k], sum(follow[context])
        return max(n - d[min(n, 3)], 0) / total + sum(d[min(x, 3)] for x in follow[context]) / total * lower

    return words, p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_the_plain_model(spark, order):
    docs = edge_docs(spark)
    totals = fit_lm(docs, fold("doc_id", 7) != 2, order=order)
    got = score_lm(docs, totals).collect()
    data = [(i, t or "") for i, t, *_ in rows()]
    words, p = plain_model([t for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 7 != 2], order)
    n, v = sum(words.values()), len(words)
    assert len(got) == len(data) and totals.tokens == n and totals.words == v
    want = {}
    for i, text in data:
        t = words_of(text) + ["</s>"]
        padded = ["<s>", *t]
        logs = sum(math.log10(p(tuple(padded[max(0, j - order + 1) : j]), padded[j])) for j in range(1, len(padded)))
        want[i] = (len(t), sum(w in words for w in t), sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), logs)
    for r in got:
        n_tokens, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    for context in (("the",), ("never seen", "the"), ("<s>", "the"))[:order]:
        assert sum(p(context, w) for w in words) + p(context, "never seen") == pytest.approx(1.0)


def test_small_chunks_and_frequent_words_give_the_same_scores(spark, monkeypatch):
    docs = edge_docs(spark)
    plain = fit_lm(docs, fold("doc_id", 7) != 2)
    want = {tuple(r) for r in score_lm(docs, plain).collect()}
    monkeypatch.setattr("logwarden.llm.op10_lm.SHARD_BYTES", 2000)
    monkeypatch.setattr("logwarden.llm.op10_lm.FREQUENT", 0.01)
    split = fit_lm(docs, fold("doc_id", 7) != 2)
    assert split.shards > plain.shards and len(split.frequent) > len(plain.frequent)
    assert split.discounts == plain.discounts and split.pairs == plain.pairs
    assert {tuple(r) for r in score_lm(docs, split).collect()} == want


def test_hash_table_finds_all_keys_and_no_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000, 100_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        values = np.stack([rng.zipf(1.3, len(keys)).clip(0, 1 << 40), rng.integers(0, 3, len(keys))], 1)
        found = HashTable(np.frombuffer(HashTable.bytes_of(keys, values), np.uint8))
        assert (found.find(keys) == values).all()
        assert not found.find(np.setdiff1d(rng.integers(0, 1 << 64, 500, dtype=np.uint64), keys)).any()


def test_a_model_of_nothing_is_uniform(spark):
    totals = fit_lm(empty_docs(spark), fold("doc_id", 7) != 2)
    r = score_lm(edge_docs(spark), totals).where("doc_id = 60").first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (1, 0, 0, 0.0)
    assert Model(totals).t.pairs == 0 and score_lm(empty_docs(spark), totals).count() == 0
