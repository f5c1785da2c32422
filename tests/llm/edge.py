"""Tables with the hard cases: nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random
import re

WORDS = "the and of in to house river stone light morning paper window garden answer letter yellow winter summer north south".split()
FRENCH = "le la les des une dans avec pour maison riviere pierre lumiere matin papier fenetre jardin reponse lettre hiver".split()

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, size long, copies long, part int, tail int, n int, key string, row string,"
    " digest string, node long, comp long, taken_id long, kept_id long, number int, place long, lang_pred string, spans string"
)
EXTRA = (0.5, 1, 2, 3, 4, 5, "k", "r", "d", 6, 7, 8, 9, 10, 11, "x", "s")


def words_of(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    out = [rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return re.sub(r"\. ", lambda _: rng.choice([". ", ".\n"]), " ".join(out))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    made = []
    for i in range(n):
        french = i % 4 == 3
        text = prose(rng, rng.randint(1, 120), FRENCH if french else WORDS)
        made.append((i, text, "fr" if french else "en", f"s{i % 5}"))
    base = prose(rng, 90)
    made += [
        (n, None, "en", "s0"),
        (n + 1, "", "fr", None),
        (n + 2, prose(rng, 40_000), "en", "s1"),  # very long
        (n + 3, "!!! ... 12 34 ???", None, "s2"),
        (n + 4, base, "en", None),
        (n + 5, base, "en", "s2"),  # exact copy
        (n + 6, base + " ending", "en", "s2"),  # near copy
        (n + 7, "\x00  odd  spaces \x1c\x1f é́ \U0001f600 ΑΣ <|endoftext|> end", "en", "s3"),
        (n + 8, "mail a.b+c@mail.example.org or 10.0.0.256 and 1.2.3.4 call +1 (017) 555-7713 pay 4111 1111 1111 1111", "en", "s3"),
        (None, "a row without an id", "en", "s4"),
        (n + 9, "\n\n \t\n", "en", "s4"),
        (n + 9, "\n\n \t\n", "en", "s4"),  # the same row again
        (n + 10, "one", None, "s4"),
    ]
    return [(*r, len(r[1] or "")) for r in made]


def edge_docs(spark, seed: int = 1, n: int = 60):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows(seed, n)], SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
