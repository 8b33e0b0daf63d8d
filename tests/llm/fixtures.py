"""Small tables with the awkward cases every operator has to bear, and plain versions of shared definitions."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node long, mark string, ids string, decoded string, "
    "size int, shard int, rows int, words string, bucket int, quality_score string, __x int"
)
WORDS = "the of stone river light and a paper green window over night song small wheel bright under field morning copper".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 400))]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 5, 8, 40, 60, 80, 120)]
    rows: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    words = base[5].split()
    near = words[:40] + ["changed"] + words[41:]
    rows += [(20, " ".join(near)), (21, base[5].upper()), (22, base[5]), (23, base[6] + " tail"), (24, "Tail " + base[6])]
    rows += [(30, None), (31, ""), (32, "  \t\n "), (33, None), (34, "ünï ▁ cödé 日本 \n\n x"), (35, "a\nb\na\nA \n\n" + base[3])]
    rows += [(None, "a text without an id " + base[4]), (None, None), (None, base[3])]
    rows += [(40, base[4]), (40, base[4]), (41, "word " * 30_000), (42, "x" * 50_000)]
    rows += [(50 + k, base[6] + f" {k}") for k in range(12)]
    return rows


def documents(spark, rows=None):
    data = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}" if i else None, len(t) if t else None, 7, "m", "i", "d", 1, 2, 3, "w", 4, "q", 5)
            for i, t in (texts() if rows is None else rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", fold(text))


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def root(parents: dict, x):
    while parents[x] != x:
        x = parents[x]
    return x
