"""Small tables with all that is odd: nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""

from __future__ import annotations

import random

CLASHING = "digest string, run int, uid long, key string, size long, slice long, fp long, block int, bucket int, data string, n long, length long, own int, v string, c long, component string, kept boolean, score double"


def texts(n: int = 60, seed: int = 5) -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source)"""
    r = random.Random(seed)
    words = ["river", "stone", "Light", "über", "niño", "été", "go", "1999", "a|b", "quite-long-word"]
    rows: list = []
    for i in range(n):
        line = " ".join(r.choices(words, k=r.randint(1, 40)))
        rows.append((i, line if i % 7 else line + "\n" + line, r.choice(["en", "de", None]), r.choice(["web", "web", "web", "book", None])))
    copy = rows[3]
    rows += [(n, copy[1], "en", "web"), (n + 1, copy[1], "en", "web"), copy, (n + 2, copy[1] + " ", "en", "web")]
    rows += [(n + 3, None, None, None), (n + 4, "", "en", "web"), (None, "", "en", None), (None, copy[1], None, "book"), (n + 5, "   \t\n", "de", "x")]
    rows += [(2**53 + 1, "beyond what a double holds", "en", "web"), (-(2**63) + 1, "far below", "en", "web"), (-(2**63) + 1, "far below", "en", "web"), (2**63 - 1, copy[1] + "!", "de", "book")]
    rows += [(n + 6, "word " * 40_000, "en", "web"), (n + 7, "x" * 120_000, "en", "web"), (n + 8, "\x00 ☃ \U0001F600", "en", "web"), (n + 9, "1234 5678", "en", "web")]
    return rows


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    wide = [(*r, len(r[1] or ""), "q", 1, 2, "k", 3, 4, 5, 6, 7, "d", 8, 9, 10, "v", 11, "z", True, 0.5) for r in rows]
    return spark.createDataFrame(wide, schema)


def key(x):
    return (x is None, x if x is not None else 0)
