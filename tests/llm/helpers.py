"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

LONG = "word " * 30_000
SYLLABLES = {
    "en": ["the", "of", "ing", "th", "er", "and", "on", "re", "ea", "ou"],
    "de": ["sch", "ung", "ein", "der", "ß", "ü", "keit", "zu", "ver", "ich"],
}


def prose(rng: random.Random, lang: str = "en", n: int = 60) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_documents(spark, extra: int = 40):
    """Documents with nulls, empties, a very long text, repeats, ties and clashing column names."""
    rng = random.Random(5)
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, "   \n\t ", None, "a", 6),
        (3, LONG, "en", None, len(LONG)),
        (4, "short", "en", "b", 5),
        (5, "short", "en", "b", 5),
        (6, "12345 !!! 678", "de", "b", 13),
    ]
    for k in range(extra):
        lang = "de" if k % 3 == 0 else "en"
        text = prose(rng, lang)
        rows.append((100 + k, text, lang, "src0", len(text)))
        if k % 5 == 0:
            rows.append((200 + k, text, lang, "src0", len(text)))
        if k % 7 == 0:
            words = text.split()
            words[-1] = "changed"
            rows.append((300 + k, " ".join(words), lang, "src1", len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, length string, block string, cluster string, rep string"
    return spark.createDataFrame([(*r, "x", "y", "z", "c", "r") for r in rows], schema)


def empty(df):
    return df.limit(0)
