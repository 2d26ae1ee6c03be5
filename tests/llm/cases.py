"""Small document tables with the awkward rows every operator has to take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "tor ven al is mar que lo den ris ta ko mi ure sa".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    same = prose(rng, 90)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (None, prose(rng, 60)), (None, None),
        (6, same), (6, same), (7, same), (8, prose(rng, 4000)), (9, "é😀 ▁x \x00 ñ"), (10, "a" * 5000),
    ]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use for their own columns
        from pyspark.sql import functions as F

        for name in ("ids", "kept", "spans", "score", "n_words", "matches", "fail_bits"):
            df = df.withColumn(name, F.lit("own"))
    return df


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
