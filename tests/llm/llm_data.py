"""Small inputs for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ka lo mi ren ta sol ver ni pa du".split()


def prose(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)]


def documents(spark, rows, **extra):
    """rows of (doc_id, text, lang, source); extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


CLASHING = {"size": -1, "row": "x", "node": 7, "score": 0.5, "kept": False, "source_size": 3, "__h": 9, "p": "p",
            "goal": 1.0, "held_out": True, "rank": 4, "component": 1, "words": "w", "n": 2, "host": "h", "__m": 5}

#: Null, empty, blank, short, long and repeated texts.
EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, "x", "fr", None),
        (5, "one two three four", "en", "b"), (5, "one two three four", "en", "b"), (None, "a b c d e f", "en", "b"),
        (7, "ab " * 30_000, "en", "a"), (8, "é\xa0ñ 中文 \U0001f600 <|endoftext|> x", "es", "c"),
        (9, "1234 !!! ---", "en", "c")]
