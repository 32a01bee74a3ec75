"""Rows that operators must take: nulls, empty and long texts, repeats, ties, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns.
CLASHES = ("rid", "h", "c", "n", "kept", "target", "taken", "size", "_size", "_row", "_s", "_b", "score", "toxic", "ids", "rank", "at")


def text(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Some 140 rows: copies, near copies, shared passages, and awkward ones."""
    rng = random.Random(seed)
    base = [text(rng, rng.randrange(30, 300)) for _ in range(40)]
    passage = text(rng, 70)
    texts = list(base)
    texts += [base[3]] * 6 + [base[4], base[4] + " "]
    for i in range(30):
        words = base[5 + i % 6].split(" ")
        for _ in range(1 + i % 9):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words))
    texts += [f"{text(rng, 20)}\n{passage} {text(rng, 15)}" for _ in range(12)]
    texts += [passage, passage.upper(), f"{passage}\t{passage}"]
    texts += [None, "", " \n\t ", "one", "one", "One", "a b c", "a b c d e", "same " * 120, "same " * 400, "é ü 日本 \U0001f600 ß", text(rng, 20_000), "x" * 40_000]
    texts += ["- a line\n" * 7 + "end of it", "a b c d", "0 \x00 nul", "w1 " * 49, "w1 " * 50]
    rows = [(i, t, "en", (None, "s1", "s2", "s2", "s3")[i % 5], len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, base[0], "en", "s1", 1), (None, None, None, None, None), rows[3], rows[3], (5, base[9], "en", "s2", 5)]
    return rows


def frame(spark, rows=None, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}) if clashes else df


def labels(spark, rows=None):
    return spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (999, 1, 1)] if rows is None else rows, "doc_id long, quality int, toxic int")
