import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages, repeated rows, and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgio") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(45)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 160))
        if i % 6 == 1:
            t = t[: len(t) // 2] + " " + passage + "\n" + t[len(t) // 2 :]
        if i % 10 == 3 and i > 10:
            t = rows[i - 7][1] or ""
        if i % 10 == 4 and i > 10:
            w = (rows[i - 8][1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        if i % 10 == 5 and i > 10:
            t = (rows[i - 9][1] or "").replace(" ", " \t ", 3).upper()
        rows.append((1000 + (i * 37) % n, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], 0))
    rows += [(5, None, "en", "s0", 0), (6, "", "en", "s0", 0), (7, " \t\n", None, None, 0), (8, "one two three", "en", "s0", 0), (9, "one  two three", "en", "s0", 0), (10, "one two", "en", "s0", 0)]
    rows += [(11, "ab " * 6000, "en", "s0", 0), (12, passage, "en", "s1", 0), (12, passage, "en", "s1", 0), (13, "É é x \x1f y", "fr", "s1", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    for c in ("digest", "row", "key", "h", "n", "cls", "token", "score", "kept", "topic", "tokens", "label", "first", "page"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
