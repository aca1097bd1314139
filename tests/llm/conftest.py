import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5):
    """A small corpus with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfgst") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def text(n):
        w = [rng.choice(vocabulary) for _ in range(n)]
        for i in range(9, n, 11):
            w[i] += "."
        return " ".join(w)

    passage, rows = text(60), []
    for i in range(60):
        rows.append((i, text(rng.randint(1, 160)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    for i in range(60, 75):  # exact copies, near copies, shared passages
        rows.append((i, rows[i - 60][1], "en", "a"))
    for i in range(75, 95):
        w = rows[i - 40][1].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w), "en", "b"))
    for i in range(95, 110):
        w = text(50).split(" ")
        rows.append((i, " ".join([*w[:20], passage, *w[20:]]) + "\n" + text(20), "de", "a"))
    rows += [(110, None, None, None), (111, "", "en", "a"), (112, " \t\n", "en", "b"), (113, "one two", "en", "b"), (114, "One TWO", "en", "b")]
    rows += [(115, text(9000), "en", "c"), (116, "x" * 5000, "en", "c"), (117, ("again and again we go on " * 40).strip(), "en", "a")]
    rows += [rows[3], rows[3], rows[100]]  # repeated rows
    rows += [(None, rows[7][1], "en", "a"), (None, text(40), "en", None), (None, None, None, None)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with what the operators add."""
    from pyspark.sql import functions as F

    own = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("size", "shard", "key", "removed", "n_words", "kept", "payload", "media", "blocks", "cls", "uid", "g"):
        own = own.withColumn(name, F.lit("clash"))
    return own.cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
