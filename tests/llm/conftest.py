from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "ba be bi bo bu da de di do du ga ge gi go gu la le li lo lu ma me mi mo mu".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows(seed=1):
    """Copies, near copies, shared passages, repeated lines, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), prose(rng, 9)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1] + " tail"]
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(4)]
    texts += [f"{line}\n{line}\n{prose(rng, 12)}\n{line}" for _ in range(3)]
    texts += [None, "", " \t\n ", "é" * 49, "é" * 50, "ab" * 400, "x", "no\nword\n\n" * 30, "Ünï cödé " * 40, prose(rng, 30_000), passage, "#*$%&|<>! " * 50, "A!! " * 60]
    rows = [(i, t, "en", ["b", "a", None, "ä"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id " * 12, "en", "a", 72)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The odd rows with further columns whose names operators use themselves."""
    plain = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return plain.withColumns({c: F.lit(1) for c in ("_doc", "_gone", "_n", "_row", "_chunks", "_epochs", "_part", "_text", "size", "key", "fp", "score", "x", "y", "to", "kind", "a", "block", "node", "a.b")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
