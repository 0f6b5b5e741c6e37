"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, node long, key long, member boolean, score double, `a.b` string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    near = [t + " x" for t in base[:8] if len(t) > 300] + [t.replace("e", "E") for t in base[8:14]]
    odd = [None, "", " ", "\n\n", "one", "two words", "É ñ ß 日本語 é" * 5, "a  b\n\n c\t\td   ", "<|endoftext|>x<|startoftext|> y<|ENDOFTEXT|>", "don't 'sx I'M 12345 3.14", "x" * 20_000, words(rng, 6000), "İstanbul K ſecret", "  　  z", "\x1c\x85 a"]
    return base + near + odd + base[:5] + [None, ""]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, None), (None, None, None, None, None), (7, "same id, other text", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(1, "A text", "en", "s", 6, 0, "d", 1, 2, True, 0.5, "q"), (2, "a TEXT", "en", "s", 6, 0, "d", 1, 2, False, 0.5, "q"), (3, "token = abcdefghijklmnop", None, None, None, None, None, None, None, None, None, None)], CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
